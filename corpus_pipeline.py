"""Documents to packed training sequences: quality, language, near copies, repeated passages, packing.

The first two stages judge every row for itself. Rows without an id have no near copies and no repeated passages and
stay; rows that share an id are one document to the third stage and share its verdict. Columns other than ``doc_id``,
``text`` and ``lang`` pass through, whatever their names; ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volfuse.llm import langid, minhash, packing, quality, queries, suffix
from volfuse.llm.staging import stage as written
from volfuse.llm.texts import read

#: Fitted models and connected components have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_copies(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = queries.public_tokenizers.path(queries.WORD_TOKENIZER)
    return packing.pack(docs, path, queries.END_ID, queries.CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents that every stage keeps; what a stage keeps is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
