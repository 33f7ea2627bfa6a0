"""The operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volfuse.llm import ann, bpe, chunked_bpe, langid, merkle, minhash, packing, quality, suffix, toxicity, url_filter, warc, whitening
from volfuse.llm.texts import read

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def fold() -> Column:
    """Rows where it is 0 are held out of everything that is learned."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def digests(coded: DataFrame) -> DataFrame:
    """Number of ids, and digests of the ids and of what they decode to."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by models of the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, fold() != 0)).withColumn("held_out", fold() == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a field of the labelled rows that aren't held out, and its toxic spans."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), fold() != 0))
    return scored.withColumns({"held_out": fold() == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    path = public_tokenizers.path(BYTE_RANKS)
    return digests(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of every page, after they were written and read again."""
    pages = read(spark, sf_dir, "pages")
    records = warc.archived(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of near copies of every document."""
    return minhash.near_copies(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur twice or more, in any document."""
    return suffix.passages(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies, with a checksum of its ids."""
    path = public_tokenizers.path(WORD_TOKENIZER)
    pieces = packing.pack(read(spark, sf_dir, "documents"), path, END_ID, CAPACITY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, from chunks that are encoded once, and the text they decode to, as digests."""
    path = public_tokenizers.path(BYTE_TOKENIZER)
    return digests(chunked_bpe.decode(chunked_bpe.encode(read(spark, sf_dir, "documents"), path), path))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight largest principal components, whitened."""
    return whitening.whitened(read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; every fifth is tampered with before it is checked."""
    return merkle.manifest(read(spark, sf_dir, "documents"), fold() == 0)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_toxicity, op3_byte_bpe, op4_url_filter, op5_warc, op6_minhash_near_dedup, op7_quality_rules,
        op8_suffix_dedup, op9_packing, op10_nearest, op11_chunked_bpe, op12_whitening, op13_merkle_manifest,
    )
    return {f.__name__: f for f in every}
