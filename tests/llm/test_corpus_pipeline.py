"""The stages, one after the other, each against what its operator says of its own input."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from volfuse.llm import langid, minhash, packing, quality, suffix

SF = "/root/testdata/sf0.001"


def kept(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and read in between."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages(spark, stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "MinHash near-dedup", "suffix-array dedup", "packing"]
    first = stages[0][0]
    for docs, result in stages[:-1]:
        assert result.columns == docs.columns == first.columns and result.dtypes == first.dtypes
    docs, result = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept(result) == kept(quality.score(docs, quality.fit(docs, labels)).where("kept"))
    docs, result = stages[1]
    assert kept(result) == kept(langid.identify(docs, langid.fit(docs, F.lit(True))).where("accepted"))
    docs, result = stages[2]
    assert kept(result) == kept(minhash.near_copies(docs).where("kept"))
    docs, result = stages[3]
    assert sorted(tuple(r) for r in result.select("doc_id", "text").collect()) == sorted(
        tuple(r) for r in suffix.without_repeats(docs.select("doc_id", "text")).collect()
    )
    assert all(r.n_chars == len(r.text) for r in result.collect())


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    docs, result = stages[0]
    long = docs.join(labels, "doc_id", "left_semi").where(F.size(F.split("text", "[ \t-\r]+")) > 60)
    assert set(kept(long)) <= set(kept(result))
    assert stages[1][0].count() == stages[1][1].count()


def test_packed_ids(stages):
    docs, result = stages[-1]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    got = {k: [] for k in want}
    for r in result.orderBy("doc_id", "start").collect():
        assert r.start == len(got[r.doc_id])
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want and result.columns == [f.split()[0] for f in packing.SCHEMA.split(", ")]


def test_run_writes_between_stages(spark, monkeypatch):
    """Each stage is given the written table of the one before, not its plan."""
    given = []
    steps = [(str(k), lambda s, docs, d: given.append(docs.inputFiles()) or docs.limit(9)) for k in range(3)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    assert corpus_pipeline.run(spark, SF).count() == 9
    assert not any("/volfuse-llm/" in f for f in given[0]) and len(given) == 3
    assert all(files and all("/volfuse-llm/documents-" in f for f in files) for files in given[1:])


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "start").count() >= stages[-1][0].count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def odd_documents(spark):
    """Rows without ids, rows that share one, and columns with names that the stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"spans": F.lit(1), "kept": F.lit("k"), "h": F.lit(2)})
    some = docs.where("doc_id < 40")
    none = some.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))
    shared = some.where("doc_id = 10").withColumn("text", F.lit("too short to stay"))
    return some.unionByName(none).unionByName(shared).select("*", F.lit(3).alias("a.b"))


def test_rows_keep_their_own_verdict(spark):
    docs = odd_documents(spark)
    alone = {r.doc_id: r.kept for r in quality.score(docs.where("kept = 'k' and text != 'too short to stay'"), None).collect()}
    out = quality.accepted(docs, None)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert sum(r.doc_id is None for r in rows) == sum(alone[i] for i in range(4))
    assert all(r.text != "too short to stay" for r in rows) and sum(r.doc_id == 10 for r in rows) == alone[10]


@pytest.mark.parametrize("k", range(4))
def test_odd_rows_and_names(spark, k):
    docs = odd_documents(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and any(r.doc_id is None for r in rows)
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).collect() == []


def test_nothing_learned_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.accepted(docs, langid.fit(docs, F.lit(True))).count() == 1


def test_filters_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality.accepted(docs, None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
