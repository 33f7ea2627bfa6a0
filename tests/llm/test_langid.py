"""The language models: probabilities, held-out accuracy, rejection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volfuse.llm import langid, queries
from volfuse.llm.texts import share

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), queries.fold() != 0)


def grams_of(words, lang):
    """Counts of the highest order's n-grams of words, symbol first, by plain loops."""
    out = {}
    for word in words:
        codes = [*map(ord, word), 0]
        for i, c in enumerate(codes):
            gram = (c, *(codes[i - j] if j <= i else 0 for j in range(1, langid.ORDER)))
            out[gram] = out.get(gram, 0) + 1
    return [(lang, *gram, n) for gram, n in out.items()]


def recursion(rows, rare):
    """Interpolated Kneser-Ney as it is written down: a function of a symbol and the ones before it, without tables."""
    tokens = sum(r[-1] for r in rows)
    value = {langid.ORDER: {r[1:-1]: r[-1] for r in rows}}
    often = {langid.ORDER: {g: n for g, n in value[langid.ORDER].items()}}
    for n in range(langid.ORDER - 1, 0, -1):
        value[n], often[n] = {}, {}
        for g in value[n + 1]:
            value[n][g[:n]] = value[n].get(g[:n], 0) + 1
            often[n][g[:n]] = often[n].get(g[:n], 0) + often[n + 1][g]

    def p(gram, alphabet):
        n = len(gram)
        if n == 0:
            return 1 / alphabet
        once, twice = (sum(v == k for v in value[n].values()) for k in (1, 2))
        d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        same = {g: v for g, v in value[n].items() if g[1:] == gram[1:]}
        listed = {g: (v - d) / sum(same.values()) for g, v in same.items() if often[n][g] >= rare * tokens}
        return listed.get(gram, 0.0) + (1 - sum(listed.values())) * p(gram[:-1], alphabet)

    return p


@pytest.mark.parametrize("rare", [0.0, 4e-6, 0.004, 0.2])
def test_probabilities_are_those_of_the_plain_recursion(spark, rare):
    """Two languages that share n-grams; with a high ``rare`` most are not listed, and probabilities still add up."""
    rng = np.random.default_rng(4)
    words = {k: ["".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(60)] for k, letters in (("x", "aab"), ("y", "abcd"))}
    rows = {k: grams_of(v, k) for k, v in words.items()}
    names = ", ".join(f"c{j} int" for j in range(langid.ORDER))
    fitted = langid.learned(spark.createDataFrame([*rows["x"], *rows["y"]], f"lang string, {names}, n long").repartition(3), rare)
    symbols = sorted({r[1] for v in rows.values() for r in v})
    alphabet = len(symbols) + 1
    contexts = {r[2:-1] for v in rows.values() for r in v[:25]} | {(9, 9, 9, 9), (ord("a"), 9, 0, 0), (0, 0, 0, 0)}
    for k, lang in enumerate(["x", "y"]):
        p = recursion(rows[lang], rare)
        for ctx in contexts:
            grams = [(c, *ctx) for c in [*symbols, 77]]
            got = np.exp(fitted.log_probability([np.array(part) for part in zip(*grams, strict=True)])[:, k].astype(float))
            assert got == pytest.approx([p(g, alphabet) for g in grams], rel=1e-4)
            assert got.sum() == pytest.approx(1, abs=1e-5)


def test_what_is_listed_depends_on_shares_alone(spark):
    """The same texts many times over give the same n-grams."""
    rows = grams_of(["the", "then", "than", "of", "often"] * 3 + ["xylem"], "a")
    names = ", ".join(f"c{j} int" for j in range(langid.ORDER))
    small, large = (
        langid.learned(spark.createDataFrame([(*r[:-1], r[-1] * times) for r in rows], f"lang string, {names}, n long"), 0.03) for times in (1, 1000)
    )
    for a, b in zip(small.grams, large.grams, strict=True):
        assert a.keys.tolist() == b.keys.tolist() and len(a.keys)
    assert 0 < len(small.grams[-1].keys) < len(rows)


def test_table_finds_all_and_nothing_else():
    keys = np.unique(langid.mix(np.arange(3000, dtype=np.uint64)))
    table = langid.Table.of(keys, np.arange(len(keys)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(langid.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


def test_held_out(spark):
    rows = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(held) < 300
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.999 * len(rows)


def test_odd_rows(spark, model):
    noise = "".join(np.random.default_rng(1).choice(list("qxzjkvwq "), 4000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !!", "a"), (4, noise, "a"), (5, "der und die " * 50_000, "a"), (None, "le la les", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and not any(out[k].accepted or out[k].score for k in (1, 2, 3))
    assert not out[4].accepted and out[5].lang_pred == "de" and out[None].lang_pred == "fr"
    assert langid.identify(docs.limit(0), model).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs, F.lit(True)) is None
    assert langid.fit(docs.limit(0), F.lit(True)) is None


def test_steps_do_not_change_entropies(model):
    import pyarrow as pa

    column = pa.array(["un deux trois quatre " * 40, None, "the one of them"])
    a, b = model.entropies(column)[0], model.entropies(column, step=7)[0]
    assert np.allclose(a, b)


def test_rejects_noise_and_a_language_left_out(spark):
    """On a table that has long odd texts among those left aside."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    fitted = langid.fit(docs, (queries.fold() != 0) & (F.col("lang") != "de"))
    rng = np.random.default_rng(3)
    noise = [(k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), size))) for size in (50, 100, 300) for k in range(20)]
    assert not any(r.accepted for r in langid.identify(spark.createDataFrame(noise, "doc_id long, text string"), fitted).collect())
    rows = langid.identify(docs.where((queries.fold() == 0) & (F.length("text") > 300)), fitted).join(docs.select("doc_id", "lang"), "doc_id").collect()
    odd, known = ([r.accepted for r in rows if (r.lang == "de") == left_out] for left_out in (True, False))
    assert len(odd) > 100 and np.mean(odd) < 0.05 and np.mean(known) >= 0.998


def test_odd_texts_do_not_set_the_limits(spark, model):
    """One mislabelled text and one of noise, both long, among the texts left aside."""
    held = spark.read.parquet(f"{SF}/documents.parquet").where(queries.fold() == 0).select("lang", "text")
    noise = "".join(np.random.default_rng(2).choice(list("qxzjkvwq "), 20_000))
    odd = spark.createDataFrame([("es", "der und die den das nicht " * 2000), ("fr", noise)], "lang string, text string")
    clean, mixed = langid.calibrated(model, held), langid.calibrated(model, held.union(odd))
    assert np.allclose(clean.limits, mixed.limits, rtol=0.02) and np.allclose(clean.spread, mixed.spread, rtol=0.25)
    assert (mixed.spread < 10).all()


def test_all_rows_are_counted(spark):
    """A language of a few long texts is learned however much there is of the others, and n-grams are counted exactly."""
    words = ["tak", "nie", "czy", "jest", "dla", "przez", "oraz"]
    ids = spark.range(10_000, 11_000).where((share(F.col("id"), 7) > 0.9) & (share(F.col("id"), 8) > 0.2)).limit(3).collect()
    long = [(r.id, " ".join(np.random.default_rng(r.id).choice(words, 150_000)), "pl") for r in ids]
    other = [(k, "the one of them and this is that " * 3, "en") for k in range(200)]
    docs = spark.createDataFrame([*long, *other, (20_000, "hei sitten kanssa", "fi"), (20_001, "42", "fi"), (20_002, "1 2", "xx")], "doc_id long, text string, lang string")
    fitted = langid.fit(docs.repartition(3), F.lit(True))
    assert fitted.languages == ["en", "fi", "pl"]
    texts = spark.createDataFrame([(1, "czy to jest dla nie oraz tak przez"), (2, "this is the one"), (3, "hei kanssa")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(texts, fitted).collect()} == {1: "pl", 2: "en", 3: "fi"}


def test_counts_are_those_of_all_symbols(spark):
    import pyarrow as pa

    batches = [pa.record_batch([["en", "de", "en"], ["The then, the", "the", t]], ["lang", "text"]) for t in ("", "a1b then", None)]
    want = {}
    for batch in batches:
        for lang, text in zip(*batch.to_pydict().values(), strict=True):
            codes, _, age = langid.symbols(pa.array([text], pa.string()))
            for gram in zip(*(p.tolist() for p in langid.history(codes, age, langid.ORDER)), strict=True):
                want[lang, *gram] = want.get((lang, *gram), 0) + 1
    for most in (1 << 19, 2):
        got = {}
        for out in langid._counts(iter(batches), most):
            for *gram, n in zip(*out.to_pydict().values(), strict=True):
                got[tuple(gram)] = got.get(tuple(gram), 0) + n
        assert got == want


def test_all_rows_are_counted_and_calibrate(spark, monkeypatch):
    """No row is left out of the models, none out of the limits, and no text is judged by models that have counted it."""
    import pyarrow as pa

    rows = [(k, f"the one of them and this is word{'abcdefghij'[k % 10]} " * 2, "en") for k in range(300)]
    rows += [(1000 + k, "der und die den das nicht mit einem " * 2, "de") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    calls, learned, calibrated = {}, langid.learned, langid.calibrated
    monkeypatch.setattr(langid, "learned", lambda counts, rare: learned(calls.setdefault("counts", counts), rare))
    monkeypatch.setattr(langid, "calibrated", lambda model, held, *judges: calibrated(model, calls.setdefault("held", held), *calls.setdefault("judges", judges)))
    fitted = langid.fit(docs, F.lit(True))
    assert fitted.languages == ["de", "en"] and np.isfinite(fitted.limits).all()
    assert calls["held"].count() == len(rows)
    symbols = {lang: sum(len(langid.symbols(pa.array([r[1]]))[0]) for r in rows if r[2] == lang) for lang in ("de", "en")}
    counted = dict(calls["counts"].groupBy("lang").agg(F.sum("n")).collect())
    assert {lang: counted[langid.ALL + lang] for lang in symbols} == symbols
    held = calls["held"].groupBy("half", "lang").count().collect()
    a, b = langid.HALVES
    assert {r.half for r in held} == {a, b} and all(counted[half + lang] + counted[other + lang] == symbols[lang] for half, other in ((a, b),) for lang in symbols)
    plain = learned(calls["counts"].where(F.col("lang").startswith(b)), 4e-6)
    parts = [np.array([ord("e"), ord("x")]), np.array([ord("h"), ord("t")]), np.array([ord("t"), 0]), np.array([0, 0]), np.array([0, 0])]
    assert calls["judges"][0][a].log_probability(parts) == pytest.approx(plain.log_probability(parts), abs=0.05)


def test_entropies_are_sums_over_all_symbols(model):
    """Repeated words, looked up once, count as often as they occur."""
    import pyarrow as pa

    column = pa.array(["the the the und, The 1 le", "", None, "12", "les les x"])
    codes, at, age = langid.symbols(column)
    log_p = model.log_probability(langid.history(codes, age, langid.ORDER)).astype(float)
    h, n = model.entropies(column)
    assert n.tolist() == np.diff(at).tolist()
    for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
        assert h[k] == pytest.approx(-log_p[i:j].sum(axis=0) / max(1, j - i))
