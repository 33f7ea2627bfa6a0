"""Repeated passages against all windows in plain Python."""

import random
import re
from collections import defaultdict

import pytest

from volfuse.llm import suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """Words that repeat an earlier window, and words of windows that are the first of several."""
    places = defaultdict(list)
    for k, text in rows:
        own = WORD.findall(text or "")
        for q in range(len(own) - least + 1):
            places[tuple(own[q : q + least])].append((k, q))
    first, again = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for k, (i, q) in enumerate(sorted(found)):
                (again if k else first)[i] |= set(range(q, q + least))
    return first, again


def check(spark, rows, least, seed, spread):
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, at int, h int").repartition(3)
    first, again = brute(rows, least)
    got_first, got = defaultdict(set), defaultdict(set)
    for r in suffix.passages(docs, least, seed, spread).collect():
        assert r.end_word - r.start_word >= least and r.first_doc_id <= r.doc_id
        (got if r.repeat else got_first)[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert got == again
    # The first of equal texts is one first passage as a whole.
    assert set(got_first) == set(first) and all(first[k] <= got_first[k] for k in first)
    return docs, again


def made(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    shared = [[rnd.choice(words) for _ in range(rnd.randint(8, 60))] for _ in range(6)]
    rows = []
    for i in range(90):
        own = []
        for _ in range(rnd.randint(0, 4)):
            own += [rnd.choice(words) for _ in range(rnd.randint(0, 12))] + (rnd.choice(shared) if rnd.random() < 0.6 else [])
        rows.append((i, " ".join(own) + rnd.choice(["", "\n", " "])))
    return rows + [(200 + i, rows[5][1]) for i in range(5)] + [(300, None), (301, ""), (302, "a " * 100), (303, "a " * 101)]


@pytest.mark.parametrize(("least", "seed", "spread"), [(20, 4, 6), (12, 3, 5), (9, 2, 1)])
def test_against_all_windows(spark, least, seed, spread):
    rows = made(least)
    docs, again = check(spark, rows, least, seed, spread)
    left = {r.doc_id: r.text for r in suffix.without_repeats(docs, least, seed, spread).collect()}
    for k, text in rows:
        own = [w for i, w in enumerate(WORD.findall(text or "")) if i not in again[k]]
        if again[k] and not own:
            assert k not in left
        else:
            assert WORD.findall(left[k] or "") == own
            assert again[k] or left[k] == text


def test_many_tasks(spark):
    """One passage that fills several tasks of the sorted table."""
    rows = [(i, f"x{i} " + "the same passage in all of them " * 3 + f"y{i}") for i in range(60)] + [(99, "nothing else")]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        check(spark, rows, 10, 3, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_default_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], suffix.LEAST, suffix.SEED, suffix.SPREAD)


def test_odd_tables(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "x " + text)], "doc_id long, text string")
    got = {r.doc_id for r in suffix.passages(docs).collect()}
    assert got == {1, 2}
    assert suffix.passages(docs.limit(0)).collect() == [] and suffix.without_repeats(docs.limit(0)).collect() == []
    left = suffix.without_repeats(docs).collect()
    assert (None, text) in [tuple(r) for r in left] and (2, "x ") in [tuple(r) for r in left]
