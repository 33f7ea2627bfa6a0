"""Near copies against all pairs in plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from volfuse.llm import components, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}


def variants(rng, base, n, most):
    """Texts that differ from ``base`` in up to ``most`` places, many of them near the limit of similarity."""
    for _ in range(n):
        own = list(base)
        for _ in range(rng.integers(0, most + 1)):
            own[rng.integers(len(own))] = f"z{rng.integers(10**6)}"
        yield " ".join(own)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    bases = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (3, 4, 5, 6, 30, 60, 120, 200)]
    texts = [t for b in bases for t in variants(rng, b, 25, max(1, len(b) // 25))]
    texts += [t.upper() for t in texts[::9]] + [None, "", " \n ", "a b", "A  b", "a b c"]
    order = rng.permutation(len(texts))
    rows = [(int(k), texts[i]) for k, i in enumerate(order)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n int, class_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_copies(docs).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute(rows).items()}


def test_members_that_no_centre_reaches(spark):
    """Variants of one base that are like the base alone share buckets but not their centre."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    rows = [(100, " ".join(base))]
    for k in range(40):
        own = list(base)
        for at in rng.choice(40, 6, replace=False) * 5 + 2:
            own[at] = f"z{k}-{at}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_copies(docs).collect()}
    assert got == brute(rows)


def test_signatures_lose_no_link(spark):
    """Pairs at the limit of similarity pass the bound, pairs far below it don't."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        n = int(rng.integers(3, 400))
        m = int(rng.integers(n, n + n // 8 + 1))
        common = int(rng.integers(0 if k % 3 else 3 * n // 4, n + 1))
        pool = rng.integers(0, 2**64 - 1, n + m - common, dtype=np.uint64)
        rows.append((k, pool[:n].tobytes(), pool[n - common :].tobytes(), n, m, common))
    sides = []
    for column, prefix in ((1, ""), (2, "c_")):
        sets = spark.createDataFrame([(r[0], r[column]) for r in rows], "id long, elements binary")
        signs = sets.mapInArrow(minhash._signed, "id bigint, " + ", ".join(f"{s} bigint" for s in minhash.SIGNATURE))
        sides.append(signs.toDF("id", *[prefix + s for s in minhash.SIGNATURE]))
    sizes = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "id long, n long, c_n long")
    kept = {r.id for r in sides[0].join(sides[1], "id").join(sizes, "id").where(minhash._may_be_similar(75)).collect()}
    linked = {r[0] for r in rows if 100 * r[5] >= 75 * (r[3] + r[4] - r[5])}
    far = {r[0] for r in rows if 100 * r[5] < 50 * (r[3] + r[4] - r[5])}
    assert linked <= kept and len(linked) > 10 and not far & kept


def test_a_large_group_of_near_copies(spark):
    """1,300 variants of one text, of similarities from 0.25 to 0.99, against all pairs."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    texts = list(variants(rng, base, 1300, 12))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_copies(docs).collect()}
    assert got == brute(list(enumerate(texts)))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_copies(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash.near_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 5, 300])
def test_sketch(size):
    rng = np.random.default_rng(size)
    t, hits = 64, []
    for _ in range(30):
        x = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        a, b = np.sort(x[: size + size // 2]), np.sort(x[size // 2 :])
        got = minhash.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, t)
        assert (got != np.uint64(2**64 - 1)).all()
        hits.append((got[0] == got[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
    assert abs(np.mean(hits)) < 0.05
    assert (minhash.sketches(np.zeros(0, int), np.zeros(0, np.uint64), 1, t) == np.uint64(2**64 - 1)).all()


def test_sets():
    owner, elements = minhash.shingle_sets(pa.array(["a b c d e a b c d e", None, "x", "X "]))
    assert np.bincount(owner, minlength=4).tolist() == [5, 0, 1, 1] and elements[-1] == elements[-2]


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(i, i + 1) for i in range(40, 100)] + [(0, i) for i in range(1, 20)] + [tuple(map(int, p)) for p in rng.integers(200, 260, (40, 2))]
    pairs += [(5, 5), (21, 20)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {k: v for k, v in group.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_a_round_of_components_takes_few_tasks(spark):
    """Every task leaves something in the driver, so rounds don't double them by unions and plans computed again."""
    context, path = spark.sparkContext, [(k, k + 1) for k in range(40)]
    links = components.stage(spark.createDataFrame(path, "a bigint, b bigint"), "path")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    context.setJobGroup("rounds", "rounds")
    try:
        found = components.components(links, "a", "b").collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(found) == [(k, 0) for k in range(41)]
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert tasks < 900
