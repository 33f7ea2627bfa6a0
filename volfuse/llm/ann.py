"""Nearest neighbours by inner product with a hash-prefix forest.

Vectors are searched in blocks of a bounded size. A block has a forest: for every tree, each vector has a
string of 32 bits, the signs of random projections (of the vector scaled by the block's largest norm, with one
more component that makes all lengths equal, so that a small angle is a large inner product), and the tree is
the sorted array of these strings. A query descends in every tree to the longest prefix that strings share
with its own; all trees then ascend together, one bit at a time, until ``candidates`` different vectors of the
block share a prefix with it in some tree. These are scored exactly, in double precision. Every block of
queries meets every block of vectors once, and the best of all blocks are merged.

Equal vectors are one entry with their ``k + 1`` smallest ids: ties go to smaller ids, so no other can be in a
result. The same parameters hold at every size; tables smaller than ``candidates`` are searched exactly.

Null vectors, zero vectors and those with null or non-finite components take no part; neither do rows without
an id, and vectors meet only those of as many components. Rows that share id and vector are one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volfuse.llm.staging import stage

BITS = 32
RESULT = "q bigint, vec_id bigint, score double"


class Forest:
    """Sorted arrays of hash strings over one block of vectors."""

    def __init__(self, x: np.ndarray, trees: int, seed: int = 1):
        self.x, self.trees = x, trees
        norm = np.linalg.norm(x, axis=1)
        top = norm.max()
        scaled = np.column_stack([x / top, np.sqrt(np.maximum(0.0, 1 - (norm / top) ** 2))])
        self.planes = np.random.default_rng((seed, x.shape[1])).standard_normal((trees, x.shape[1] + 1, BITS))
        self.order, self.strings = [], []
        for t in range(trees):
            code = self.code(scaled, t)
            order = np.argsort(code, kind="stable")
            self.order.append(order)
            self.strings.append(code[order])

    def code(self, x: np.ndarray, tree: int) -> np.ndarray:
        signs = x @ self.planes[tree] > 0
        return np.packbits(signs, axis=1, bitorder="big").view(">u4").ravel().astype(np.uint32)

    def ranges(self, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share ``bits`` leading bits with each query's begin and end, by tree and query."""
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        rest = np.uint32((1 << (BITS - bits)) - 1)
        for t in range(self.trees):
            low[t] = np.searchsorted(self.strings[t], codes[t] & ~rest, "left")
            high[t] = np.searchsorted(self.strings[t], codes[t] | rest, "right")
        return low, high

    def search(self, q: np.ndarray, candidates: int):
        """For each query, the places of at least ``candidates`` vectors, or of all."""
        unit = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
        codes = np.stack([self.code(unit, t) for t in range(self.trees)])
        wanted, open_ = min(candidates, len(self.x)), np.arange(len(q))
        # From the level at which a random string has a neighbour in its tree; deeper ones hold too few for any.
        bits = min(BITS, max(0, int(math.log2(len(self.x))) + 1))
        found = np.zeros(len(self.x), bool)
        while len(open_):
            low, high = self.ranges(codes[:, open_], bits)
            enough = (high - low).sum(axis=0) >= wanted
            left = []
            for i in range(len(open_)):
                if not enough[i] and bits:
                    left.append(open_[i])
                    continue
                found[:] = False
                for t in range(self.trees):
                    found[self.order[t][low[t, i] : high[t, i]]] = True
                places = np.flatnonzero(found)
                if len(places) >= wanted or not bits:
                    yield int(open_[i]), places
                else:
                    left.append(open_[i])
            open_, bits = np.array(left, np.int64), bits - 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy().astype(float)
    return flat.reshape(len(column), -1)


def _cell(trees: int, candidates: int, k: int):
    """The best ``k`` ids of one block of vectors for one block of queries."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows_q, rows_id, rows_score = [], [], []
        if queries.num_rows and vectors.num_rows:
            # Vectors in order of their smallest id: among equal scores the first is the one to take.
            vectors = vectors.sort_by("class_id")
            x, q = _matrix(vectors.column("embedding")), _matrix(queries.column("embedding"))
            names, ids = queries.column("class_id").to_numpy(), vectors.column("ids").to_pylist()
            for i, places in Forest(x, trees).search(q, candidates):
                score = (x[places] * q[i]).sum(axis=1)
                best = np.argsort(-score, kind="stable")[:k]
                rows = sorted((-score[b], v) for b in best.tolist() for v in ids[places[b]])[:k]
                rows_q += [names[i]] * len(rows)
                rows_id += [v for _, v in rows]
                rows_score += [-s for s, _ in rows]
        columns = [pa.array(rows_q, pa.int64()), pa.array(rows_id, pa.int64()), pa.array(rows_score, pa.float64())]
        return pa.table(columns, ["q", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def classes(rows: DataFrame, most: int) -> DataFrame:
    """One row for each different vector, with its ``most`` smallest ids."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    out = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return out.select(F.col("ids")[0].alias("class_id"), "ids", "embedding", F.size("embedding").alias("dim"))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 128, candidates: int = 3000, block: int = 8192, queries_block: int = 4096
) -> DataFrame:
    """The ``k`` nearest others of every row where ``is_query`` holds: query_id, rank, vec_id, score."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding").distinct()
    index = stage(classes(rows, k + 1), "vectors")
    asked = rows.where(is_query).join(index.select("embedding", "class_id"), "embedding").select(F.col("vec_id").alias("query_id"), "class_id")
    asked = stage(asked, "asked")
    heads = stage(asked.select("class_id").distinct().join(index.drop("ids"), "class_id"), "heads")
    parts = max(1, math.ceil(index.count() / block))
    groups = max(1, math.ceil(heads.count() / queries_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part, group = F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(groups)).cast("int")
    left = heads.select("class_id", "embedding", "dim", group.alias("g"), every(parts).alias("p")).groupBy("dim", "g", "p")
    right = index.select("class_id", "ids", "embedding", "dim", part.alias("p"), every(groups).alias("g")).groupBy("dim", "g", "p")
    found = left.cogroup(right).applyInArrow(_cell(trees, candidates, k + 1), RESULT)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    own = asked.join(stage(lists, "lists"), asked["class_id"] == F.col("q"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("n", "f"))
    return out.select("query_id", (F.col("n") + 1).alias("rank"), "f.vec_id", (-F.col("f.s")).alias("score"))
