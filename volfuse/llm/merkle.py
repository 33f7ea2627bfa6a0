"""Merkle trees over documents: one tree a source, one over the sources' roots, and a checked proof for every row.

A leaf is the digest of a row's five fields. A leaf's place among its source's leaves is a rank query, so leaves
are never sorted: each task packs the ids it meets into bitmaps of 1,024 ids, compressed to lists where they hold
few, Spark merges them by source and chunk, and a directory of counts (of the words inside a bitmap, of the
chunks inside a node of 1,024 chunks, and so on) gives the number of rows before any id. Nodes are then reduced
by (source, place / 256): every group is an array of 256 slots, which yields two levels of 16 at once. The
siblings on the way up are kept by group, one list for 256 nodes, and handed down again; every row's proof and
its folded root are computed from its own digest and these lists.

No group has more than 1,024 members, whatever the share of a source, and nothing of the tree passes the driver.

Null fields are ``-``. Rows without a source form a tree of their own, which comes first; rows without an id come
first in their source, and their text is never changed. Rows that share a source and an id ascend by their leaf;
equal rows are separate leaves. An empty table gives an empty result. Columns other than ``doc_id``, ``source``,
``lang``, ``n_chars`` and ``text`` take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volfuse.llm.staging import stage

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RUN = 16
#: Two levels of a tree are reduced at once.
BLOCK = RUN * RUN
CHUNK_BITS = 10
#: Chunks with fewer ids are kept as a list: 64 of two bytes take the room of the bits.
FEW = 64
#: Chunks are numbered from 1; chunk 0, before all others, holds the rows without an id.
FIRST_CHUNK = (1 << (63 - CHUNK_BITS)) + 1


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(text: Column) -> Column:
    """The digest of a row with this text in place of its own."""
    parts = [F.col(f"`{c}`").cast("string") for c in FIELDS[:-1]] + [text.cast("string")]
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("-")) for p in sized]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """One row for each document: tree, id, place of the id in chunk and bitmap, leaf, and the leaf after tampering."""
    text = F.col("text").cast("string")
    changed = F.when(F.coalesce(tampered, F.lit(False)) & (lower_ascii(text) != text), leaf(lower_ascii(text)))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    id_ = F.col("doc_id").cast("long")
    return docs.select(
        tree.alias("tree"),
        id_.alias("doc_id"),
        F.coalesce(F.shiftright(id_, CHUNK_BITS) + F.lit(FIRST_CHUNK), F.lit(0)).alias("chunk"),
        F.coalesce(id_.bitwiseAND((1 << CHUNK_BITS) - 1), F.lit(0)).cast("int").alias("bit"),
        leaf(text).alias("leaf"),
        changed.alias("changed"),
    )


def packed(bits: np.ndarray, extra: np.ndarray) -> bytes:
    """A compressed bitmap of different ids in order, and how many rows beyond one each has."""
    if extra.any():
        return b"x" + bits.astype("<u2").tobytes() + extra.astype("<i8").tobytes()
    if len(bits) < FEW:
        return b"l" + bits.astype("<u2").tobytes()
    flags = np.zeros(1 << CHUNK_BITS, bool)
    flags[bits] = True
    return b"b" + np.packbits(flags, bitorder="little").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind, body = data[:1], data[1:]
    if kind == b"b":
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
        return bits, np.zeros(len(bits), np.int64)
    if kind == b"l":
        bits = np.frombuffer(body, "<u2").astype(np.int64)
        return bits, np.zeros(len(bits), np.int64)
    n = len(body) // 10
    return np.frombuffer(body[: 2 * n], "<u2").astype(np.int64), np.frombuffer(body[2 * n :], "<i8").astype(np.int64)


def counted(bits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids in order, and the rows beyond one."""
    total = np.bincount(bits, rows, 1 << CHUNK_BITS).astype(np.int64)
    own = np.flatnonzero(total)
    return own, total[own] - 1


def _partial_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one task knows of each chunk, batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").dictionary_encode()
        chunk, bit = batch.column("chunk").to_numpy(), batch.column("bit").to_numpy()
        number = tree.indices.to_numpy()
        order = np.lexsort((chunk, number))
        new = np.flatnonzero((np.diff(chunk[order]) != 0) | (np.diff(number[order]) != 0)) + 1
        groups = np.split(order, new)
        bitmaps = [packed(*counted(bit[g], np.ones(len(g)))) for g in groups]
        first = pa.array([g[0] for g in groups])
        columns = [batch.column("tree").take(first), batch.column("chunk").take(first), pa.array(bitmaps, pa.binary())]
        yield pa.record_batch(columns, ["tree", "chunk", "bitmap"])


def _merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial bitmaps of a chunk as one, and the number of its rows."""
    for batch in batches:
        merged, total = [], []
        for parts in batch.column("parts"):
            pairs = [unpacked(p.as_py()) for p in parts.values]
            bits, extra = counted(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] + 1 for p in pairs]))
            merged.append(packed(bits, extra))
            total.append(int(len(bits) + extra.sum()))
        columns = [batch.column("tree"), batch.column("chunk"), pa.array(merged, pa.binary()), pa.array(total, pa.int64())]
        yield pa.record_batch(columns, ["tree", "chunk", "bitmap", "n"])


def bitmaps(rows: DataFrame) -> DataFrame:
    """The merged bitmap of every tree's chunks, with the number of its rows."""
    schema = "tree string, chunk bigint, bitmap binary"
    parts = rows.select("tree", "chunk", "bit").mapInArrow(_partial_bitmaps, schema)
    return parts.groupBy("tree", "chunk").agg(F.collect_list("bitmap").alias("parts")).mapInArrow(_merge_bitmaps, schema + ", n bigint")


def directory(chunks: DataFrame) -> DataFrame:
    """Adds to every chunk the rows of its tree before it, and all rows of the tree.

    Counts climb from node to node, 1,024 children each, until a tree has one node; then the sums go down again.
    """
    levels = [chunks.select("tree", F.col("chunk").alias("node"), "n")]
    while not levels[-1].groupBy("tree").count().where("count > 1").isEmpty():
        up = levels[-1].groupBy("tree", F.shiftright("node", CHUNK_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(stage(up, "counts"))
    before = levels[-1].select("tree", "node", F.col("n").alias("total"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels[:-1]):
        up = F.shiftright("node", CHUNK_BITS)
        earlier = Window.partitionBy("tree", up).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        inside = level.select("tree", "node", up.alias("up"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inside"))
        parent = before.withColumnRenamed("node", "up")
        before = inside.join(parent, ["tree", "up"]).select("tree", "node", "total", (F.col("before") + F.col("inside")).alias("before"))
    return chunks.join(before.withColumnRenamed("node", "chunk"), ["tree", "chunk"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank queries: the place of the first row with an id, and the rows that share it."""
    for batch in batches:
        place, shared = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, np.int64)
        column = batch.column("bitmap").dictionary_encode()
        number, bit = column.indices.to_numpy(), batch.column("bit").to_numpy()
        for k, data in enumerate(column.dictionary.to_pylist()):
            bits, extra = unpacked(data)
            rows = np.zeros(1 << CHUNK_BITS, np.int64)
            rows[bits] = extra + 1
            mine = np.flatnonzero(number == k)
            place[mine] = (np.cumsum(rows) - rows)[bit[mine]]
            shared[mine] = rows[bit[mine]]
        place += batch.column("before").to_numpy()
        names = ["tree", "doc_id", "leaf", "changed", "total"]
        yield pa.record_batch([*map(batch.column, names), pa.array(place), pa.array(shared)], [*names, "place", "shared"])


def ordinals(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``ordinal``, from 0, in order of the keys: ranges of rows are numbered apart, then moved by the
    number of rows in the ranges before."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = stage(ranged, "ranges").withColumn("range", F.shiftright("at", 33))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    first = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return ranged.join(first, "range").withColumn("ordinal", F.col("first") + inside).drop("range", "at", "first")


def placed(rows: DataFrame) -> DataFrame:
    """Every leaf with its place in its tree and the size of the tree."""
    chunks = stage(directory(stage(bitmaps(rows), "bitmaps")), "directory")
    schema = "tree string, doc_id bigint, leaf string, changed string, total bigint, place bigint, shared bigint"
    asked = rows.join(chunks.drop("n"), ["tree", "chunk"])
    found = stage(asked.select("tree", "doc_id", "bit", "leaf", "changed", "total", "bitmap", "before").mapInArrow(_ranked, schema), "places")
    single = found.where("shared = 1").drop("shared")
    if found.where("shared > 1").isEmpty():
        return single
    # Rows that share an id ascend by leaf.
    several = stage(ordinals(found.where("shared > 1"), "tree", "place", "leaf"), "shared")
    first = several.groupBy("tree", "place").agg(F.min("ordinal").alias("first"))
    several = several.join(first, ["tree", "place"]).withColumn("place", F.col("place") + F.col("ordinal") - F.col("first"))
    return single.unionByName(several.select(single.columns))


SEGMENT = "array<struct<left:string,right:string>>"


def siblings(nodes: list[str], total: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of a group of up to 256 nodes of a tree whose level has ``total``, and for every node what stands
    to the left and right of it, level by level."""
    if total <= 1:
        return nodes[0], [[] for _ in nodes]
    sides: list[list[tuple[str, str]]] = []
    tops = []
    for a in range(0, len(nodes), RUN):
        run = nodes[a : a + RUN]
        tops.append(digest("".join(run)))
        sides += [[("".join(run[:i]), "".join(run[i + 1 :]))] for i in range(len(run))]
    if total <= RUN:
        return tops[0], sides
    upper = [("".join(tops[:i]), "".join(tops[i + 1 :])) for i in range(len(tops))]
    for k, own in enumerate(sides):
        own.append(upper[k // RUN])
    return digest("".join(tops)), sides


def _slots(batch: pa.RecordBatch) -> Iterator[tuple[int, list[dict]]]:
    """The members of each group, slot by slot."""
    for k, members in enumerate(batch.column("members")):
        slots: list = [None] * len(members)
        for m in members.as_py():
            slots[m["slot"]] = m
        yield k, slots


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each group."""
    for batch in batches:
        total = batch.column("total").to_pylist()
        tops = [siblings([m["leaf"] for m in slots], total[k])[0] for k, slots in _slots(batch)]
        above = pa.array([-(-n // BLOCK) for n in total], pa.int64())
        yield pa.record_batch([batch.column("tree"), batch.column("block"), above, pa.array(tops, pa.string())], ["tree", "place", "total", "leaf"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every member of each group what stands beside it on the way to the root of its tree."""
    for batch in batches:
        total = batch.column("total").to_pylist()
        for k, slots in _slots(batch):
            _, sides = siblings([m["leaf"] for m in slots], total[k])
            above = [(s["left"], s["right"]) for s in batch.column("path")[k].as_py()]
            block = batch.column("block")[k].as_py() * BLOCK
            n = len(slots)
            columns = [
                pa.array([batch.column("tree")[k].as_py()] * n, pa.string()),
                pa.array([block + i for i in range(n)], pa.int64()),
                pa.array([[{"left": a, "right": b} for a, b in [*own, *above]] for own in sides], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                pa.array([batch.column("top")[k].as_py()] * n, pa.string()),
            ]
            yield pa.record_batch(columns, ["tree", "place", "path", "top"])


def blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes of one level as arrays of slots by tree and place / 256."""
    slot = F.pmod("place", F.lit(BLOCK)).cast("int").alias("slot")
    block = F.shiftright("place", BLOCK.bit_length() - 1).alias("block")
    return nodes.groupBy("tree", block).agg(F.first("total").alias("total"), F.collect_list(F.struct(slot, "leaf", *more)).alias("members"))


def paths(nodes: DataFrame) -> DataFrame:
    """For every node (tree, place, total, leaf) the siblings on its way up and the root of its tree."""
    alone = nodes.where("total <= 1").select("tree", "place", F.array().cast(SEGMENT).alias("path"), F.col("leaf").alias("top"))
    many = nodes.where("total > 1")
    if many.isEmpty():
        return alone
    groups = stage(blocks(many), "slots")
    up = paths(stage(groups.mapInArrow(_tops, "tree string, place bigint, total bigint, leaf string"), "nodes"))
    joined = groups.join(up.withColumnRenamed("place", "block"), ["tree", "block"])
    below = joined.mapInArrow(_handed_down, f"tree string, place bigint, path {SEGMENT}, top string")
    return stage(alone.unionByName(below), "paths")


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and folded root of every leaf of each group."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    for batch in batches:
        total = batch.column("total").to_pylist()
        for k, slots in _slots(batch):
            _, sides = siblings([m["leaf"] for m in slots], total[k])
            above = [(s["left"], s["right"]) for s in batch.column("path")[k].as_py()]
            shared = "".join(a + b for a, b in above)
            proof = [digest("".join(a + b for a, b in own) + shared) for own in sides]
            fold = [folded(m["changed"] or m["leaf"], [*own, *above]) for m, own in zip(slots, sides, strict=True)]
            n = len(slots)
            columns = [[m["doc_id"] for m in slots], [m["leaf"] for m in slots], [batch.column("subroot")[k].as_py()] * n,
                       [batch.column("root")[k].as_py()] * n, proof, fold]
            kinds = [pa.int64()] + [pa.string()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Per document: id, leaf, subroot, root, the digest of its proof, the root that its possibly tampered text folds
    to with the original siblings, and whether that is the root."""
    nodes = placed(stage(leaves(docs, tampered), "leaves"))
    groups = stage(blocks(nodes, "doc_id", "changed"), "leaf-slots")
    up = paths(stage(groups.mapInArrow(_tops, "tree string, place bigint, total bigint, leaf string"), "nodes"))
    sub = stage(up.where("place = 0").select("tree", F.col("top").alias("leaf")), "subroots")
    order = stage(ordinals(sub, "tree"), "trees").withColumnRenamed("ordinal", "place")
    over = paths(order.select(F.lit("").alias("tree"), "place", F.lit(order.count()).alias("total"), "leaf"))
    over = order.select("tree", "place").join(over.select("place", F.col("path").alias("over"), F.col("top").alias("root")), "place")
    way = up.join(over.drop("place"), "tree").select("tree", F.col("place").alias("block"), F.concat("path", "over").alias("path"), F.col("top").alias("subroot"), "root")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proved = groups.join(way, ["tree", "block"]).mapInArrow(_proved, schema)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
