"""Near copies by fast similarity sketches, banding and exact verification.

A text is lower-cased (A to Z) and cut into words; its set holds the hashes of its different shingles of
five words, of the whole sequence if it has fewer. A sketch of t coordinates is filled in rounds: in the
first t rounds every element falls at random into one of the t bins, in round t + i into bin i, and each bin
keeps the smallest value, where a value of an earlier round is always smaller. So every coordinate is filled,
two sketches agree in a coordinate with the probability that is the similarity of the sets, and the number of
agreeing ones is concentrated around its mean; mostly one round is enough.

Equal sets are one class, represented by the smallest id. Representatives that agree in a whole band of
coordinates are candidates; with 32 bands of 4, a pair of similarity 0.75 is missed in 5 of a million cases.
A bucket's members are compared with a centre, not with each other: with the one that meets most others in its
buckets. Members of buckets that still hold several components get new, exact buckets by their rarest shingles,
in which members of the smallest components are the centres, 16 times as many each round, until no bucket holds
members of several components that no centre was compared with. The rounds end as each makes centres of some
members. Pairs leave the join only if their sizes and, in the exact buckets, their signatures allow the similarity:
an element whose bit the other signature lacks is not in the other set, so the number of such bits bounds what two
sets share. Hardly any pair without a link is left to be verified on the full sets.

Null texts and texts without words have an empty set and no links. Rows without an id are dropped; rows that
share an id are one document with the links of all of them, and each gives a row of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volfuse.llm.components import components
from volfuse.llm.staging import is_empty, stage
from volfuse.llm.texts import LOWER, U64, hash_spans, mix, pieces, text_bytes, windows, words

#: Words of a signature of 1,024 bits.
SIGNATURE = [f"s{k}" for k in range(16)]
_ROUND, _VALUE = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the different shingles of each text, in order."""
    raw, at = text_bytes(column)
    raw = LOWER[raw]
    first, last, text = words(raw, at)
    hashes = hash_spans(raw, first, last)
    shingle, place = windows(hashes, text, size)
    owner = text[place]
    count = np.bincount(text, minlength=len(column))
    for n in range(1, size):
        some = (count == n)[text]
        if some.any():
            whole, place = windows(hashes[some], text[some], n)
            shingle, owner = np.concatenate([shingle, mix(whole + U64(n))]), np.concatenate([owner, text[some][place]])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def sketches(owner: np.ndarray, elements: np.ndarray, texts: int, t: int) -> np.ndarray:
    """The sketches of sets given as (owner, element); rows of owners without elements are all ones."""
    top = U64(2**64 - 1)
    out = np.full(texts * t, top, U64)
    for i in range(2 * t):
        if not len(owner):
            break
        h = mix(elements + U64((i + 1) * int(_ROUND) % 2**64))
        if i < t:
            bins = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64)
        else:
            bins = np.full(len(h), i - t)
        # The round is the leading byte, or two, of the value.
        value = (mix(h ^ _VALUE) >> U64(16)) | (U64(i) << U64(48))
        np.minimum.at(out, owner * t + bins, value)
        open_ = (out.reshape(texts, t) == top).any(axis=1)[owner]
        owner, elements = owner[open_], elements[open_]
    return out.reshape(texts, t)


def _sketched(bands: int, rows: int, size: int):
    """Batches of sketched documents: two sums over the set identify it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                owner, elements = shingle_sets(part.column("text"), size)
                count = np.bincount(owner, minlength=n)
                start = np.minimum(np.searchsorted(owner, np.arange(n)), max(0, len(owner) - 1))
                sums = []
                for salt in (1, 2):
                    part_sums = np.zeros(n, U64)
                    if len(owner):
                        part_sums = np.add.reduceat(mix(elements * U64(2 * salt + 1) + U64(salt)), start)
                    sums.append(np.where(count > 0, part_sums, U64(0)).view(np.int64))
                coordinates = sketches(owner, elements, n, bands * rows).reshape(n, bands, rows)
                key = np.zeros((n, bands), U64)
                for r in range(rows):
                    key = mix(key * U64(3) + coordinates[:, :, r])
                key = mix(key + np.arange(bands, dtype=U64) * _ROUND)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
                columns = [part.column("doc_id"), pa.array(count, pa.int64()), *map(pa.array, sums), lists]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _sets(size: int):
    """Batches of documents' sets, as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                owner, elements = shingle_sets(part.column("text"), size)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
                data = [elements[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.record_batch([part.column("doc_id"), pa.array(data, pa.binary())], ["id", "elements"])

    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sets as one row for each element."""
    for batch in batches:
        for part in pieces(batch, "elements"):
            raw, at = text_bytes(part.column("elements"))
            owner = np.repeat(part.column("id").to_numpy(), np.diff(at) // 8)
            yield pa.record_batch([pa.array(owner), pa.array(np.frombuffer(raw.tobytes(), np.int64))], ["id", "h"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sets as signatures: each element sets the bit that its hash names."""
    for batch in batches:
        for part in pieces(batch, "elements"):
            raw, at = text_bytes(part.column("elements"))
            h = np.frombuffer(raw.tobytes(), U64)
            owner = np.repeat(np.arange(part.num_rows), np.diff(at) // 8)
            bits = np.zeros((part.num_rows, len(SIGNATURE)), U64)
            np.bitwise_or.at(bits, (owner, (h >> U64(60)).astype(np.int64)), U64(1) << (h >> U64(54) & U64(63)))
            yield pa.record_batch([part.column("id"), *map(pa.array, bits.view(np.int64).T)], ["id", *SIGNATURE])


def _may_be_similar(percent: int) -> Column:
    """False only for pairs that share too few elements, by their sizes and signatures."""
    lacks = lambda a, b: " + ".join(f"bit_count({a}{s} & ~{b}{s})" for s in SIGNATURE)
    shared = F.expr(f"least(n - ({lacks('', 'c_')}), c_n - ({lacks('c_', '')}))")
    return shared * (100 + percent) >= percent * (F.col("n") + F.col("c_n"))


def _similar(percent: int):
    """Batches of pairs with both sets, reduced to those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column("elements_a"), batch.column("elements_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * shared >= percent * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def classes(docs: DataFrame, bands: int = 32, rows: int = 4, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every document with its class of equal sets, and the classes with their band keys."""
    text = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
    drawn = stage(text.mapInArrow(_sketched(bands, rows, size), schema), "sketches")
    one = drawn.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    one = stage(one, "classes")
    keys = ["n_shingles", "set_a", "set_b"]
    members = drawn.drop("bands").join(one, keys)
    members = members.withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    heads = drawn.where("n_shingles > 0").join(one, keys).where("doc_id = class_id").select("doc_id", "n_shingles", "bands")
    heads = stage(heads, "heads")
    return members.select("doc_id", "n_shingles", "class_id"), heads


def linked(docs: DataFrame, heads: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """``node`` and ``component`` of the representatives with verified links, of which enough are found."""
    spark = docs.sparkSession
    rows = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    full = stage(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "keys")
    held = stage(rows.join(full, "key"), "buckets")
    # A member of many large buckets is like many others: the best centre.
    weight = stage(held.groupBy("id").agg(F.sum("members").alias("weight")), "weights")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(weight.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = stage(text.mapInArrow(_sets(size), "id bigint, elements binary"), "sets")
    own = held.drop("members").join(weight, "id").withColumn("component", F.col("id"))
    found = tested = spark.createDataFrame([], "a bigint, b bigint")
    centres = 1
    while True:
        centre, pairs = starred(own, centres, percent)
        pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = found.union(stage(verified(pairs, sets, percent), "verified"))
        tested = tested.union(pairs)
        component = stage(components(found, "a", "b"), "components")
        left = own.join(centre.select("key", F.col("c_id").alias("id")), ["key", "id"], "left_anti")
        own = mixed(left, component)
        if centres == 1 and not is_empty(own):
            own = mixed(prefixes(own, sets, percent), component)
        if is_empty(own):
            return component
        centres *= 16


def starred(own: DataFrame, centres: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Up to ``centres`` members of each bucket, the heaviest of as many parts of it, and the pairs they make with
    members of other components whose sizes, and signatures if they have them, allow the similarity."""
    signs = [s for s in SIGNATURE if s in own.columns]
    slot = F.pmod(F.xxhash64("id", F.lit(centres)), F.lit(centres))
    held = ["id", "n", "component", *signs]
    best = F.max(F.struct("weight", (-F.col("id")).alias("back"), *held)).alias("c")
    centre = own.groupBy("key", slot.alias("slot")).agg(best)
    centre = stage(centre.select("key", *[F.col(f"c.{x}").alias(f"c_{x}") for x in held]), "centres")
    pairs = own.join(centre, "key").where("component != c_component and 100 * least(n, c_n) >= %d * greatest(n, c_n)" % percent)
    if signs:
        pairs = pairs.where(_may_be_similar(percent))
    return centre, pairs.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct()


def mixed(held: DataFrame, component: DataFrame) -> DataFrame:
    """Members of buckets that hold several components; those of small components are the centres to come."""
    many = component.groupBy("component").agg((-F.count("*")).alias("weight"))
    named = component.withColumnRenamed("node", "id").join(many, "component")
    own = held.select("key", "id", "n", *[s for s in SIGNATURE if s in held.columns]).join(named, "id", "left")
    own = own.withColumns({"component": F.coalesce("component", "id"), "weight": F.coalesce("weight", F.lit(-1))})
    own = stage(own, "named")  # both sides of the join below read it
    several = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least_n"))
    return stage(own.join(several.where("x != y").select("key", "least_n"), "key"), "members")


def prefixes(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets by shingle in which every possible link between these members meets.

    Sets of sizes n and m that are similar enough share at least percent * (n + m) / (100 + percent) shingles, so
    with all shingles in one order, rare ones first, the first n + 1 less that number of either have one in
    common. A set that differs from its like in many places has only rare shingles there, and meets hardly any.
    """
    least = F.greatest(F.min("least_n"), F.ceil(F.col("n") * percent / 100))
    sizes = own.groupBy("id", "n").agg(least.alias("m"))
    shared = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    sizes = stage(sizes.select("id", "n", (F.col("n") - shared + 1).alias("first")), "sizes")
    shingles = sets.join(sizes.select("id"), "id", "left_semi").mapInArrow(_flat, "id bigint, h bigint")
    shingles = stage(shingles, "shingles")
    often = stage(shingles.groupBy("h").agg(F.count("*").alias("often")).where("often > 1"), "often")
    ranked = shingles.join(often, "h", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    rare = Window.partitionBy("id").orderBy("often", "h")  # the shingles of one document
    ranked = ranked.withColumn("place", F.row_number().over(rare)).where("often > 1")
    signs = sets.join(sizes.select("id"), "id", "left_semi").mapInArrow(_signed, "id bigint, " + ", ".join(f"{s} bigint" for s in SIGNATURE))
    named = ranked.join(sizes, "id").where("place <= first").select(F.col("h").alias("key"), "id", "n")
    return named.join(signs, "id")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda x: sets.toDF(x, f"elements_{x}")
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar(percent), "a bigint, b bigint")


def near_copies(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """Per document: id, size of its set, component and whether it stands for it."""
    members, heads = classes(docs, bands, rows, size)
    component = linked(docs, heads, percent, size).withColumnRenamed("node", "class_id")
    out = members.join(component, "class_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
