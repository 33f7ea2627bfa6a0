"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only at positions that the content selects: of every ``spread`` neighbouring windows of
``seed`` words, the one of the smallest hash. A kept suffix is known by a hash of its first ``core`` words,
where core = least - spread + 1, so every passage of ``least`` words that occurs twice has a kept position
with the same core in both places. The suffixes are sorted by this hash over all tasks, so that a frequent
passage may fill many of them, and neighbours are compared: those with an equal neighbour lie in candidate
passages. Around them the match is extended to the left and right: the windows of ``least`` words that have a
candidate at a kept place are sorted and compared in the same way, which confirms each window (by 64-bit
hashes), and confirmed windows that overlap are joined to passages. Of equal texts only the one of the
smallest id takes part in the search, the others repeat all of it.

The first occurrence of a window, by id and position, is the one to keep; the words of the later ones are
repeats. Null texts and texts of fewer than ``least`` words have no passages. Rows without an id are left
out of the search and kept as they are by ``without_repeats``; rows that share an id share their passages.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.llm.staging import stage
from volfuse.llm.texts import U64, hash_spans, long_windows, numbered, pieces, text_bytes, words

SEED, LEAST, SPREAD = 8, 50, 16


def selected(hashes: np.ndarray, text: np.ndarray, seed: int, spread: int) -> np.ndarray:
    """Positions that are the smallest, the first of equal ones, of any ``spread`` neighbouring windows of ``seed`` words."""
    value, place = long_windows(hashes, text, seed)
    owner = text[place]
    n = len(value) - spread + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(value))
    span = 1
    while span < spread:  # the smallest of twice as many neighbours at each step
        step = min(span, spread - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(value[b] < value[a], b, a)
        span += step
    inside = owner[:n] == owner[spread - 1 :]
    return place[np.unique(best[:n][inside])]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Hash and text number of every word, its number in its text, and the ids of the texts."""
    raw, at = text_bytes(batch.column("text"))
    first, last, text = words(raw, at)
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return hash_spans(raw, first, last), text, number, batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _suffixes(least: int, seed: int, spread: int):
    """Batches of kept suffixes: hash of the core, hash of the text, position, id; and one row for each whole
    text, whose position is its number of words below zero."""
    core = least - spread + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, text, number, ids = _rows(part)
                kept = selected(hashes, text, seed, spread)
                value, place = long_windows(hashes, text, core)
                spot = np.searchsorted(place, kept)
                some = spot < len(place)
                some[some] = place[spot[some]] == kept[some]
                kept, spot = kept[some], spot[some]
                whole = part.column("t").to_numpy()
                size = np.bincount(text, minlength=len(ids))
                long = np.flatnonzero(size >= least)
                columns = [
                    pa.array(np.concatenate([value[spot].view(np.int64), whole[long]])),
                    pa.array(np.concatenate([whole[text[kept]], whole[long]])),
                    pa.array(np.concatenate([number[kept], -size[long]]), pa.int32()),
                    pa.array(np.concatenate([ids[text[kept]], ids[long]]), pa.int64()),
                ]
                yield pa.record_batch(columns, ["h", "t", "at", "doc_id"])

    return run


def _windows(least: int, spread: int):
    """Batches of windows of ``least`` words around the candidate positions of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, text, number, ids = _rows(part)
                value, place = long_windows(hashes, text, least)
                lists = part.column("places")
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                spots = lists.flatten().to_numpy().astype(np.int64)
                begin = np.searchsorted(text, np.arange(part.num_rows + 1))
                inside = begin[owner] + spots < begin[owner + 1]
                owner, spots = owner[inside], spots[inside]
                mark = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(mark, begin[owner] + np.maximum(0, spots - spread + 1), 1)
                np.add.at(mark, begin[owner] + spots + 1, -1)
                some = np.cumsum(mark)[place] > 0
                columns = [pa.array(value[some].view(np.int64)), pa.array(ids[text[place[some]]]), pa.array(number[place[some]], pa.int32())]
                yield pa.record_batch(columns, ["h", "doc_id", "at"])

    return run


FOUND = "h bigint, doc_id bigint, at int, first_doc_id bigint, first_at int, edge boolean"


def _found(h, ids, at, first_id, first_at, edge=False) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    columns = (h, ids, at, first_id, first_at, np.full(len(h), edge))
    names = [f.split()[0] for f in FOUND.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _neighbours(same: list[str]):
    """Of a task's sorted rows, those whose hash a neighbour has too, with the first row of that hash.

    Rows that equal the one before in the columns ``same`` are passed over. A task's first and last hash may go
    on in its neighbours: for these two it also gives an edge, a row with their number in place of the position,
    and their rows even if they are alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, edge, last, waiting = None, None, None, None  # edge and last: hash, rows so far, first id and position
        for batch in batches:
            if same and batch.num_rows:
                parts = [batch.column(c).to_numpy() for c in same]
                differs = np.zeros(batch.num_rows, bool)
                for x in parts:
                    differs[1:] |= x[1:] != x[:-1]
                differs[0] = before != [x[0] for x in parts]
                before = [x[-1] for x in parts]
                batch = batch.filter(pa.array(differs))
            if not batch.num_rows:
                continue
            h, ids, at = (batch.column(c).to_numpy() for c in ("h", "doc_id", "at"))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            many = ~new | np.append(~new[1:], False)
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            first_id, first_at = ids[start].copy(), at[start].copy()
            begins = np.flatnonzero(new)
            runs = [[h[i], n, ids[i], at[i]] for i, n in ((begins[0], np.append(begins, len(h))[1]), (begins[-1], len(h) - begins[-1]))]
            if last is None:
                many[0] = True
            if last is not None and h[0] == last[0]:
                lead = start == 0
                first_id[lead], first_at[lead] = last[2:]
                many[0] = True
                if waiting is not None:
                    yield waiting
                runs[0] = [h[0], runs[0][1] + last[1], *last[2:]]
            elif last is not None:
                edge = edge or last
            if len(begins) > 1:
                edge = edge or runs[0]
            last, end = runs[1] if len(begins) > 1 else runs[0], slice(len(h) - 1, len(h))
            waiting = None if many[-1] else _found(h[end], ids[end], at[end], first_id[end], first_at[end])
            if many.any():
                yield _found(h[many], ids[many], at[many], first_id[many], first_at[many])
        if waiting is not None:
            yield waiting
        if last is not None:
            hashes, counts, first_id, first_at = zip(*([edge, last] if edge else [last]), strict=True)
            yield _found(hashes, first_id, counts, first_id, first_at, True)

    return run


def repeated(rows: DataFrame, order: list[str], same: list[str], name: str) -> DataFrame:
    """The rows whose hash ``h`` occurs twice or more, with the first id and position that has it.

    All rows are sorted over all tasks, so rows of one hash may fill many tasks. The edges of tasks, two rows for
    each at most, tell how often their hashes occur over all of them, and where first.
    """
    held = stage(rows, name)
    ordered = held.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(ordered.mapInArrow(_neighbours(same), FOUND), f"{name}-found")
    whole = found.where("edge").groupBy("h").agg(F.sum("at").alias("n"), F.min(F.struct("first_doc_id", "first_at")).alias("f"))
    out = found.where("not edge").join(F.broadcast(whole), "h", "left").where("n is null or n > 1")
    first = [F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c) for c in ("first_doc_id", "first_at")]
    return out.select("doc_id", "at", *first)


def _joined(least: int):
    """Of windows sorted by id, kind and position, the passages they make up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for doc_id, again, at, size, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "repeat", "at", "size", "first_doc_id")), strict=True):
                if held and held[0] == doc_id and held[1] == again and at <= held[3]:
                    held[3], held[4] = max(held[3], at + size), min(held[4], first)
                else:
                    if held:
                        rows.append(held)
                    held = [doc_id, again, at, at + size, first]
            if rows:
                yield _passages(rows)
        if held:
            yield _passages([held])

    return run


def _passages(rows: list[list]) -> pa.RecordBatch:
    doc_id, again, start, end, first = zip(*rows, strict=True)
    columns = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(again), pa.array(first, pa.int64())]
    return pa.record_batch(columns, ["doc_id", "start_word", "end_word", "repeat", "first_doc_id"])


def passages(docs: DataFrame, least: int = LEAST, seed: int = SEED, spread: int = SPREAD) -> DataFrame:
    """Passages of ``least`` words or more that occur twice or more: id, first word, end, whether the passage
    is a repeat of an earlier one, and the smallest id that has one of its windows first."""
    text = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    coded = text.withColumn("t", F.xxhash64("text", F.length("text")))
    kept = stage(coded.mapInArrow(_suffixes(least, seed, spread), "h bigint, t bigint, at int, doc_id bigint"), "kept")
    # Equal texts: all but the first repeat the whole.
    whole = kept.where("at < 0")
    equal = whole.groupBy("t", "at").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1")
    copies = whole.join(stage(equal.drop("n"), "equal"), ["t", "at"])
    copies = copies.select("doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("repeat"), F.lit(0).alias("at"), (-F.col("at")).alias("size"), "first_doc_id")
    candidates = repeated(kept.where("at >= 0"), ["h", "t", "at", "doc_id"], ["h", "t", "at"], "suffixes")
    places = stage(candidates.groupBy("doc_id").agg(F.collect_list("at").alias("places")), "places")
    around = text.join(places, "doc_id").mapInArrow(_windows(least, spread), "h bigint, doc_id bigint, at int")
    found = repeated(around, ["h", "doc_id", "at"], ["h", "doc_id", "at"], "windows")
    again = ~((F.col("doc_id") == F.col("first_doc_id")) & (F.col("at") == F.col("first_at")))
    rows = found.select("doc_id", again.alias("repeat"), "at", F.lit(least).alias("size"), "first_doc_id").union(copies)
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "repeat", "at")
    schema = "doc_id bigint, start_word bigint, end_word bigint, repeat boolean, first_doc_id bigint"
    return rows.mapInArrow(_joined(least), schema)


def _cut(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """The texts without their passages; the column after the documents' own holds these."""
    own_text = batch.column(names.index("text"))
    raw, at = text_bytes(own_text)
    first, _, text = words(raw, at)
    begin = np.searchsorted(text, np.arange(batch.num_rows + 1))
    data, out, keep = raw.tobytes(), [], []
    for k, spans in enumerate(batch.column(len(names)).to_pylist()):
        own = first[begin[k] : begin[k + 1]]
        if not spans:
            out.append(own_text[k].as_py())
            keep.append(True)
            continue
        gone = np.zeros(len(own) + 1, np.int64)
        for s in spans:
            gone[min(s["a"], len(own))] += 1
            gone[min(s["b"], len(own))] -= 1
        drop = np.cumsum(gone)[:-1] > 0
        starts = np.append(own, at[k + 1])
        left = data[at[k] : starts[0]] if len(own) else data[at[k] : at[k + 1]]
        runs = np.flatnonzero(np.diff(np.concatenate([[True], drop, [True]]).astype(np.int8)))
        left += b"".join(data[starts[a] : starts[b]] for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True))
        out.append(left.decode("utf-8"))
        keep.append(not drop.all())
    columns = [pa.array(out, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))


def without_repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED, spread: int = SPREAD) -> DataFrame:
    """The documents without the words that repeat an earlier passage; those with nothing left are gone. Rows without
    an id stay as they are; other columns stay, whatever their names."""
    found = passages(docs, least, seed, spread).where("repeat")
    names = docs.columns
    spare = "spans" + "_" * max(map(len, names))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias(spare))
    spans = stage(spans, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, names.index("text")):
                yield _cut(part, names)

    rows = numbered(docs.join(spans, "doc_id", "left").select(*[F.col(f"`{c}`") for c in names], spare))
    return rows.mapInArrow(run, numbered(docs).schema).toDF(*names)
