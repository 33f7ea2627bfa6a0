"""Records of delimited text whose quoted fields may hold line breaks, from files that are split between tasks.

A task that starts in the middle of a file cannot tell whether its first line is inside a quoted field. So every
split is read twice. The first pass finds, for each split, whether it ends inside a field if it began outside, and
if it began inside; these pairs compose like functions, so a window over the splits of a file, not over its lines,
tells how each split really begins. The second pass cuts the lines into records. Those that cross a split's bounds
leave it in fragments, at most two for each split, which are put together by their place in the file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, HEADER, REST, OPEN = range(4)


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted field. A field is quoted if it begins with a quote; two quotes in it
    stand for one."""
    if '"' not in line:
        return inside
    at = 0
    if not inside and line[0] == '"':
        inside, at = True, 1
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
        at = line.find(f'{sep}"', at)
        if at < 0:
            return False
        inside, at = True, at + len(sep) + 1


def _splits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The lines of each batch by file and split; a split's batches follow each other."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(width)]
        begin = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or (columns[0][k], columns[1][k]) != (columns[0][begin], columns[1][begin]):
                yield (columns[0][begin], columns[1][begin]), columns[2][begin:k]
                begin = k


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def begin_inside(lines: DataFrame, sep: str) -> DataFrame:
    """The splits (file, start) that begin inside a quoted field."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, states = None, (False, True)
        rows: list[tuple] = []
        for place, texts in _splits(batches, 3):
            if place != held:
                if held is not None:
                    rows.append((*held, *states))
                held, states = place, (False, True)
            for text in texts:
                states = (ends_inside(text, states[0], sep), ends_inside(text, states[1], sep))
        if held is not None:
            rows.append((*held, *states))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        names = ["file", "start", "outside", "inside"]
        yield pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names)

    found = lines.mapInArrow(ends, "file string, start bigint, outside boolean, inside boolean")
    splits = Window.partitionBy("file").orderBy("start")  # one row for each split of a file
    before = splits.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)
    found = found.withColumn("flips", F.sum(flips).over(splits.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("state"), "flips"))
    found = found.withColumns({"known": F.last(known, ignorenulls=True).over(before), "turned": F.lag("flips").over(splits)})
    state = F.coalesce(F.col("known.state"), F.lit(0)) + F.coalesce("turned", F.lit(0)) - F.coalesce(F.col("known.flips"), F.lit(0))
    return found.where(F.pmod(state, F.lit(2)) == 1).select("file", "start")


def quoted_records(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """The records of delimited files, one text each, and the files' first records, which hold the names.

    The driver learns which splits begin inside a field, a place for each, and hands these to the tasks.
    """
    lines = _lines(spark, path)
    inside = spark.sparkContext.broadcast({(r["file"], r["start"]) for r in begin_inside(lines, sep).collect()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, str]] = []
        held: tuple[str, int] | None = None
        open_, state, kind = [], False, WHOLE

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            batch = pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["file", "start", "kind", "value"])
            rows.clear()
            return batch

        def close() -> None:
            if held is not None and (open_ or kind == REST):
                rows.append((*held, REST if kind == REST else OPEN, "\n".join(open_)))

        for place, texts in _splits(batches, 3):
            if place != held:
                close()
                held, open_, state = place, [], place in inside.value
                kind = REST if state else HEADER if place[1] == 0 else WHOLE
            for text in texts:
                state = ends_inside(text, state, sep)
                open_.append(text)
                if not state:
                    rows.append((*place, kind, "\n".join(open_)))
                    open_, kind = [], WHOLE
            if rows:
                yield out()
        close()
        yield out()

    found = lines.mapInArrow(cut, "file string, start bigint, kind int, value string")
    whole = found.where(F.col("kind") == WHOLE).select("value")
    fragments = found.where(F.col("kind").isin(REST, OPEN))
    order = Window.partitionBy("file").orderBy("start", "kind")  # at most two rows for each split of a file
    fragments = fragments.withColumn("record", F.sum(F.when(F.col("kind") == OPEN, 1).otherwise(0)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "value")))
    joined = fragments.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined.select("value")), found.where(F.col("kind") == HEADER).select("file", "value")


def read_quoted(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited files with a header line each as text columns; large files are split between tasks.

    Names come from the first file by name. Blank records are left out, short ones are filled with nulls. Without a
    file that has a record there are no columns. A header has to end in its file's first split.
    """
    records, headers = quoted_records(spark, path, sep)
    header = headers.orderBy("file").limit(1).first()
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    names = next(csv.reader([header["value"].removeprefix("\ufeff").removesuffix("\r")], delimiter=sep))
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    text = F.regexp_replace("value", "\r$", "")
    given = records.select(text.alias("value")).where(F.length(F.trim("value")) > 0)
    parsed = given.select(F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select("r.*").toDF(*names)
