"""The two aggregations that also run on streams. Both reuse the batch expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volfuse.operators.bars import bar_aggregates, bar_inputs, finish_bars
from volfuse.operators.sentiment import sentiment_aggregates
from volfuse.functions.scores import weighted_sentiment
from volfuse.session import stage_path


def _by_hour(sdf: DataFrame, keys: Sequence[str], ts: str, width: str, delay: str):
    """Grouping by tumbling window. Watermarks need a zoned time; the UTC session makes it equal."""
    timed = sdf.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    return timed.groupBy(*keys, F.window("_event_time", width).alias("_window"))


def _with_hour(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    hour = F.col("_window.start").cast("timestamp_ntz").alias("hour")
    return df.select(*keys, hour, *[c for c in df.columns if c not in (*keys, "_window")])


def stream_bars(
    sdf: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts", width: str = "1 hour",
    delay: str = "2 hours", tie: str | None = None,
) -> DataFrame:
    """Bars with VWAP per key and window; rows later than ``delay`` behind the newest are dropped."""
    rows = sdf.na.drop("any", subset=[*keys, ts]).withColumns(bar_inputs(ts, tie))
    bars = _by_hour(rows, keys, ts, width, delay).agg(*bar_aggregates())
    return finish_bars(_with_hour(bars, keys))


def stream_sentiment(
    scored: DataFrame, ts: str = "timestamp", width: str = "1 hour", delay: str = "2 hours"
) -> DataFrame:
    """Hourly sentiment of a stream of scored posts; those later than ``delay`` behind the newest are dropped.

    The scorer keeps no state. In ``append`` mode state holds the open hours only, however long the stream runs.
    """
    hourly = _with_hour(_by_hour(scored, [], ts, width, delay).agg(*sentiment_aggregates()), [])
    return hourly.withColumn("weighted_sentiment", weighted_sentiment("sentiment_score", "likes", "retweets"))


@dataclass
class Progress:
    """What one run of a stream counted, batch by batch."""

    rows: list[int] = field(default_factory=list)  #: rows read from the source
    state: list[int] = field(default_factory=list)  #: windows kept open after the batch
    late: list[int] = field(default_factory=list)  #: partial sums (one a task and window) that came too late and were dropped
    watermark: list[str] = field(default_factory=list)  #: what the batch was judged by

    def add(self, batch) -> None:
        self.rows.append(batch["numInputRows"])
        self.state.append(sum(s["numRowsTotal"] for s in batch["stateOperators"]))
        self.late.append(sum(s["numRowsDroppedByWatermark"] for s in batch["stateOperators"]))
        self.watermark.append(batch["eventTime"].get("watermark", ""))


def drain(
    spark: SparkSession, sdf: DataFrame, name: str, mode: str = "complete", may_be_empty: bool = False,
    progress: Progress | None = None,
) -> DataFrame:
    """Process everything the source holds now and return the result table.

    ``append`` emits a window once the watermark has passed it, so the newest windows stay open, state is
    dropped and files are only ever added; ``complete`` keeps all state and rewrites the whole result, with
    the open windows. A source that gives no row at all raises unless it ``may_be_empty``. ``progress`` is
    given the counts of the last batches, as many as ``spark.sql.streaming.numRecentProgressUpdates`` says.
    """
    out, state = stage_path(spark, name), stage_path(spark, f"{name}-state")
    writer = sdf.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(_replace(out)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if progress is not None:
        for batch in query.recentProgress:
            progress.add(batch)
    if not may_be_empty and not sum(p["numInputRows"] for p in query.recentProgress):
        raise RuntimeError(f"the source of {name} gave no rows")
    try:
        return spark.read.schema(sdf.schema).parquet(out)
    except AnalysisException as error:  # nothing was written: no rows came, or no window is closed yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], sdf.schema)


def _replace(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write
