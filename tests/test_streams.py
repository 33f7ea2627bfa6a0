import pytest
from pyspark.sql import functions as F

from helpers import BAR_SCHEMA, at, trade, trades
from volfuse.operators import sentiment
from volfuse.operators.bars import hourly_bars
from volfuse.plans import queries
from volfuse.streaming import streams


def feed(spark, tmp_path, *batches):
    """Each batch becomes one file and, one file per trigger, one micro-batch."""
    path = str(tmp_path / "in")
    for rows in batches:
        trades(spark, *rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tie", [None, "bar_id"])
def test_stream_equals_batch(spark, tmp_path, tie):
    first = [trade(i / 5, i, 10.0 + i % 7, symbol="ab"[i % 2]) for i in range(40)]
    second = [trade(8 + i / 5, 100 + i, 20.0 + i % 3, symbol="ab"[i % 2]) for i in range(40)]
    stream, path = feed(spark, tmp_path, first, second)
    got = streams.drain(spark, streams.stream_bars(stream, tie=tie), "bars")
    want = hourly_bars(spark.read.parquet(path), tie=tie).select(*got.columns)
    assert rows(got) == rows(want) and got.schema["hour"].dataType.simpleString() == "timestamp_ntz"


def test_append_drops_late_rows_and_keeps_open_windows_back(spark, tmp_path):
    stream, _ = feed(
        spark, tmp_path,
        [trade(0.5, 1, 1.0), trade(10.5, 2, 2.0)],
        [trade(10.6, 6, 2.0)],  # rows are judged by the watermark of the batch before
        [trade(0.6, 3, 99.0), trade(9.5, 4, 4.0)],  # 0.6 is behind the watermark, 9.5 is not
        [trade(30.0, 5, 5.0)],  # moves the watermark past everything before
    )
    got = streams.drain(spark, streams.stream_bars(stream, delay="2 hours"), "bars", mode="append")
    closed = {r["hour"]: r["high"] for r in got.collect()}
    assert closed == {at(0): 1.0, at(9): 4.0, at(10): 2.0}


def test_sentiment_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "posts")
    moment = F.lit(at(0)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 3)
    posts = spark.range(200).select(
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "with &amp; for it").otherwise("is it on").alias("text"),
        (F.col("id") % 5).cast("string").alias("likes"),
        F.lit("1").alias("retweets"),
    )
    posts.write.parquet(path)

    def scored(df):
        return sentiment.lexicon_scorer(sentiment.clean_posts(df))

    stream = spark.readStream.schema(posts.schema).parquet(path)
    got = streams.drain(spark, streams.stream_sentiment(scored(stream)), "sentiment")
    want = sentiment.hourly_sentiment(scored(spark.read.parquet(path))).select(*got.columns)
    assert got.count() == 10
    for a, b in zip(rows(got), rows(want), strict=True):  # means depend on the order of addition
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-12)


def test_empty_source(spark, tmp_path):
    path = tmp_path / "empty"
    path.mkdir()
    stream = spark.readStream.schema(BAR_SCHEMA).parquet(str(path))
    assert streams.drain(spark, streams.stream_bars(stream), "bars", may_be_empty=True).count() == 0
    with pytest.raises(RuntimeError, match="gave no rows"):
        streams.drain(spark, streams.stream_bars(stream), "bars")


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_several_files(spark, tmp_path, files):
    """A table is a folder of files on any cluster; all of them belong to the stream."""
    for name in ("events", "documents"):
        given = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        given.repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    for stream, batch in (("stream_bars", "hourly_bars"), ("stream_sentiment", "hourly_sentiment")):
        got = queries.registered()[stream](spark, str(tmp_path))
        want = queries.registered()[batch](spark, str(tmp_path)).select(got.columns)
        assert rows(got) == rows(want) and got.count() > 50


def test_sentiment_state_holds_open_hours_only(spark, tmp_path):
    """Days of posts, a file each: hours leave the state as they close, and late posts are counted, not added."""
    path = str(tmp_path / "posts")
    post = "timestamp string, text string, likes string, retweets string"
    for day in range(1, 9):
        rows = [(f"2024-01-{day:02d} {h:02d}:10:00", "with for", "1", "2") for h in range(24)]
        late = [("2024-01-01 05:00:00", "is it", "9", "9")] * 3 if day == 6 else []
        spark.createDataFrame([*rows, *late], post).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(post).option("maxFilesPerTrigger", 1).parquet(path)
    scored = sentiment.lexicon_scorer(sentiment.clean_posts(stream))
    progress = streams.Progress()
    got = streams.drain(spark, streams.stream_sentiment(scored), "closed", mode="append", progress=progress)
    assert got.count() == 8 * 24 - 3 and got.filter("tweet_count <> 1 or likes <> 1").count() == 0
    assert sum(progress.rows) == 8 * 24 + 3 and sum(progress.late) == 1
    assert max(progress.state) <= 27 and progress.state[-1] == 3
    assert progress.watermark[-1].startswith("2024-01-08T21:10")
