"""The given tables seen as market and post feeds (FIXTURES.md has the rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars_from_events(events: DataFrame) -> DataFrame:
    """Events as trades: the event type is the symbol, the value moves its price around a level of its own."""
    event, level = F.col("event_id"), F.pow(F.lit(2.0), F.length("event_type")) * 125.0
    value = F.col("value") + level
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        event.alias("bar_id"),
        value.alias("open"),
        (value + (event % 7) / 10.0 + 0.2).alias("high"),
        F.greatest(value - (event % 5) / 10.0, F.lit(0.0)).alias("low"),
        F.when(event % 53 != 0, value + (event % 3) / 10.0).alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def bars_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"))


def posts_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as posts, every column but the id as text; some values are broken on purpose.

    Every whole text is a post. Some documents bring one more post, with an empty or a missing text and an
    id below zero.
    """
    doc = F.col("doc_id")
    ident = doc.cast("string")
    offset = F.make_dt_interval(days=(doc % 32).cast("int"), mins=(doc * 7919 % 960).cast("int"))
    at = F.to_timestamp_ntz(F.lit("2023-12-31 06:00:00")) + offset
    tagged = F.concat(
        F.lit("RT @user_"), ident, F.lit(" Tom &amp; Al "), F.col("text"), F.lit(" https://t.co/x"), ident, F.lit(" #topic")
    )
    likes = F.when(doc % 11 == 0, "n/a").when(doc % 7 == 0, "3.7")
    whole = F.struct(doc.alias("post_id"), F.when(doc % 5 == 0, tagged).otherwise(F.col("text")).alias("text"))
    more = F.struct((-1 - doc).alias("post_id"), F.when(doc % 97 == 0, "RT").alias("text"))
    posts = F.when((doc % 97 == 0) | (doc % 89 == 1), F.array(whole, more)).otherwise(F.array(whole))
    return documents.withColumn("post", F.explode(posts)).select(
        "post.post_id",
        F.when(doc % 101 == 100, "bad").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        "post.text",
        (doc % 3).cast("string").alias("replies"),
        likes.otherwise((F.col("n_chars") % 97).cast("string")).alias("likes"),
        (doc % 13).cast("string").alias("retweets"),
    )


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_documents(table(spark, sf_dir, "documents"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files: those of its folder, or the one file it consists of."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
