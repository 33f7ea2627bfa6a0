"""Posts to an hourly sentiment index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volfuse.functions.casts import parse_ts, to_count
from volfuse.functions.scores import signed_score, weighted_sentiment
from volfuse.functions.text import clean_text
from volfuse.operators.bars import floor_time

# Placeholder word lists for the invented prose of the given documents.
POSITIVE = ["with", "for", "that", "was", "der", "la"]
NEGATIVE = ["is", "it", "on", "as", "die", "le"]
LETTER = "[a-zà-ÿ]"  # a word is a longest run of these in the lower-cased text


def clean_posts(df: DataFrame, ts: str = "timestamp", min_length: int = 3, entities: bool = True) -> DataFrame:
    """Typed posts with cleaned text; texts that end up shorter than ``min_length`` are dropped."""
    counts = ("replies", "likes", "retweets")
    read = {c: to_count(c) if c in df.columns else F.lit(0).cast("bigint") for c in counts}
    # A filter on the cleaned text would be pushed below the cleaning and evaluate it a second time;
    # an array of one text or none is evaluated once.
    kept = F.filter(F.array(clean_text("text", entities)), lambda text: F.char_length(text) >= min_length)
    return df.withColumns({ts: parse_ts(ts), "text": F.explode(kept), **read})


def min_chars(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    return df.filter(F.char_length(col) >= n)


# --- scoring ----------------------------------------------------------------------------------


def lexicon_scorer(
    df: DataFrame, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE, text: str = "text"
) -> DataFrame:
    """Label, probability and signed score from counts of listed words; stays inside the JVM.

    One search finds the listed words; the words of a text are never all spelled out as an array.
    """
    positive, negative = list(positive), list(negative)
    listed = "|".join(re.escape(w) for w in [*positive, *negative])
    search = F.lit(f"(?<!{LETTER})(?:{listed})(?!{LETTER})")
    found = df.withColumn("_hits", F.regexp_extract_all(F.lower(text), search, F.lit(0)))
    pos, hits = F.size(F.filter("_hits", lambda w: w.isin(*positive))), F.size("_hits")
    counted = found.withColumn("_balance", F.coalesce(F.try_divide(2.0 * pos - hits, hits), F.lit(0.0)))
    label = F.when(F.col("_balance") > 0, "positive").when(F.col("_balance") < 0, "negative").otherwise("neutral")
    scored = counted.withColumns({"label": label, "probability": F.abs("_balance")})
    return scored.withColumn("sentiment_score", signed_score("label", "probability")).drop("_hits", "_balance")


def score_posts(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
    text: str = "text",
    batch: int = 32,
) -> DataFrame:
    """Label, probability and signed score from any model.

    ``load`` runs once per Python task and returns a function from a list of texts to a list of
    (label, probability); it is called with at most ``batch`` texts at a time. No others are held as
    Python strings meanwhile.
    """

    @F.arrow_udf("label string, probability double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            parts = (texts.slice(i, batch).fill_null("").to_pylist() for i in range(0, len(texts), batch))
            found = [(label, probability) for part in parts for label, probability in model(part)]
            label, probability = zip(*found, strict=True) if found else ((), ())
            columns = [pa.array(label, pa.string(), from_pandas=True), pa.array(probability, pa.float64(), from_pandas=True)]
            yield pa.StructArray.from_arrays(columns, ["label", "probability"])

    scored = df.withColumn("_scored", predict(F.col(text)))
    scored = scored.withColumns({"label": F.col("_scored.label"), "probability": F.col("_scored.probability")})
    return scored.withColumn("sentiment_score", signed_score("label", "probability")).drop("_scored")


def fit_text_scorer(train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 18) -> PipelineModel:
    """Classifier for 0/1 labels on hashed word frequencies; ``features`` is the number of slots words share."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol=label, probabilityCol="_p", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train)


def margin_scores(model: PipelineModel, df: DataFrame, out: str = "sentiment_score") -> DataFrame:
    """Probability of positive minus probability of negative."""
    scored = model.transform(df).withColumn("_pair", vector_to_array("_p"))
    return scored.withColumn(out, F.col("_pair")[1] - F.col("_pair")[0]).select(*df.columns, out)


# --- the hourly index -------------------------------------------------------------------------


def sentiment_aggregates(level: str = "hour") -> list[Column]:
    index = [
        F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("sentiment_score"),
        F.count("text").alias("tweet_count"),
        F.coalesce(F.avg("likes"), F.lit(0.0)).alias("likes"),
        F.coalesce(F.avg("retweets"), F.lit(0.0)).alias("retweets"),
    ]
    if level == "post":
        per_post = F.avg(weighted_sentiment("sentiment_score", "likes", "retweets"))
        index.append(F.coalesce(per_post, F.lit(0.0)).alias("weighted_sentiment"))
    return index


def hourly_sentiment(df: DataFrame, ts: str = "timestamp", width: str = "1 hour", level: str = "hour") -> DataFrame:
    """Mean score, number of posts, mean likes and retweets per hour that has posts.

    The engagement weight is applied to the hourly means, or with ``level="post"`` to every post.
    """
    timed = df.filter(F.col(ts).isNotNull()).withColumn("hour", floor_time(ts, width))
    hourly = timed.groupBy("hour").agg(*sentiment_aggregates(level))
    if level == "post":
        return hourly
    return hourly.withColumn("weighted_sentiment", weighted_sentiment("sentiment_score", "likes", "retweets"))
