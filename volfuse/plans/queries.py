"""The registered queries: every operator once, over the whole given tables.

Results are rounded here and only here, so that they can be compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volfuse.functions import casts
from volfuse.functions.scores import fmt_kpis, fmt_metrics
from volfuse.operators import bars, dataset, evaluate, fusion, indicators, models, report, scenario, sentiment
from volfuse.plans import pipeline, scoring
from volfuse.schema import FEATURES, RESULTS, TARGET
from volfuse.session import stage, stage_path, use_utc
from volfuse.sources import fixtures, tables
from volfuse.streaming import streams

#: The period of the queries whose feature it is.
START, END = "2024-01-05", "2024-01-25"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals; adding zero removes a negative one."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})


def query(fn: Query, digits: int = 6) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(use_utc(spark), sf_dir), digits)

    _queries[fn.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_queries)


# --- price ------------------------------------------------------------------------------------


@query
def hourly_bars(spark, d):
    return pipeline.bars(spark, d)


@query
def bars_filled(spark, d):
    return pipeline.filled(spark, d)


@partial(query, digits=8)  # means of many prices with two decimals often end in a 5 at the seventh
def resample_mean(spark, d):
    return bars.resample_mean(fixtures.bars_raw(spark, d))


@query
def returns_fwdvol(spark, d):
    labelled = indicators.returns_and_label(pipeline.filled(spark, d))
    return labelled.select("symbol", "hour", "return", "future_volatility")


@query
def rsi(spark, d):
    return indicators.rsi(pipeline.filled(spark, d)).select("symbol", "hour", "rsi")


@query
def macd(spark, d):
    return indicators.macd(pipeline.filled(spark, d)).select("symbol", "hour", "macd", "macd_signal")


@query
def bollinger(spark, d):
    return indicators.bollinger(pipeline.filled(spark, d)).select("symbol", "hour", "bollinger_h", "bollinger_l")


@query
def atr(spark, d):
    return indicators.atr(pipeline.filled(spark, d)).select("symbol", "hour", "atr")


@query
def price_features(spark, d):
    return pipeline.features(spark, d)


def _quiet(spark, d) -> DataFrame:
    """Bars of which one symbol's price stands still for weeks."""
    still = (F.col("symbol") == "view") & (F.col("hour") >= F.lit("2024-01-04").cast("timestamp_ntz"))
    price = {c: F.when(still, F.lit(2050.0)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return pipeline.filled(spark, d).withColumns(price)


@query
def quiet_rsi(spark, d):
    return indicators.rsi(_quiet(spark, d)).select("symbol", "hour", "rsi")


@query
def macd_fast(spark, d):
    return indicators.macd(_quiet(spark, d), 2, 26, 9).select("symbol", "hour", "macd", "macd_signal")


@query
def macd_slow(spark, d):
    return indicators.macd(_quiet(spark, d), 12, 200, 3).select("symbol", "hour", "macd", "macd_signal")


@query
def bars_csv(spark, d):
    """The trades written as a file of the feed's form, without a column named close, read, made into bars."""
    raw, path = fixtures.bars_raw(spark, d), stage_path(spark, "bars-csv")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("decimal(20,6)")
    columns = {"Timestamp": at, "Venue": F.lit("x1"), " Price": "close", "Open": "open", "High": "high", "Low": "low", "Volume": "volume", "symbol": "symbol"}
    rows = raw.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
    tables.write_table(rows, path, "csv")
    tables.require(spark, path)
    return bars.hourly_bars(tables.read_bars(spark, path))


@query
def bars_by_day(spark, d):
    """Bars stored by day; then one run writes the days of a range again, from their own trades only."""
    raw, path = fixtures.bars_raw(spark, d), stage_path(spark, "bars-by-day")
    by_day = lambda trades: bars.hourly_bars(trades, tie="bar_id").withColumn("day", F.to_date("hour"))
    spoilt = by_day(raw).withColumn("close", F.when(F.col("day").between(START, END), -1.0).otherwise(F.col("close")))
    tables.write_parts(spoilt, path, ["day"])
    tables.write_parts(by_day(raw.where(F.to_date("ts").between(START, END))), path, ["day"])
    return spark.read.parquet(path).drop("day")


# --- posts ------------------------------------------------------------------------------------


@query
def lenient_casts(spark, d):
    raw = fixtures.posts_raw(spark, d)
    epoch = (F.lit(1704067200) + F.col("post_id") * 3601).cast("string")
    return raw.select(
        "post_id",
        casts.parse_ts("timestamp").alias("ts"),
        casts.to_ts(F.when(F.col("post_id") % 2 == 0, epoch).otherwise(F.col("timestamp"))).alias("ts_epoch_or_text"),
        casts.parse_ts(F.concat("timestamp", F.lit("+02:00"))).alias("ts_aware"),
        casts.to_utc(casts.parse_ts("timestamp"), "Asia/Tokyo").alias("ts_from_zone"),
        casts.to_count("likes").alias("likes"),
        casts.to_count("retweets").alias("retweets"),
    )


@query
def posts_clean(spark, d):
    return pipeline.posts(spark, d)


@query
def posts_sample(spark, d):
    return dataset.first_n(pipeline.posts(spark, d).select("post_id", "timestamp", "likes", "retweets"), 500)


@query
def posts_csv(spark, d):
    """The posts written as a file of the feed's form, read, cleaned."""
    raw, path = fixtures.posts_raw(spark, d), stage_path(spark, "posts-csv")
    rows = raw.select(F.col("post_id").cast("string").alias(" id"), "timestamp", F.col("text").alias("text "), "likes", "retweets")
    rows.write.options(header=True, escape='"', sep=";").csv(path)
    tables.require(spark, path)
    posts = sentiment.clean_posts(tables.read_posts(spark, path, multi_line=True))
    return posts.select("timestamp", "text", "likes", "retweets", "replies")


@query
def posts_scored(spark, d):
    return pipeline.scored(spark, d).select("post_id", "label", "probability", "sentiment_score")


@query
def posts_scored_batches(spark, d):
    """The same word lists behind the interface for any model: batches of texts in Python workers."""
    positive, negative, gap = sentiment.POSITIVE, sentiment.NEGATIVE, sentiment.LETTER.replace("[", "[^") + "+"

    def load():
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def score(texts):
            words = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.string())), gap)
            owner, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
            up, down = (
                np.bincount(owner, pc.is_in(flat, pa.array(listed)).to_numpy(zero_copy_only=False), len(texts))
                for listed in (positive, negative)
            )
            balance = (up - down) / np.maximum(1, up + down)
            label = np.select([balance > 0, balance < 0], ["positive", "negative"], "neutral")
            return list(zip(label.tolist(), np.abs(balance).tolist(), strict=True))

        return score

    scored = sentiment.score_posts(pipeline.posts(spark, d), load)
    return scored.select("post_id", "label", "probability", "sentiment_score")


@query
def hourly_sentiment(spark, d):
    return pipeline.hourly(spark, d)


@query
def post_weighted(spark, d):
    return sentiment.hourly_sentiment(pipeline.scored(spark, d), level="post").select("hour", "weighted_sentiment")


@query
def sentiment_in_range(spark, d):
    return fusion.within_range_of(pipeline.hourly(spark, d), pipeline.features(spark, d))


@query
def sentiment_of_days(spark, d):
    """Posts stored by day; of the days that have bars, and of no others, they are read, cleaned and scored."""
    raw, path = fixtures.posts_raw(spark, d), stage_path(spark, "posts-by-day")
    tables.write_by_day(raw, path, "timestamp")
    hours = stage(pipeline.features(spark, d).select("hour"), "hours")
    posts = fusion.days_of(tables.read_by_day(spark, path, raw.schema), hours).drop("day")
    hourly = sentiment.hourly_sentiment(sentiment.lexicon_scorer(sentiment.clean_posts(posts)))
    return fusion.within_range_of(hourly, hours)


@query
def text_scorer(spark, d):
    """Fitted on the labelled posts of even ids, applied to all posts."""
    quality = F.col("quality").cast("double").alias("label")
    given = fixtures.table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), quality).where("post_id % 2 = 0")
    raw = fixtures.posts_raw(spark, d)
    model = sentiment.fit_text_scorer(stage(sentiment.clean_posts(raw.join(given, "post_id")).select("text", "label"), "labelled"))
    return sentiment.margin_scores(model, sentiment.clean_posts(raw).select("post_id", "text")).select("post_id", "sentiment_score")


# --- fusion and model inputs --------------------------------------------------------------------


@query
def fused_dataset(spark, d):
    return pipeline.fused(spark, d)


@query
def fusion_match(spark, d):
    return fusion.match_count(pipeline.fused(spark, d))


@query
def model_matrix(spark, d):
    return pipeline.matrix(spark, d, START, END)


@query
def split_bounds(spark, d):
    """Hourly rows and daily rows, each cut at 80 %."""
    table = stage(pipeline.matrix(spark, d), "matrix")
    daily = report.daily_rollup(table)
    by_hour = dataset.split_bounds(table).withColumn("level", F.lit("hour"))
    by_day = dataset.split_bounds(daily, spec=report.DAILY).withColumn("level", F.lit("day"))
    return by_hour.unionByName(by_day)


@query
def minmax_scaled(spark, d):
    return pipeline.prepared(spark, d).scaled


@query
def minmax_reloaded(spark, d):
    """The ranges stored and loaded again, as a later run has them."""
    p, path = pipeline.prepared(spark, d), stage_path(spark, "scaler")
    p.scaler.save(spark, path)
    return dataset.MinMax.load(spark, path).transform(p.split)


@query
def minmax_inverse(spark, d):
    p = pipeline.prepared(spark, d)
    back = p.scaler.inverse(p.scaled, {c: c for c in ("close", "atr", TARGET)})
    return back.select("symbol", "hour", "close", "atr", TARGET)


@query
def sequence_windows(spark, d):
    table = stage(pipeline.matrix(spark, d), "matrix")
    seq = dataset.sequences(table, share=0.8)
    close = FEATURES.index("close")
    # Later steps count more, so a swapped or missing step changes the sum.
    weighted = F.aggregate(
        F.transform("x", lambda step, i: step[close] * (i + 1)), F.lit(0.0), lambda total, v: total + v
    )
    return seq.select(
        "symbol",
        "label_ts",
        "label",
        "split",
        F.size(F.flatten("x")).cast("bigint").alias("n_cells"),
        F.col("x")[0][close].alias("first_close"),
        F.element_at("x", -1)[close].alias("last_close"),
        F.element_at("x", -1)[FEATURES.index("vwap")].alias("last_vwap"),
        weighted.alias("weighted_close"),
    )


# --- evaluation ---------------------------------------------------------------------------------

_FORECASTS = {"Previous": "previous", "Mean24": "mean24"}


@query
def reg_metrics(spark, d):
    return evaluate.regression_metrics(pipeline.forecasts(spark, d), "actual", _FORECASTS)


@query
def blend_search(spark, d):
    return evaluate.blend_search(pipeline.forecasts(spark, d), "actual", *_FORECASTS.values())


@query
def leaderboard(spark, d):
    """Each result goes to its own file, as training runs leave them; one file does not exist."""
    predictions = stage(pipeline.forecasts(spark, d), "forecasts")
    results = {
        "baseline": evaluate.regression_metrics(predictions, "actual", _FORECASTS),
        "ensemble": evaluate.best_blend(predictions, "actual", *_FORECASTS.values()).drop("w"),
    }
    paths = [stage_path(spark, name) for name in ("baseline", "recurrent", "ensemble")]
    tables.write_table(results["baseline"], paths[0], "csv")
    tables.write_table(results["ensemble"], paths[2], "csv")
    found = [tables.read_optional(spark, path, RESULTS) for path in paths]
    return fmt_metrics(evaluate.leaderboard(found)).withColumn("source", F.col("source").cast("bigint"))


@query
def pred_bounds(spark, d):
    return report.prediction_bounds(pipeline.forecasts(spark, d), "actual", "mean24")


@query
def last_predictions(spark, d):
    return report.chart_predictions(pipeline.forecasts(spark, d), 150)


# --- report -------------------------------------------------------------------------------------


def _daily(spark, d) -> DataFrame:
    return report.daily_rollup(pipeline.fused(spark, d))


@query
def daily_rollup(spark, d):
    return _daily(spark, d)


@query
def sentiment_ma7(spark, d):
    return report.chart_posts(stage(_daily(spark, d), "daily"))


@query
def daily_rollup_range(spark, d):
    """Days of a chosen range; the open end is the data's own."""
    return report.daily_rollup(pipeline.fused(spark, d), start="2024-01-10 05:00:00")


@query
def chart_price(spark, d):
    return report.chart_price(_daily(spark, d))


@query
def chart_vol_sentiment(spark, d):
    return report.chart_vol_sentiment(_daily(spark, d))


@query
def series_close(spark, d):
    return report.series(pipeline.features(spark, d), "close")


@query
def kpi_summary(spark, d):
    return report.kpis(dataset.time_range(pipeline.fused(spark, d), START, END))


@query
def kpi_text(spark, d):
    return fmt_kpis(report.kpis(dataset.time_range(pipeline.fused(spark, d), START, END)))


@query
def vol_regimes(spark, d):
    return report.regimes(pipeline.features(spark, d), TARGET)


@query
def data_profile(spark, d):
    return tables.profile(fixtures.bars_raw(spark, d))


# --- models -------------------------------------------------------------------------------------


def _scores(df: DataFrame, y: str, *cols: str) -> DataFrame:
    return evaluate.regression_metrics(df, y, {c: c for c in cols})


@query
def linreg_univariate(spark, d):
    ready = models.assemble(stage(pipeline.matrix(spark, d), "matrix"), ["atr"])
    model = models.fit_linear(ready)
    return ready.agg(F.count("*").alias("n")).select(
        "n", F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept")
    )


def _linear(spark, d, kind: str = "test") -> DataFrame:
    """Scaled rows of one side with the prediction of a least squares model that was stored and loaded again."""
    p = pipeline.prepared(spark, d)
    ready = stage(models.assemble(p.scaler.transform(p.split, FEATURES)), "model-rows")
    path = stage_path(spark, "linear")
    models.save_model(models.fit_linear(ready.filter("split = 'train'")), path)
    return models.load_model(LinearRegressionModel, path).transform(ready.filter(F.col("split") == kind))


@query
def linreg_by_symbol(spark, d):
    """A line for each symbol."""
    fits = models.fit_linear_by_series(pipeline.matrix(spark, d), ["atr"])
    return fits.select("symbol", "n", F.col("coefficients")[0].alias("slope"), "intercept")


@query
def linreg_metrics(spark, d):
    return _scores(_linear(spark, d), TARGET, "LinearRegression")


@query
def linreg_residuals(spark, d):
    """What least squares promises: residuals of the training rows are orthogonal to all features."""
    fitted = _linear(spark, d, "train")
    residual = F.col("LinearRegression") - F.col(TARGET)
    products = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(F.col(c) * residual), 8).alias("product")) for c in FEATURES])
    return fitted.agg(products.alias("all")).select(F.inline("all"))


@query
def forest_metrics(spark, d):
    _, _, test = pipeline.row_models(pipeline.prepared(spark, d))
    return _scores(test, TARGET, "LinearRegression", "RandomForest")


@query
def top_features(spark, d):
    p = pipeline.prepared(spark, d)
    _, forest, test = pipeline.row_models(p)
    return dataset.top_k(models.importances(forest, test), "importance", 10)


@query
def lagged_metrics(spark, d):
    seq = stage(models.flatten_steps(pipeline.scaled_sequences(pipeline.prepared(spark, d))), "lagged")
    train, test = seq.filter("split = 'train'"), seq.filter("split = 'test'")
    for algo in ("linear", "gbt"):
        test = models.fit_lagged(train, algo, out=f"lagged_{algo}").transform(test)
    return _scores(test, "label", "lagged_linear", "lagged_gbt")


@query
def test_predictions(spark, d):
    p = pipeline.prepared(spark, d)
    _, forest, _ = pipeline.row_models(p)
    return pipeline.prediction_table(p, forest)


@query
def stored_linear(spark, d):
    """Test rows forecast by a later run, from the scaler and the least squares that a training run has stored."""
    p, path = pipeline.prepared(spark, d), stage_path(spark, "stored-linear")
    scoring.train(p, path, trees=None)
    scored = scoring.load(spark, path).forecast(p.split.filter("split = 'test'"))
    return scored.select("symbol", "hour", F.col(TARGET).alias("actual"), scoring.LINEAR)


# --- scenarios ----------------------------------------------------------------------------------


@query
def scenario_features(spark, d):
    return scenario.apply_scenarios(pipeline.fused(spark, d))


@query
def scenario_scores(spark, d):
    """The least squares model on the newest step of every scenario."""
    fused = stage(pipeline.fused(spark, d), "fused")
    p = pipeline.prepare(fused)
    linear = models.fit_linear(models.assemble(p.scaled).filter("split = 'train'"), out="Linear")
    windows = dataset.last_step(scenario.scenario_windows(scenario.apply_scenarios(fused), p.scaler))
    scored = scenario.score_scenarios(linear.transform(models.assemble(windows)), p.scaler, {"Linear": F.col("Linear")})
    return scored.select("symbol", "preset", "Linear", "Linear_regime")


@query
def scenario_models(spark, d):
    """Every stored model and the blend on the newest step of every scenario."""
    fused, path = stage(pipeline.fused(spark, d), "fused"), stage_path(spark, "stored-models")
    scoring.train(pipeline.prepare(fused), path)
    stored = scoring.load(spark, path)
    windows = dataset.last_step(scenario.scenario_windows(scenario.apply_scenarios(fused), stored.scaler))
    named = {c: F.col(c) for c in stored.columns}
    scored = scenario.score_scenarios(stored.predict(windows), stored.scaler, named)
    return scored.select("symbol", "preset", *named, *[f"{c}_regime" for c in named])


# --- streams ------------------------------------------------------------------------------------


@query
def stream_bars(spark, d):
    trades = fixtures.bars_from_events(fixtures.stream_table(spark, d, "events"))
    return streams.drain(spark, streams.stream_bars(trades, tie="bar_id"), "stream-bars")


@query
def stream_bars_closed(spark, d):
    """Only windows that the watermark has passed; their state is dropped."""
    trades = fixtures.bars_from_events(fixtures.stream_table(spark, d, "events"))
    return streams.drain(spark, streams.stream_bars(trades, tie="bar_id"), "stream-closed", mode="append")


@query
def stream_sentiment(spark, d):
    posts = sentiment.clean_posts(fixtures.posts_from_documents(fixtures.stream_table(spark, d, "documents")))
    scored = sentiment.lexicon_scorer(posts.filter(F.col("timestamp").isNotNull()))
    return streams.drain(spark, streams.stream_sentiment(scored), "stream-sentiment")


@query
def stream_sentiment_closed(spark, d):
    """Only hours that the watermark has passed; their state is dropped."""
    posts = sentiment.clean_posts(fixtures.posts_from_documents(fixtures.stream_table(spark, d, "documents")))
    scored = sentiment.lexicon_scorer(posts.filter(F.col("timestamp").isNotNull()))
    return streams.drain(spark, streams.stream_sentiment(scored), "stream-sentiment-closed", mode="append")
