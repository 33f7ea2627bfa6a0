"""The queries without an SQL twin, recomputed by brute force from the tables they start from."""

import numpy as np
import pytest

import __spark_entry__ as entry
from volfuse.operators import scenario
from volfuse.plans import pipeline
from volfuse.schema import FEATURES, TARGET

SF = "/root/testdata/sf0.001"
STEPS = 12


@pytest.fixture(scope="module")
def prepared(spark):
    return pipeline.prepared(spark, SF)


@pytest.fixture(scope="module")
def frame(prepared):
    return prepared.matrix.orderBy("symbol", "hour").toPandas()


@pytest.fixture(scope="module")
def scaled(frame):
    """Every column scaled by its range over the first 80 % of each symbol's rows."""
    order = frame.groupby("symbol").cumcount()
    size = frame.groupby("symbol")["hour"].transform("size")
    train = order < np.floor(size * 0.8)
    out = frame.copy()
    for c in [*FEATURES, TARGET]:
        low, high = frame.loc[train, c].min(), frame.loc[train, c].max()
        out[c] = (frame[c] - low) / ((high - low) or 1.0)
    return out.assign(train=train)


@pytest.fixture(scope="module")
def sequences(frame, scaled):
    x, y, key, train = [], [], [], []
    for symbol, part in scaled.groupby("symbol"):
        values, target = part[FEATURES].to_numpy(), frame.loc[part.index, TARGET].to_numpy()
        hours, n = part["hour"].tolist(), len(part) - STEPS
        for i in range(n):
            x.append(values[i : i + STEPS])
            y.append(target[i + STEPS])
            key.append((symbol, hours[i + STEPS]))
            train.append(i < int(n * 0.8))
    return np.array(x), np.array(y), key, np.array(train)


def run(spark, name):
    return entry.queries()[name](spark, SF)


def least_squares(x, y):
    coefficients, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    return lambda z: np.c_[z, np.ones(len(z))] @ coefficients


def test_linear_baseline(spark, frame, scaled):
    x, y, train = scaled[FEATURES].to_numpy(), frame[TARGET].to_numpy(), scaled["train"].to_numpy()
    error = least_squares(x[train], y[train])(x[~train]) - y[~train]
    row = run(spark, "linreg_metrics").first()
    assert row["MAE"] == pytest.approx(np.abs(error).mean(), abs=1e-5)
    assert row["RMSE"] == pytest.approx(np.sqrt((error**2).mean()), abs=1e-5)


def test_prediction_table(prepared, sequences, frame, scaled):
    x, y, key, train = sequences
    table = pipeline.prediction_table(prepared).toPandas().set_index(["symbol", "label_ts"])
    rows = table.loc[[k for k, t in zip(key, train) if not t]]
    assert len(table) == (~train).sum() and (rows["RandomForest"] == 0).all()
    np.testing.assert_allclose(rows["actual"], y[~train], atol=1e-9)
    np.testing.assert_allclose(rows["LinearRegression"], least_squares(x[train, -1], y[train])(x[~train, -1]), atol=1e-4)
    np.testing.assert_allclose(rows["Ensemble"], rows["LinearRegression"] * 0.0 + _best(rows, y[~train]), atol=1e-8)


def _best(rows, y):
    blends = {w: w * rows["RandomForest"] + (1 - w) * rows["LinearRegression"] for w in np.linspace(0, 1, 101)}
    return blends[min(blends, key=lambda w: np.sqrt(((blends[w] - y) ** 2).mean()))]


def test_scenario_scores(spark, prepared, frame, scaled):
    got = run(spark, "scenario_scores").toPandas().set_index(["symbol", "preset"])
    fused = pipeline.fused(spark, SF).toPandas().sort_values("hour")
    assert len(got) == fused["symbol"].nunique() * len(scenario.PRESETS)
    train = scaled["train"].to_numpy()
    predict = least_squares(scaled[FEATURES].to_numpy()[train], scaled[TARGET].to_numpy()[train])
    counts = ["volume", "tweet_count", "likes", "retweets"]
    low = np.array([prepared.scaler.low[c] for c in FEATURES])
    width = np.array([(prepared.scaler.high[c] - prepared.scaler.low[c]) or 1.0 for c in FEATURES])
    span, base = prepared.scaler.high[TARGET] - prepared.scaler.low[TARGET], prepared.scaler.low[TARGET]
    for symbol, part in fused.groupby("symbol"):
        last = part[FEATURES].iloc[-1].copy()
        for c in ("open", "high", "low", "close"):
            last[c] *= 0.91
        last[["return", "sentiment_score", "tweet_count", "likes", "retweets"]] = [-0.09, -0.78, 7800, 22000, 8500]
        last["weighted_sentiment"] = -0.78 * np.log1p(22000 + 8500 + 1)
        last[counts] = np.log1p(last[counts].astype(float))
        want = predict(((last.to_numpy(float) - low) / width)[None])[0] * span + base
        assert got.loc[(symbol, "crash"), "Linear"] == pytest.approx(want, rel=1e-3, abs=1e-5)
        band = "low" if want < 0.005 else "normal" if want < 0.015 else "high"
        assert got.loc[(symbol, "crash"), "Linear_regime"] == band


def test_forest_beats_nothing_but_is_sane(spark):
    rows = {r["model"]: r for r in run(spark, "forest_metrics").collect()}
    assert rows.keys() == {"LinearRegression", "RandomForest"} and all(r["MAE"] <= r["RMSE"] for r in rows.values())


def test_text_margins(spark):
    got = run(spark, "text_scorer")
    assert got.count() == pipeline.posts(spark, SF).count()
    assert got.filter("sentiment_score not between -1 and 1").count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scores = {r["post_id"]: r["sentiment_score"] for r in got.collect()}
    held = [(labels[k], v) for k, v in scores.items() if k in labels and k % 2]
    pairs = [a > b for y, a in held if y == 1 for z, b in held if z == 0]
    assert sum(pairs) > 0.6 * len(pairs)
