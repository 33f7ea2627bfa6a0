import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, column, prices
from volfuse.operators import indicators
from volfuse.operators.series import Series, decayed_scan, ffill, number_rows, with_halo
from volfuse.session import stage

N = 400
EXACT = {"rtol": 1e-9, "atol": 1e-9}


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    return 100 + np.cumsum(rng.normal(size=N))


@pytest.fixture(scope="module")
def bars(spark, walk):
    return prices(spark, [float(v) for v in walk]).cache()


def expected(close):
    c = pd.Series(close)
    high, low, previous = c + 1, c - 1, c.shift(1)
    change = c.diff()
    up = change.clip(lower=0).fillna(0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    down = (-change).clip(lower=0).fillna(0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()

    def mean(s, n):
        return s.ewm(span=n, min_periods=n, adjust=False).mean()

    out = pd.DataFrame({"rsi": 100 - 100 / (1 + up / down)})
    out["macd"] = mean(c, 12) - mean(c, 26)
    out["macd_signal"] = mean(out["macd"], 9)
    middle, dev = c.rolling(20).mean(), c.rolling(20).std(ddof=0)
    out["bollinger_h"], out["bollinger_l"] = middle + 2 * dev, middle - 2 * dev
    tr = pd.concat([high - low, (high - previous).abs(), (low - previous).abs()], axis=1).max(axis=1)
    atr = np.full(len(c), np.nan)
    atr[13] = tr[:14].mean()
    for i in range(14, len(c)):
        atr[i] = (atr[i - 1] * 13 + tr[i]) / 14
    out["atr"] = atr
    out["return"] = c.pct_change()
    out["future_volatility"] = out["return"].rolling(24).std().shift(-24)
    return out


# Blocks far shorter than the series make every value depend on halo rows and carried values.
@pytest.mark.parametrize("block", [4096, 97])
def test_all_indicators_match_pandas(bars, walk, block):
    got = indicators.indicator_table(bars, spec=Series(rows=block)).orderBy("hour").toPandas()
    want = expected(walk)
    for name in want:
        np.testing.assert_allclose(got[name].astype(float), want[name], err_msg=name, **EXACT)


@pytest.mark.parametrize(
    "run", [indicators.rsi, indicators.macd, indicators.bollinger, indicators.atr, indicators.returns_and_label]
)
def test_single_indicators_agree_with_the_table(bars, run):
    table = indicators.indicator_table(bars).orderBy("hour").toPandas()
    got = run(bars).orderBy("hour").toPandas()
    for name in set(got) - set(bars.columns):
        np.testing.assert_allclose(got[name].astype(float), table[name].astype(float), **EXACT)


def test_warm_up_rows(bars):
    table = indicators.indicator_table(bars).orderBy("hour").toPandas()
    first = {c: int(table[c].first_valid_index()) for c in ("rsi", "macd", "macd_signal", "bollinger_h", "atr", "return")}
    assert first == {"rsi": 13, "macd": 25, "macd_signal": 33, "bollinger_h": 19, "atr": 13, "return": 1}
    assert indicators.price_features(bars).count() == N - 33 - 24


@pytest.mark.parametrize("alpha", [2 / 13, 2 / 27, 2 / 10, 1 / 14, 0.002, 0.9, 1.0])
@pytest.mark.parametrize("block", [4096, 50])
def test_decayed_scan(spark, walk, alpha, block):
    values = [None, None, *[float(v) for v in walk]]
    got = decayed_scan(prices(spark, values), "close", alpha, "y", Series(rows=block))
    want = pd.Series([np.nan, np.nan, *walk]).ewm(alpha=alpha, adjust=False).mean()
    np.testing.assert_allclose(np.array(column(got, "y"), dtype=float), want, **EXACT)


def test_long_series_stays_exact(spark):
    """Three blocks of the default size, with values of both signs."""
    rng = np.random.default_rng(11)
    values = rng.normal(size=10_000)
    frame = pd.DataFrame({"symbol": "a", "hour": pd.date_range(at(0), periods=len(values), freq="h"), "close": values})
    df = spark.createDataFrame(frame, "symbol string, hour timestamp_ntz, close double")
    want = pd.Series(values).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(column(decayed_scan(df, "close", 1 / 14, "y"), "y"), want, rtol=0, atol=1e-12)


def test_leading_nulls_shift_the_start(spark, walk):
    got = indicators.indicator_table(prices(spark, [None, None, None, *[float(v) for v in walk]])).orderBy("hour").toPandas()
    assert int(got["macd"].first_valid_index()) == 28
    want = expected(walk)["macd"].to_numpy()
    np.testing.assert_allclose(got["macd"].astype(float)[3:], want, **EXACT)


def test_rising_prices_have_full_strength(spark):
    rsi = column(indicators.rsi(prices(spark, [float(i) for i in range(1, 20)])), "rsi")
    assert rsi[:13] == [None] * 13 and rsi[13:] == [100.0] * 6


def test_thirteen_rows_are_too_few(spark):
    assert column(indicators.rsi(prices(spark, [float(i) for i in range(13)])), "rsi") == [None] * 13


def test_zero_price_gives_no_return(spark):
    assert column(indicators.returns(prices(spark, [0.0, 5.0, 10.0])), "return") == [None, None, 1.0]


def test_log_returns(spark):
    got = column(indicators.returns(prices(spark, [1.0, np.e, 0.0, 1.0]), kind="log"), "return")
    assert got[0] is None and got[1] == pytest.approx(1.0) and got[2:] == [None, None]
    with pytest.raises(ValueError):
        indicators.returns(prices(spark, [1.0]), kind="other")


def test_label_needs_all_24_returns(spark):
    closes = [float(10 + (i * 7) % 5) for i in range(26)]
    label = column(indicators.returns_and_label(prices(spark, closes)), "future_volatility")
    returns = pd.Series(closes).pct_change()
    assert label[0] == pytest.approx(returns[1:25].std()) and label[1] == pytest.approx(returns[2:26].std())
    assert label[2:] == [None] * 24


def test_no_look_ahead(spark, walk):
    """Changing later prices changes no feature, only labels."""
    cut = 200
    changed = [float(v) for v in walk[:cut]] + [float(v) * 3 for v in walk[cut:]]
    before = indicators.indicator_table(prices(spark, [float(v) for v in walk]), spec=Series(rows=60)).orderBy("hour").toPandas()
    after = indicators.indicator_table(prices(spark, changed), spec=Series(rows=60)).orderBy("hour").toPandas()
    features = ["rsi", "macd", "macd_signal", "bollinger_h", "bollinger_l", "atr", "return"]
    pd.testing.assert_frame_equal(before[features][:cut], after[features][:cut], rtol=1e-12)
    assert not np.allclose(before["future_volatility"][cut - 20 : cut], after["future_volatility"][cut - 20 : cut])


def test_symbols_do_not_touch(spark, walk):
    one, two = [float(v) for v in walk[:100]], [float(v) for v in walk[100:250]]
    both = prices(spark, one, "a").unionByName(prices(spark, two, "b", first=40))
    together = indicators.indicator_table(both)
    for symbol, closes, first in (("a", one, 0), ("b", two, 40)):
        alone = indicators.indicator_table(prices(spark, closes, symbol, first)).orderBy("hour").toPandas()
        part = together.filter(f"symbol = '{symbol}'").orderBy("hour").toPandas()
        pd.testing.assert_frame_equal(alone, part, rtol=1e-12)


@pytest.mark.parametrize("block", [4096, 4])
def test_ffill_reaches_over_blocks(spark, block):
    closes = [None, 1.0, None, None, None, None, None, None, None, None, 2.0, None]
    got = column(ffill(prices(spark, closes), ["close"], Series(rows=block)), "close")
    assert got == [None] + [1.0] * 9 + [2.0] * 2


@pytest.mark.parametrize("block", [4096, 7])
def test_number_rows_with_holes(spark, block):
    df = prices(spark, [float(i) for i in range(40)]).filter("close % 3 != 0")
    numbered = number_rows(df, Series(rows=block))
    assert column(numbered, "rn") == list(range(1, 27)) and set(column(numbered, "n")) == {26}


def test_halo_filter_keeps_what_windows_need(spark, walk):
    bars = prices(spark, [float(v) for v in walk])
    part = with_halo(bars, "2024-01-05 00:00:00", "2024-01-06 00:00:00", before=20, after=24)
    assert part.count() == 20 + 25 + 24
    full = indicators.bollinger(bars).filter("hour between '2024-01-05' and '2024-01-06'").orderBy("hour").toPandas()
    cut = indicators.bollinger(part).filter("hour between '2024-01-05' and '2024-01-06'").orderBy("hour").toPandas()
    pd.testing.assert_frame_equal(full, cut, rtol=1e-9)


# --- long stretches without a move, spans far apart -------------------------------------------------


def plain_ema(x, span):
    out = [x[0]]
    for v in x[1:]:
        out.append(out[-1] + 2.0 / (span + 1) * (v - out[-1]))
    return np.array(out)


def quiet(n=7000):
    rng = np.random.default_rng(7)
    return [float(v) for v in 100 + rng.normal(size=200).cumsum()] + [77.0] * n


@pytest.mark.parametrize("block", [64, 700, 4096])
def test_rsi_stays_where_nothing_moves(spark, block):
    closes = quiet()
    up, down, want = 0.0, 0.0, []
    for i, c in enumerate(closes):
        change = c - closes[i - 1] if i else 0.0
        if change:
            last = i
        up, down = (13 * up + max(change, 0)) / 14, (13 * down + max(-change, 0)) / 14
        want.append(100 - 100 / (1 + up / down) if down > 1e-250 and i == last else want[-1] if want else 100.0)
    df = stage(prices(spark, closes), "quiet")
    got = column(indicators.rsi(df, spec=Series(rows=block)), "rsi")
    assert got[:13] == [None] * 13
    np.testing.assert_allclose(got[13:], want[13:], atol=1e-9)
    table = indicators.indicator_table(df.withColumns({"volume": F.lit(1.0)}), spec=Series(rows=block))
    np.testing.assert_allclose(column(table, "rsi")[13:], want[13:], atol=1e-9)


@pytest.mark.parametrize("spans", [(2, 26, 9), (12, 200, 3), (2, 2000, 2), (1, 5, 1)])
def test_macd_at_any_spans(spark, spans):
    fast, slow, signal = spans
    closes = quiet(3000)
    difference = plain_ema(closes, fast) - plain_ema(closes, slow)
    smooth = plain_ema(difference[slow - 1 :], signal)
    df = stage(prices(spark, closes), "quiet")
    for rows_ in (64, 4096):
        out = indicators.macd(df, *spans, spec=Series(rows=rows_))
        np.testing.assert_allclose(column(out, "macd")[slow - 1 :], difference[slow - 1 :], atol=1e-9)
        np.testing.assert_allclose(column(out, "macd_signal")[slow + signal - 2 :], smooth[signal - 1 :], atol=1e-9)
    table = indicators.indicator_table(df, macd_spans=spans)
    np.testing.assert_allclose(column(table, "macd")[slow - 1 :], difference[slow - 1 :], atol=1e-9)


@pytest.mark.parametrize("rows", [64, 700, 4096])
@pytest.mark.parametrize("spans", [(1, 2, 3), (12, 26, 9), (2, 300, 2000)])
def test_scans_over_blocks(spark, rows, spans):
    """Equal to the plain recursion, however far apart the spans are and wherever blocks end."""
    fast, slow, signal = spans
    values = np.cumsum(np.random.default_rng(5).normal(size=5000)) + 500
    spec = Series(rows=rows)
    got = indicators.macd(prices(spark, values.tolist()), fast, slow, signal, spec=spec)

    def scan(x, span):
        alpha, y = 2 / (span + 1), [x[0]]
        for v in x[1:]:
            y.append(alpha * v + (1 - alpha) * y[-1])
        return np.array(y)

    macd = scan(values, fast) - scan(values, slow)
    over = scan(macd[slow - 1 :], signal)
    rows_ = got.orderBy("hour").collect()
    np.testing.assert_allclose([r["macd"] for r in rows_[slow - 1 :]], macd[slow - 1 :], rtol=0, atol=1e-9)
    np.testing.assert_allclose([r["macd_signal"] for r in rows_[slow + signal - 2 :]], over[signal - 1 :], rtol=0, atol=1e-9)
    assert all(r["macd"] is None for r in rows_[: slow - 1])
