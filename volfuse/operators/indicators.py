"""Technical indicators and the volatility label, on gap-free bars.

Each indicator is a few column expressions over a panel. They come in three layers (neighbouring
rows, scans, scans of scans), and everything in one layer shares one window operator. Scans are continued
from block to block by one summary row per block; the rows of the first two layers are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volfuse.operators.series import HOURLY, Panel, Scan, Series, carry_over, scan_blocks, to_panel
from volfuse.session import stage


def _span(n: int) -> float:
    return 2.0 / (n + 1)


def _full(value: Column, counted: str, frame, n: int) -> Column:
    """A frame that is not full gives null."""
    return F.when(F.count(counted).over(frame) == n, value)


def _neighbours(panel: Panel, col: str = "close") -> dict[str, Column]:
    return {"_prev": F.lag(col).over(panel.window)}


def _return(kind: str, col: str) -> Column:
    ratio = F.try_divide(F.col(col), F.col("_prev"))
    if kind == "simple":
        return ratio - 1.0
    if kind == "log":
        return F.when(ratio > 0, F.ln(ratio))
    raise ValueError(f"unknown return kind {kind!r}")


def _label(panel: Panel, n: int, col: str) -> Column:
    ahead = panel.frame(1, n)
    return _full(F.stddev_samp(col).over(ahead), col, ahead, n)


def _bands(panel: Panel, n: int, k: float, col: str) -> dict[str, Column]:
    frame = panel.frame(1 - n, 0)
    middle = _full(F.avg(col).over(frame), col, frame, n)
    reach = F.stddev_pop(col).over(frame) * F.lit(float(k))
    return {"bollinger_h": middle + reach, "bollinger_l": middle - reach}


def _moves(col: str) -> dict[str, Column]:
    """Gain and loss of each step; a step without predecessor has neither."""
    change = F.col(col) - F.col("_prev")
    return {"_gain": F.when(change > 0, change).otherwise(0.0), "_loss": F.when(change < 0, -change).otherwise(0.0)}


def _rsi_scans(n: int) -> list[Scan]:
    return [Scan("_up", "_gain", 1.0 / n), Scan("_dn", "_loss", 1.0 / n)]


def _index() -> Column:
    """The index on rows with a move. A step without a move shrinks both averages alike and leaves it as it was."""
    strength = F.try_divide("_up", "_dn")
    index = F.coalesce(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + strength), F.lit(100.0))
    return F.when(F.col("_gain") + F.col("_loss") > 0, index)


def _rsi(n: int) -> Column:
    """The index of the last move; 100 where nothing was lost because nothing ever moved."""
    return F.when(F.col("_n__gain") >= n, F.coalesce("rsi", F.lit(100.0)))


def _macd_scans(fast: int, slow: int, col: str) -> list[Scan]:
    return [Scan("_fast", col, _span(fast)), Scan("_slow", col, _span(slow))]


def _macd(slow: int, col: str) -> Column:
    return F.when(F.col(f"_n_{col}") >= slow, F.col("_fast") - F.col("_slow"))


def _signal(slow: int, signal: int, col: str) -> Column:
    return F.when(F.col(f"_n_{col}") >= slow + signal - 1, F.col("macd_signal"))


def _scanned(panel: Panel, scans: list[Scan], **more: Column) -> Panel:
    """The scans of the panel's own rows, from the first row of the series on; the rows are written once."""
    inner = scan_blocks(panel, scans).add(**more)
    return inner.over(carry_over(inner.over(stage(inner.placed(), "scans")), scans))


def _true_range() -> Column:
    high, low, previous = F.col("high"), F.col("low"), F.col("_prev")
    return F.greatest(high - low, F.abs(high - previous), F.abs(low - previous))


# --- one indicator at a time ------------------------------------------------------------------


def _given(df: DataFrame, out: DataFrame, *added: str) -> DataFrame:
    return out.select(*[c for c in df.columns if c not in added], *added)


def returns(df: DataFrame, kind: str = "simple", col: str = "close", out: str = "return", spec: Series = HOURLY):
    """Change against the previous step; null on the first row and after a zero price."""
    panel = to_panel(df, spec, before=1)
    panel = panel.add(**_neighbours(panel, col)).add(**{out: _return(kind, col)})
    return _given(df, panel.home(), out)


def forward_vol(df: DataFrame, n: int = 24, col: str = "return", out: str = "future_volatility", spec: Series = HOURLY):
    """Sample deviation of the next ``n`` returns; null unless all of them exist."""
    panel = to_panel(df, spec, after=n)
    return _given(df, panel.add(**{out: _label(panel, n, col)}).home(), out)


def returns_and_label(df: DataFrame, kind: str = "simple", n: int = 24, spec: Series = HOURLY) -> DataFrame:
    panel = to_panel(df, spec, before=1, after=n)
    panel = panel.add(**_neighbours(panel)).add(**{"return": _return(kind, "close")})
    return _given(df, panel.add(future_volatility=_label(panel, n, "return")).home(), "return", "future_volatility")


def bollinger(df: DataFrame, n: int = 20, k: float = 2, col: str = "close", spec: Series = HOURLY) -> DataFrame:
    """Mean of ``n`` steps plus and minus ``k`` population deviations."""
    panel = to_panel(df, spec, before=n - 1)
    return _given(df, panel.add(**_bands(panel, n, k, col)).home(), "bollinger_h", "bollinger_l")


def moving_avg(df: DataFrame, col: str, n: int, out: str, spec: Series = HOURLY) -> DataFrame:
    """Mean of the last ``n`` steps; null unless all of them have a value."""
    panel = to_panel(df, spec, before=n - 1)
    frame = panel.frame(1 - n, 0)
    return _given(df, panel.add(**{out: _full(F.avg(col).over(frame), col, frame, n)}).home(), out)


def rsi(df: DataFrame, n: int = 14, col: str = "close", spec: Series = HOURLY) -> DataFrame:
    """Relative strength from Wilder averages of gains and losses; 100 when nothing was lost."""
    panel = to_panel(df, spec, before=1)
    panel = _scanned(panel.add(**_neighbours(panel, col)).add(**_moves(col)), _rsi_scans(n)).add(rsi=_index())
    panel = panel.add(rsi=F.last("rsi", ignorenulls=True).over(panel.so_far))
    return _given(df, carry_over(panel, [], ["rsi"]).withColumn("rsi", _rsi(n)), "rsi")


def macd(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close", spec: Series = HOURLY
) -> DataFrame:
    """Difference of two exponential means, and the exponential mean of that difference."""
    panel = _scanned(to_panel(df, spec), _macd_scans(fast, slow, col)).add(macd=_macd(slow, col))
    over = [Scan("macd_signal", "macd", _span(signal))]
    out = carry_over(scan_blocks(panel, over), over).withColumn("macd_signal", _signal(slow, signal, col))
    return _given(df, out, "macd", "macd_signal")


def atr(df: DataFrame, n: int = 14, spec: Series = HOURLY) -> DataFrame:
    """Wilder average of the true range, started by the mean of the first ``n``."""
    panel = to_panel(df, spec, before=1)
    panel = panel.add(**_neighbours(panel)).add(_tr=_true_range())
    return _given(df, _scanned(panel, [Scan("atr", "_tr", 1.0 / n, head=n)]).home(), "atr")


# --- all of them ------------------------------------------------------------------------------


ADDED = ["rsi", "macd", "macd_signal", "bollinger_h", "bollinger_l", "atr", "return", "future_volatility"]


def indicator_table(
    bars: DataFrame,
    rsi_n: int = 14,
    macd_spans: tuple[int, int, int] = (12, 26, 9),
    bands: tuple[int, float] = (20, 2),
    atr_n: int = 14,
    label_n: int = 24,
    kind: str = "simple",
    spec: Series = HOURLY,
) -> DataFrame:
    """Indicators, return and label of gap-free bars; warm-up and tail rows hold nulls."""
    fast, slow, signal = macd_spans
    panel = to_panel(bars, spec, before=max(1, bands[0] - 1), after=label_n)
    panel = panel.add(**_neighbours(panel), **_bands(panel, *bands, "close"))
    panel = panel.add(**_moves("close"), _tr=_true_range(), **{"return": _return(kind, "close")})
    scans = [*_rsi_scans(rsi_n), *_macd_scans(fast, slow, "close"), Scan("atr", "_tr", 1.0 / atr_n, head=atr_n)]
    panel = _scanned(panel, scans, future_volatility=_label(panel, label_n, "return"))
    panel = panel.add(rsi=_index(), macd=_macd(slow, "close"))
    over = [Scan("macd_signal", "macd", _span(signal))]
    panel = scan_blocks(panel, over).add(rsi=F.last("rsi", ignorenulls=True).over(panel.so_far))
    out = carry_over(panel, over, ["rsi"])
    return _given(bars, out.withColumns({"rsi": _rsi(rsi_n), "macd_signal": _signal(slow, signal, "close")}), *ADDED)


def price_features(bars: DataFrame, **settings) -> DataFrame:
    """``indicator_table`` without its incomplete rows."""
    return indicator_table(bars, **settings).na.drop("any")
