"""Random small series against pandas, with blocks of a few rows."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import at
from volfuse.operators.bars import fill_bars
from volfuse.operators.series import Series, ffill, number_rows

SCHEMA = "symbol string, hour timestamp_ntz, open double, high double, low double, close double, volume double, vwap double"
VALUE = st.one_of(st.none(), st.integers(1, 9).map(float))
HOURS = st.dictionaries(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), st.tuples(VALUE, VALUE), min_size=1, max_size=25)
quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows_of(cells):
    return [(s, at(h), c, c, c, c, 1.0, v) for (s, h), (c, v) in cells.items()]


def frame(cells):
    named = pd.DataFrame(rows_of(cells), columns=["symbol", "hour", "open", "high", "low", "close", "volume", "vwap"])
    return named.astype({c: float for c in named.columns[2:]})


def same(got, want, cols):
    def listed(df):
        ordered = df.sort_values(["symbol", "hour"])[["symbol", "hour", *cols]].astype(object)
        return ordered.where(ordered.notna(), None).values.tolist()

    assert listed(got) == listed(want)


@quick
@given(cells=HOURS, block=st.integers(1, 9))
def test_grid_and_carry(spark, cells, block):
    given_rows = frame(cells)
    got = fill_bars(spark.createDataFrame(rows_of(cells), SCHEMA), Series(rows=block)).toPandas()
    parts = []
    for symbol, part in given_rows.groupby("symbol"):
        grid = part.set_index("hour").drop(columns="symbol").astype(float).resample("h").first()
        grid["volume"] = grid["volume"].fillna(0)
        parts.append(grid.ffill().reset_index().assign(symbol=symbol))
    same(got, pd.concat(parts), ["open", "close", "volume", "vwap"])


@quick
@given(cells=HOURS, block=st.integers(1, 9))
def test_fill_and_number(spark, cells, block):
    given_rows = frame(cells)
    df = spark.createDataFrame(rows_of(cells), SCHEMA)
    got = number_rows(ffill(df, ["close", "vwap"], Series(rows=block)), Series(rows=block)).toPandas()
    want = given_rows.sort_values(["symbol", "hour"]).reset_index(drop=True)
    want[["close", "vwap"]] = want.groupby("symbol")[["close", "vwap"]].ffill()
    want["rn"] = want.groupby("symbol").cumcount() + 1
    want["n"] = want.groupby("symbol")["hour"].transform("size")
    same(got, want, ["close", "vwap", "rn", "n"])
