"""Every registered query against its SQL twin, over whole tables of the smallest scale."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracles  # noqa: E402
from volfuse.session import clear_stages  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
#: Queries of the package for documents have tests of their own.
NAMES = [name for name in entry.queries() if name not in entry.LLM_QUERIES]


@pytest.fixture(scope="module")
def duck():
    return check_oracles.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    clear_stages(spark)
    assert got
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == names
        want = rel.select(", ".join(f'"{c}"' for c in names)).fetchall()
        assert check_oracles.compare(names, got, want) == ""


def test_registry():
    assert set(SQL) <= set(entry.queries())
    rows_only = set(NAMES) - set(SQL)
    assert rows_only == {
        "text_scorer", "linreg_metrics", "forest_metrics", "top_features", "lagged_metrics", "test_predictions", "scenario_models",
    }


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["symbol", "hour"]
