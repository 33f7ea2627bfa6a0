"""Queries with an SQL twin, over whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import check_oracles  # noqa: E402

from volfuse.llm import oracles, queries  # noqa: E402


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", list(oracles.registered()))
def test_query(spark, name, sf):
    path = f"/root/testdata/{sf}"
    df = queries.registered()[name](spark, path)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(names).collect()]
    rel = check_oracles.duck(path).sql(oracles.registered()[name])
    assert sorted(rel.columns) == names
    assert check_oracles.compare(names, got, rel.select(", ".join(names)).fetchall()) == ""
