"""Quoted records that cross the bounds of splits, against Python's csv module."""

import csv
import random

import pytest

from volfuse.sources.records import begin_inside, ends_inside, read_quoted, _lines

PART = ["a", "bc", ";", "\n", '"', "é", " ", "some longer text ", "\n\n", "1"]


def written(path, rows, names):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter=";", lineterminator="\n")
        out.writerow(names)
        out.writerows(rows)


def fields(rng, most):
    return ["".join(rng.choice(PART) for _ in range(rng.randrange(most))) for _ in range(3)]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [37, 200, 5000])
def test_records_across_splits(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    want = []
    for k in range(2):
        rows = [[f"{k}-{i}", *fields(rng, 10)] for i in range(60)]
        want += rows
        written(tmp_path / f"{k}.csv", rows, ["id", "x", "y y", "z"])
    small_splits(size)
    df = read_quoted(spark, str(tmp_path), ";")
    assert df.columns == ["id", "x", "y y", "z"]
    assert sorted([c or "" for c in r] for r in df.collect()) == sorted(want)
    assert size > 1000 or _lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4


def test_a_field_over_many_splits(spark, tmp_path, small_splits):
    """A text of many lines that fills whole splits belongs to one record."""
    text = "\n".join(f"line {i}" for i in range(300))
    written(tmp_path / "x.csv", [["1", text], ["2", "b"], ["3", text], ["4", ""]], ["id", "text"])
    small_splits(100)
    got = {r.id: r.text for r in read_quoted(spark, str(tmp_path / "x.csv"), ";").collect()}
    assert got == {"1": text, "2": "b", "3": text, "4": None}
    assert begin_inside(_lines(spark, str(tmp_path)), ";").count() > 10


@pytest.mark.parametrize(
    ("line", "inside", "want"),
    [
        ("a;b", False, False), ("a;b", True, True), ('"a', False, True), ('a"', True, False), ('a""', True, True), ('"a";"b', False, True),
        ('5" wide;"x"', False, False), ('say ""x"";y', True, True), ('x";"y', True, True), ('x";y"', True, False), ('""', False, False), ("", True, True),
    ],
)
def test_state_after_a_line(line, inside, want):
    assert ends_inside(line, inside, ";") == want


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_quoted(spark, str(tmp_path / "empty.csv")).columns == []
    (tmp_path / "crlf.csv").write_bytes(b'\xef\xbb\xbfid,"te""xt"\r\n1,"a\r\nb"\r\n\r\n2\r\n')
    df = read_quoted(spark, str(tmp_path / "crlf.csv"))
    assert df.columns == ["id", 'te"xt'] and sorted(tuple(r) for r in df.collect()) == [("1", "a\r\nb"), ("2", None)]
