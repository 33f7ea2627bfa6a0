import pytest
from pyspark.sql import functions as F

from helpers import at, column, prices, trade, trades
from volfuse.operators import fusion
from volfuse.operators.bars import hourly_bars
from volfuse.operators.sentiment import clean_posts
from volfuse.schema import RESULTS
from volfuse.session import clear_stages, refuse_temporary, shared_dir, stage
from volfuse.sources import tables
from volfuse.sources.columns import numeric_cols, resolve_price_col, resolve_ts_col


def text_file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_market_csv(spark, tmp_path):
    path = text_file(
        tmp_path, "m.csv",
        "Timestamp,Open,High,Low,Close,Volume\n1704067260.0,1,3,1,2,10\n1704067320,2,4,2,NaN,5\nbad,1,1,1,1,1\n"
        "2024-01-01 01:30:00,5,5,5,,7\n",
    )
    raw = tables.read_bars(spark, path, symbol="btc")
    assert raw.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"] and raw.count() == 4
    bars = hourly_bars(raw).orderBy("hour").collect()
    assert [(b["symbol"], b["hour"], b["open"], b["volume"]) for b in bars] == [
        ("btc", at(0), 1.0, 15.0),
        ("btc", at(1), 5.0, 7.0),
    ]


def test_market_parquet_round_trip(spark, tmp_path):
    feed = trades(spark, trade(0.5, 1, 3.0), trade(1.5, 2, 4.0))
    tables.write_table(feed.withColumnRenamed("ts", "timestamp"), str(tmp_path / "p"))
    assert column(tables.read_bars(spark, str(tmp_path / "p"), "parquet"), "ts", "ts") == [at(0.5), at(1.5)]


def test_posts_csv(spark, tmp_path):
    path = text_file(
        tmp_path, "t.csv",
        'id;timestamp ;text;likes;retweets;replies\n1;2018-01-01 00:00:01+00;"two\nlines; ""q""";3;4;5\n2;x;üç;a;;\n',
    )
    posts = tables.read_posts(spark, path, multi_line=True)
    assert posts.columns == ["timestamp", "text", "replies", "likes", "retweets"]
    got = clean_posts(posts, min_length=1).orderBy("text").collect()
    assert [(r["text"], r["likes"], r["retweets"], r["replies"]) for r in got] == [('two lines; "q"', 3, 4, 5), ("üç", 0, 0, 0)]


def test_table_round_trip(spark, tmp_path):
    results = spark.createDataFrame([("m", 0.1, 1 / 3, None)], RESULTS)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        tables.write_table(results, path, fmt)
        assert tables.read_table(spark, path, RESULTS, fmt).collect() == results.collect()


def test_partitioned_write_prunes(spark, tmp_path):
    path = str(tmp_path / "bars")
    both = prices(spark, [1.0, 2.0]).unionByName(prices(spark, [3.0], "b"))
    tables.write_table(both, path, partition_by=["symbol"])
    part = spark.read.parquet(path).filter("symbol = 'b'")
    assert column(part, "close") == [3.0]
    assert "PartitionFilters: [isnotnull(symbol" in part._jdf.queryExecution().executedPlan().toString()


def test_missing_inputs(spark, tmp_path):
    missing = str(tmp_path / "none")
    empty = tables.read_optional(spark, missing)
    assert empty.count() == 0 and empty.columns == ["model", "MAE", "RMSE", "R2"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, missing)
    with pytest.raises(FileNotFoundError):
        tables.require(spark, missing)
    tables.require(spark, str(tmp_path))


def test_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "date string, time string, CLOSE double")
    assert resolve_ts_col(df) == "date" and resolve_price_col(df) == "CLOSE"
    other = spark.createDataFrame([("x", 2.0, 3)], "when string, price double, size int")
    assert resolve_ts_col(other) == "when" and resolve_price_col(other) == "price"
    assert numeric_cols(other) == ["price", "size"]


def test_price_under_another_name(spark, tmp_path):
    path = text_file(tmp_path, "o.csv", "date,price\n2024-01-01 00:10:00,7\n")
    row = tables.read_bars(spark, path).first()
    assert (row["ts"], row["close"], row["volume"]) == (at(1 / 6), 7.0, None)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert [tuple(r) for r in tables.profile(df).collect()] == [("a", True, 2, 1), ("b", False, 2, 2)]
    assert tables.head(prices(spark, [1.0, 2.0, 3.0]), "hour", 2).count() == 2


def test_stages_live_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    assert f"{shared_dir(spark)}/volfuse/numbers-" in staged.inputFiles()[0] and staged.count() == 10
    clear_stages(spark)
    with pytest.raises(Exception):
        staged.count()


def test_price_is_the_first_column_of_numbers(spark, tmp_path):
    path = text_file(tmp_path, "v.csv", "Timestamp,Venue,Price,Size\n1704067260,x1,3.5,2\n1704067320,x2,,4\n")
    rows = tables.read_bars(spark, path).orderBy("ts").collect()
    assert [r["close"] for r in rows] == [3.5, None]


def test_long_post_files_are_split(spark, tmp_path):
    path = text_file(tmp_path, "posts.csv", "timestamp;text\n" + "2024-01-01 00:00:00;with it\n" * 40_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert tables.read_posts(spark, path).rdd.getNumPartitions() > 3
        quoted = tables.read_posts(spark, path, multi_line=True)
        assert quoted.rdd.getNumPartitions() > 3 and quoted.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_machines_own_folder_is_refused(spark):
    for folder in ("/tmp/x", "file:///tmp/x/y"):
        with pytest.raises(RuntimeError, match="temporary"):
            refuse_temporary(spark, folder)
    refuse_temporary(spark, "file:///mnt/shared/x")


def test_a_rerun_replaces_its_own_days(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.createDataFrame([(1, "mon"), (2, "mon"), (3, "tue")], "v int, day string")
    tables.write_parts(df, path, ["day"])
    for _ in range(2):
        tables.write_parts(spark.createDataFrame([(7, "tue"), (8, "wed")], "v int, day string"), path, ["day"])
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "day").collect())) == [(1, "mon"), (2, "mon"), (7, "tue"), (8, "wed")]


def test_days_outside_the_range_are_not_read(spark, tmp_path):
    """Posts stored by day: files of other days are spoilt, and nobody notices."""
    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00" if i % 10 else "bad", "x" * (i % 7)) for i in range(300)]
    posts = spark.createDataFrame(rows, "post_id long, timestamp string, text string")
    path = tmp_path / "by-day"
    tables.write_by_day(posts, str(path), "timestamp")
    stored = tables.read_by_day(spark, str(path), posts.schema)
    assert sorted(tuple(r) for r in stored.drop("day").collect()) == sorted(rows)
    hours = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-03 22:00:00', timestamp_ntz'2024-01-05 01:00:00')) AS hour")
    for part in path.glob("day=*"):
        if part.name not in {"day=2024-01-03", "day=2024-01-04", "day=2024-01-05"}:
            for file in part.glob("*.parquet"):
                file.write_bytes(b"spoilt")
            for checksum in part.glob(".*.crc"):
                checksum.unlink()
    got = fusion.days_of(stored, hours)
    want = [r for r in rows if r[1][:10] in {"2024-01-03", "2024-01-04", "2024-01-05"}]
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)
    with pytest.raises(Exception):
        stored.agg({"text": "max"}).collect()


def test_one_day_stored_again(spark, tmp_path):
    path = str(tmp_path / "by-day")
    posts = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "post_id long, timestamp string")
    for rows in (posts, posts.where("post_id = 2").withColumn("post_id", F.lit(3).cast("long"))):
        tables.write_by_day(rows, path, "timestamp")
    assert sorted(r["post_id"] for r in tables.read_by_day(spark, path, posts.schema).collect()) == [1, 3]
