"""Ticks to bars: packed order keys equal struct ordering, as a hash aggregate."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from equityspark.sources import readers, views


def ticks(spark, n=3000):
    rng = random.Random(2)
    t0 = dt.datetime(1969, 12, 30)
    rows = [(f"T{rng.randrange(3) if i % 3 else 0}", t0 + dt.timedelta(seconds=rng.randrange(86400 * 5), microseconds=rng.randrange(3)), rng.random() * 9, 1, i) for i in range(n)]
    rows += [("T1", t0 + dt.timedelta(hours=i % 4), float(i), 1, 10**6 - i) for i in range(40)]
    rows += [("T2", None, 1.0, 1, 7), ("T2", t0, 2.0, 1, None)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, price double, qty long, id long").repartition(5)


@pytest.mark.parametrize("interval", ["1h", "1d", "1wk", "1mo"])
def test_packed_order_equals_struct_order(spark, interval):
    df = ticks(spark)
    packed = readers.resample_ohlcv(df, ["ticker"], "ts", "price", "qty", "id", interval)
    struct = readers.resample_ohlcv(df.withColumn("s", F.struct("id")), ["ticker"], "ts", "price", "qty", "s", interval)
    several = readers.resample_ohlcv(df.withColumn("hi", F.col("id") / 1000).withColumns({"hi": F.floor("hi"), "lo": F.col("id") % 1000}), ["ticker"], "ts", "price", "qty", [("hi", 6), ("lo", 3)], interval)
    key = lambda x: sorted(map(str, x.where("date IS NOT NULL").collect()))
    known = df.where("id IS NOT NULL AND ts IS NOT NULL")
    want = {}
    for r in known.withColumn("bar", readers.bucket_start(F.col("ts"), interval)).collect():
        want.setdefault((r["ticker"], r["bar"]), []).append((r["ts"], r["id"], r["price"]))
    got = {(r["ticker"], r["date"]): (r["open"], r["close"]) for r in packed.where("date IS NOT NULL").collect()}
    assert {k: (min(v)[2], max(v)[2]) for k, v in want.items()} == {k: got[k] for k in want}
    assert key(packed) == key(several)
    own = readers.resample_ohlcv(known.withColumn("s", F.struct("id")), ["ticker"], "ts", "price", "qty", "s", interval)
    assert key(own) == key(readers.resample_ohlcv(known, ["ticker"], "ts", "price", "qty", "id", interval)) and struct.columns == packed.columns


def test_bars_are_a_hash_aggregate(spark):
    plan = views.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_keys_beyond_their_digits_are_an_error(spark):
    df = spark.range(5).withColumn("n", F.lit(-1))
    for parts in ([(F.col("id") + 98, 2)], [(F.col("n"), 3)]):
        with pytest.raises(PySparkException):
            df.select(readers.packed_order(parts).alias("o")).collect()
    with pytest.raises(ValueError):
        readers.packed_order([(F.col("id"), 18), (F.col("id"), 18), (F.col("id"), 3)])
    wide = spark.createDataFrame([(10**17, 10**17 + 1, 99)], "a long, b long, c long").select(readers.packed_order([(F.col(c), d) for c, d in (("a", 18), ("b", 18), ("c", 2))]).alias("o"))
    assert int(wide.first()["o"]) == (10**17 * 10**18 + 10**17 + 1) * 100 + 99


def test_partitions_of_series_follow_the_trades(spark, tmp_path, monkeypatch):
    rows = [(i % 20, f"2024-01-{1 + i % 9:02d}", 100.0 + i, 2.0, i, 1, i) for i in range(600)]
    names = "l_suppkey long, l_shipdate string, l_extendedprice double, l_quantity double, l_orderkey long, l_linenumber int, l_partkey long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    few = sorted(map(tuple, views.bars(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(views, "SERIES_ROWS", 50)
    many = views.bars(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 12  # 600 trades, 50 each; the session has four shuffle partitions
    assert sorted(map(tuple, many.collect())) == few and few
    # one ticker lies in one partition, so series windows need no exchange of their own
    where = many.select("ticker", F.spark_partition_id().alias("p")).distinct()
    assert where.count() == where.select("ticker").distinct().count()
