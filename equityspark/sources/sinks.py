"""Writes: replace-by-key, upsert, exports (ids A5, A6, A10-A12, A14, A16-A18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equityspark.functions.core import latest_per

TICKER_BUCKETS = 256


def ticker_bucket(buckets: int = TICKER_BUCKETS):
    """Directory key for ticker tables: a fixed number of folders however many tickers."""
    return F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")


def write_by_ticker(df: DataFrame, path: str, buckets: int = TICKER_BUCKETS) -> None:
    """Full write, partitioned by ticker bucket and sorted by (ticker, date) inside files,
    so that a ticker predicate prunes folders and then row groups.

    The shuffle key is (bucket, year) so one bucket is written by several tasks.
    """
    year = F.year("date") if "date" in df.columns else F.lit(0)
    (
        df.withColumn("ticker_bucket", ticker_bucket(buckets))
        .repartition("ticker_bucket", year)
        .sortWithinPartitions("ticker", *(["date"] if "date" in df.columns else []))
        .write.mode("overwrite").partitionBy("ticker_bucket").parquet(path)
    )


def replace_tickers(spark: SparkSession, new: DataFrame, path: str, staging: str, buckets: int = TICKER_BUCKETS) -> None:
    """Delete the tickers of ``new`` from the table and append their new rows.

    Only the touched buckets are rewritten (dynamic partition overwrite). The merged
    rows go to ``staging`` first because Spark cannot overwrite files it is reading.
    """
    tagged = new.withColumn("ticker_bucket", ticker_bucket(buckets))
    year = F.year("date") if "date" in new.columns else F.lit(0)
    touched = tagged.select("ticker_bucket").distinct()
    old = spark.read.parquet(path)
    kept = old.join(F.broadcast(touched), "ticker_bucket", "left_semi").join(
        new.select("ticker").distinct(), "ticker", "left_anti"
    )  # ``touched`` has at most ``buckets`` rows
    kept.unionByName(tagged, allowMissingColumns=True).write.mode("overwrite").parquet(staging)
    (
        spark.read.parquet(staging).repartition("ticker_bucket", year)
        .sortWithinPartitions("ticker", *(["date"] if "date" in new.columns else [])).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("ticker_bucket").parquet(path)
    )


def upsert(current: DataFrame | None, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key of both inputs; ``order`` decides which is latest."""
    both = changes if current is None else current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return latest_per(both, keys, F.struct(*order), rest)


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV in as many files as there are partitions; columns must be unique names."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_universe(df: DataFrame, path: str, name: str, description: str = "", updated: str | None = None) -> None:
    """One universe as JSON: {name, description, last_updated, tickers, sectors}.

    A universe file holds the members of one named list (hundreds of tickers).
    """
    sectors = df.where(F.col("sector").isNotNull()).groupBy("sector").agg(F.sort_array(F.collect_set("ticker")).alias("t"))
    by_sector = sectors.agg(F.map_from_entries(F.collect_list(F.struct("sector", "t"))).alias("sectors"))
    listed = df.agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    out = listed.join(F.broadcast(by_sector)).select(
        F.lit(name).alias("name"),
        F.lit(description).alias("description"),
        (F.lit(updated) if updated else F.date_format(F.current_timestamp(), "yyyy-MM-dd")).alias("last_updated"),
        "tickers",
        "sectors",
    )
    out.write.mode("overwrite").json(path)


def append_analyses(df: DataFrame, path: str) -> None:
    """Append reports, foldered by date."""
    df.write.mode("append").partitionBy("date").parquet(path)


def delete_by_id(spark: SparkSession, path: str, staging: str, ids: DataFrame, key: str = "doc_id") -> None:
    """Remove reports by id; only the date folders that hold one of them are rewritten.

    Folders left without a report are deleted one by one, as they are found; their names
    are streamed to the driver, so there is no limit on their number.
    """
    stored = spark.read.parquet(path)
    days = stored.join(ids.select(key), key, "left_semi").select("date").distinct()
    kept = stored.join(days, "date", "left_semi").join(ids.select(key), key, "left_anti")
    emptied = days.join(kept.select("date").distinct(), "date", "left_anti")
    kept.write.mode("overwrite").parquet(staging)
    emptied.write.mode("overwrite").parquet(f"{staging}-emptied")  # decided before the store changes
    spark.read.schema(kept.schema).parquet(staging).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("date").parquet(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in spark.read.schema("date date").parquet(f"{staging}-emptied").toLocalIterator():
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"date={row['date']}"), True)


def restore_analyses(spark: SparkSession, backup: str, path: str, schema) -> None:
    """Load all backed-up JSON reports that the store does not hold yet, keeping their ids."""
    saved = spark.read.schema(schema).json(backup)
    known = spark.read.parquet(path).select("doc_id")
    append_analyses(saved.join(known, "doc_id", "left_anti"), path)
