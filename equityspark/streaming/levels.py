"""Upserts from a stream kept in levels (ids J8, A6).

Every micro-batch is reduced to its newest row per key and written to a folder of level 0.
When ``fanout`` folders of a level are complete they are merged into one of the next level,
so after n batches a reader opens at most ``fanout - 1`` folders per level and log n levels,
and a row is rewritten once per level. A folder is named by the batches it covers: a retried
batch overwrites its own folders, a reader takes the widest folders and skips what they
cover, and covered folders are deleted one merge later.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from equityspark.sources.sinks import upsert
from equityspark.streaming.event_log import each_batch

FANOUT = 8
FILE_ROWS = 4_000_000
_NAME = re.compile(r"level=(\d+)-from=(\d+)-to=(\d+)")


def _name(level: int, first: int, last: int) -> str:
    return f"level={level}-from={first}-to={last}"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(level, first, last) of the complete folders, widest first."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    found = []
    for f in fs.listStatus(where):
        m = _NAME.fullmatch(f.getPath().getName())
        if m and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found.append(tuple(map(int, m.groups())))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def active(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Folders that no wider one covers."""
    out: list[tuple[int, int, int]] = []
    for level, first, last in found:
        if not any(a <= first and last <= z for _, a, z in out):
            out.append((level, first, last))
    return sorted(out, key=lambda x: x[1])


def upsert_levels(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], fanout: int = FANOUT, file_rows: int = FILE_ROWS) -> StreamingQuery:
    """Newest row per key by ``order`` of a stream, in levels under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _put(spark, upsert(None, batch, keys, order), f"{path}/{_name(0, batch_id, batch_id)}", keys, file_rows)
        width, level = fanout, 0
        while (batch_id + 1) % width == 0:
            level += 1
            first, step = batch_id + 1 - width, width // fanout
            parts = [f"{path}/{_name(level - 1, a, a + step - 1)}" for a in range(first, batch_id + 1, step)]
            merged = upsert(None, spark.read.schema(batch.schema).parquet(*parts), keys, order)
            _put(spark, merged, f"{path}/{_name(level, first, batch_id)}", keys, file_rows)
            width *= fanout
        # folders that were covered before this batch: a retry of it needs none of them
        found = folders(spark, path)
        covers = [(a, z) for _, a, z in found if z < batch_id]
        for level, a, z in found:
            if any((b, y) != (a, z) and b <= a and z <= y for b, y in covers):
                fs, where = _fs(spark, f"{path}/{_name(level, a, z)}")
                fs.delete(where, True)

    return each_batch(changes, write, checkpoint)


def _put(spark: SparkSession, df: DataFrame, path: str, keys: list[str], file_rows: int) -> None:
    """One file per ``file_rows`` rows, each a key range: rows are counted in the staged form, not computed twice."""
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    parts = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    fs, where = _fs(spark, staged)
    fs.delete(where, True)


def read_levels(spark: SparkSession, path: str, keys: list[str], order: list[str], schema) -> DataFrame:
    """Newest row per key over all levels."""
    parts = [f"{path}/{_name(*f)}" for f in active(folders(spark, path))]
    if not parts:
        return spark.createDataFrame([], schema)
    return upsert(None, spark.read.schema(schema).parquet(*parts), keys, order).select(*spark.createDataFrame([], schema).columns)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: list[str], schema, file_rows: int = FILE_ROWS) -> None:
    """The whole newest state as one folder of key ranges."""
    _put(spark, read_levels(spark, path, keys, order, schema), target, keys, file_rows)
