"""Versioned Parquet tables: staged folders and one manifest that names the current version (ids A5, A12, A17).

A change writes new folders first (rows, or keys that are deleted) and then one small manifest
file; readers follow the newest manifest, so a write that stops half-way leaves the old
version readable, and of two writers that start from the same version one fails. A delete or
a replacement writes the keys concerned and no data: rows are dropped on reading by an
anti-join on the keys, until ``compact`` folds the deletes in.

The rows of a folder are dealt by ranges of (partition, keys) and sorted, so a filter on the
partition skips files and row groups by their statistics, and the number of files follows the
bytes written and not the number of partition values.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSIONS, DATA = "_versions", "_data"


class VersionConflict(RuntimeError):
    """Another writer published a version first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class VersionedTable:
    """Rows of one schema under ``path``; ``keys`` identify what is deleted or replaced, ``partition`` orders the files and prunes."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str):
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), keys, partition

    # Manifests ---------------------------------------------------------------------
    def versions(self) -> list[int]:
        fs, where = _fs(self.spark, f"{self.path}/{VERSIONS}")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json") and not f.getPath().getName().startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``version`` (0: none yet), ``schema``, ``data`` and ``deletes``: lists of [sequence, folder]."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "data": [], "deletes": []}
        text = self.spark.read.text(f"{self.path}/{VERSIONS}/{version:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, old: dict, **change) -> int:
        version = old["version"] + 1
        body = json.dumps({**old, **change, "version": version})
        fs, final = _fs(self.spark, f"{self.path}/{VERSIONS}/{version:010d}.json")
        _, staged = _fs(self.spark, f"{self.path}/{VERSIONS}/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(body.encode()))
        out.close()
        # a rename is one step; where it would overwrite, the check before it decides
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise VersionConflict(f"version {version} of {self.path} exists")
        return version

    def _stage(self, df: DataFrame) -> str:
        folder = f"{DATA}/{uuid.uuid4().hex}"
        by = [c for c in dict.fromkeys([self.partition, *self.keys]) if c in df.columns]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{self.path}/{folder}")
        return folder

    # Reading -----------------------------------------------------------------------
    def _union(self, parts: list, schema: StructType) -> DataFrame:
        """All folders with their sequence number ``_seq``."""
        out = None
        for seq, folder in parts:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn("_seq", F.lit(seq))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], StructType([*schema.fields])).withColumn("_seq", F.lit(0))

    def read(self, version: int | None = None) -> DataFrame:
        """Live rows of a version (default: the newest)."""
        return self._live(self.manifest(version)).drop("_seq")

    def _live(self, state: dict) -> DataFrame:
        if state["schema"] is None:
            raise ValueError(f"no version of {self.path} yet")
        schema = StructType.fromJson(state["schema"])
        rows = self._union(state["data"], schema)
        if not state["deletes"]:
            return rows
        gone = self._union(state["deletes"], StructType([schema[c] for c in self.keys]))
        gone = gone.groupBy(*self.keys).agg(F.max("_seq").alias("_gone"))  # a delete acts on rows written before it
        return rows.join(gone.withColumnsRenamed({c: f"_d_{c}" for c in self.keys}),
                         [F.col(c) == F.col(f"_d_{c}") for c in self.keys] + [F.col("_seq") < F.col("_gone")], "left_anti")

    # Changes -----------------------------------------------------------------------
    def append(self, df: DataFrame) -> int:
        state = self.manifest()
        return self._publish(state, schema=state["schema"] or df.schema.jsonValue(), data=[*state["data"], [state["version"] + 1, self._stage(self._shaped(df, state))]])

    def _shaped(self, df: DataFrame, state: dict) -> DataFrame:
        return df if state["schema"] is None else df.select(*StructType.fromJson(state["schema"]).names)

    def _marks(self, state: dict, keys: DataFrame) -> str:
        """Stage those of ``keys`` that live rows have."""
        return self._stage(self._live(state).select(*self.keys).join(keys.select(*self.keys).distinct(), self.keys, "left_semi").distinct())

    def delete(self, keys: DataFrame) -> int:
        """Delete all rows with one of ``keys``; writes no data file."""
        state = self.manifest()
        if state["schema"] is None:
            return 0
        return self._publish(state, deletes=[*state["deletes"], [state["version"] + 1, self._marks(state, keys)]])

    def replace(self, df: DataFrame) -> int:
        """Rows of ``df`` instead of all rows with their keys, in one version."""
        state = self.manifest()
        if state["schema"] is None:
            return self.append(df)
        seq = state["version"] + 1
        return self._publish(state, deletes=[*state["deletes"], [seq, self._marks(state, df)]], data=[*state["data"], [seq, self._stage(self._shaped(df, state))]])

    def append_new(self, df: DataFrame) -> int:
        """Append rows whose keys the table does not hold."""
        state = self.manifest()
        fresh = df if state["schema"] is None else df.join(self._live(state).select(*self.keys), self.keys, "left_anti")
        return self._publish(state, schema=state["schema"] or df.schema.jsonValue(), data=[*state["data"], [state["version"] + 1, self._stage(self._shaped(fresh, state))]])

    def compact(self) -> int:
        """One folder with the live rows, no deletes; older versions stay readable until ``vacuum``."""
        state = self.manifest()
        return self._publish(state, data=[[state["version"] + 1, self._stage(self._live(state).drop("_seq"))]], deletes=[])

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but the newest ``keep`` and folders none of those names; returns the folders removed."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        named = {folder for m in kept for _, folder in [*m["data"], *m["deletes"]]}
        for v in known[:-keep]:
            fs, where = _fs(self.spark, f"{self.path}/{VERSIONS}/{v:010d}.json")
            fs.delete(where, False)
        fs, root = _fs(self.spark, f"{self.path}/{DATA}")
        stale = [f.getPath() for f in fs.listStatus(root) if f"{DATA}/{f.getPath().getName()}" not in named]
        for p in stale:
            fs.delete(p, True)
        return len(stale)
