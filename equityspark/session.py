"""Session settings the engine expects; harmless to apply to an existing session."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "equityspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with adaptive execution, skew handling and UTC time.

    No shuffle-partition count is fixed here: adaptive execution starts from the
    cluster's own default and coalesces. Small local runs pass their own value.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) gets a temporary folder; on a cluster a missing setting
    is an error, because machine-local files do not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current, configured = sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    in_one_process = re.fullmatch(r"local(\[.*\])?", sc.master) is not None
    if current and (configured or in_one_process):
        return current
    if not configured:
        if not in_one_process:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        configured = tempfile.mkdtemp(prefix="equityspark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame, prefix: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and continue from the files:
    later passes read only the columns they need."""
    path = scratch_folder(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """Name of a new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
