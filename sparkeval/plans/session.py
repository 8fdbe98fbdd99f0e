"""Session settings and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits a join partition that one key has made too large. By default Spark skips
# that when it costs one more shuffle (a groupBy on the join key); a straggler costs more.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Event-time windows are aligned to UTC; so are times without a zone when they are read.
TIME_ZONE = {"spark.sql.session.timeZone": "UTC"}


# Python workers look for the package where the driver found it, besides their own path.
ROOT = str(Path(__file__).resolve().parents[2])


def configure(spark: SparkSession) -> SparkSession:
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key, value in {**ADAPTIVE, **TIME_ZONE}.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the storage that all executors share.

    Only a local session may lack the setting; it then gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="sparkeval-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to shared storage and read it back: later plans start from files, so a lost executor
    costs a re-read, and each reader scans only the columns it needs."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, few: int = 16) -> DataFrame:
    """Hash-partition a table that is read in a few pieces only, fewer than the session has cores.

    One small file is one task, however much work each row takes. A piece is at most
    ``spark.sql.files.maxPartitionBytes`` large, so what is shuffled here is bounded; a table in
    ``few`` pieces or more passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    enough = df.rdd.getNumPartitions() >= min(cores, few)
    return df if enough else df.repartition(cores, *keys)
