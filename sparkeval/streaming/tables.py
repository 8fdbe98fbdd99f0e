"""Results of streaming queries as tables that a repeated micro-batch cannot spoil."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start(
    df: DataFrame,
    path: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "update",
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``write`` per micro-batch; the checkpoint lies beside the data, on shared storage."""
    writer = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


COMPACT_EVERY = 16


def numbered_folders(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers n of the folders ``name=n`` there, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the micro-batches that have a folder there, rising."""
    return numbered_folders(spark, folder, "batch")


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_batches(spark: SparkSession, folder: str, before: int) -> None:
    """Remove the folders of the micro-batches before that number."""
    for n in batches(spark, folder):
        if n < before:
            drop_folder(spark, f"{folder}/batch={n}")


def changes_to(
    path: str, keys: list[str] | None = None, every: int = COMPACT_EVERY, highest: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch into a folder of its own.

    With ``keys`` the newest version of each row is written out every ``every`` micro-batches, from the
    last such table and the changes since; what is older than the last such table goes. So reading
    ``latest`` takes one table and fewer than ``2 * every`` folders, however long the stream runs. A
    micro-batch that runs again finds all that it read the first time. With ``highest`` the version with the
    highest value of that only column holds, whichever micro-batch brought it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if keys and batch_id % every == every - 1:
            spark = batch.sparkSession
            newest = _latest(spark, path, keys, batch_id, highest)
            newest.write.mode("overwrite").parquet(f"{path}/compacted/batch={batch_id}")
            done = batch_id - every
            drop_batches(spark, f"{path}/compacted", done)
            drop_batches(spark, f"{path}/changes", done + 1)

    return write


def latest(spark: SparkSession, path: str, keys: list[str], highest: str | None = None) -> DataFrame:
    """The newest version of each row from the changes; with ``highest`` the one highest in that column."""
    return _latest(spark, path, keys, None, highest).drop("batch")


def _latest(
    spark: SparkSession, path: str, keys: list[str], upto: int | None, highest: str | None = None
) -> DataFrame:
    """Newest rows with the batch they come from; ``upto``: as that micro-batch saw them."""
    tables = [n for n in batches(spark, f"{path}/compacted") if upto is None or n < upto]
    since = tables[-1] if tables else -1
    numbers = [n for n in batches(spark, f"{path}/changes") if n > since and (upto is None or n <= upto)]
    folders = [f"{path}/changes/batch={n}" for n in numbers]
    parts = []
    if folders:
        parts.append(spark.read.option("basePath", f"{path}/changes").parquet(*folders))
    if tables:
        parts.append(spark.read.parquet(f"{path}/compacted/batch={since}"))
    changes = reduce(DataFrame.unionByName, parts)
    values = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch").alias("_row")
    if highest:
        newest = F.struct(F.max(highest).alias(highest), F.max("batch").alias("batch")).alias("_row")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/changes").drop("batch")
