"""Reports, generation logs and the names of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.functions.common import ColumnOrName, as_column
from sparkeval.operators.telemetry import generation_log, generation_log_files
from sparkeval.plans.session import work_dir
from sparkeval.streaming.tables import drop_folder


def basename(path: ColumnOrName, level: int = 1) -> Column:
    """Last part of a path (``level`` 2: the part before it); null if there is none."""
    parts = F.filter(F.split(as_column(path), "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-level))


def run_key(
    dataset: ColumnOrName,
    base_model: ColumnOrName,
    checkpoint: ColumnOrName,
    enable_thinking: ColumnOrName,
    temperature: ColumnOrName,
    val_n: ColumnOrName,
) -> Column:
    """Name of an evaluation result. Without a checkpoint (null) its two parts are left out."""
    mode = F.when(as_column(enable_thinking), F.lit("thinking")).otherwise(F.lit("nonthinking"))
    return F.concat_ws(
        "_",
        F.lit("eval_results"),
        as_column(dataset),
        basename(base_model),
        basename(checkpoint, 2),
        basename(checkpoint),
        mode,
        F.concat(F.lit("temp"), as_column(temperature).cast("string")),
        F.concat(F.lit("valn"), as_column(val_n).cast("string")),
    )


def rate_label(rate: ColumnOrName) -> Column:
    """Learning rate as in ``2e-4``."""
    return F.replace(F.format_string("%.0e", as_column(rate)), F.lit("e-0"), F.lit("e-"))


def training_run_name(
    prefix: str, model: ColumnOrName, rate: ColumnOrName, batch: ColumnOrName, *more: Column
) -> Column:
    return F.concat_ws(
        "_",
        F.lit(prefix),
        basename(model),
        F.concat(F.lit("lr"), rate_label(rate)),
        F.concat(F.lit("bs"), as_column(batch).cast("string")),
        *more,
    )


def write_report(
    summary: DataFrame,
    results: DataFrame,
    generations: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
) -> None:
    """Three JSON data sets below ``path``, gzipped: summary, one row per problem, and the nested samples."""
    for name, df in (("summary", summary), ("results", results), ("generations", generations)):
        keys = [c for c in partition_by or [] if c in df.columns]
        df.write.mode("overwrite").partitionBy(*keys).json(f"{path}/{name}", compression="gzip")


def write_generation_log(files: DataFrame, path: str) -> None:
    """One folder per flush."""
    files.write.mode("overwrite").partitionBy("flush_step").json(path)


def generation_log_sink(path: str, every: int = 5) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes the records (step, seq, prompt, completion) of a micro-batch
    nested under their flush step, as ``generation_log_files`` does in batch.

    The folder is named after the micro-batch, so a batch that runs again replaces its own files. A
    flush that arrives in several micro-batches has a part in each; their ``num_samples`` add up. The
    records are read several times, so they are stored while they are nested.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        records = work_dir(spark, "records")
        try:
            batch.write.parquet(records)
            stored = spark.read.schema(batch.schema).parquet(records)
            files = generation_log_files(generation_log(stored, every=every))
            files.write.mode("overwrite").partitionBy("flush_step").json(f"{path}/batch={batch_id}")
        finally:
            drop_folder(spark, records)

    return write
