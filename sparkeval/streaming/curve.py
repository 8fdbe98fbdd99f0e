"""Running rates of an evaluation that is still being answered, and answers that are taken back.

The problems of a run are cut into blocks by their order. A block stores the sums up to each of its
problems, counted from its own start, and there is one row of totals per block. An answer that comes late to
an early problem renews the block of that problem and the totals: what follows it is not written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkeval.functions.answers import equivalent
from sparkeval.operators.grading import PROBLEM, Grader, count_answers, evaluate, extract, percent, score
from sparkeval.streaming.tables import (
    batches,
    changes_to,
    drop_batches,
    drop_folder,
    latest,
    numbered_folders,
    start,
)

BLOCK_SIZE = 100_000
MAX_BLOCKS = 10_000
COUNTS = ["num_correct", "num_formatted"]
SUMS = ["idx", "sum_passed", "sum_correct", "sum_formatted"]


def stream_running_metrics(
    completions: DataFrame,
    path: str,
    problems: DataFrame,
    grader: Grader = equivalent,
    order: str = "ord",
    block_size: int = BLOCK_SIZE,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the running rates of one run over a stream of its samples, for ``read_running_metrics``.

    ``order`` is a unique integer; a block covers ``block_size`` values of it. More than ``MAX_BLOCKS`` blocks
    are an error. ``problems`` must not change while the stream lasts. Samples of unknown problems are left
    out; every other sample counts, so none may come twice.
    """
    listed = _listed(problems, order, block_size)
    spark = problems.sparkSession
    if not batches(spark, f"{path}/totals"):
        _write_blocks(listed.withColumns({c: F.lit(0).cast("long") for c in COUNTS}), path, 0)
        _write_totals(spark, path, 0, listed, None)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, batch_id + 1
        added = evaluate(batch, problems, grader).select("problem_id", *COUNTS).join(listed, "problem_id")
        arrived = f"{path}/added/batch={version}"
        added.repartition("block").write.mode("overwrite").partitionBy("block").parquet(arrived)
        touched = numbered_folders(spark, arrived, "block")
        if touched:
            new = spark.read.schema(added.schema).parquet(arrived).select(*listed.columns, *COUNTS)
            held = _blocks(spark, path, listed, version, touched).select(*listed.columns, *COUNTS)
            sums = [F.sum(c).alias(c) for c in COUNTS]
            _write_blocks(held.unionByName(new).groupBy(*listed.columns).agg(*sums), path, version)
        _write_totals(spark, path, version, listed, touched)
        _drop_superseded(spark, path, version - 1)
        for name in ("added", "totals"):
            drop_batches(spark, f"{path}/{name}", version - 1)

    return start(completions, path, write, "append", available_now)


def read_running_metrics(
    spark: SparkSession, path: str, problems: DataFrame, val_n: int, order: str = "ord"
) -> DataFrame:
    """What ``running_metrics`` gives for all samples so far: the stored sums behind those of earlier blocks."""
    rows = _blocks(spark, path, _listed(problems, order, 1))
    totals = spark.read.parquet(f"{path}/totals/batch={batches(spark, f'{path}/totals')[-1]}")
    # One row per block: their number is bounded, so one task and a broadcast are.
    earlier = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in SUMS])
    run = rows.join(F.broadcast(offsets), "block").withColumns({c: F.col(c) + F.col(f"_{c}") for c in SUMS})
    asked = F.col("idx") * val_n
    return run.select(
        F.col("ord").alias(order),
        "problem_id",
        "idx",
        (F.col("num_correct") > 0).alias("has_correct"),
        "num_correct",
        percent(F.col("sum_passed"), F.col("idx")).alias("pass_at_n_pct"),
        percent(F.col("sum_correct"), asked).alias("average_at_n_pct"),
        percent(F.col("sum_formatted"), asked).alias("format_rate"),
    )


def _listed(problems: DataFrame, order: str, block_size: int) -> DataFrame:
    place = F.col(order).cast("long")
    return problems.select("problem_id", place.alias("ord"), F.floor(place / block_size).cast("long").alias("block"))


def _schema(listed: DataFrame) -> T.StructType:
    return T.StructType([*listed.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS + SUMS]])


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each block, the newest before ``before``."""
    found: dict[int, int] = {}
    for version in batches(spark, f"{path}/blocks"):
        if before is None or version < before:
            found |= dict.fromkeys(numbered_folders(spark, f"{path}/blocks/batch={version}", "block"), version)
    return found


def _blocks(
    spark: SparkSession, path: str, listed: DataFrame, before: int | None = None, only: list[int] | None = None
) -> DataFrame:
    newest = _newest(spark, path, before)
    kept = set(newest if only is None else only)
    folders = [f"{path}/blocks/batch={version}/block={b}" for b, version in newest.items() if b in kept]
    reader = spark.read.schema(_schema(listed))
    return reader.option("basePath", f"{path}/blocks").parquet(*folders or [f"{path}/blocks"])


def _write_blocks(counts: DataFrame, path: str, version: int) -> None:
    upto = Window.partitionBy("block").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = [F.lit(1), F.when(F.col("num_correct") > 0, 1).otherwise(0), *map(F.col, COUNTS)]
    sums = {name: F.sum(term).over(upto).cast("long") for name, term in zip(SUMS, terms)}
    target = f"{path}/blocks/batch={version}"
    counts.withColumns(sums).write.mode("overwrite").partitionBy("block").parquet(target)


def _write_totals(
    spark: SparkSession, path: str, version: int, listed: DataFrame, renewed: list[int] | None
) -> None:
    """Totals of all blocks. Those that this version did not write are taken over; None: it wrote all."""
    sums = [F.max(c).alias(c) for c in SUMS]
    written = spark.read.schema(_schema(listed)).parquet(f"{path}/blocks/batch={version}") if renewed != [] else None
    parts = [written.groupBy("block").agg(*sums)] if written is not None else []
    if renewed is not None:
        before = spark.read.parquet(f"{path}/totals/batch={version - 1}")
        parts.append(before.filter(~F.col("block").isin(renewed)) if renewed else before)
    elif len(numbered_folders(spark, f"{path}/blocks/batch={version}", "block")) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks: take a larger block_size")
    reduce(DataFrame.unionByName, parts).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/batch={version}")


def _drop_superseded(spark: SparkSession, path: str, upto: int) -> None:
    """Remove what no later micro-batch reads: blocks with a newer version up to ``upto``."""
    newest = _newest(spark, path, upto + 1)
    for version in batches(spark, f"{path}/blocks"):
        held = numbered_folders(spark, f"{path}/blocks/batch={version}", "block")
        old = [b for b in held if version < newest.get(b, version)]
        if held and len(old) == len(held):
            drop_folder(spark, f"{path}/blocks/batch={version}")
        else:
            for b in old:
                drop_folder(spark, f"{path}/blocks/batch={version}/block={b}")


def stream_answers(
    changes: DataFrame,
    path: str,
    keys: list[str] = PROBLEM,
    version: str = "version",
    retracted: str = "retracted",
    available_now: bool = True,
) -> StreamingQuery:
    """Follow samples that are added, replaced and taken back, for ``read_answers`` and ``read_scores``.

    A change names its sample by ``keys`` and ``sample_idx``; the one with the highest ``version`` holds,
    in whatever order they arrive. One with ``retracted`` takes the sample back (its text is not read), null
    is false. Only the answers are kept: no text is read a second time, and no state store holds the samples:
    the highest change of each micro-batch is written, and the reader takes the highest of all. Changes of one sample with equal
    versions are ordered by their answers; a null version is below all others.
    """
    holds = _holds(retracted)
    answers = extract(changes).withColumn("predicted", F.when(holds, F.col("predicted")))
    place = F.struct(version, holds.alias("holds"), "predicted")
    store = changes_to(path, [*keys, "sample_idx"], highest="change")

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch.groupBy(*keys, "sample_idx").agg(F.max("change").alias("change")), batch_id)

    stream = answers.select(*keys, "sample_idx", place.alias("change"))
    return start(stream, path, write, "append", available_now)


def _holds(retracted: str) -> Column:
    return ~F.coalesce(F.col(retracted), F.lit(False))


def read_answers(spark: SparkSession, path: str, keys: list[str] = PROBLEM) -> DataFrame:
    """The answers that hold now, as ``extract`` gives them."""
    held = latest(spark, path, [*keys, "sample_idx"], "change").filter("change.holds")
    answer = F.col("change.predicted")
    return held.select(*keys, "sample_idx", answer.alias("predicted"), answer.isNotNull().alias("formatted"))


def read_scores(
    spark: SparkSession, path: str, problems: DataFrame, grader: Grader = equivalent, keys: list[str] = PROBLEM
) -> DataFrame:
    """Per-problem measures as of now, for ``summary`` and the other batch operators. Votes are counted anew
    from the answers, so a retracted sample loses its vote and its place as the first."""
    return score(count_answers(read_answers(spark, path, keys), keys), problems, grader, keys)
