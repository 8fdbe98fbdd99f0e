"""Streaming evaluation, loss windows, moving averages, newest rows and deduplication.

Each function starts its query and returns it; the results are read from ``path`` with ``latest`` or
``appended``, or with the reader named in the docstring.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkeval.functions.answers import equivalent
from sparkeval.functions.hashing import hash_order
from sparkeval.operators.grading import PROBLEM, Grader, count_answers, extract, score
from sparkeval.operators.selection import last_n, sample_upto
from sparkeval.operators.telemetry import ema, loss_windows
from sparkeval.plans.skew import same_group
from sparkeval.streaming.tables import batches, changes_to, drop_batches, latest, start


def stream_metrics(
    completions: DataFrame, path: str, keys: list[str] = PROBLEM, available_now: bool = True
) -> StreamingQuery:
    """Keep the number of samples per distinct answer; samples are counted before the shuffle."""
    counts = count_answers(extract(completions), keys)
    write = changes_to(path, [*keys, "formatted", "answer"])
    return start(counts, path, write, available_now=available_now)


def stream_scores(
    spark: SparkSession,
    path: str,
    problems: DataFrame,
    grader: Grader = equivalent,
    keys: list[str] = PROBLEM,
) -> DataFrame:
    """Per-problem measures as of now, for ``summary`` and the other batch operators."""
    counts = latest(spark, path, [*keys, "formatted", "answer"])
    return score(counts, problems, grader, keys)


def stream_loss_windows(
    telemetry: DataFrame,
    path: str,
    delay: str,
    duration: str | None = None,
    slide: str | None = None,
    session_gap: str | None = None,
    by: list[str] | None = None,
    ts: str = "ts",
    available_now: bool = True,
) -> StreamingQuery:
    """Loss windows with rows later than ``delay`` dropped.

    Tumbling and sliding windows are written again whenever they change; read them with ``latest``.
    Session windows are written once they are closed; read them with ``appended``.
    """
    marked = telemetry.withWatermark(ts, delay)
    windows = loss_windows(marked, duration, slide, session_gap, by, ts)
    mode = "append" if session_gap else "update"
    kept = None if session_gap else ["window_start", "window_end", *(by or [])]
    return start(windows, path, changes_to(path, kept), mode, available_now)


def stream_ema(
    stream: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    value: str,
    decay: float = 0.999,
    available_now: bool = True,
    **ranges: Any,
) -> StreamingQuery:
    """Moving average per key over a stream; read the values with ``appended``.

    A micro-batch is averaged with the batch operator, which spreads one long series over many tasks,
    and continues from the averages stored by the batch before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(_held(path, batch_id - 1)) if batch_id else None
        values = ema(batch, keys, order, value, decay, before, **ranges)
        target = f"{path}/changes/batch={batch_id}"
        values.write.mode("overwrite").parquet(target)
        ends = spark.read.schema(values.schema).parquet(target)
        ends = ends.groupBy(*keys).agg(F.max_by("ema", F.struct(*order)).alias("ema"))
        if before is not None:
            ends = ends.unionByName(same_group(before, ends, keys, "left_anti"))
        ends.write.mode("overwrite").parquet(_held(path, batch_id))
        drop_batches(spark, f"{path}/state", batch_id - 1)

    return start(stream, path, write, "append", available_now)


def stream_last_n(
    stream: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    n: int,
    available_now: bool = True,
) -> StreamingQuery:
    """Newest ``n`` rows per key; read them with ``read_last_n``.

    Each micro-batch is merged with the rows held so far by the batch operator, which trims a key
    with very many rows before the shuffle. The held rows, ``n`` per key at most, are the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id:
            batch = batch.unionByName(batch.sparkSession.read.parquet(_held(path, batch_id - 1)))
        last_n(batch, keys, order, n).write.mode("overwrite").parquet(_held(path, batch_id))
        drop_batches(batch.sparkSession, f"{path}/state", batch_id - 1)

    return start(stream, path, write, "append", available_now)


def stream_sample(
    stream: DataFrame, path: str, n: int, seed: int, key: str, available_now: bool = True
) -> StreamingQuery:
    """The ``n`` rows that ``sample_exact`` picks from all rows so far (all, while there are fewer); read
    them with ``read_sample``.

    ``key`` is unique. Once the sample is full, only rows of a micro-batch whose hash is not above the
    highest one held are looked at further: ever fewer, and of these and the sample the first ``n`` are kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            held = spark.read.schema(batch.schema).parquet(_held(path, batch_id - 1))
            size, limit = held.agg(F.count("*"), F.max(hash_order(seed, key))).first()
            if size >= n:
                batch = batch.filter(hash_order(seed, key) <= F.lit(limit))
            batch = held.unionByName(batch)
        pool = f"{path}/pool/batch={batch_id}"
        batch.write.mode("overwrite").parquet(pool)
        kept = sample_upto(spark.read.schema(batch.schema).parquet(pool), n, seed, key)
        kept.write.mode("overwrite").parquet(_held(path, batch_id))
        drop_batches(spark, f"{path}/state", batch_id - 1)
        drop_batches(spark, f"{path}/pool", batch_id + 1)

    return start(stream, path, write, "append", available_now)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The sample after the last micro-batch."""
    return spark.read.parquet(_held(path, batches(spark, f"{path}/state")[-1]))


def _held(path: str, batch_id: int) -> str:
    return f"{path}/state/batch={batch_id}"


def read_last_n(spark: SparkSession, path: str) -> DataFrame:
    """The rows held after the last micro-batch."""
    return spark.read.parquet(_held(path, batches(spark, f"{path}/state")[-1]))


def stream_dedup(
    stream: DataFrame,
    path: str,
    keys: list[str],
    delay: str,
    spread: list[str],
    ts: str = "ts",
    shares: int = 16,
    available_now: bool = True,
) -> StreamingQuery:
    """First row per ``keys`` within the watermark; read the rows with ``appended``.

    Copies are dropped within salted shares first, so a value that fills a third of the stream does
    not pass through one task.
    """
    share = F.pmod(F.xxhash64(*spread), F.lit(shares)).cast("int")
    once = (
        stream.withWatermark(ts, delay)
        .withColumn("_share", share)
        .dropDuplicatesWithinWatermark([*keys, "_share"])
        .drop("_share")
        .dropDuplicatesWithinWatermark(keys)
    )
    return start(once, path, changes_to(path), "append", available_now)
