"""Keyed states give what the batch operators give, and a micro-batch writes the keys that it touches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkeval.operators import telemetry as M
from sparkeval.operators.selection import last_n
from sparkeval.plans.session import work_dir
from sparkeval.streaming import state
from sparkeval.streaming.tables import appended
from test_streams import as_stream, rows_of


@pytest.fixture(scope="module")
def series(spark):
    """A hot key, small ones and a null key, in four files; ids rise within a key."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), round(rng.uniform(-5, 5), 2)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, run string, value double").cache()


def test_ema_state(spark, series):
    path = work_dir(spark)
    query = state.stream_ema_state(as_stream(series, F.floor(F.col("id") / 100)), path, ["run"], ["id"], "value", 0.9)
    query.awaitTermination()
    want = M.ema(series, ["run"], ["id"], "value", 0.9)
    assert rows_of(appended(spark, path).select(*want.columns).fillna("null")) == rows_of(want.fillna("null"))
    ends = want.groupBy("run").agg(F.max_by("ema", "id").alias("ema")).fillna("null")
    assert rows_of(state.read_ema_state(spark, path).select("run", "ema").fillna("null")) == rows_of(ends)


@pytest.mark.parametrize("shares", [1, 5])
def test_last_n_state(spark, series, shares):
    path = work_dir(spark)
    stream = as_stream(series, F.floor(F.col("id") / 100))
    state.stream_last_n_state(stream, path, ["run"], ["id"], 7, shares).awaitTermination()
    got = state.read_last_n_state(spark, path, ["run"], ["id"], 7)
    want = last_n(series, ["run"], ["id"], 7)
    assert rows_of(got.select(*want.columns).fillna("null")) == rows_of(want.fillna("null"))


def changelog_bytes(spark, path, version):
    """Size of what all partitions logged for a version of the state."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint/state")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    total = 0
    while files.hasNext():
        file = files.next()
        total += file.getLen() if file.getPath().getName() == f"{version}.changelog" else 0
    return total


def test_a_micro_batch_writes_the_keys_it_touches(spark):
    """The second micro-batch has rows for one key in a hundred."""
    first = spark.range(4000).select("id", F.col("id").alias("key"), F.lit(1.5).alias("value"), F.lit(0).alias("file"))
    second = spark.range(0, 4000, 100).select((F.col("id") + 9000).alias("id"), F.col("id").alias("key"), F.lit(2.5).alias("value"), F.lit(1).alias("file"))
    stream = as_stream(first.union(second), F.col("file"))
    for run in (
        lambda p: state.stream_ema_state(stream, p, ["key"], ["id"], "value"),
        lambda p: state.stream_last_n_state(stream, p, ["key"], ["id"], 2, 1),
    ):
        path = work_dir(spark)
        run(path).awaitTermination()
        assert 0 < changelog_bytes(spark, path, 2) < 0.05 * changelog_bytes(spark, path, 1)


def test_keys_share_calls(spark):
    """Six hundred keys in two files, with times, null values and numbers that no double holds."""
    rows = [(2**60 + i, i % 600 if i % 600 else None, i) for i in range(3000)]
    table = spark.createDataFrame(rows, "id long, key long, n int").select(
        "id", "key", F.timestamp_seconds(F.col("n") * 1000).alias("ts"), F.when(F.col("n") % 7 > 0, F.col("n") / 8).alias("value")
    )
    stream, path = as_stream(table, F.floor((F.col("id") - 2**60) / 1500)), work_dir(spark)
    query = state.stream_last_n_state(stream, path, ["key"], ["ts", "id"], 2)
    query.awaitTermination()
    got, want = state.read_last_n_state(spark, path, ["key"], ["ts", "id"], 2), last_n(table, ["key"], ["ts", "id"], 2)
    assert dict(got.dtypes) == dict(want.dtypes)
    assert rows_of(got.select(*want.columns).fillna(-1)) == rows_of(want.fillna(-1))
    # A call of Python handles many keys: groups are buckets, and no key of this table is dealt to shares.
    held = state._state(spark, path, "rows")
    assert held.select("key").distinct().count() <= state.BUCKETS
    assert held.count() == 600
    path = work_dir(spark)
    state.stream_ema_state(stream, path, ["key"], ["ts", "id"], "value", 0.9).awaitTermination()
    want = M.ema(table, ["key"], ["ts", "id"], "value", 0.9)
    got = appended(spark, path).select(*want.columns)
    rounded = lambda df: rows_of(df.withColumn("ema", F.round("ema", 9)).fillna(-1))
    assert rounded(got) == rounded(want)
