"""Streams give what the batch operators give over the same rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from sparkeval.functions.answers import fallback_equal
from sparkeval.operators import grading as G
from sparkeval.operators import telemetry as M
from sparkeval.operators.selection import last_n, sample_exact
from sparkeval.plans.session import work_dir
from sparkeval.sources.sinks import generation_log_sink, write_generation_log
from sparkeval.streaming import operators as streams
from sparkeval.streaming.tables import appended, batches, changes_to, latest, start

START = dt.datetime(2024, 1, 1)


def as_stream(df, file_of, files_per_batch=1):
    """``df`` as files that arrive one after the other."""
    spark = df.sparkSession
    path = work_dir(spark, "arrivals")
    numbers = sorted(r[0] for r in df.select(file_of).distinct().collect())
    for n in numbers:
        df.filter(file_of == n).coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@pytest.fixture(scope="module")
def telemetry(spark):
    rng = random.Random(8)
    rows = [
        (i, START + dt.timedelta(minutes=10 * i), rng.choice(["hot", "hot", "cold"]), rng.random(), 0.5)
        for i in range(240)
    ]
    return spark.createDataFrame(rows, "id long, ts timestamp, run string, value double, weight double").cache()


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("slide", [None, "3 hours"])
def test_loss_windows(spark, telemetry, slide):
    path = work_dir(spark)
    stream = as_stream(telemetry, F.floor(F.col("id") / 60))
    streams.stream_loss_windows(stream, path, "2 hours", "6 hours", slide, by=["run"]).awaitTermination()
    got = latest(spark, path, ["window_start", "window_end", "run"])
    want = M.loss_windows(telemetry, "6 hours", slide, by=["run"])
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_late_rows_are_dropped(spark, telemetry):
    late = telemetry.filter("id = 0").withColumn("id", F.lit(999).cast("long"))
    path = work_dir(spark)
    stream = as_stream(telemetry.unionByName(late), F.floor(F.col("id") / 60))
    streams.stream_loss_windows(stream, path, "2 hours", "6 hours").awaitTermination()
    got = latest(spark, path, ["window_start", "window_end"])
    assert got.agg(F.sum("n")).first()[0] == 240


def test_session_windows(spark, telemetry):
    """Sessions are written once closed: a last row far ahead closes all others."""
    end = telemetry.filter("id = 239").select(
        F.lit(5000).cast("long").alias("id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"),
        F.lit("end").alias("run"), "value", "weight",
    )
    rows = telemetry.filter("id % 60 < 40").unionByName(end)
    path = work_dir(spark)
    stream = as_stream(rows, F.floor(F.col("id") / 60))
    streams.stream_loss_windows(stream, path, "1 hour", session_gap="2 hours", by=["run"]).awaitTermination()
    want = M.loss_windows(rows, session_gap="2 hours", by=["run"]).filter("run <> 'end'")
    got = appended(spark, path).filter("run <> 'end'")
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    assert got.count() > 4


def test_window_arguments(telemetry):
    with pytest.raises(ValueError):
        M.loss_windows(telemetry)


def test_ema(spark, telemetry):
    path = work_dir(spark)
    stream = as_stream(telemetry, F.floor(F.col("id") / 60))
    streams.stream_ema(stream, path, ["run"], ["ts", "id"], "value", 0.9, rows_per_range=20).awaitTermination()
    got = appended(spark, path).select("id", "ema")
    want = M.ema(telemetry, ["run"], ["ts", "id"], "value", 0.9).select("id", "ema")
    assert rows_of(got) == rows_of(want)


def test_last_n(spark, telemetry):
    path = work_dir(spark)
    stream = as_stream(telemetry, F.floor(F.col("id") / 50))
    streams.stream_last_n(stream, path, ["run"], ["ts", "id"], 7).awaitTermination()
    got = streams.read_last_n(spark, path).select("run", "id")
    assert rows_of(got) == rows_of(last_n(telemetry, ["run"], ["ts", "id"], 7).select("run", "id"))


def test_dedup(spark, telemetry):
    path = work_dir(spark)
    stream = as_stream(telemetry, F.floor(F.col("id") / 60))
    streams.stream_dedup(stream, path, ["run"], "60 days", ["id"]).awaitTermination()
    assert sorted(r.run for r in appended(spark, path).collect()) == ["cold", "hot"]


def test_metrics_and_a_repeated_batch(spark):
    rng = random.Random(9)
    rows = [(f"p{rng.choice([0, 0, 1, 2, 3])}", i, f"\\boxed{{{rng.choice('AB')}}}") for i in range(90)]
    completions = spark.createDataFrame(rows, "problem_id string, sample_idx int, text string")
    problems = spark.createDataFrame([(f"p{i}", "A") for i in range(5)], "problem_id string, ground_truth string")
    path = work_dir(spark)
    stream = as_stream(completions, F.floor(F.col("sample_idx") / 30))
    streams.stream_metrics(stream, path).awaitTermination()
    want = rows_of(G.evaluate(completions, problems, fallback_equal))
    assert rows_of(streams.stream_scores(spark, path, problems, fallback_equal)) == want
    last = spark.read.parquet(f"{path}/changes/batch=2")
    copy = spark.createDataFrame(last.collect(), last.schema)
    copy.write.mode("overwrite").parquet(f"{path}/changes/batch=2")
    assert rows_of(streams.stream_scores(spark, path, problems, fallback_equal)) == want


def test_generation_log(spark):
    rows = [(s, s * 100 + i, f"p{s}", f"c{i}") for s in range(12) for i in range(40 if s == 3 else 2)]
    df = spark.createDataFrame(rows, "step long, seq long, prompt string, completion string")
    log = M.generation_log(df, rows_per_range=9)
    assert {(r.step, r.flush_step) for r in log.collect()} == {
        (s, 5 if s <= 5 else 10 if s <= 10 else 15) for s in range(12)
    }
    files = M.generation_log_files(log, part_size=16, rows_per_salt=10)
    path = work_dir(spark)
    write_generation_log(files, path)
    back = spark.read.json(path).filter("flush_step = 5").orderBy("part").collect()
    assert [(r.part, r.num_samples, len(r.generations)) for r in back] == [(0, 50, 16), (1, 50, 16), (2, 50, 16), (3, 50, 2)]
    assert [(g.step, g.completion) for r in back for g in r.generations] == [
        (s, c) for s, _, _, c in rows if s <= 5
    ]


def test_generation_log_stream(spark):
    rows = [(s, s, f"p{s}", "c") for s in range(12)]
    df = spark.createDataFrame(rows, "step long, seq long, prompt string, completion string")
    out, state = work_dir(spark), work_dir(spark)
    stream = as_stream(df, F.floor(F.col("step") / 4))
    start(stream, state, generation_log_sink(out), "append").awaitTermination()
    back = spark.read.json(out).orderBy("batch", "flush_step").collect()
    assert [(r.batch, r.flush_step, r.num_samples) for r in back] == [(0, 5, 4), (1, 5, 2), (1, 10, 2), (2, 10, 3), (2, 15, 1)]
    assert [g.prompt for r in back for g in r.generations] == [f"p{s}" for s in range(12)]


def test_changes_are_compacted(spark):
    """However many micro-batches, few folders are read, and a batch that runs again changes nothing."""
    path = work_dir(spark)
    write = changes_to(path, ["k"], every=3)
    for b in range(14):
        batch = spark.createDataFrame([(b % 4, b), (100 + b, b)], "k int, v int")
        write(batch, b)
        if b in (5, 8):
            write(batch, b)
        got = {r.k: r.v for r in latest(spark, path, ["k"]).collect()}
        assert got == {k % 4: k for k in range(b + 1)} | {100 + k: k for k in range(b + 1)}
        folders = batches(spark, f"{path}/changes")
        assert len(folders) < 6 and len(batches(spark, f"{path}/compacted")) <= 2


def test_states_are_dropped(spark, telemetry):
    path = work_dir(spark)
    stream = as_stream(telemetry, F.floor(F.col("id") / 30))
    streams.stream_ema(stream, path, ["run"], ["ts", "id"], "value", 0.9).awaitTermination()
    assert batches(spark, f"{path}/state") == [6, 7]


def test_ema_of_a_null_key_goes_on(spark):
    rows = [(i, START + dt.timedelta(minutes=i), None if i % 2 else "k", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, run string, value double")
    path = work_dir(spark)
    stream = as_stream(df, F.floor(F.col("id") / 20))
    streams.stream_ema(stream, path, ["run"], ["ts", "id"], "value", 0.9).awaitTermination()
    want = M.ema(df, ["run"], ["ts", "id"], "value", 0.9).select("id", "ema")
    assert rows_of(appended(spark, path).select("id", "ema")) == rows_of(want)
    assert spark.read.parquet(f"{path}/state/batch=2").count() == 2


def test_a_copy_after_expiry_is_a_new_row(spark):
    # The state of a key goes at the end of the first micro-batch that starts beyond its time.
    rows = [(i, START + dt.timedelta(hours=h), "a", 0.0) for i, h in enumerate([0, 1, 50, 51, 200])]
    df = spark.createDataFrame(rows, "id long, ts timestamp, run string, value double")
    path = work_dir(spark)
    stream = as_stream(df, F.col("id"))
    streams.stream_dedup(stream, path, ["run"], "2 hours", ["id"]).awaitTermination()
    assert sorted(r.id for r in appended(spark, path).collect()) == [0, 4]


def test_metric_means(spark):
    rows = [("train", "loss", 1.0), ("train", "loss", 2.0), ("eval", "loss", 4.0)]
    df = spark.createDataFrame(rows, "mode string, key string, value double")
    got = {r.metric: r.mean_value for r in M.metric_means(df).collect()}
    assert got == {"loss": 1.5, "eval_loss": 4.0}


def test_weightless_groups_are_left_out(spark):
    rows = [(START, "a", 1.0, 0.0), (START, "b", 1.0, 0.25), (START, "b", 2.0, 0.25)]
    df = spark.createDataFrame(rows, "ts timestamp, run string, value double, weight double")
    assert [(r.run, r.loss) for r in M.loss_windows(df, "1 day", by=["run"]).collect()] == [("b", 6.0)]


def test_steps(spark):
    df = spark.range(12)
    got = df.filter(M.every_step("id", 5)).collect()
    assert [r.id for r in got] == [5, 10]
    assert [r.id for r in df.filter(M.every_step("id", 10, 1, False)).collect()] == [9]
    assert [r.id for r in M.optimizer_steps(df, "id", 4).collect()] == [4, 8]


@pytest.mark.parametrize("n", [0, 7, 60, 500])
def test_sample(spark, n):
    """Samples smaller than a file, larger than one, and larger than the stream; one key is null."""
    rows = spark.createDataFrame([(i if i else None, i % 4) for i in range(200)], "id long, file int")
    path = work_dir(spark)
    streams.stream_sample(as_stream(rows, F.col("file")), path, n, 5, "id").awaitTermination()
    want = sample_exact(rows, n, 5, "id") if n <= 200 else rows
    assert rows_of(streams.read_sample(spark, path).fillna(-1)) == rows_of(want.fillna(-1))
    assert batches(spark, f"{path}/pool") == [] and len(batches(spark, f"{path}/state")) == 2
