"""Ranges, running sums, moving averages and salted joins: the same results however data are cut."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from sparkeval.operators.selection import sample_exact, split
from sparkeval.operators.telemetry import ema
from sparkeval.plans.ordering import RANGE, numbered, ranks, running_sums, with_ranges
from sparkeval.plans.session import materialize, spread, work_dir
from sparkeval.plans.skew import attach


@pytest.fixture(scope="module")
def series(spark):
    """Key 'a' holds most of the rows."""
    rng = random.Random(3)
    rows = [
        (key, place, rng.gauss(0, 1))
        for key, size in (("a", 900), ("b", 120), ("c", 1))
        for place in rng.sample(range(100_000), size)
    ]
    return rows, spark.createDataFrame(rows, "k string, i long, x double").repartition(5).cache()


@pytest.mark.parametrize("rows_per_range", [10**6, 300, 11])
def test_ranks(series, rows_per_range):
    rows, df = series
    got = {(r.k, r.i): r["rank"] for r in ranks(df, ["k"], ["i"], rows_per_range=rows_per_range).collect()}
    for key in "abc":
        places = sorted(i for k, i, _ in rows if k == key)
        assert [got[key, i] for i in places] == list(range(len(places)))


@pytest.mark.parametrize("rows_per_range", [10**6, 40])
def test_running_sums_over_everything(series, rows_per_range):
    rows, df = series
    unique = df.withColumn("o", F.col("i") * 3 + F.when(F.col("k") == "a", 0).otherwise(1))
    unique = unique.filter(F.col("k") != "c")
    out = running_sums(unique, [], ["o"], {"total": F.col("i")}, rows_per_range=rows_per_range)
    total = 0
    for row in sorted(out.collect(), key=lambda r: r.o):
        total += row.i
        assert row.total == total


@pytest.mark.parametrize("decay", [0.0, 0.5, 0.9, 0.999, 1.0])
@pytest.mark.parametrize("rows_per_range", [10**6, 37])
def test_ema(series, decay, rows_per_range):
    rows, df = series
    want, state = {}, {}
    for k, i, x in sorted(rows):
        state[k] = decay * state[k] + (1 - decay) * x if k in state else x
        want[k, i] = state[k]
    got = ema(df, ["k"], ["i"], "x", decay, rows_per_range=rows_per_range).collect()
    assert len(got) == len(rows)
    assert max(abs(want[r.k, r.i] - r.ema) for r in got) < 1e-12


def test_ema_blocks_are_longer_than_the_decay(spark):
    """decay**-i would leave the range of a double after 900 rows; blocks restart before."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.sin("id").alias("x"))
    out = {r.i: r.ema for r in ema(df, ["k"], ["i"], "x", 0.45).collect()}
    value = None
    for i, x in ((r.i, r.x) for r in sorted(df.collect(), key=lambda r: r.i)):
        value = x if value is None else 0.45 * value + 0.55 * x
        assert abs(out[i] - value) < 1e-12


def test_ema_examples(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([10.0, 20.0, 0.0])], "k int, i int, x double")
    got = [r.ema for r in ema(df, ["k"], ["i"], "x", 0.9).orderBy("i").collect()]
    assert got == pytest.approx([10.0, 11.0, 9.9])


def test_ema_continues(series):
    rows, df = series
    whole = {(r.k, r.i): r.ema for r in ema(df, ["k"], ["i"], "x", 0.9).collect()}
    early, late = df.filter("i < 50000"), df.filter("i >= 50000")
    head = ema(early, ["k"], ["i"], "x", 0.9)
    ends = head.groupBy("k").agg(F.max_by("ema", "i").alias("ema"))
    for r in ema(late, ["k"], ["i"], "x", 0.9, start=ends, rows_per_range=50).collect():
        assert r.ema == pytest.approx(whole[r.k, r.i], abs=1e-12)


@pytest.mark.parametrize("rows_per_salt", [10**6, 20])
def test_attach(series, rows_per_salt):
    rows, df = series
    sizes = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    joined = attach(df, sizes, ["k"], ["i"], "n", rows_per_salt=rows_per_salt).collect()
    assert sorted((r.k, r.i) for r in joined) == sorted((k, i) for k, i, _ in rows)
    assert {(r.k, r.n) for r in joined} == {("a", 900), ("b", 120), ("c", 1)}


def test_attach_spreads_a_hot_key(spark, series):
    """With salting no shuffle partition of the join holds most of the hot key."""
    _, df = series
    sizes = df.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach(df, sizes, ["k"], ["i"], "n", rows_per_salt=20)
        parts = joined.filter("k = 'a'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 900 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_attach_left_keeps_unknown_keys(spark, series):
    rows, df = series
    sizes = df.filter("k <> 'b'").groupBy("k").agg(F.count("*").alias("n"))
    joined = attach(df, sizes, ["k"], ["i"], "n", how="left", rows_per_salt=50)
    assert joined.count() == len(rows)
    assert joined.filter("k = 'b' and n is null").count() == 120


def test_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark).startswith(root)
    assert work_dir(spark) != work_dir(spark)
    df = spark.range(10)
    stored = materialize(df)
    assert stored.inputFiles()[0].removeprefix("file://").startswith(root)
    assert stored.count() == 10


@pytest.mark.parametrize("rows_per_range", [10**6, 20])
def test_null_is_a_group(series, rows_per_range):
    rows, df = series
    named = df.withColumn("k", F.when(F.col("k") != "b", F.col("k")))
    out = ranks(named, ["k"], ["i"], rows_per_range=rows_per_range).filter("k is null")
    places = sorted(i for k, i, _ in rows if k == "b")
    assert sorted((r.i, r["rank"]) for r in out.collect()) == [(i, n) for n, i in enumerate(places)]
    averages = ema(named, ["k"], ["i"], "x", 0.9, rows_per_range=rows_per_range)
    averages = {r.i: r.ema for r in averages.filter("k is null").collect()}
    whole = {r.i: r.ema for r in ema(df.filter("k = 'b'"), ["k"], ["i"], "x", 0.9).collect()}
    assert averages == pytest.approx(whole)
    sizes = named.groupBy("k").agg(F.count("*").alias("n"))
    joined = attach(named, sizes, ["k"], ["i"], "n", rows_per_salt=rows_per_range)
    assert joined.count() == len(rows) and joined.filter("k is null and n = 120").count() == 120


def test_large_groups_are_cut(series):
    _, df = series
    ranged, was_cut = with_ranges(df, ["k"], ["i"], 100)
    assert was_cut and ranged.count() == 1021
    sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 300
    assert not with_ranges(df, ["k"], ["i"], 2000)[1]


ORDERS = {
    "text": "cast(id as string)",
    "words": "concat('w', cast(id % 7 as string))",
    "date": "date_add(date'2020-01-01', cast(id as int))",
    "tied time": "timestamp_seconds(id div 100)",
    "decimal": "cast(id as decimal(20,2)) / 7",
    "nulls": "if(id % 3 = 0, null, id)",
}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("group", ["'k'", "if(id > 20, null, 'k')", "if(id > 990, 'k', null)"])
def test_any_order_gives_one_answer_at_every_size(spark, order, group):
    df = spark.range(1000).selectExpr(f"{group} AS k", f"{ORDERS[order]} AS o", "id").repartition(5)
    whole = ranks(df, ["k"], ["o", "id"], rows_per_range=10**6).collect()
    for rows_per_range in (400, 30):
        cut = ranks(df, ["k"], ["o", "id"], rows_per_range=rows_per_range).collect()
        assert sorted(map(str, cut)) == sorted(map(str, whole))
    places = {}
    for r in sorted(whole, key=lambda r: (r.k or "", r.o is not None, r.o or 0, r.id)):
        assert r["rank"] == places.get(r.k, 0)
        places[r.k] = r["rank"] + 1


def test_texts_stay_out_of_the_task_that_numbers(spark):
    df = spark.range(500).selectExpr("id", "repeat('x', 50) AS text")
    out = numbered(df, [], ["id"], "place")
    assert [r.place for r in out.orderBy("id").collect()] == list(range(500))
    windows = out._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert windows.count("Range") == 2  # the rows, and their ids alone


@pytest.mark.parametrize("decay", [0.3, 0.9])
@pytest.mark.parametrize("rows_per_range", [10**6, 50])
def test_ema_of_large_values_and_null_keys(spark, decay, rows_per_range):
    values = [1e60, 1e300, 3.0, -1e299, 0.0, 1.0] * 40
    rows = [(None, i, v) for i, v in enumerate(values)] + [("k", i, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {(r.k, r.i): r.ema for r in ema(df, ["k"], ["i"], "x", decay, rows_per_range=rows_per_range).collect()}
    state = None
    for i, v in enumerate(values):
        state = v if state is None else decay * state + (1 - decay) * v
        assert got[None, i] == pytest.approx(state, rel=1e-9)
    assert got["k", 99] == pytest.approx(1.0)


def test_splits_and_samples_cover_null_keys(spark):
    df = spark.range(21).selectExpr("if(id = 20, null, id) AS k", "id")
    for seed in range(6):
        train, test = split(df, 0.4, seed, "k")
        assert sorted(r.id for r in train.union(test).collect()) == list(range(21))
        assert test.count() == 9
        assert sample_exact(df, 5, seed, "k").count() == 5


def test_spread_leaves_wide_tables_alone(spark):
    wide, narrow = spark.range(100, numPartitions=16), spark.range(100, numPartitions=1)
    assert spread(wide, "id") is wide
    assert spread(narrow, "id").rdd.getNumPartitions() == 8


def test_small_keys_are_not_cut(spark):
    """A table larger than a range, whose keys are small, is neither written nor sorted as a whole."""
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("i"))
    out = ranks(df, ["k"], ["i"], rows_per_range=50)
    assert "parquet" not in out._jdf.queryExecution().toString().lower()
    assert all(r["rank"] == r.i // 100 for r in out.collect())
    some_large = df.withColumn("k", F.when(F.col("i") < 200, -1).otherwise(F.col("k")))
    out = ranks(some_large, ["k"], ["i"], rows_per_range=50)
    assert {r.i: r["rank"] for r in out.collect()} == {i: i if i < 200 else i // 100 - 2 for i in range(1000)}
