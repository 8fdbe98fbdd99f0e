"""Splits, samples, first-of-each and newest-N."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from pyspark.sql import functions as F

from sparkeval.operators import selection as S


def order(seed: int, key: int) -> tuple[str, int]:
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key


@pytest.mark.parametrize("size", [0.01, 0.007, 0.5, 1.0, 0.0])
@pytest.mark.parametrize("partitions", [1, 8])
def test_split(spark, size, partitions):
    df = spark.range(1234).repartition(partitions)
    train, test = S.split(df, size, 42, "id")
    got = {r.id for r in test.collect()}
    want = sorted(range(1234), key=lambda k: order(42, k))[: math.ceil(round(size * 1234, 9))]
    assert got == set(want)
    assert {r.id for r in train.collect()} == set(range(1234)) - got


def test_split_is_a_filter(spark):
    _, test = S.split(spark.range(500), 0.1, 1, "id")
    assert "Exchange" not in test._jdf.queryExecution().executedPlan().toString()


def test_sample_exact(spark):
    got = [r.id for r in S.sample_exact(spark.range(300), 20, 42, "id").collect()]
    assert sorted(got) == sorted(sorted(range(300), key=lambda k: order(42, k))[:20])
    with pytest.raises(ValueError):
        S.sample_exact(spark.range(3), 4, 42, "id")


def test_sample_fraction(spark):
    df = spark.range(20_000)
    rows = S.sample_fraction(df, 0.01, 7, "id").count()
    assert 140 < rows < 260
    assert S.sample_fraction(df, 1.0, 7, "id").count() == 20_000
    assert S.sample_fraction(df, 0.01, 7, "id").count() == S.sample_fraction(
        df.repartition(3), 0.01, 7, "id"
    ).count()


def test_dedup_keeps_the_first(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaab"), i, f"v{i}") for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "prompt string, seq int, v string").repartition(7)
    got = {(r.prompt, r.seq, r.v) for r in S.dedup_first(df, ["prompt"], ["seq"]).collect()}
    firsts = {p: min(s for q, s, _ in rows if q == p) for p in "ab"}
    assert got == {(p, s, f"v{s}") for p, s in firsts.items()}
    assert S.dedup_first(df.select("prompt"), ["prompt"], ["prompt"]).count() == 2


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_last_n(spark, n):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id"
    )
    got = {}
    for r in S.last_n(df, ["k"], ["id"], n).collect():
        got.setdefault(r.k, set()).add(r.id)
    for key, ids in got.items():
        everything = [r.id for r in df.filter(F.col("k") == key).collect()]
        assert ids == set(sorted(everything)[-n:])


def test_last_n_trims_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = S.last_n(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ordinal(spark):
    df = spark.createDataFrame([(v,) for v in (30, 10, 20)], "v int")
    got = {r.v: r.ordinal for r in S.with_ordinal(df, "v", rows_per_range=1).collect()}
    assert got == {10: 0, 20: 1, 30: 2}
