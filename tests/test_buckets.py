"""Bucketed tables: joins and counts that move no completion, hot problems in shares."""

from __future__ import annotations

import random
import re

import pytest

from sparkeval.operators import grading
from sparkeval.plans import buckets
from test_streams import rows_of


@pytest.fixture(scope="module")
def tables(spark):
    """Half of the completions belong to problem 1; one has no problem, one problem no completion."""
    rng = random.Random(6)
    owners = [rng.choice([1, 1, 1, rng.randrange(2, 12)]) for _ in range(400)] + [None, 77]
    rows = [(p, i, f"so \\boxed{{{rng.choice(['7', '7.0', '8', ''])}}}" if i % 9 else "none") for i, p in enumerate(owners)]
    completions = spark.createDataFrame(rows, "problem_id int, sample_idx int, text string")
    problems = spark.createDataFrame([(p, f"q{p}", "7") for p in range(14)], "problem_id int, problem string, ground_truth string")
    return completions, problems


@pytest.mark.parametrize("rows_per_share", [1_000_000, 40])
def test_stored_tables_give_the_same(tables, rows_per_share):
    completions, problems = tables
    stored, asked = buckets.store(completions, problems, 4, rows_per_share=rows_per_share)
    got = buckets.join_stored(stored, asked)
    want = completions.join(problems, "problem_id")
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    want = grading.evaluate(completions, problems)
    assert rows_of(buckets.evaluate_stored(stored, asked).select(*want.columns)) == rows_of(want)
    shares = {r[0] for r in stored.filter("problem_id = 1").select(buckets.SHARE).distinct().collect()}
    assert len(shares) == 1 if rows_per_share > 400 else len(shares) > 3
    assert asked.filter("problem_id = 1").count() >= len(shares)
    buckets.drop(stored, asked)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_completions_are_not_moved(spark, tables):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored, asked = buckets.store(*tables, 4)
        joined = plan(buckets.join_stored(stored, asked))
        assert "SortMergeJoin" in joined and "Exchange" not in joined
        scored = plan(buckets.evaluate_stored(stored, asked))
        # Below the first exchange over the completions there are counts, partial and final: one per answer.
        below = scored[re.search(r"Exchange hashpartitioning\(problem_id#\d+, formatted", scored).end() :]
        assert below.index("HashAggregate(keys=[problem_id") < below.index("Scan")
        assert "Exchange" not in below[: below.index("Scan")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert buckets.evaluate_stored(*buckets.store(tables[0].limit(0), tables[1], 2)).count() == 0
