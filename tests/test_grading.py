"""Metrics on small tables whose results can be counted by hand, and rewards."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pandas as pd
import pytest

from pyspark.sql import functions as F

from sparkeval.functions.answers import NO_ANSWER, equivalent, fallback_equal
from sparkeval.operators import grading as G
from sparkeval.operators.selection import pending
from sparkeval.registry import apply_rewards, grader, register_grader, register_reward

PROBLEMS = [("p1", 0, "q1", "1/2"), ("p2", 1, "q2", "B"), ("p3", 2, "q3", "C"), ("p4", 3, "q4", "0")]
ANSWERS = {
    "p1": ["1/2", "0.5", "0.25", None],  # three candidates with one vote each: the first wins
    "p2": ["B", "A", "A", "B"],  # a tie: first seen wins
    "p3": ["", "", NO_ANSWER, "C"],  # empty boxes vote for the sentinel
}


def tables(spark):
    problems = spark.createDataFrame(
        PROBLEMS, "problem_id string, ord long, problem string, ground_truth string"
    )
    rows = [
        (p, i, "nothing" if a is None else "so \\boxed{" + a + "}")
        for p, answers in ANSWERS.items()
        for i, a in enumerate(answers)
    ]
    return problems, spark.createDataFrame(rows, "problem_id string, sample_idx int, text string")


def test_majority(spark):
    problems, completions = tables(spark)
    votes = {r.problem_id: r for r in G.majority_vote(G.grade(completions, problems)).collect()}
    assert [votes[p].majority_answer for p in ("p1", "p2", "p3")] == ["1/2", "B", NO_ANSWER]
    assert [votes[p].votes for p in ("p1", "p2", "p3")] == [1, 2, 3]
    assert [votes[p].majority_vote_correct for p in ("p1", "p2", "p3")] == [True, True, False]


def test_unformatted_only(spark):
    problems = spark.createDataFrame([("p", 0, "q", "x")], "problem_id string, ord long, problem string, ground_truth string")
    completions = spark.createDataFrame([("p", 0, "x")], "problem_id string, sample_idx int, text string")
    row = G.evaluate(completions, problems).first()
    assert (row.num_formatted, row.num_correct, row.majority_vote_correct) == (0, 0, False)
    vote = G.majority_vote(G.grade(completions, problems)).first()
    assert (vote.majority_answer, vote.votes, vote.majority_vote_correct) == (None, 0, False)


def test_summary(spark):
    problems, completions = tables(spark)
    scored = G.evaluate(completions, problems)
    row = G.summary(scored, problems, 4, attributes={"dataset": "x"}).first()
    assert row.dataset == "x"
    assert (row.num_problems, row.total_solutions) == (4, 16)
    assert (row.pass_at_n, row.average_at_n, row.majority_vote_at_n, row.formatted_count) == (3, 5, 2, 11)
    assert (row.pass_at_n_pct, row.average_at_n_pct) == (75.0, 31.25)
    assert (row.majority_vote_at_n_pct, row.format_rate) == (50.0, 68.75)
    observed = G.summary(scored, problems, 4, "observed").first()
    assert observed.total_solutions == 12
    nothing = G.summary(scored.limit(0), problems.limit(0), 4).first()
    assert (nothing.num_problems, nothing.pass_at_n_pct, nothing.format_rate) == (0, None, None)
    with pytest.raises(ValueError):
        G.summary(scored, problems, 4, "guessed")


def plain_evaluation(completions, gold, grade):
    """The measures per problem, counted one sample at a time."""
    out = {}
    for p, samples in completions.items():
        stored = [a if a else NO_ANSWER for a in samples]
        votes = Counter(s for s, a in zip(stored, samples) if a is not None)
        winner = votes.most_common(1)[0][0] if votes else None
        correct = sum(a is not None and grade(a, gold[p]) for a in samples)
        out[p] = (
            len(samples),
            correct,
            sum(a is not None for a in samples),
            correct > 0,
            winner is not None and grade(winner, gold[p]),
        )
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_random_evaluation(spark, partitions):
    """Both ways through the package agree with plain counting; one problem holds a third of all rows."""
    rng = random.Random(11)
    pool = ["A", "a", "B", "", None, NO_ANSWER, " a b ", "ab"]
    gold = {f"p{i}": rng.choice(["A", "ab", "", "[noboxedanswerfound]"]) for i in range(60)}
    answers = {p: rng.choices(pool, k=rng.randrange(1, 9)) for p in gold}
    answers["p0"] = rng.choices(pool, k=150)
    answers = {p: [a if a is None else a.strip() for a in samples] for p, samples in answers.items()}
    rows = [
        (p, i, "no" if a is None else f"\\boxed{{{a}}}")
        for p, samples in answers.items()
        for i, a in enumerate(samples)
    ]
    problems = spark.createDataFrame(
        [(p, i, p, g) for i, (p, g) in enumerate(gold.items())],
        "problem_id string, ord long, problem string, ground_truth string",
    )
    completions = spark.createDataFrame(rows, "problem_id string, sample_idx int, text string")
    completions = completions.repartition(partitions)

    def grade(a, g):
        return a.replace(" ", "").lower() == g.replace(" ", "").lower()

    want = plain_evaluation(answers, gold, grade)
    scored = G.evaluate(completions, problems, fallback_equal)
    assert {r.problem_id: tuple(r)[1:] for r in scored.collect()} == want
    graded = G.grade(completions, problems, fallback_equal)
    counted = {r.problem_id: tuple(r)[1:] for r in G.per_problem(graded).collect()}
    assert counted == {p: w[:4] for p, w in want.items()}
    votes = G.majority_vote(graded, fallback_equal)
    assert {r.problem_id: r.majority_vote_correct for r in votes.collect()} == {
        p: w[4] for p, w in want.items()
    }


@pytest.mark.parametrize("rows_per_range", [10**6, 5])
def test_running(spark, rows_per_range):
    problems, completions = tables(spark)
    scored = G.evaluate(completions, problems)
    rows = G.running_metrics(scored, problems, 4, rows_per_range=rows_per_range).orderBy("ord").collect()
    assert [r.idx for r in rows] == [1, 2, 3, 4]
    assert [round(r.pass_at_n_pct, 2) for r in rows] == [100.0, 100.0, 100.0, 75.0]
    assert [round(r.average_at_n_pct, 3) for r in rows] == [50.0, 50.0, 41.667, 31.25]
    assert [r.problem_id for r in G.progress_snapshot(G.running_metrics(scored, problems, 4), 2).collect()] == ["p2", "p4"]


def test_runs(spark):
    problems, completions = tables(spark)
    both = completions.withColumn("run_id", F.lit("x")).unionByName(
        completions.filter("sample_idx < 2").withColumn("run_id", F.lit("y"))
    )
    keys = ["run_id", "problem_id"]
    board = G.leaderboard(
        G.summary(G.evaluate(both, problems, keys=keys), problems, 4, runs=["run_id"])
    ).collect()
    assert [(r.run_id, r.average_at_n_pct) for r in board] == [("x", 31.25), ("y", 18.75)]


def test_join_keeps_unanswered(spark):
    problems, completions = tables(spark)
    joined = G.join_completions(completions, problems)
    assert joined.count() == 13
    assert joined.filter("text is null").select("problem_id").collect()[0][0] == "p4"
    assert [r.problem_id for r in pending(problems, completions, ["problem_id"]).collect()] == ["p4"]


def test_results_and_generations(spark):
    problems, completions = tables(spark)
    scored = G.evaluate(completions, problems)
    first = {r.problem_id: r for r in G.results(completions, problems, scored, 4).collect()}
    assert (first["p3"].predicted_answer, first["p3"].formatted) == (NO_ANSWER, True)
    assert (first["p1"].correct, first["p3"].correct) == (True, False)
    assert first["p1"].full_generation == "so \\boxed{1/2}"
    parts = G.generations(completions, problems, part_size=3).orderBy("problem_id", "part").collect()
    sizes = [(r.problem_id, r.part, [g.sample_idx for g in r.generations]) for r in parts]
    assert sizes[:2] == [("p1", 0, [0, 1, 2]), ("p1", 1, [3])]
    assert parts[1].generations[0].predicted_answer == NO_ANSWER


def test_explode_outputs(spark):
    df = spark.createDataFrame([("p", ["x", "y"])], "problem_id string, outputs array<string>")
    assert [tuple(r) for r in G.explode_outputs(df).collect()] == [("p", 0, "x"), ("p", 1, "y")]


@pytest.mark.parametrize("rows_per_salt", [10**6, 3])
def test_group_advantage(spark, rows_per_salt):
    groups = {"a": [1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0], "b": [0.5], "c": [2.0, 2.0]}
    rows = [(g, i, r) for g, rewards in groups.items() for i, r in enumerate(rewards)]
    df = spark.createDataFrame(rows, "g string, i int, r double")
    out = G.group_advantage(df, ["g"], "r", ["i"], rows_per_salt=rows_per_salt).collect()
    for row in out:
        rewards = groups[row.g]
        spread = statistics.stdev(rewards) if len(rewards) > 1 else 0.0
        assert row.advantage == pytest.approx((row.r - statistics.mean(rewards)) / (spread + 1e-4))
    assert len(out) == len(rows)
    plain = G.group_advantage(df, ["g"], "r", ["i"], scale=False).filter("g = 'a' and i = 0").first()
    assert plain.advantage == pytest.approx(1 - statistics.mean(groups["a"]))
    assert G.mean_reward(df, ["g"], "r").filter("g = 'a'").first().mean_reward == 0.625


def test_registry(spark):
    problems, completions = tables(spark)

    @F.pandas_udf("double")
    def longer(text: pd.Series) -> pd.Series:
        return (text.str.len() > 10).astype(float)

    register_reward("long", lambda completion, answer, **columns: longer(completion))
    register_reward("early", lambda completion, answer, sample_idx, **_: (sample_idx == 0).cast("double"))
    joined = completions.join(problems, "problem_id")
    row = apply_rewards(joined, ["correctness", "long", "early"]).filter("problem_id = 'p2' and sample_idx = 0").first()
    assert (row.correctness, row.long, row.early) == (1.0, 1.0, 1.0)

    @F.pandas_udf("boolean")
    def same_length(p: pd.Series, g: pd.Series) -> pd.Series:
        return p.str.len().eq(g.str.len())

    register_grader("length", lambda p, g: same_length(p, g))
    scored = G.evaluate(completions, problems, grader("length"))
    assert {r.problem_id: r.num_correct for r in scored.collect()}["p2"] == 4
    assert grader("equivalent") is equivalent
    with pytest.raises(ValueError):
        grader("unknown")


def test_hot_problem_is_split_at_run_time(spark):
    """One problem with a third of all rows and only distinct answers: adaptive execution splits it."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    completions = spark.range(150_000, numPartitions=16).select(
        hot.alias("problem_id"),
        F.col("id").cast("int").alias("sample_idx"),
        F.concat(F.lit("so \\boxed{a"), F.col("id").cast("string"), F.lit("}")).alias("text"),
    )
    problems = spark.range(-1, 5000).select(F.col("id").alias("problem_id"), F.lit("a0").alias("ground_truth"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",  # several map tasks, as at scale
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for result in (G.evaluate(completions, problems), G.grade(completions, problems)):
            rows = result.collect()
            plan = result._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan
            assert len(rows) in (150_000, result.select("problem_id").distinct().count())
    finally:
        for key in settings:
            spark.conf.unset(key)
