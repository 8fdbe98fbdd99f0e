"""Reports of several runs: each run's own samples, lowest sample first, unanswered problems counted."""

from __future__ import annotations

import pytest

from sparkeval.operators import grading


@pytest.fixture(scope="module")
def tables(spark):
    problems = spark.createDataFrame(
        [(p, p, f"q{p}", "7") for p in (1, 2, 3)], "problem_id int, ord int, problem string, ground_truth string"
    )
    rows = [("a", 1, 1, "7"), ("a", 1, 2, "8"), ("b", 1, 1, "9"), ("b", 2, 4, "7"), ("b", 2, 5, "1")]
    completions = spark.createDataFrame(
        [(r, p, i, f"so \\boxed{{{x}}}") for r, p, i, x in rows],
        "run_id string, problem_id int, sample_idx int, text string",
    )
    return completions, problems


def test_results(tables):
    completions, problems = tables
    scored = grading.evaluate(completions, problems, keys=["run_id", "problem_id"])
    out = grading.results(completions, problems, scored, 2, runs=["run_id"]).collect()
    assert {(r.run_id, r.problem_id): (r.predicted_answer, r.correct) for r in out} == {
        ("a", 1): ("7", True),
        ("a", 2): ("[No boxed answer found]", False),
        ("a", 3): ("[No boxed answer found]", False),
        ("b", 1): ("9", False),
        ("b", 2): ("7", True),
        ("b", 3): ("[No boxed answer found]", False),
    }


def test_too_many_runs_are_an_error(tables, monkeypatch):
    monkeypatch.setattr(grading, "MAX_RUNS", 1)
    completions, problems = tables
    scored = grading.evaluate(completions, problems, keys=["run_id", "problem_id"])
    with pytest.raises(Exception, match="more than 1 runs"):
        grading.results(completions, problems, scored, 2, runs=["run_id"]).collect()


def test_results_keep_unanswered_problems(tables):
    completions, problems = tables
    one = completions.filter("run_id = 'a'")
    out = {r.problem_id: r for r in grading.results(one, problems, grading.evaluate(one, problems), 2).collect()}
    assert len(out) == 3
    assert out[1].predicted_answer == "7" and out[1].formatted and out[1].correct
    assert out[3].predicted_answer == "[No boxed answer found]" and out[3].num_correct == 0 and not out[3].pass_at_n


def test_results_of_every_run_keep_unanswered_problems(tables):
    completions, problems = tables
    scored = grading.evaluate(completions, problems, keys=["run_id", "problem_id"])
    rows = grading.results(completions, problems, scored, 2, runs=["run_id"]).collect()
    out = {(r.run_id, r.problem_id): r for r in rows}
    assert len(rows) == len(out) == 6
    assert (out["a", 1].predicted_answer, out["a", 1].correct) == ("7", True)
    for key in (("a", 2), ("a", 3), ("b", 3)):
        r = out[key]
        assert (r.predicted_answer, r.num_correct, r.problem) == ("[No boxed answer found]", 0, f"q{key[1]}")
        assert not (r.pass_at_n or r.majority_vote_correct or r.correct or r.formatted) and r.full_generation is None


def test_generations(tables):
    completions, problems = tables
    out = grading.generations(completions, problems, runs=["run_id"]).collect()
    assert {(r.run_id, r.problem_id): [g.sample_idx for g in r.generations] for r in out} == {
        ("a", 1): [1, 2],
        ("b", 1): [1],
        ("b", 2): [4, 5],
    }


def test_running_metrics_count_unanswered_problems(tables):
    completions, problems = tables
    scored = grading.evaluate(completions, problems, keys=["run_id", "problem_id"])
    out = grading.running_metrics(scored, problems, 2, runs=["run_id"])
    last = {r.run_id: r.pass_at_n_pct for r in out.filter("idx = 3").collect()}
    assert last == pytest.approx({"a": 100 / 3, "b": 100 / 3})
    assert out.count() == 6


def test_only_first_samples_are_moved(spark):
    """All but the first sample of a problem and run are dropped before the shuffle."""
    rows = [("a", f"p{i % 5}", i // 5, f"\\boxed{{{i}}}") for i in range(50)]
    samples = spark.createDataFrame(rows, "run_id string, problem_id string, sample_idx int, text string")
    asked = spark.createDataFrame([(f"p{i}", "?", str(i)) for i in range(5)], "problem_id string, problem string, ground_truth string")
    scored = grading.evaluate(samples, asked, keys=["run_id", "problem_id"])
    out = grading.results(samples, asked, scored, 10, runs=["run_id"])
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "LeftSemi" not in plan
    assert sorted((r.problem_id, r.full_generation, r.correct) for r in out.collect()) == [(f"p{i}", f"\\boxed{{{i}}}", True) for i in range(5)]
