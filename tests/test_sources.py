"""Scans, benchmark adapters, reports and run names."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from sparkeval.operators import grading as G
from sparkeval.plans.session import work_dir
from sparkeval.sources import benchmarks as B
from sparkeval.sources import sinks, tables


def test_required_columns(spark):
    path = work_dir(spark)
    spark.createDataFrame([("p", "s", 1)], "problem string, solution string, other int").write.parquet(path)
    df = tables.read_corpus(spark, path, ["problem", "solution"])
    assert df.columns == ["problem", "solution"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<problem:string,solution:string>" in plan
    with pytest.raises(ValueError, match="Answer"):
        tables.read_corpus(spark, path, ["problem", "Answer"])


def test_adapters(spark):
    frames = {
        "math500": ([(0, "p", r"so \boxed{ 3 }"), (1, "q", "none")], "n int, problem string, solution string"),
        "amo-bench": ([(0, "p", "a", "id7")], "n int, prompt string, answer string, question_id string"),
        "aime24": ([(0, "p", "a", 9)], "n int, problem string, answer string, id int"),
        "aime25": ([(0, "p", 12, 4)], "n int, problem string, answer int, problem_idx int"),
        "hmmt25": ([(0, "p", 1.5, None)], "n int, problem string, answer double, problem_idx int"),
        "minerva": ([(0, "p", "a")], "n int, question string, answer string"),
        "amc23": ([(0, "p", "a", "x")], "n int, question string, answer string, id string"),
    }
    sources = {n: (spark.createDataFrame(rows, schema), "n") for n, (rows, schema) in frames.items()}
    got = {(r.dataset, r.problem_id): r.ground_truth for r in B.unify_benchmarks(sources).collect()}
    assert got == {
        ("math500", "0"): "3",
        ("math500", "1"): "none",
        ("amo-bench", "id7"): "a",
        ("aime24", "9"): "a",
        ("aime25", "4"): "12",
        ("hmmt25", "0"): "1.5",
        ("minerva", "0"): "a",
        ("amc23", "x"): "a",
    }
    with pytest.raises(ValueError, match="Unknown dataset"):
        B.shape_of("gsm8k")
    with pytest.raises(ValueError, match="answer"):
        B.adapt_benchmark(spark.range(1).withColumn("problem", F.lit("p")), "AIME24", "id")


def test_read_benchmark(spark):
    path = work_dir(spark)
    rows = spark.range(20).select("id", F.col("id").cast("string").alias("problem"), F.lit("a").alias("answer"))
    rows.repartition(4).write.json(path)
    few = B.read_benchmark(spark, "aime24", path, "id", 3, "json")
    assert sorted(r.problem for r in few.collect()) == ["0", "1", "2"]
    assert B.read_benchmark(spark, "aime24", path, "id", None, "json").count() == 20
    assert B.read_benchmark(spark, "aime24", path, "id", 99, "json").count() == 20


def test_completions_as_table_and_stream(spark):
    path = work_dir(spark)
    rows = [("r", "p", 0, "t")]
    spark.createDataFrame(rows, tables.COMPLETIONS).write.parquet(path)
    assert tables.read_completions(spark, path).count() == 1
    assert tables.read_completions(spark, path, streaming=True).isStreaming


def test_run_key(spark):
    df = spark.createDataFrame(
        [("aime24", "/m/Base-1B", "/runs/x/checkpoint-5", True, 1.0, 16), ("amc23", "org/Base/", None, False, 0.6, 6)],
        "d string, m string, c string, t boolean, temp double, n int",
    )
    got = [r[0] for r in df.select(sinks.run_key("d", "m", "c", "t", "temp", "n")).collect()]
    assert got == [
        "eval_results_aime24_Base-1B_x_checkpoint-5_thinking_temp1.0_valn16",
        "eval_results_amc23_Base_nonthinking_temp0.6_valn6",
    ]


@pytest.mark.parametrize("rate, label", [(2e-4, "2e-4"), (0.0002, "2e-4"), (5e-6, "5e-6"), (1e-10, "1e-10")])
def test_rate_label(spark, rate, label):
    assert spark.range(1).select(sinks.rate_label(F.lit(rate))).first()[0] == label


def test_run_name(spark):
    name = sinks.training_run_name("sft", F.lit("a/b/Base"), F.lit(1e-5), F.lit(32), F.lit("ep4"))
    assert spark.range(1).select(name).first()[0] == "sft_Base_lr1e-5_bs32_ep4"


def test_report(spark):
    problems = spark.createDataFrame([("p", 0, "é?", "A")], "problem_id string, ord long, problem string, ground_truth string")
    completions = spark.createDataFrame(
        [("p", 0, "\\boxed{A} 😀"), ("p", 1, "no")], "problem_id string, sample_idx int, text string"
    )
    scored = G.evaluate(completions, problems)
    path = work_dir(spark)
    attributes = {"run_id": "r1", "dataset": "aime24"}
    sinks.write_report(
        G.summary(scored, problems, 2, attributes=attributes),
        G.results(completions, problems, scored, 2),
        G.generations(completions, problems),
        path,
        ["run_id"],
    )
    summary = spark.read.json(f"{path}/summary").first()
    assert (summary.run_id, summary.dataset, summary.pass_at_n, summary.average_at_n_pct) == ("r1", "aime24", 1, 50.0)
    row = spark.read.json(f"{path}/results").first()
    assert (row.problem, row.full_generation, row.predicted_answer) == ("é?", "\\boxed{A} 😀", "A")
    samples = spark.read.json(f"{path}/generations").first().generations
    assert [(s.predicted_answer, s.formatted, s.correct) for s in samples] == [
        ("A", True, True), ("[No boxed answer found]", False, False)
    ]


def test_reports_are_compressed(spark, tmp_path):
    one = spark.createDataFrame([("r", 1)], "run_id string, n int")
    sinks.write_report(one, one, one, str(tmp_path), ["run_id"])
    for name in ("summary", "results", "generations"):
        assert spark.read.json(f"{tmp_path}/{name}").select("run_id", "n").collect() == one.collect()
        files = [f.name for f in (tmp_path / name).rglob("part-*")]
        assert files and all(f.endswith(".json.gz") for f in files)
