"""Answers, grading, metrics and rewards over lineitem (completions) and orders (problems)."""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import Bindings
from bindings.tables import (
    COMPLETIONS_SQL,
    EVALUATED,
    LAST_SQL,
    PROBLEMS_SQL,
    VAL_N,
    completions,
    problems,
    quote,
    rounded,
    table,
    votes_sql,
)
from sparkeval.functions.algebra import equivalent_algebra
from sparkeval.functions.answers import (
    boxed_first,
    boxed_last,
    equivalent,
    fallback_equal,
    normalize_answer,
)
from sparkeval.operators import grading
from sparkeval.operators.selection import pending
from sparkeval.plans import buckets
from sparkeval.plans.session import materialize, work_dir
from sparkeval.registry import apply_rewards
from sparkeval.sources.sinks import run_key, training_run_name, write_report

B = Bindings()
RUN = ["run_id", "problem_id"]
FIRST = r"regexp_extract(text, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)"
HAS_FIRST = r"regexp_matches(text, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}')"
FIRST_BOX = f"""first_box AS (
  SELECT problem_id, run_id, sample_idx, CASE WHEN {HAS_FIRST} THEN trim({FIRST}) END AS answer
  FROM completions)"""
REWARDS = f"""rewards AS (
  SELECT problem_id, sample_idx,
         CASE WHEN lower(answer) = lower(ground_truth) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward
  FROM first_box JOIN problems USING (problem_id))"""
WITH_FIRST = f"WITH {PROBLEMS_SQL},\n{COMPLETIONS_SQL},\n{FIRST_BOX},\n{REWARDS}"
WITH_LAST = f"WITH {COMPLETIONS_SQL},\n{LAST_SQL}"
WITH_GRADED = f"WITH {EVALUATED}"
WITH_SCORED = f"WITH {EVALUATED},\n{votes_sql()}"
TOTALS = f"""totals AS (
  SELECT count(*) AS num_problems, count(*) * {VAL_N} AS total_solutions,
         count(*) FILTER (WHERE has_correct) AS pass_at_n,
         CAST(coalesce(sum(num_correct), 0) AS BIGINT) AS average_at_n,
         count(*) FILTER (WHERE majority_vote_correct) AS majority_vote_at_n,
         CAST(coalesce(sum(num_formatted), 0) AS BIGINT) AS formatted_count
  FROM problems LEFT JOIN scored USING (problem_id))"""
WITH_TOTALS = f"{WITH_SCORED},\n{TOTALS}"


def pct(part: str, whole: str, name: str) -> str:
    return f"round({part} / {whole}::DOUBLE * 100, 6) AS {name}"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return grading.evaluate(completions(spark, d), problems(spark, d))


def summary(spark: SparkSession, d: str) -> DataFrame:
    out = grading.summary(scored(spark, d), problems(spark, d), VAL_N)
    return out.withColumns(
        rounded("pass_at_n_pct", "average_at_n_pct", "majority_vote_at_n_pct", "format_rate")
    )


@B.add("scan_completions", f"WITH {COMPLETIONS_SQL} SELECT * FROM completions")
def scan_completions(spark, d):
    return completions(spark, d)


@B.add(
    "join_completions",
    f"""WITH {PROBLEMS_SQL}, {COMPLETIONS_SQL}
SELECT problem_id, ground_truth, sample_idx, text FROM problems LEFT JOIN completions USING (problem_id)""",
)
def join_completions(spark, d):
    joined = grading.join_completions(completions(spark, d), problems(spark, d))
    return joined.select("problem_id", "ground_truth", "sample_idx", "text")


@B.add(
    "boxed_first",
    f"{WITH_FIRST} SELECT problem_id, sample_idx, answer FROM first_box",
)
def first_box(spark, d):
    return completions(spark, d).select("problem_id", "sample_idx", boxed_first("text").alias("answer"))


@B.add("boxed_last", f"{WITH_LAST} SELECT problem_id, sample_idx, answer FROM last_box")
def last_box(spark, d):
    return completions(spark, d).select("problem_id", "sample_idx", boxed_last("text").alias("answer"))


@B.add(
    "normalize_answer",
    f"{WITH_LAST} SELECT problem_id, sample_idx, lower(trim(answer)) AS answer FROM last_box",
)
def normalized(spark, d):
    answers = completions(spark, d).withColumn("answer", boxed_last("text"))
    return answers.select("problem_id", "sample_idx", normalize_answer("answer").alias("answer"))


def rewarded(spark: SparkSession, d: str) -> DataFrame:
    rewards = grading.exact_rewards(completions(spark, d), problems(spark, d))
    return rewards.select("problem_id", "sample_idx", "reward")


@B.add("reward_exact", f"{WITH_FIRST} SELECT * FROM rewards")
def reward_exact(spark, d):
    return rewarded(spark, d)


@B.add("reward_registry", f"{WITH_FIRST} SELECT * FROM rewards")
def reward_registry(spark, d):
    """The same through the registry, where a reward sees the text and all other columns."""
    joined = completions(spark, d).join(problems(spark, d), "problem_id")
    return apply_rewards(joined, ["correctness"]).select(
        "problem_id", "sample_idx", F.col("correctness").alias("reward")
    )


@B.add(
    "reward_mean",
    f"""{WITH_FIRST} SELECT problem_id, count(*) AS num_samples, round(avg(reward), 6) AS mean_reward
FROM rewards GROUP BY problem_id""",
)
def reward_mean(spark, d):
    means = grading.mean_reward(rewarded(spark, d), ["problem_id"])
    return means.withColumns(rounded("mean_reward"))


@B.add(
    "group_advantage",
    f"""{WITH_FIRST} SELECT problem_id, sample_idx, reward,
  round((reward - avg(reward) OVER p) / (coalesce(stddev_samp(reward) OVER p, 0) + 1e-4), 6) + 0.0
    AS advantage
FROM rewards WINDOW p AS (PARTITION BY problem_id)""",
)
def group_advantage(spark, d):
    rows = materialize(rewarded(spark, d), "rewards")
    out = grading.group_advantage(rows, ["problem_id"], "reward", ["sample_idx"])
    return out.withColumn("advantage", F.round("advantage", 6) + 0.0)


@B.add(
    "grade_fallback",
    rf"""WITH {PROBLEMS_SQL}, {COMPLETIONS_SQL}, {LAST_SQL}
SELECT problem_id, sample_idx,
       coalesce(lower(replace(replace(answer, '$', ''), ' ', '')) = lower(ground_truth), false) AS correct
FROM last_box JOIN problems USING (problem_id)""",
)
def grade_fallback(spark, d):
    graded = grading.grade(completions(spark, d), problems(spark, d), fallback_equal)
    return graded.select("problem_id", "sample_idx", "correct")


SPELLED = r"""CASE l_linenumber WHEN 1 THEN '0.' || lpad(CAST(d AS VARCHAR), 2, '0')
    WHEN 2 THEN d || '\%' WHEN 3 THEN '\frac{' || d || '}{100}' WHEN 4 THEN (2 * d) || '/200'
    WHEN 5 THEN '$ 0.' || lpad(CAST(d AS VARCHAR), 2, '0') || '0 $'
    WHEN 6 THEN '\dfrac{' || (10 * d) || '}{1000}' ELSE '+' || d || '.0%' END"""


@B.add(
    "grade_equiv",
    f"""SELECT l_orderkey, l_linenumber, {SPELLED} AS predicted,
  '0.' || lpad(CAST(t AS VARCHAR), 2, '0') AS ground_truth, d = t AS correct
FROM (SELECT *, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
      FROM lineitem)""",
)
def grade_equiv(spark, d):
    """The discount spelled in seven ways against the tax as a decimal: equal where the values are."""
    cents = F.round(F.col("l_discount") * 100).cast("long")
    tax = F.round(F.col("l_tax") * 100).cast("long")

    def decimal(value):
        return F.concat(F.lit("0."), F.lpad(value.cast("string"), 2, "0"))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    line = F.col("l_linenumber")
    spelled = (
        F.when(line == 1, decimal(cents))
        .when(line == 2, text(cents, "\\%"))
        .when(line == 3, text("\\frac{", cents, "}{100}"))
        .when(line == 4, text(cents * 2, "/200"))
        .when(line == 5, text("$ ", decimal(cents), "0 $"))
        .when(line == 6, text("\\dfrac{", cents * 10, "}{1000}"))
        .otherwise(text("+", cents, ".0%"))
    )
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", spelled.alias("predicted"), decimal(tax).alias("ground_truth")
    )
    return grading.graded_once(lines, "predicted", "ground_truth")


# Two spellings of one expression in x; with ``off`` they are one apart. The last kind cannot be read.
EXPRESSIONS = {
    0: ("(x+{a})^2", "x^{{2}}+{2a}x+{aa+off}"),
    1: ("(x+{a})(x-{b})", "x^2+{a-b}x-{ab+off}"),
    2: (r"\frac{{x}}{{{a}}}+\frac{{x}}{{{b}}}", r"\frac{{{a+b+off}x}}{{{ab}}}"),
    3: (r"\sqrt{{{aab}}}", r"{a}\sqrt{{{b+off}}}"),
    4: (r"({a}\pi r)^{{-2}}", r"\frac{{1}}{{{aa+off}r^2\cdot\pi^2}}"),
    5: (r"\sin({a})", r"\sin({a+off})"),
}
TERMS = {
    "a": "a", "b": "b", "2a": "2 * a", "aa+off": "a * a + off", "a-b": "a - b", "ab+off": "a * b + off",
    "a+b+off": "a + b + off", "ab": "a * b", "aab": "a * a * b", "b+off": "b + off", "a+off": "a + off",
}


def expression_parts(form: str) -> list[tuple[str, bool]]:
    """Literal texts and the names of terms, in order."""
    return [x for text, name, _, _ in Formatter().parse(form) for x in ((text, False), (name, True)) if x[0]]


def expression_sql(side: int) -> str:
    def text(form: str) -> str:
        return " || ".join(f"CAST({TERMS[x]} AS VARCHAR)" if term else quote(x) for x, term in expression_parts(form))

    return "CASE kind " + " ".join(f"WHEN {k} THEN {text(v[side])}" for k, v in EXPRESSIONS.items()) + " END"


@B.add(
    "grade_algebra",
    f"""SELECT l_orderkey, l_linenumber, {expression_sql(0)} AS predicted, {expression_sql(1)} AS ground_truth,
  off = 0 AS correct
FROM (SELECT *, CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, l_suppkey % 6 AS kind,
        CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS off FROM lineitem)""",
)
def grade_algebra(spark, d):
    """Expressions in several spellings, equal or one apart."""
    off = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    numbers = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linenumber").cast("bigint").alias("a"),
        F.col("l_quantity").cast("bigint").alias("b"),
        off.alias("off"),
        F.pmod("l_suppkey", F.lit(6)).alias("kind"),
    )

    def text(side: int) -> Column:
        def of(form: str) -> Column:
            return F.concat(*[F.expr(TERMS[x]).cast("string") if term else F.lit(x) for x, term in expression_parts(form)])

        return reduce(lambda c, k: c.when(F.col("kind") == k, of(EXPRESSIONS[k][side])), EXPRESSIONS, F)

    lines = numbers.select("l_orderkey", "l_linenumber", text(0).alias("predicted"), text(1).alias("ground_truth"))
    return grading.graded_once(lines, "predicted", "ground_truth", equivalent_algebra)


@B.add(
    "grade_table",
    f"{WITH_GRADED} SELECT problem_id, sample_idx, predicted, formatted, correct FROM graded",
)
def grade_table(spark, d):
    graded = grading.grade(completions(spark, d), problems(spark, d))
    return graded.select("problem_id", "sample_idx", "predicted", "formatted", "correct")


@B.add(
    "per_problem",
    f"""{WITH_GRADED} SELECT problem_id, count(*) AS num_samples, count(*) FILTER (WHERE correct) AS num_correct,
  count(*) FILTER (WHERE formatted) AS num_formatted, bool_or(correct) AS has_correct FROM graded GROUP BY problem_id""",
)
def per_problem(spark, d):
    return grading.per_problem(grading.grade(completions(spark, d), problems(spark, d)))


@B.add(
    "majority_vote",
    f"""{WITH_SCORED} SELECT g.problem_id, majority_answer, coalesce(votes, 0) AS votes,
  coalesce(won, false) AS majority_vote_correct
FROM (SELECT DISTINCT problem_id FROM graded) g LEFT JOIN votes USING (problem_id)""",
)
def majority_vote(spark, d):
    return grading.majority_vote(grading.grade(completions(spark, d), problems(spark, d)))


@B.add("evaluate", f"{WITH_SCORED} SELECT * FROM scored")
def evaluate(spark, d):
    return scored(spark, d)


@B.add(
    "pass_at_n",
    f"{WITH_TOTALS} SELECT num_problems, pass_at_n, {pct('pass_at_n', 'num_problems', 'pass_at_n_pct')} FROM totals",
)
def pass_at_n(spark, d):
    return summary(spark, d).select("num_problems", "pass_at_n", "pass_at_n_pct")


@B.add(
    "avg_at_n",
    f"""{WITH_TOTALS} SELECT total_solutions, average_at_n,
  {pct('average_at_n', 'total_solutions', 'average_at_n_pct')},
  (SELECT round(count(*) FILTER (WHERE correct) / count(*)::DOUBLE * 100, 6) FROM graded) AS observed_pct FROM totals""",
)
def avg_at_n(spark, d):
    """Both denominators: the samples asked for, and the samples there are."""
    rows, asked = materialize(scored(spark, d), "scored"), problems(spark, d)
    observed = grading.summary(rows, asked, VAL_N, "observed").select(
        F.round("average_at_n_pct", 6).alias("observed_pct")
    )
    declared = grading.summary(rows, asked, VAL_N).withColumns(rounded("average_at_n_pct"))
    return declared.select("total_solutions", "average_at_n", "average_at_n_pct").withColumn(
        "observed_pct", observed.scalar()
    )


@B.add(
    "maj_at_n",
    f"""{WITH_TOTALS} SELECT num_problems, majority_vote_at_n,
  {pct('majority_vote_at_n', 'num_problems', 'majority_vote_at_n_pct')} FROM totals""",
)
def maj_at_n(spark, d):
    return summary(spark, d).select("num_problems", "majority_vote_at_n", "majority_vote_at_n_pct")


@B.add(
    "format_rate",
    f"""{WITH_TOTALS} SELECT total_solutions, formatted_count,
  {pct('formatted_count', 'total_solutions', 'format_rate')} FROM totals""",
)
def format_rate(spark, d):
    return summary(spark, d).select("total_solutions", "formatted_count", "format_rate")


SUMMARY_SQL = f"""{VAL_N} AS val_n, num_problems, total_solutions, pass_at_n,
  {pct('pass_at_n', 'num_problems', 'pass_at_n_pct')}, average_at_n,
  {pct('average_at_n', 'total_solutions', 'average_at_n_pct')}, majority_vote_at_n,
  {pct('majority_vote_at_n', 'num_problems', 'majority_vote_at_n_pct')}, formatted_count,
  {pct('formatted_count', 'total_solutions', 'format_rate')}"""


@B.add("eval_summary", f"{WITH_TOTALS} SELECT {SUMMARY_SQL} FROM totals")
def eval_summary(spark, d):
    return summary(spark, d)


RUNNING = f"""{WITH_SCORED},
ordered AS (
  SELECT ord, problem_id, row_number() OVER o AS idx, coalesce(has_correct, false) AS has_correct,
         coalesce(num_correct, 0) AS num_correct,
         sum(CASE WHEN has_correct THEN 1 ELSE 0 END) OVER o AS p,
         sum(coalesce(num_correct, 0)) OVER o AS c, sum(coalesce(num_formatted, 0)) OVER o AS f
  FROM problems LEFT JOIN scored USING (problem_id)
  WINDOW o AS (ORDER BY ord ROWS UNBOUNDED PRECEDING)),
running AS (
  SELECT ord, problem_id, idx, has_correct, num_correct, {pct('p', 'idx', 'pass_at_n_pct')},
         {pct('c', f'(idx * {VAL_N})', 'average_at_n_pct')}, {pct('f', f'(idx * {VAL_N})', 'format_rate')}
  FROM ordered)"""


def running(spark: SparkSession, d: str) -> DataFrame:
    stored = materialize(scored(spark, d), "scored")
    out = grading.running_metrics(stored, problems(spark, d), VAL_N)
    return out.withColumns(rounded("pass_at_n_pct", "average_at_n_pct", "format_rate"))


@B.add("running_metrics", f"{RUNNING} SELECT * FROM running")
def running_metrics(spark, d):
    return running(spark, d)


@B.add("progress_snapshot", f"{RUNNING} SELECT * FROM running WHERE idx % 10 = 0")
def progress_snapshot(spark, d):
    return grading.progress_snapshot(running(spark, d))


@B.add(
    "eval_results",
    f"""{WITH_SCORED} SELECT p.problem_id, p.problem, p.ground_truth, {VAL_N} AS val_n,
  coalesce(s.num_correct, 0) AS num_correct, coalesce(s.has_correct, false) AS pass_at_n,
  coalesce(s.majority_vote_correct, false) AS majority_vote_correct,
  coalesce(g.predicted, '[No boxed answer found]') AS predicted_answer,
  g.text AS full_generation, coalesce(g.correct, false) AS correct, coalesce(g.formatted, false) AS formatted
FROM problems p LEFT JOIN scored s USING (problem_id)
LEFT JOIN graded g ON g.problem_id = p.problem_id AND g.sample_idx = 0""",
)
def eval_results(spark, d):
    rows = completions(spark, d)
    return grading.results(rows, problems(spark, d), scored(spark, d), VAL_N)


@B.add(
    "eval_generations",
    f"""{WITH_GRADED} SELECT problem_id, CAST(sample_idx // 64 AS INTEGER) AS part,
  string_agg(sample_idx || '|' || predicted || '|' || text || '|' || correct || '|' || formatted, ';'
             ORDER BY sample_idx) AS generations
FROM graded GROUP BY problem_id, sample_idx // 64""",
)
def eval_generations(spark, d):
    nested = grading.generations(completions(spark, d), problems(spark, d))
    fields = ["sample_idx", "predicted_answer", "full_generation", "correct", "formatted"]
    sample = lambda g: F.concat_ws("|", *[g[f].cast("string") for f in fields])
    return nested.withColumn("generations", F.array_join(F.transform("generations", sample), ";"))


@B.add(
    "eval_report",
    f"""{WITH_SCORED} SELECT p.problem_id, p.ground_truth, s.num_correct, s.has_correct AS pass_at_n,
  s.majority_vote_correct, s.num_samples AS num_generations
FROM problems p JOIN scored s USING (problem_id)""",
)
def eval_report(spark, d):
    """Writes the report and reads its JSON back."""
    path = work_dir(spark, "report")
    rows, asked = materialize(completions(spark, d), "completions"), problems(spark, d)
    per = materialize(grading.evaluate(rows, asked), "scored")
    write_report(
        grading.summary(per, asked, VAL_N),
        grading.results(rows, asked, per, VAL_N),
        grading.generations(rows, asked),
        path,
    )
    header = spark.read.json(f"{path}/results")
    detail = spark.read.json(f"{path}/generations").groupBy("problem_id")
    sizes = detail.agg(F.sum(F.size("generations")).alias("num_generations"))
    return header.join(sizes, "problem_id").select(
        "problem_id",
        "ground_truth",
        "num_correct",
        "pass_at_n",
        "majority_vote_correct",
        "num_generations",
    )


RUNS_SCORED = f"WITH {EVALUATED},\n{votes_sql('run_id, problem_id')}"


def scored_runs(spark: SparkSession, d: str) -> DataFrame:
    return grading.evaluate(completions(spark, d), problems(spark, d), keys=RUN)


@B.add(
    "eval_results_runs",
    f"""{RUNS_SCORED} SELECT a.run_id, p.problem_id, p.problem, p.ground_truth, {VAL_N} AS val_n,
  coalesce(s.num_correct, 0) AS num_correct, coalesce(s.has_correct, false) AS pass_at_n,
  coalesce(s.majority_vote_correct, false) AS majority_vote_correct,
  coalesce(g.predicted, '[No boxed answer found]') AS predicted_answer,
  g.text AS full_generation, coalesce(g.correct, false) AS correct, coalesce(g.formatted, false) AS formatted
FROM (SELECT DISTINCT run_id FROM scored) a CROSS JOIN problems p
LEFT JOIN scored s ON s.problem_id = p.problem_id AND s.run_id = a.run_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, problem_id ORDER BY sample_idx) AS r FROM graded) g
  ON g.problem_id = p.problem_id AND g.run_id = a.run_id AND r = 1""",
)
def eval_results_runs(spark, d):
    """Every problem for every run; the first sample of a run is any index, as samples are numbered per
    problem."""
    rows = completions(spark, d)
    stored = materialize(scored_runs(spark, d), "scored")
    return grading.results(rows, problems(spark, d), stored, VAL_N, runs=["run_id"])


@B.add(
    "eval_generations_runs",
    f"""{WITH_GRADED} SELECT run_id, problem_id, CAST(sample_idx // 64 AS INTEGER) AS part,
  string_agg(sample_idx || '|' || predicted || '|' || correct, ';' ORDER BY sample_idx) AS generations
FROM graded GROUP BY run_id, problem_id, sample_idx // 64""",
)
def eval_generations_runs(spark, d):
    nested = grading.generations(completions(spark, d), problems(spark, d), runs=["run_id"])
    fields = ["sample_idx", "predicted_answer", "correct"]
    sample = lambda g: F.concat_ws("|", *[g[f].cast("string") for f in fields])
    return nested.withColumn("generations", F.array_join(F.transform("generations", sample), ";"))


@B.add(
    "running_metrics_runs",
    f"""{RUNS_SCORED},
ordered AS (
  SELECT run_id, ord, problem_id, row_number() OVER o AS idx, coalesce(has_correct, false) AS has_correct,
         coalesce(num_correct, 0) AS num_correct,
         sum(CASE WHEN has_correct THEN 1 ELSE 0 END) OVER o AS p,
         sum(coalesce(num_correct, 0)) OVER o AS c, sum(coalesce(num_formatted, 0)) OVER o AS f
  FROM (SELECT DISTINCT run_id FROM scored) CROSS JOIN problems LEFT JOIN scored USING (run_id, problem_id)
  WINDOW o AS (PARTITION BY run_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT run_id, ord, problem_id, idx, has_correct, num_correct, {pct('p', 'idx', 'pass_at_n_pct')},
       {pct('c', f'(idx * {VAL_N})', 'average_at_n_pct')}, {pct('f', f'(idx * {VAL_N})', 'format_rate')}
FROM ordered""",
)
def running_metrics_runs(spark, d):
    """Each run over all problems, answered or not."""
    stored = materialize(scored_runs(spark, d), "scored")
    out = grading.running_metrics(stored, problems(spark, d), VAL_N, runs=["run_id"])
    return out.withColumns(rounded("pass_at_n_pct", "average_at_n_pct", "format_rate"))


# Attributes of a report, besides its numbers.
ATTRIBUTES = {
    "base_model": "base-1",
    "dataset": "aime24",
    "enable_thinking": True,
    "temperature": 1.0,
    "top_p": 0.95,
    "top_k": -1,
    "min_p": 0.0,
    "presence_penalty": 0.0,
    "max_new_tokens": 38912,
}


@B.add(
    "eval_report_runs",
    f"""{RUNS_SCORED}, n AS (SELECT count(*) AS num_problems FROM problems)
SELECT run_id, {", ".join(f"{quote(v) if isinstance(v, str) else v} AS {k}" for k, v in ATTRIBUTES.items())},
  {VAL_N} AS val_n, any_value(num_problems) AS num_problems,
  count(*) FILTER (WHERE has_correct) AS pass_at_n, CAST(sum(num_correct) AS BIGINT) AS average_at_n,
  any_value(num_problems) AS listed, CAST(sum(num_samples) AS BIGINT) AS num_generations
FROM scored, n GROUP BY run_id""",
)
def eval_report_runs(spark, d):
    """One report per run with all its attributes, in folders by run, read back. Its results list every
    problem."""
    path = work_dir(spark, "report")
    rows, asked = materialize(completions(spark, d), "completions"), problems(spark, d)
    per = materialize(grading.evaluate(rows, asked, keys=RUN), "scored")
    write_report(
        grading.summary(per, asked, VAL_N, runs=["run_id"], attributes=ATTRIBUTES),
        grading.results(rows, asked, per, VAL_N, runs=["run_id"]),
        grading.generations(rows, asked, runs=["run_id"]),
        path,
        ["run_id"],
    )
    header = spark.read.json(f"{path}/summary")
    listed = spark.read.json(f"{path}/results").groupBy("run_id").agg(F.count("*").alias("listed"))
    detail = spark.read.json(f"{path}/generations").groupBy("run_id")
    sizes = detail.agg(F.sum(F.size("generations")).alias("num_generations"))
    return header.join(listed, "run_id").join(sizes, "run_id").select(
        "run_id", *ATTRIBUTES, "val_n", "num_problems", "pass_at_n", "average_at_n", "listed", "num_generations"
    )


@B.add(
    "join_bucketed",
    f"""WITH {PROBLEMS_SQL}, {COMPLETIONS_SQL}
SELECT problem_id, sample_idx, run_id, text, problem, ground_truth FROM completions JOIN problems USING (problem_id)""",
)
def join_bucketed(spark, d):
    """Both tables stored in buckets; the join reads them as they lie."""
    stored, asked = buckets.store(completions(spark, d), problems(spark, d), 16)
    return buckets.join_stored(stored, asked).select("problem_id", "sample_idx", "run_id", "text", "problem", "ground_truth")


@B.add(
    "evaluate_bucketed",
    f"""{WITH_SCORED} SELECT problem_id, num_samples, num_correct, num_formatted, has_correct, majority_vote_correct
FROM scored""",
)
def evaluate_bucketed(spark, d):
    stored, asked = buckets.store(completions(spark, d), problems(spark, d), 16)
    return buckets.evaluate_stored(stored, asked)


@B.add(
    "explode_outputs",
    f"{WITH_LAST} SELECT problem_id, sample_idx, text FROM completions",
)
def explode_outputs(spark, d):
    """One array of outputs per problem and part, exploded into samples again."""
    parts = grading.generations(completions(spark, d), problems(spark, d))
    texts = F.transform("generations", lambda g: g["full_generation"])
    exploded = grading.explode_outputs(parts.select("problem_id", "part", texts.alias("outputs")))
    index = F.col("sample_idx") + F.col("part") * 64
    return exploded.select("problem_id", index.alias("sample_idx"), "text")


@B.add(
    "resume_anti_join",
    f"""WITH {PROBLEMS_SQL}
SELECT problem_id, ord, problem, ground_truth FROM problems
WHERE problem_id NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("problem_id"))
    return pending(problems(spark, d), done, ["problem_id"])


@B.add(
    "leaderboard",
    f"""WITH {EVALUATED},
{votes_sql('run_id, problem_id')}
SELECT run_id, np AS num_problems, np * {VAL_N} AS total_solutions,
  {pct('sum(num_correct)', f'(np * {VAL_N})', 'average_at_n_pct')},
  {pct('count(*) FILTER (WHERE has_correct)', 'np', 'pass_at_n_pct')},
  {pct('count(*) FILTER (WHERE majority_vote_correct)', 'np', 'majority_vote_at_n_pct')}
FROM scored, (SELECT count(*) AS np FROM problems) GROUP BY run_id, np""",
)
def leaderboard(spark, d):
    asked = problems(spark, d)
    per = grading.evaluate(completions(spark, d), asked, keys=RUN)
    board = grading.leaderboard(grading.summary(per, asked, VAL_N, runs=["run_id"]))
    return board.withColumns(
        rounded("average_at_n_pct", "pass_at_n_pct", "majority_vote_at_n_pct")
    )


@B.add(
    "run_key",
    """SELECT 'eval_results_' || l_returnflag || '_base-' || l_linenumber ||
  CASE WHEN l_tax = 0 THEN '' ELSE '_run-' || l_linenumber || '_checkpoint-' || l_suppkey END ||
  CASE WHEN l_linestatus = 'O' THEN '_thinking' ELSE '_nonthinking' END ||
  '_temp' || l_discount || '_valn' || l_linenumber AS run_key,
  'sft_base-' || l_linenumber || '_lr' || l_linenumber || 'e-4_bs' || CAST(l_quantity AS BIGINT)
    AS training_run, count(*) AS n
FROM lineitem GROUP BY 1, 2""",
)
def run_keys(spark, d):
    number, supplier = F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    model = F.concat(F.lit("/models/base-"), number)
    checkpoint = F.concat(F.lit("/runs/run-"), number, F.lit("/checkpoint-"), supplier)
    key = run_key(
        "l_returnflag",
        model,
        F.when(F.col("l_tax") != 0, checkpoint),
        F.col("l_linestatus") == "O",
        "l_discount",
        "l_linenumber",
    )
    rate = F.col("l_linenumber") * 1e-4
    name = training_run_name("sft", model, rate, F.col("l_quantity").cast("long"))
    return (
        table(spark, d, "lineitem")
        .groupBy(key.alias("run_key"), name.alias("training_run"))
        .agg(F.count("*").alias("n"))
    )
