"""Grade completions and turn them into pass@n, avg@n, majority vote and format rate."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.functions.answers import (
    boxed_first,
    boxed_last,
    equivalent,
    exact_reward,
    stored_prediction,
)
from sparkeval.plans.ordering import running_sums
from sparkeval.plans.skew import attach, same_group

Grader = Callable[[Column, Column], Column]
PROBLEM = ["problem_id"]
MAX_RUNS = 10_000


def join_completions(completions: DataFrame, problems: DataFrame) -> DataFrame:
    """Every completion with its problem, and once each problem that has none.

    Written as an inner join plus the rest: in an outer join kept on the problem side Spark cannot
    split a problem that holds very many completions.
    """
    matched = completions.join(problems, "problem_id")
    answered = completions.select("problem_id").distinct()
    unmatched = problems.join(answered, "problem_id", "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def extract(completions: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by the answer in its last box, before anything is shuffled."""
    kept = [c for c in completions.columns if c != text]
    answers = completions.select(*kept, boxed_last(text).alias("predicted"))
    return answers.withColumn("formatted", F.col("predicted").isNotNull())


def grade(
    completions: DataFrame, problems: DataFrame, grader: Grader = equivalent, text: str = "text"
) -> DataFrame:
    """One row per sample: stored prediction, formatted, correct, and the gold answer."""
    gold = problems.select("problem_id", "ground_truth")
    joined = extract(completions, text).join(gold, "problem_id")
    correct = F.col("formatted") & grader(F.col("predicted"), F.col("ground_truth"))
    return joined.withColumn("correct", F.coalesce(correct, F.lit(False))).withColumn(
        "predicted", stored_prediction("predicted")
    )


def graded_once(
    df: DataFrame, predicted: str, gold: str, grader: Grader = equivalent, into: str = "correct", **salting
) -> DataFrame:
    """Add ``into``: the grade of each row, found once for each distinct pair of answers.

    The pairs are an aggregate, and a pair that very many rows share is joined back in shares. Null answers
    are pairs like any other; an empty table gives an empty table.
    """
    pairs = df.groupBy(predicted, gold).agg(F.count("*").alias("_n"))
    judged = pairs.withColumn(into, F.coalesce(grader(F.col(predicted), F.col(gold)), F.lit(False)))
    others = [c for c in df.columns if c not in (predicted, gold)] or [predicted]
    return attach(df, judged, [predicted, gold], others, "_n", **salting).drop("_n")


def per_problem(graded: DataFrame, keys: list[str] = PROBLEM) -> DataFrame:
    """Counts per problem from graded samples."""
    return graded.groupBy(*keys).agg(
        F.count("*").alias("num_samples"),
        F.count_if("correct").alias("num_correct"),
        F.count_if("formatted").alias("num_formatted"),
        F.coalesce(F.bool_or("correct"), F.lit(False)).alias("has_correct"),
    )


def _winner(votes: Column, first: Column, value: Column) -> Column:
    """Value with the most votes; the one seen first wins a tie."""
    return F.max_by(value, F.struct(votes, -first))


def majority_vote(
    graded: DataFrame, grader: Grader = equivalent, keys: list[str] = PROBLEM
) -> DataFrame:
    """Most common stored prediction among the formatted samples, and whether it is correct.

    Votes are counted per (problem, prediction) first, so what reaches one task per problem is its
    distinct answers.
    """
    votes = (
        graded.groupBy(*keys, "predicted")
        .agg(
            F.count_if("formatted").alias("votes"),
            F.min(F.when(F.col("formatted"), F.col("sample_idx"))).alias("first_idx"),
            F.max("ground_truth").alias("ground_truth"),
        )
        .groupBy(*keys)
        .agg(
            F.max("ground_truth").alias("ground_truth"),
            F.max("votes").alias("votes"),
            _winner(
                F.col("votes"),
                F.col("first_idx"),
                F.when(F.col("votes") > 0, F.col("predicted")),
            ).alias("majority_answer"),
        )
    )
    right = grader(F.col("majority_answer"), F.col("ground_truth"))
    return votes.select(
        *keys,
        "majority_answer",
        "votes",
        F.coalesce((F.col("votes") > 0) & right, F.lit(False)).alias("majority_vote_correct"),
    )


def evaluate(
    completions: DataFrame,
    problems: DataFrame,
    grader: Grader = equivalent,
    keys: list[str] = PROBLEM,
    text: str = "text",
) -> DataFrame:
    """All per-problem measures in one pass over the completions.

    Samples are counted per distinct answer before the shuffle, so texts never leave the scan and each
    distinct answer of a problem is graded once, not once per sample.
    """
    return score(count_answers(extract(completions, text), keys), problems, grader, keys)


def count_answers(extracted: DataFrame, keys: list[str] = PROBLEM) -> DataFrame:
    """Samples per (problem, stored answer). Empty boxes share the sentinel and are counted apart."""
    stored = extracted.withColumn("answer", stored_prediction("predicted"))
    return stored.groupBy(*keys, "formatted", "answer").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("predicted") == "").alias("n_empty"),
        F.min("sample_idx").alias("first_idx"),
    )


def score(
    counts: DataFrame,
    problems: DataFrame,
    grader: Grader = equivalent,
    keys: list[str] = PROBLEM,
) -> DataFrame:
    """Grade the counted answers and fold them into one row per problem."""
    gold = problems.select("problem_id", "ground_truth")
    formatted = F.col("formatted")
    has_empty = formatted & (F.col("n_empty") > 0)
    graded = counts.join(gold, "problem_id").select(
        *keys,
        "formatted",
        "answer",
        "n",
        "first_idx",
        F.col("n_empty"),
        (formatted & grader(F.col("answer"), F.col("ground_truth"))).alias("correct"),
        F.when(has_empty, grader(F.lit(""), F.col("ground_truth"))).alias("empty_correct"),
    )
    correct = F.when(F.col("correct"), F.col("n") - F.col("n_empty")).otherwise(0) + F.when(
        F.col("empty_correct"), F.col("n_empty")
    ).otherwise(0)
    votes = F.when(formatted, F.col("n")).otherwise(0)
    return (
        graded.groupBy(*keys)
        .agg(
            F.sum("n").alias("num_samples"),
            F.sum(correct).alias("num_correct"),
            F.sum(votes).alias("num_formatted"),
            _winner(votes, F.col("first_idx"), F.col("correct")).alias("majority_vote_correct"),
        )
        .withColumn("has_correct", F.col("num_correct") > 0)
        .select(
            *keys,
            "num_samples",
            "num_correct",
            "num_formatted",
            "has_correct",
            "majority_vote_correct",
        )
    )


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def summary(
    scored: DataFrame,
    problems: DataFrame,
    val_n: int,
    denominator: str = "declared",
    runs: list[str] | None = None,
    attributes: dict[str, Any] | None = None,
) -> DataFrame:
    """One row per run (one row in all without ``runs``) with counts and percentages.

    Problems without completions count in the denominators. ``denominator`` chooses between
    ``val_n`` samples per problem and the number of samples that exist.
    """
    if denominator not in ("declared", "observed"):
        raise ValueError(f"denominator must be 'declared' or 'observed', not {denominator!r}")
    asked = problems.select(F.count("*")).scalar()
    sums = [
        F.coalesce(F.sum("num_samples"), F.lit(0)).alias("_observed"),
        F.count_if("has_correct").alias("pass_at_n"),
        F.coalesce(F.sum("num_correct"), F.lit(0)).alias("average_at_n"),
        F.count_if("majority_vote_correct").alias("majority_vote_at_n"),
        F.coalesce(F.sum("num_formatted"), F.lit(0)).alias("formatted_count"),
    ]
    totals = (scored.groupBy(*runs) if runs else scored).agg(*sums).withColumn("num_problems", asked)
    total = F.col("num_problems") * val_n if denominator == "declared" else F.col("_observed")
    n, count = F.col("total_solutions"), F.col("num_problems")
    return totals.withColumn("total_solutions", total.cast("long")).select(
        *(runs or []),
        *[F.lit(v).alias(k) for k, v in (attributes or {}).items()],
        F.lit(val_n).alias("val_n"),
        "num_problems",
        "total_solutions",
        "pass_at_n",
        percent(F.col("pass_at_n"), count).alias("pass_at_n_pct"),
        "average_at_n",
        percent(F.col("average_at_n"), n).alias("average_at_n_pct"),
        "majority_vote_at_n",
        percent(F.col("majority_vote_at_n"), count).alias("majority_vote_at_n_pct"),
        "formatted_count",
        percent(F.col("formatted_count"), n).alias("format_rate"),
    )


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Runs with their average accuracy, sorted, best first: a row per run, so the sort is small."""
    return summaries.select(
        "run_id",
        "num_problems",
        "total_solutions",
        "average_at_n_pct",
        "pass_at_n_pct",
        "majority_vote_at_n_pct",
    ).orderBy(F.desc("average_at_n_pct"), "run_id")


def for_every_run(problems: DataFrame, scored: DataFrame, runs: list[str]) -> DataFrame:
    """Each problem once per run of ``scored``, from a list of the runs' names: ``MAX_RUNS`` at most, more
    are an error."""
    names = scored.select(F.struct(*runs).alias("_run")).distinct()
    few = F.when(F.count("*") <= MAX_RUNS, F.sort_array(F.collect_list("_run")))
    too_many = F.raise_error(F.lit(f"more than {MAX_RUNS} runs"))
    every_run = names.limit(MAX_RUNS + 1).select(few.otherwise(too_many)).scalar()
    repeated = problems.select("*", F.explode(every_run).alias("_run"))
    return repeated.select("_run.*", *problems.columns)


def running_metrics(
    scored: DataFrame,
    problems: DataFrame,
    val_n: int,
    order: str = "ord",
    runs: list[str] | None = None,
    **ranges,
) -> DataFrame:
    """Rates after each problem in ``order``, which is unique; problems without an answer count.

    With ``runs`` every run that reported anything gets a row for every problem: the result of the
    report, a row per run and problem. ``scored`` is read several times: pass a stored table.
    """
    runs = runs or []
    listed = problems.select("problem_id", order)
    if runs:
        listed = for_every_run(listed, scored, runs)
    rows = same_group(listed, scored, [*runs, "problem_id"], "left").fillna(
        0, ["num_correct", "num_formatted"]
    )
    sums = {
        "idx": F.lit(1),
        "sum_passed": F.when(F.col("has_correct"), 1).otherwise(0),
        "sum_correct": F.col("num_correct"),
        "sum_formatted": F.col("num_formatted"),
    }
    run = running_sums(rows, runs, [order], sums, **ranges)
    asked = F.col("idx") * val_n
    return run.select(
        *runs,
        order,
        "problem_id",
        "idx",
        F.coalesce("has_correct", F.lit(False)).alias("has_correct"),
        "num_correct",
        percent(F.col("sum_passed"), F.col("idx")).alias("pass_at_n_pct"),
        percent(F.col("sum_correct"), asked).alias("average_at_n_pct"),
        percent(F.col("sum_formatted"), asked).alias("format_rate"),
    )


def progress_snapshot(running: DataFrame, every: int = 10) -> DataFrame:
    return running.filter(F.pmod(F.col("idx"), F.lit(every)) == 0)


def results(
    completions: DataFrame,
    problems: DataFrame,
    scored: DataFrame,
    val_n: int,
    grader: Grader = equivalent,
    text: str = "text",
    runs: list[str] | None = None,
) -> DataFrame:
    """Report header, one row per problem (and run); the first sample stands at the top level.

    The first is the one with the lowest ``sample_idx``; the others are dropped before the shuffle.
    ``scored`` is read twice with ``runs``: pass a stored table.
    All problems are listed, with ``runs`` all for every run that ``scored`` has; those without an answer
    with zeros and the mark for a missing answer.
    """
    runs = runs or []
    keys = [*runs, "problem_id"]
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("sample_idx")))
    lowest = completions.select(*keys, text, place.alias("_place")).filter(F.col("_place") <= 1)
    first = lowest.select(*keys, text, boxed_last(text).alias("_answer"))
    gold = problems.select("problem_id", "problem", "ground_truth")
    listed = same_group(for_every_run(gold, scored, runs) if runs else gold, scored, keys, "left")
    joined = same_group(listed, first, keys, "left").fillna(0, ["num_correct"])
    joined = joined.fillna(False, ["has_correct", "majority_vote_correct"])
    return joined.select(
        *keys,
        "problem",
        "ground_truth",
        F.lit(val_n).alias("val_n"),
        "num_correct",
        F.col("has_correct").alias("pass_at_n"),
        "majority_vote_correct",
        stored_prediction("_answer").alias("predicted_answer"),
        F.col(text).alias("full_generation"),
        F.coalesce(
            F.col("_answer").isNotNull() & grader(F.col("_answer"), F.col("ground_truth")),
            F.lit(False),
        ).alias("correct"),
        F.col("_answer").isNotNull().alias("formatted"),
    )


def generations(
    completions: DataFrame,
    problems: DataFrame,
    grader: Grader = equivalent,
    part_size: int = 64,
    text: str = "text",
    runs: list[str] | None = None,
) -> DataFrame:
    """Report detail: the samples of a problem (and run) in order, nested in parts of ``part_size``.

    A problem may have any number of samples, a row may not: part ``p`` holds the samples
    ``p * part_size`` up to the next part.
    """
    graded = grade(
        completions.withColumn("full_generation", F.col(text)), problems, grader, text
    )
    part = F.floor(F.col("sample_idx") / part_size).cast("int")
    sample = F.struct(
        "sample_idx",
        F.col("predicted").alias("predicted_answer"),
        "full_generation",
        "correct",
        "formatted",
    )
    return graded.groupBy(*(runs or []), "problem_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(sample)).alias("generations")
    )


def explode_outputs(df: DataFrame, outputs: str = "outputs", text: str = "text") -> DataFrame:
    """One row per sample from a table with one array of outputs per problem."""
    kept = [c for c in df.columns if c != outputs]
    return df.select(*kept, F.posexplode(outputs).alias("sample_idx", text))


def exact_rewards(
    completions: DataFrame, problems: DataFrame, text: str = "text"
) -> DataFrame:
    """Reward of each sample: 1.0 where its first box holds the gold answer.

    The answer is read before the join, so the texts stay where they are.
    """
    kept = [c for c in completions.columns if c != text]
    answers = completions.select(*kept, boxed_first(text).alias("_answer"))
    joined = answers.join(problems.select("problem_id", "ground_truth"), "problem_id")
    return joined.select(*kept, exact_reward("_answer", "ground_truth").alias("reward"))


def group_advantage(
    df: DataFrame,
    group: list[str],
    reward: str,
    spread: list[str],
    eps: float = 1e-4,
    scale: bool = True,
    **salting,
) -> DataFrame:
    """Reward minus the group mean, divided by the group's sample deviation plus ``eps``.

    The statistics are aggregated (partial sums first) and joined back; a window would put all samples
    of a prompt in one task. A group of one has deviation 0.
    """
    stats = df.groupBy(*group).agg(
        F.count("*").alias("_n"),
        F.avg(reward).alias("_mean"),
        F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_std"),
    )
    centred = F.col(reward) - F.col("_mean")
    advantage = centred / (F.col("_std") + eps) if scale else centred
    joined = attach(df, stats, group, spread, "_n", **salting)
    return joined.withColumn("advantage", advantage).drop("_n", "_mean", "_std")


def mean_reward(df: DataFrame, group: list[str], reward: str = "reward") -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("num_samples"), F.avg(reward).alias("mean_reward")
    )

