"""Tables stored in buckets by problem, so that joins and counts over them move no rows.

Completions are large and read by many evaluations: stored once in buckets of the problem's id, every later
join with the problems and every count per problem starts from the files as they lie. A problem with more
than ``rows_per_share`` completions is cut into shares, each with a copy of the problem, so that no bucket
has to hold it whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.functions.answers import equivalent
from sparkeval.operators.grading import PROBLEM, Grader, count_answers, extract, score
from sparkeval.plans.skew import MAX_HOT, ROWS_PER_SALT

SHARE = "_share"


def _stored(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """A table in the warehouse, a file per bucket and task, sorted by its keys."""
    table = f"{name}_{uuid.uuid4().hex}"
    hashed = df.repartition(buckets, *keys)  # as buckets are dealt, so each bucket is one file
    hashed.write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``store`` from the warehouse. Frames that read them can no longer be run."""
    for df in tables:
        name = df._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get().identifier().table()
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def store(
    completions: DataFrame,
    problems: DataFrame,
    buckets: int = 200,
    spread: str = "sample_idx",
    rows_per_share: int = ROWS_PER_SALT,
) -> tuple[DataFrame, DataFrame]:
    """Both tables in ``buckets`` by ``problem_id`` and ``_share``, which is 0 but for problems with very
    many completions: there a hash of ``spread`` deals the completions, and each share has the problem.

    The list of such problems is broadcast and at most ``MAX_HOT`` rows long, the largest first. Rows with
    a null problem match nothing, and stay. An empty table is stored as such.
    """
    counts = completions.filter("problem_id is not null").groupBy(*PROBLEM).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") > rows_per_share).orderBy(F.desc("_n"), *PROBLEM).limit(MAX_HOT)
    hot = F.broadcast(hot.select(*PROBLEM, F.ceil(F.col("_n") / rows_per_share).cast("int").alias("_shares")))
    shares = F.coalesce("_shares", F.lit(1))
    dealt = completions.join(hot, PROBLEM, "left").withColumn(SHARE, F.pmod(F.xxhash64(spread), shares).cast("int"))
    copied = problems.join(hot, PROBLEM, "left").withColumn(SHARE, F.explode(F.sequence(F.lit(0), shares - 1)))
    keys = [*PROBLEM, SHARE]
    return tuple(
        _stored(df.drop("_shares"), name, keys, buckets) for df, name in ((dealt, "completions"), (copied, "problems"))
    )


def join_stored(completions: DataFrame, problems: DataFrame) -> DataFrame:
    """Every completion with its problem. Neither of the stored tables is moved."""
    return completions.join(problems.hint("merge"), [*PROBLEM, SHARE]).drop(SHARE)


def evaluate_stored(completions: DataFrame, problems: DataFrame, grader: Grader = equivalent, text: str = "text") -> DataFrame:
    """``evaluate`` over stored tables. Answers are counted where the completions lie; only the counts of
    distinct answers move."""
    here = count_answers(extract(completions, text), [*PROBLEM, SHARE])
    counts = here.groupBy(*PROBLEM, "formatted", "answer").agg(
        F.sum("n").alias("n"), F.sum("n_empty").alias("n_empty"), F.min("first_idx").alias("first_idx")
    )
    return score(counts, problems.filter(F.col(SHARE) == 0), grader)
