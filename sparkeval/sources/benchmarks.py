"""Benchmarks with different columns brought to one shape."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.functions.answers import boxed_last
from sparkeval.operators.selection import with_ordinal
from sparkeval.sources.tables import require


@dataclass(frozen=True)
class Shape:
    """Columns of one benchmark. Without an answer column the gold answer is read from the solution."""

    problem: str
    answer: str | None
    id: str | None
    split: str


# The benchmarks that can be named and where each keeps its fields.
SHAPES = {
    "math500": Shape("problem", None, None, "test"),
    "amo-bench": Shape("prompt", "answer", "question_id", "test"),
    "aime24": Shape("problem", "answer", "id", "train"),
    "aime25": Shape("problem", "answer", "problem_idx", "train"),
    "hmmt25": Shape("problem", "answer", "problem_idx", "train"),
    "minerva": Shape("question", "answer", "id", "test"),
    "amc23": Shape("question", "answer", "id", "test"),
}
UNIFIED = ["dataset", "ord", "problem_id", "problem", "ground_truth"]


def shape_of(name: str) -> Shape:
    shape = SHAPES.get(name.lower())
    if shape is None:
        raise ValueError(f"Unknown dataset: {name}. Choose one of {', '.join(sorted(SHAPES))}")
    return shape


def gold_answer(df: DataFrame, shape: Shape) -> Column:
    if shape.answer is not None:
        return F.col(shape.answer).cast("string")
    return F.coalesce(boxed_last("solution"), F.col("solution"))


def adapt_benchmark(df: DataFrame, name: str, order: str, **ranges) -> DataFrame:
    """(dataset, ord, problem_id, problem, ground_truth). ``order`` numbers the rows of the source;
    a missing id becomes that number."""
    shape = shape_of(name)
    require(df, [c for c in (shape.problem, shape.answer or "solution", order) if c])
    numbered = with_ordinal(df, order, "ord", **ranges)
    ordinal = F.col("ord").cast("string")
    has_id = shape.id is not None and shape.id in df.columns
    problem_id = F.coalesce(F.col(shape.id).cast("string"), ordinal) if has_id else ordinal
    return numbered.select(
        F.lit(name.lower()).alias("dataset"),
        "ord",
        problem_id.alias("problem_id"),
        F.col(shape.problem).alias("problem"),
        gold_answer(df, shape).alias("ground_truth"),
    )


def first_samples(benchmark: DataFrame, num_samples: int | None) -> DataFrame:
    """The first ``num_samples`` problems; all of them for None or 0."""
    return benchmark.filter(F.col("ord") < num_samples) if num_samples else benchmark


def read_benchmark(
    spark: SparkSession,
    name: str,
    path: str,
    order: str,
    num_samples: int | None = None,
    format: str = "parquet",
) -> DataFrame:
    shape_of(name)
    return first_samples(adapt_benchmark(spark.read.format(format).load(path), name, order), num_samples)


def unify_benchmarks(sources: dict[str, tuple[DataFrame, str]], **ranges) -> DataFrame:
    """One table from several sources: name -> (table, order column)."""
    adapted = [adapt_benchmark(df, name, order, **ranges) for name, (df, order) in sources.items()]
    return reduce(DataFrame.unionByName, adapted)
