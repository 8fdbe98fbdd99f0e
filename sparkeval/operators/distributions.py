"""Student and teacher distributions as tables: pairing, long form, reductions, objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.functions.distributions import pointwise, sampled_logprob
from sparkeval.functions.sequences import IGNORE

POSITION = ["seq_id", "pos"]


def pair(
    student: DataFrame, teacher: DataFrame, on: list[str] = POSITION, values: str = "logits"
) -> DataFrame:
    """Both models' vectors for the same position, joined on the position's unique key."""
    s = student.withColumnRenamed(values, "student")
    t = teacher.select(*on, F.col(values).alias("teacher"))
    return s.join(t, on)


def explode_vocabulary(df: DataFrame, on: list[str] = POSITION) -> DataFrame:
    """Long form (position, token_id, s, t) of a paired table."""
    cells = F.posexplode(F.arrays_zip("student", "teacher")).alias("token_id", "cell")
    return df.select(*on, cells).select(
        *on,
        "token_id",
        F.col("cell.student").cast("double").alias("s"),
        F.col("cell.teacher").cast("double").alias("t"),
    )


def gather(df: DataFrame, token: str = "token", on: list[str] = POSITION) -> DataFrame:
    """(position, token, s, t): the entries of a paired table at one token of each position, read from the
    vectors in place. Positions with a null token, or one outside the vocabulary, have none."""
    inside = (F.col(token) >= 0) & (F.col(token) < F.size("student"))
    s, t = (F.get(c, F.col(token).cast("int")).cast("double").alias(c[0]) for c in ("student", "teacher"))
    return df.filter(inside).select(*on, token, s, t)


def gather_token(
    cells: DataFrame, chosen: DataFrame, on: list[str] = POSITION, token: str = "token_id"
) -> DataFrame:
    """Entries of the long form that ``chosen`` (position, token id) names."""
    return cells.join(chosen.select(*on, token), [*on, token])


def top_k_cells(cells: DataFrame, k: int, on: list[str] = POSITION) -> DataFrame:
    """The teacher's k largest entries per position; the lowest token id wins a tie."""
    best = Window.partitionBy(*on).orderBy(F.desc("t"), "token_id")
    ranked = cells.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k)


def divergence_long(
    cells: DataFrame,
    beta: float = 0.5,
    temperature: float = 1.0,
    top_k: int | None = None,
    on: list[str] = POSITION,
) -> DataFrame:
    """(position, divergence) from the long form. A group is one vocabulary, so its size is bounded.

    All steps share the position's partitioning: one shuffle.
    """
    if top_k:
        cells = top_k_cells(cells, top_k, on)
    here = Window.partitionBy(*on)

    z = {side: F.col(side) / temperature for side in ("s", "t")}
    scaled = cells.withColumns({"_z" + side: z[side] - F.max(z[side]).over(here) for side in z})
    logs = {"_l" + side: F.col("_z" + side) - F.log(F.sum(F.exp("_z" + side)).over(here)) for side in z}
    scaled = scaled.withColumns(logs)
    term = pointwise(F.col("_ls"), F.col("_lt"), beta)
    return scaled.groupBy(*on).agg(F.sum(term).alias("divergence"))


def unmasked(label: str = "label") -> Column:
    return F.col(label) != IGNORE


def reduce_divergence(
    df: DataFrame,
    reduction: str = "batchmean",
    value: str = "divergence",
    label: str | None = "label",
    seq: str = "seq_id",
    vocabulary: str | None = None,
) -> DataFrame:
    """One number from one row per position.

    ``batchmean`` divides by the unmasked tokens, or by the sequences where there are no labels;
    ``mean`` divides by all token and vocabulary cells, whose number per row is in ``vocabulary``;
    ``none`` returns the unmasked rows. Nothing left to divide by gives null.
    """
    rows = df.filter(unmasked(label)) if label else df
    total = F.sum(value)
    if reduction == "none":
        return rows
    if reduction == "sum":
        result = F.coalesce(total, F.lit(0.0))
    elif reduction == "batchmean":
        size = F.count("*") if label else F.count_distinct(seq)
        result = F.try_divide(total, size)
    elif reduction == "mean":
        if vocabulary is None:
            raise ValueError("reduction 'mean' needs the column with the vocabulary size per row")
        result = F.try_divide(total, F.sum(vocabulary))
    else:
        raise ValueError(f"unknown reduction {reduction!r}")
    return rows.agg(result.alias("loss"))


def token_advantage(
    df: DataFrame,
    token: str = "token_id",
    temperature: float = 1.0,
    student: str = "student",
    teacher: str = "teacher",
) -> DataFrame:
    """Log-probabilities of the sampled token under both models and their difference.

    The vectors are dropped here, so later shuffles move three numbers per token.
    """
    kept = [c for c in df.columns if c not in (student, teacher)]
    scored = df.select(
        *kept,
        sampled_logprob(student, token, temperature).alias("student_logprob"),
        sampled_logprob(teacher, token, temperature).alias("teacher_logprob"),
    )
    return scored.withColumn("advantage", F.col("teacher_logprob") - F.col("student_logprob"))


def pg_objective(df: DataFrame, label: str | None = "label") -> DataFrame:
    """-mean(advantage * student log-probability) over the unmasked tokens."""
    rows = df.filter(unmasked(label)) if label else df
    return rows.agg((-F.avg(F.col("advantage") * F.col("student_logprob"))).alias("objective"))


def divergence_profile(df: DataFrame, by: list[str], value: str = "divergence") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("tokens"),
        F.avg(value).alias("mean_" + value),
        F.max(value).alias("max_" + value),
    )


def ema_update(
    state: DataFrame, params: DataFrame, decay: float = 0.999, name: str = "name", values: str = "values"
) -> DataFrame:
    """decay * state + (1 - decay) * parameter, per name; names the state does not know are skipped
    and state without a parameter stays as it is."""
    new = params.select(name, F.col(values).alias("_new"))
    mixed = F.zip_with(
        values, "_new", lambda old, x: old.cast("double") * decay + x.cast("double") * (1 - decay)
    )
    kept = F.transform(values, lambda x: x.cast("double"))
    return state.join(new, name, "left").select(
        name, F.when(F.col("_new").isNull(), kept).otherwise(mixed).alias(values)
    )
