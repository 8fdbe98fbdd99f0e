"""Bring one row per group back to every row of the group, whatever the group sizes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
MAX_HOT = 10_000


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    count: str,
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    null_group: bool = True,
) -> DataFrame:
    """Join ``big`` with ``small``, which is unique in ``on`` and knows the group sizes (``count``).

    A key with more than ``rows_per_salt`` rows is cut into that many shares by a hash of the columns
    ``spread``, and its single small row is repeated once per share, so no task gets the whole group.
    The broadcast list of such keys is at most ``MAX_HOT`` rows long, the largest keys first: a key
    beyond it holds less than one ``MAX_HOT``-th of all rows, which is no hot key. The hash is taken from the data, so a task that runs again gives the same rows.
    With ``null_group`` null is a key like any other, as in ``groupBy``.
    """
    hot = (
        small.filter(F.col(count) > rows_per_salt)
        .orderBy(F.desc(count), *on)
        .limit(MAX_HOT)
        .select(*on, F.ceil(F.col(count) / rows_per_salt).cast("int").alias("_shares"))
    )
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    salted = _looked_up(big, hot, on, null_group).withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), shares).cast("int")
    )
    repeated = _looked_up(small, hot, on, null_group).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), shares - 1))
    )
    salted, repeated, on = salted.drop("_shares"), repeated.drop("_shares"), [*on, "_salt"]
    joined = same_group(salted, repeated, on, how) if null_group else salted.join(repeated, on, how)
    return joined.drop("_salt")


def _looked_up(df: DataFrame, hot: DataFrame, on: list[str], null_group: bool) -> DataFrame:
    if null_group:
        return same_group(df, F.broadcast(hot), on, "left")
    return df.join(F.broadcast(hot), on, "left")


def same_group(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null."""
    l, r = left.alias("_left"), right.alias("_right")
    equal = [F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")) for c in on]
    if how in ("left_semi", "left_anti"):
        return l.join(r, reduce(and_, equal), how)
    added = [F.col(f"_right.{c}") for c in right.columns if c not in on]
    return l.join(r, reduce(and_, equal), how).select("_left.*", *added)
