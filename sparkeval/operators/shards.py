"""Divergences over a vocabulary that is dealt into shards, so that no row and no window holds all of it.

The long form (position, token_id, s, t) is gathered into shards of ``size`` neighbouring token ids. A shard
sums its exponentials relative to its own maximum; such pairs of maximum and sum merge into the
normaliser of the position, which goes back to the shards. What moves after the first shuffle is a few
numbers per shard, or with ``top_k`` at most k entries of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.functions.common import let
from sparkeval.functions.distributions import divergence, pointwise
from sparkeval.operators.distributions import POSITION
from sparkeval.plans.skew import same_group

SHARD = 4096


def shards(cells: DataFrame, size: int = SHARD, on: list[str] = POSITION) -> DataFrame:
    """(position, shard, cells): the entries of ``size`` neighbouring token ids in one array. A token id comes
    once per position, so an array has ``size`` entries at most."""
    part = F.floor(F.col("token_id") / size).cast("bigint")
    entry = F.struct("token_id", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t"))
    return cells.groupBy(*on, part.alias("shard")).agg(F.collect_list(entry).alias("cells"))


def _mass(values: Column) -> Column:
    """struct<top, sum>: the maximum and the sum of exponentials relative to it."""
    return let(
        F.array_max(values),
        lambda top: F.struct(
            top.alias("top"), F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)).alias("sum")
        ),
    )


def _merged(masses: Column) -> Column:
    """Log of the sum of exponentials that (maximum, sum) pairs stand for."""
    return let(
        F.array_max(F.transform(masses, lambda m: m["top"])),
        lambda top: top + F.log(F.aggregate(masses, F.lit(0.0), lambda a, m: a + m["sum"] * F.exp(m["top"] - top))),
    )


def top_k_sharded(cells: DataFrame, k: int, size: int = SHARD, on: list[str] = POSITION) -> DataFrame:
    """(position, cells): the teacher's k largest entries, best first; the lowest token id wins a tie.

    Each shard gives its own k, and a position chooses among these.
    """

    def best(entries: Column) -> Column:
        keyed = F.transform(entries, lambda c: F.struct((-c["t"]).alias("low"), c["token_id"], c["s"], c["t"]))
        return F.slice(F.array_sort(keyed), 1, k)

    own = shards(cells, size, on).withColumn("cells", best("cells"))
    return own.groupBy(*on).agg(F.flatten(F.collect_list("cells")).alias("cells")).withColumn("cells", best(F.col("cells")))


def divergence_sharded(
    cells: DataFrame,
    beta: float = 0.5,
    temperature: float = 1.0,
    top_k: int | None = None,
    size: int = SHARD,
    on: list[str] = POSITION,
) -> DataFrame:
    """(position, divergence), as ``divergence_long`` gives. Null is a position like any other; an empty
    table gives an empty one."""
    if top_k:
        kept = top_k_sharded(cells, top_k, size, on)
        return kept.select(*on, divergence("cells.s", "cells.t", beta, temperature).alias("divergence"))
    dealt = shards(cells, size, on)
    z = {side: F.transform(f"cells.{side}", lambda x: x / temperature) for side in ("s", "t")}
    masses = dealt.select(*on, *[_mass(z[side]).alias(side) for side in z])
    norms = masses.groupBy(*on).agg(*[_merged(F.collect_list(side)).alias(f"_{side}") for side in z])
    joined = same_group(dealt, norms, on, "inner")
    terms = F.transform(
        "cells",
        lambda c: pointwise(c["s"] / temperature - F.col("_s"), c["t"] / temperature - F.col("_t"), beta),
    )
    share = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return joined.groupBy(*on).agg(F.sum(share).alias("divergence"))
