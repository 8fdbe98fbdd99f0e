"""Ranks, running sums and prefix maps over long orders, without putting a whole group in one task.

A window without a partition key, or over one very large key, runs in a single task. A table of more
than ``ROWS_PER_RANGE`` rows is therefore sorted into ranges first, by keys and the whole order, so a
group of any size and rows with equal first order columns spread. Each range is summed on its own, the
range totals (a row per range and key) are accumulated, and each row adds the total of the ranges before
its own. Only the columns that are needed travel; wide rows are joined with their place afterwards.

Rows are counted per hash of their keys first: only those of keys that may be larger than a range are cut,
the others meet in one shuffle by key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.plans.session import materialize
from sparkeval.plans.skew import same_group

ROWS_PER_RANGE = 1_000_000
RANGE = "_range"
KEY_HASHES = 65_536
MAX_LARGE = 1_000


def with_ranges(
    df: DataFrame, keys: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> tuple[DataFrame, bool]:
    """Add ``_range``, which rises along ``keys`` and ``order``; also whether there is more than one.

    The ranges are those of a range-partitioned sort, by any sortable columns, nulls first. They are
    written to shared storage with their rows, so every reader, also one that runs again, sees the same.
    Where the cuts fall changes the balance, never a result.
    """
    rows = df.count()
    if rows <= rows_per_range:
        return df.withColumn(RANGE, F.lit(0)), False
    dealt = df.repartitionByRange(math.ceil(rows / rows_per_range), *keys, *order)
    return materialize(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges"), True


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add, per entry of ``sums``, its total over the rows up to and including this one.

    ``order`` is unique within ``keys`` and of any sortable types; nulls come first.
    """
    if keys:
        return _sums_by_key(df, keys, order, sums, rows_per_range)
    return _sums_in_ranges(df, keys, order, sums, rows_per_range)


def _sums_by_key(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], rows_per_range: int
) -> DataFrame:
    """Rows of the few hashes with more rows than a range are cut into ranges, all others are summed by key."""
    hashed = F.pmod(F.xxhash64(*keys), F.lit(KEY_HASHES))
    counts = df.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("_n"))
    large = [r[0] for r in counts.filter(F.col("_n") > rows_per_range).limit(MAX_LARGE + 1).collect()]
    if len(large) > MAX_LARGE:
        return _sums_in_ranges(df, keys, order, sums, rows_per_range)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = [F.sum(c).over(whole).alias(n) for n, c in sums.items()]
    if not large:
        return df.select(*df.columns, *summed)
    is_large = hashed.isin(large)
    cut = _sums_in_ranges(df.filter(is_large), keys, order, sums, rows_per_range)
    return df.filter(~is_large).select(*df.columns, *summed).union(cut)


def _sums_in_ranges(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], rows_per_range: int
) -> DataFrame:
    ranged, was_cut = with_ranges(df, keys, order, rows_per_range)
    here = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    if not was_cut:
        return ranged.select(*df.columns, *[F.sum(c).over(here).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(c).alias("_t_" + n) for n, c in sums.items()])
    # A range begins inside one group at most, so this has a row per range at most.
    before = totals.select(
        *keys,
        RANGE,
        F.count("*").over(earlier).alias("_ranges"),
        *[F.sum("_t_" + n).over(earlier).alias("_b_" + n) for n in sums],
    ).filter(F.col("_ranges") > 0)
    local = ranged.select("*", *[F.sum(c).over(here).alias("_l_" + n) for n, c in sums.items()])
    joined = same_group(local, before, [*keys, RANGE], "left")
    return joined.select(
        *df.columns,
        *[(F.col("_l_" + n) + F.coalesce(F.col("_b_" + n), F.lit(0))).alias(n) for n in sums],
    )


def ranks(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", **ranges
) -> DataFrame:
    """Add the 0-based place of each row within ``keys`` in ``order``."""
    counted = running_sums(df, keys, order, {name: F.lit(1)}, **ranges)
    return counted.withColumn(name, F.col(name) - 1)


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, **ranges
) -> DataFrame:
    """``ranks`` for wide rows: keys and order are numbered alone, and every row looks its place up, so
    texts and arrays never meet in the task that numbers."""
    own = list(dict.fromkeys([*keys, *order]))
    return same_group(df, ranks(df.select(*own), keys, order, name, **ranges), own, "inner")


def prefix_maps(
    units: DataFrame, keys: list[str], order: str, slope: str, shift: str, most: int
) -> DataFrame:
    """Replace (slope, shift), the map x -> slope * x + shift of each unit, by the map of all units
    *before* it within ``keys``; the first gets x -> x.

    Composed by doubling: a step joins each unit's map with the one that many places back, so no list
    of units is built. ``most`` is the largest number of units of a key, or more.
    """
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    out = units.withColumns(
        {slope: F.lag(slope, 1, 1.0).over(along), shift: F.lag(shift, 1, 0.0).over(along)}
    )
    back = 1
    while back < most:
        a, b = F.lag(slope, back, 1.0).over(along), F.lag(shift, back, 0.0).over(along)
        out = out.withColumns(
            {slope: F.col(slope) * a, shift: F.col(shift) + F.col(slope) * b}
        )
        back *= 2
    return out
