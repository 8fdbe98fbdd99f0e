"""First-of-each, samples, splits, newest-N, ordinals and unfinished work."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.functions.hashing import hash_below, hash_order
from sparkeval.plans.ordering import numbered

GROUP_LIMIT = 1000  # Spark keeps only the first rows of a group before the shuffle up to this many


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep, of the rows with equal ``keys``, the first in ``order``.

    An aggregate, so copies are dropped before the shuffle: a text that fills a third of the table
    leaves each task once.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def sample_exact(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows picked by a seeded hash of the unique ``key``; raises if there are fewer.

    A filter: the rows up to the ``n``-th in the seeded order, which is found by counting.
    """
    if df.select(key).limit(n).count() < n:
        raise ValueError(f"cannot sample {n} rows: the table has fewer")
    return df.filter(_upto(df, n, seed, key)) if n else df.limit(0)


def sample_upto(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """What ``sample_exact`` picks, or all rows if there are fewer than ``n``."""
    if n >= df.count():
        return df
    return df.filter(_upto(df, n, seed, key)) if n else df.limit(0)


def sample_fraction(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """Keep each row with probability ``fraction``; a filter, decided by the row's key alone."""
    return df.filter(hash_below(seed, key, fraction))


def split_point(df: DataFrame, rows: int, seed: int, key: str) -> tuple[str, object]:
    """Hash and key of row number ``rows`` in the seeded order.

    Counts rows per hash prefix (at most 65,536 groups), steps into the prefix that holds the wanted
    row until few rows share it, and sorts only those.
    """
    hashed = df.select(hash_order(seed, key).alias("_h"), F.col(key).alias("_k"))
    prefix, wanted, pool = "", rows, hashed
    while True:
        size = len(prefix) + 4
        counts = pool.groupBy(F.substring("_h", 1, size).alias("p")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p"))
        row = (
            counts.withColumn("upto", upto)
            .filter(F.col("upto") >= wanted)
            .orderBy("p")
            .first()
        )
        prefix, wanted = row["p"], wanted - (row["upto"] - row["n"])
        pool = hashed.filter(F.startswith(F.col("_h"), F.lit(prefix)))
        if row["n"] <= 10_000 or size >= 32:
            cut = pool.orderBy("_h", "_k").limit(wanted).agg(F.max(F.struct("_h", "_k"))).first()[0]
            return cut["_h"], cut["_k"]


def _upto(df: DataFrame, rows: int, seed: int, key: str) -> Column:
    """True for the first ``rows`` rows in the seeded order, and false for the others."""
    cut_hash, cut_key = split_point(df, rows, seed, key)
    order = hash_order(seed, key)
    at_cut = (order == cut_hash) & F.coalesce(F.col(key) <= F.lit(cut_key), F.lit(cut_key is None))
    return (order < cut_hash) | at_cut


def split_flag(df: DataFrame, test_size: float, seed: int, key: str) -> Column:
    """True for the ``ceil(test_size * rows)`` first rows in the seeded order of the unique ``key``.

    Once the cut point is known the split is a filter: no shuffle, and the same after a retry.
    """
    rows = df.count()
    wanted = math.ceil(Decimal(str(test_size)) * rows)
    if wanted == 0:
        return F.lit(False)
    return _upto(df, wanted, seed, key)


def split(
    df: DataFrame, test_size: float, seed: int, key: str
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, and independent of partitions."""
    in_test = split_flag(df, test_size, seed, key)
    return df.filter(~in_test), df.filter(in_test)


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each group (``order`` ascending is oldest first).

    Up to ``GROUP_LIMIT`` rows Spark trims each group before the shuffle; beyond that the groups are
    trimmed in salted shares first.
    """
    newest = [F.desc(c) for c in order]

    def trim(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
        return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")

    if n > GROUP_LIMIT:
        shares = df.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(256)))
        df = trim(shares, [*keys, "_share"]).drop("_share")
    return trim(df, keys)


def with_ordinal(df: DataFrame, order: str, name: str = "ordinal", **ranges) -> DataFrame:
    """Number all rows from 0 in ``order`` (unique, nulls first)."""
    return numbered(df, [], [order], name, **ranges)


def pending(problems: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """Problems with no graded sample yet."""
    return problems.join(graded.select(*keys).distinct(), keys, "left_anti")
