"""Seeded pseudo-random order that depends on the row alone, not on partitions or engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeval.functions.common import ColumnOrName, as_column


def hash_order(seed: int, key: ColumnOrName) -> Column:
    """32 hex digits; sorting by them is a seeded shuffle of the keys, null being one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(as_column(key).cast("string"), F.lit(""))))


def hash_below(seed: int, key: ColumnOrName, fraction: float) -> Column:
    """True for about ``fraction`` of the keys."""
    if fraction >= 1:
        return F.lit(True)
    limit = f"{math.floor(fraction * 16**8):08x}"
    return F.substring(hash_order(seed, key), 1, 8) < limit
