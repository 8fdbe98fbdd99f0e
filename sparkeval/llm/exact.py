"""Whole numbers of any size in tasks, and their exact sums across tasks."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB = 32
LONGEST = (1 << 63) - 1


def finite(vector: Column | str) -> Column:
    """Whether a vector is there and none of its entries is null, NaN or infinite."""
    entries = F.col(vector) if isinstance(vector, str) else vector
    ok = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf))
    return entries.isNotNull() & F.forall(entries.cast("array<double>"), ok)


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def scaled(values: np.ndarray, factor: int) -> np.ndarray:
    """``floor(factor * value)`` for doubles, exactly (``factor`` is a power of two): 64-bit numbers where
    all fit in 62 bits, else Python's."""
    values = values.astype(np.float64)
    if np.abs(values).max(initial=0) < (1 << 62) / factor:
        return np.floor(values * factor).astype(np.int64)
    whole = [[int(v) * factor if abs(v) >= 1 << 53 else math.floor(v * factor) for v in row] for row in values.tolist()]
    return np.array(whole, object).reshape(values.shape)


def for_squares(*arrays: np.ndarray, terms: int) -> list[np.ndarray]:
    """The arrays as they are if a sum of ``terms`` squared differences of their entries fits in 64 bits,
    else as Python's numbers."""
    bound = math.isqrt((1 << 62) // max(1, terms)) // 2
    if all(a.dtype != object and np.abs(a).max(initial=0) <= bound for a in arrays):
        return list(arrays)
    return [a.astype(object) for a in arrays]


def limbs(keys: Iterable[tuple[int, int]], values: Iterable[int]) -> pa.RecordBatch:
    """(a, b, limb, value): each number cut into pieces of 32 bits, whose sums stay small."""
    rows = []
    for (a, b), value in zip(keys, map(int, values)):
        limb = 0
        while not -(1 << LIMB) < value < 1 << LIMB:
            rows.append((a, b, limb, value & ((1 << LIMB) - 1)))
            value >>= LIMB
            limb += 1
        rows.append((a, b, limb, value))
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
        names=["a", "b", "limb", "value"],
    )


LIMBS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "limb")] + [T.StructField("value", T.LongType())])


def summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The exact sum for each (a, b). Only as many rows as there are sums and limbs reach the driver."""
    totals: dict[tuple[int, int], int] = defaultdict(int)
    for r in parts.groupBy("a", "b", "limb").agg(F.sum("value").alias("value")).collect():
        totals[r["a"], r["b"]] += r["value"] << (LIMB * r["limb"])
    return dict(totals)
