"""Whitening of embeddings from an exact covariance, counted bit by bit.

Each entry becomes a whole number. Of a block of rows, every dimension is shifted to start at 0 and cut
into bit planes, and each plane is packed across the rows into words of 64 bits. The product of two
dimensions, summed over the rows, is then the popcount of AND of each pair of their planes, weighted by
the two powers of two. Shifts are undone in whole numbers. Tasks add their blocks and hand on one exact
sum per pair of dimensions; the driver centres these sums as integers, n * sum(xy) - sum(x) sum(y), and only
then divides and decomposes one matrix of dimensions x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import append, fewer, fresh, struct
from sparkeval.llm.exact import LIMBS, LONGEST, finite, for_squares, limbs, rows_of, summed
from sparkeval.plans.session import materialize

SCALE = 64
OFFSET = 1_000_000
LARGEST = float(1 << 55)  # entries from here on are no 64-bit numbers when scaled
BLOCK = 4096  # rows whose planes are packed at once
WHITE = struct(deviation="bigint", whitened="array<double>")
SIZE = -1  # place of the number of rows, and of the sums of single dimensions, among the products


def numbers(df: DataFrame, key: str, vector: str, dimensions: int | None = None) -> DataFrame:
    """(key, x): ``floor(64 * entry) + 1000000`` for each entry of each vector.

    Left out are null vectors, those with null, not finite or unscalable entries (2^55 and more, no 64-bit
    number when scaled), and those that are not ``dimensions`` long; unless given, that is the most
    frequent length, the greatest of equally frequent ones.
    """
    small = lambda e: F.abs(e) < LARGEST
    good = df.filter(finite(vector) & F.forall(F.col(vector).cast("array<double>"), small))
    if dimensions is None:
        lengths = good.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
        most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
        dimensions = most["length"] if most else 0
    number = lambda e: F.floor(SCALE * e) + F.lit(OFFSET).cast("bigint")
    x = F.transform(F.col(vector).cast("array<double>"), number)
    return good.filter(F.size(vector) == dimensions).select(key, x.alias("x"))


def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each pair of dimensions' products and of each dimension, over a block of rows, as Python's
    numbers."""
    n, d = x.shape
    low = x.min(axis=0)
    shifted = (x - low).astype(np.uint64)
    widths = [int(v).bit_length() for v in shifted.max(axis=0)]
    owner = np.repeat(np.arange(d), widths)
    bit = np.concatenate([np.arange(w) for w in widths]).astype(np.uint64) if len(owner) else np.zeros(0, np.uint64)
    planes = np.zeros((len(owner), -(-n // 64) * 64), np.uint8)
    planes[:, :n] = ((shifted.T[owner] >> bit[:, None]) & np.uint64(1)).astype(np.uint8)
    words = np.packbits(planes, axis=1).view(np.uint64)
    counts = np.zeros((len(owner), len(owner)), np.int64)
    for p in range(len(owner)):
        counts[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    counts = np.maximum(counts, counts.T)
    wide = 2 * max(widths, default=0) + n.bit_length() > 61
    weight = np.array([1 << int(b) for b in bit], object)
    if not wide:
        weight = weight.astype(np.int64)
    found = np.zeros((d, d), object)
    sums = np.zeros(d, object)
    if len(owner):
        have = [i for i, w in enumerate(widths) if w]
        starts = np.searchsorted(owner, have)
        weighted = np.add.reduceat((counts.astype(object) if wide else counts) * weight[:, None], starts, axis=0)
        found[np.ix_(have, have)] = np.add.reduceat(weighted * weight, starts, axis=1).astype(object)
        sums[have] = np.add.reduceat(np.diagonal(counts).astype(weight.dtype) * weight, starts).astype(object)
    low = low.astype(object)
    found += np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return found, sums + n * low


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums, and the leading components of their covariance."""

    n: int
    sums: list[int]
    values: list[float]  # eigenvalues, falling
    axes: np.ndarray  # [dimensions, components], unit length, over the root of the eigenvalue
    explained: list[float | None]
    identity_error: float | None

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared deviation from the mean, times n^2, and the whitened components of each row."""
        sums = np.array(self.sums, object)
        far = max((int(np.abs(x).max(initial=0)) * self.n + abs(max(self.sums, key=abs))) if self.sums else 0, 0)
        kind = np.int64 if far < 1 << 62 else object
        gaps = x.astype(kind) * (np.int64(self.n) if kind is np.int64 else self.n) - sums.astype(kind)
        (squares,) = for_squares(gaps, terms=x.shape[1])
        deviation = (squares * squares).sum(axis=1)
        return deviation, (gaps / self.n).astype(np.float64) @ self.axes


def fit(x: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors ``x``; None without any.

    Components come by falling eigenvalue, each with its largest entry positive. One whose eigenvalue is
    not above rounding (rank-deficient tables) has no whitened values. ``explained`` is its share of the
    trace, null for a trace of 0. The driver holds one matrix of dimensions x dimensions.
    """
    distinct = materialize(x.select("x").distinct(), "distinct")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = 0, 0, 0
        for block in _blocks(batches):
            found, own = products(block)
            total, sums, n = total + found, sums + own, n + len(block)
        if n:
            pairs = [(i, j) for i in range(len(sums)) for j in range(i, len(sums))]
            keys = [(SIZE, SIZE), *((SIZE, i) for i in range(len(sums))), *pairs]
            yield limbs(keys, [n, *sums, *(total[p] for p in pairs)])

    found = summed(fewer(distinct).mapInArrow(run, LIMBS))
    if not found:
        return None
    n = found.pop((SIZE, SIZE))
    sums = [found.pop((SIZE, i)) for i in range(sum(a == SIZE for a, _ in found))]
    centred = np.zeros((len(sums), len(sums)))
    for (i, j), value in found.items():
        centred[i, j] = centred[j, i] = (n * value - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(centred)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    real = values > max(values[0], 0) * len(sums) * 2.0**-50
    axes = np.where(real, vectors * signs / np.sqrt(np.where(real, values, 1)), np.nan)
    trace = np.trace(centred)
    good = axes[:, real]
    error = np.abs(good.T @ centred @ good - np.eye(good.shape[1])).max(initial=0) if real.any() else None
    return Whitening(
        n, sums, values.tolist(), axes, [float(v / trace) if trace > 0 else None for v in values],
        None if error is None else float(error),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(rows_of(batch.column(0)))
            size += batch.num_rows
        if size >= BLOCK:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def whiten(df: DataFrame, model: Whitening, into: str = "white", x: str = "x") -> DataFrame:
    """Add ``into``: deviation (sum over the dimensions of (n * x - sum)^2, null if no 64-bit number) and
    whitened, a value per component, null for a component that has none.

    Repeated rows get equal values, an empty table stays empty, and other columns stay (one named
    ``into`` is replaced).
    """

    def rows(columns: dict[str, list]) -> list[tuple]:
        if not columns[x]:
            return []
        deviation, white = model.apply(np.array(columns[x], np.int64))
        return [
            (int(v) if v <= LONGEST else None, [None if w != w else w for w in row])
            for v, row in zip(deviation, white.tolist())
        ]

    return append(df, into, WHITE, rows, [x])


def whitened(df: DataFrame, key: str, vector: str, components: int = 16, dimensions: int | None = None) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector of
    ``numbers`` and each component, from 1; vectors with fewer dimensions have as many components.

    The covariance is that of the distinct vectors, so repeated rows weigh once and all get their values.
    A single distinct vector has components without values; an empty table gives an empty table. No other
    column is read.
    """
    rows = numbers(df, key, vector, dimensions)
    model = fit(rows, components)
    held = fresh(rows, "_white")
    if model is None:
        model, rows = Whitening(0, [], [], np.zeros((0, 0)), [], None), rows.limit(0)
    done = whiten(rows, model, held)
    share = F.array(*[F.lit(e).cast("double") for e in model.explained]) if model.explained else F.lit(None).cast("array<double>")
    each = done.select(
        key, F.col(f"{held}.deviation").alias("deviation"), F.posexplode(f"{held}.whitened").alias("_at", "whitened")
    )
    return each.select(
        key,
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("_at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
