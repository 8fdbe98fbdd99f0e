"""Clusters of vectors in exact integer arithmetic, each vector assigned by the threshold algorithm.

Each dimension has the list of all centroids, sorted by their value there. From a vector's own value the
list is walked outward in both directions, all dimensions a step at a time. A centroid that turns up
anywhere for the first time is measured exactly. A centroid that no list has shown yet is at least as far
as the last step in each dimension, so the walk of a vector ends when the sum of the squared steps is
strictly more than its best exact distance; until then an equal distance with a smaller number can still
come. All vectors of a batch walk at once, and those that have ended drop out.

The centroids (k times the dimensions) go to every task. A round sums each cluster in place and hands on
one exact sum per task, cluster and dimension; no vector moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkeval.llm.common import append, fewer, fresh, struct
from sparkeval.llm.exact import LIMBS, LONGEST, finite, for_squares, limbs, rows_of, scaled, summed
from sparkeval.plans.session import materialize

SCALE = 1024
COUNT = -1  # place of a cluster's size among its sums
FOUND = struct(cluster="int", distance="bigint")


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids, number 0 first, with the sorted list of each dimension."""

    points: list[list[int]]
    order: np.ndarray = field(init=False)  # [k, dimensions]: which centroid is at a place of a list
    lists: np.ndarray = field(init=False)  # [k, dimensions]: its value
    values: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        values = np.array(self.points, object)
        if not values.size or np.abs(values).max() < 1 << 62:
            values = values.astype(np.int64)
        values = values.reshape(len(self.points), len(self.points[0]) if self.points else 0)
        object.__setattr__(self, "values", values)
        object.__setattr__(self, "order", np.argsort(values, axis=0, kind="stable"))
        object.__setattr__(self, "lists", np.take_along_axis(values, self.order, axis=0))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; of equally near ones the
        smallest number."""
        x, lists, values = for_squares(vectors, self.lists, self.values, terms=vectors.shape[1])
        n, k = len(x), len(values)
        dims = np.arange(x.shape[1])
        right = np.stack([np.searchsorted(lists[:, i], x[:, i]) for i in dims], axis=1) if len(dims) else np.zeros((n, 0), int)
        left = right - 1
        seen = np.zeros((n, k), bool)
        label = np.full(n, k)
        best = np.zeros(n, x.dtype)
        going = np.arange(n)
        for _ in range(k):
            own, below, above = x[going], left[going], right[going]
            down = own - lists[np.maximum(below, 0), dims]
            up = lists[np.minimum(above, k - 1), dims] - own
            take = (above >= k) | ((below >= 0) & (down <= up).astype(bool))
            step = np.where(take, down, up)
            shown = self.order[np.where(take, below, above), dims]
            left[going], right[going] = below - take, above + ~take
            hit = np.zeros((len(going), k), bool)
            hit[np.arange(len(going))[:, None], shown] = True
            row, centre = np.nonzero(hit & ~seen[going])
            seen[going] |= hit
            self._measured(x, values, going[row], centre, label, best)
            frontier = (step * step).sum(axis=1)
            going = going[~(frontier > best[going]).astype(bool)]
            if not len(going):
                break
        return label, best

    @staticmethod
    def _measured(x, values, row, centre, label, best) -> None:
        """Keep the nearest of the measured centroids of each row, in ``label`` and ``best``."""
        k = len(values)
        for c in range(k):
            rows = row[centre == c]
            if len(rows):
                gap = x[rows] - values[c]
                distance = (gap * gap).sum(axis=1)
                nearer = (distance < best[rows]).astype(bool) | ((distance == best[rows]).astype(bool) & (c < label[rows]))
                nearer |= label[rows] == k
                label[rows[nearer]], best[rows[nearer]] = c, distance[nearer]

    def sha256(self, number: int) -> str:
        """Of a centroid's components as decimal numbers, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.points[number])).encode()).hexdigest()


def kept(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(key, vector) of the vectors with ``dimensions`` entries, none of them null or not finite."""
    kind = df.schema[vector].dataType
    plain = F.col(vector) if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    return df.filter((F.size(vector) == dimensions) & finite(vector)).select(key, plain.alias(vector))


def first(vectors: DataFrame, key: str, vector: str, k: int, seed: int, scale: int) -> Centroids:
    """The ``k`` vectors with the least hash of seed and key; rows with one key come by their vectors."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("_hash"), F.col(vector).alias("_vector")).orderBy("_hash", "_vector").limit(k)
    found = [r["_vector"] for r in rows.collect()]
    return Centroids(scaled(np.array(found, np.float64), scale).tolist() if found else [])


def moved(vectors: DataFrame, vector: str, centroids: Centroids, scale: int) -> Centroids:
    """The floor of each cluster's mean; a centroid without vectors stays."""
    k, dimensions = centroids.values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, dimensions), object), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled(rows_of(batch.column(0)), scale)
            label, _ = centroids.nearest(x)
            narrow = x.dtype != object and np.abs(x).max(initial=0) < 1 << 40
            for c in np.unique(label).tolist():
                own = x[label == c]
                sums[c] += (own if narrow else own.astype(object)).sum(axis=0)
                sizes[c] += len(own)
        for c in range(k):
            if sizes[c]:
                yield limbs([(c, i) for i in range(COUNT, dimensions)], [sizes[c], *sums[c]])

    totals = summed(fewer(vectors.select(vector)).mapInArrow(run, LIMBS))
    return Centroids(
        [
            [totals[c, i] // totals[c, COUNT] for i in range(dimensions)] if (c, COUNT) in totals else point
            for c, point in enumerate(centroids.points)
        ]
    )


def fit(
    df: DataFrame,
    key: str,
    vector: str,
    dimensions: int = 64,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    scale: int = SCALE,
) -> Centroids:
    """Centroids after ``rounds`` rounds over all vectors with exactly ``dimensions`` finite entries.

    Entries become whole numbers, ``floor(scale * entry)``, of any size; all sums and means are exact. A
    table with fewer than ``k`` such vectors has as many centroids as vectors, equal ones included; null
    keys count as the empty text. ``rounds`` is a maximum in name only: a round that moves no centroid
    would be followed by equal ones. ``k`` times ``dimensions`` numbers must fit on the driver.
    """
    vectors = materialize(kept(df, key, vector, dimensions), "vectors")
    centroids = first(vectors, key, vector, k, seed, scale)
    for _ in range(rounds if centroids.points else 0):
        before, centroids = centroids, moved(vectors, vector, centroids, scale)
        if centroids.points == before.points:
            break
    return centroids


def assign(df: DataFrame, centroids: Centroids, vector: str, into: str = "nearest", scale: int = SCALE) -> DataFrame:
    """Add ``into``: the number of the nearest centroid and the squared distance to it, in whole numbers.

    The vectors must be as long as the centroids and finite (``kept``). A distance that is no 64-bit
    number is null. Repeated rows get equal values, an empty table stays empty, other columns stay (one
    named ``into`` is replaced).
    """

    def rows(columns: dict[str, list]) -> list[tuple]:
        if not columns[vector]:
            return []
        label, best = centroids.nearest(scaled(np.array(columns[vector], np.float64), scale))
        return [(int(c), int(d) if d <= LONGEST else None) for c, d in zip(label, best)]

    return append(df, into, FOUND, rows, [vector])


def clusters(
    df: DataFrame, key: str, vector: str, dimensions: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = SCALE
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that ``fit`` uses.

    Inertias are sums of distances, null where one of these is null or the sum is no 64-bit number. Rows
    with other vectors are left out; an empty table gives an empty table. No other column is read.
    """
    centroids = fit(df, key, vector, dimensions, k, rounds, seed, scale)
    held = fresh(df, "_nearest")
    vectors = kept(df, key, vector, dimensions)
    if not centroids.points:
        vectors = vectors.limit(0)
    placed = assign(vectors, centroids, vector, held, scale).select(F.col(key).alias("_key"), f"{held}.*")
    placed = materialize(placed, "assigned")
    wide = F.col("distance").cast("decimal(38,0)")
    sizes = placed.groupBy("cluster").agg(F.sum(wide).alias("sum"), F.count_if(F.col("distance").isNull()).alias("missing")).collect()
    sums = {r["cluster"]: int(r["sum"]) if not r["missing"] and r["sum"] <= LONGEST else None for r in sizes}
    total = None if None in sums.values() or sum(sums.values()) > LONGEST else sum(sums.values())
    facts = [(c, s, total, centroids.sha256(c)) for c, s in sorted(sums.items())]
    names = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    told = df.sparkSession.createDataFrame(facts, names)  # a row per cluster, k at most
    return placed.withColumnRenamed("_key", key).join(F.broadcast(told), "cluster")
