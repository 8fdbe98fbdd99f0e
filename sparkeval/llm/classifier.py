"""A quality score from document statistics: random Fourier features, ridge, isotonic calibration.

The features approximate a Gaussian kernel, so a linear fit on them is a kernel fit whose size does not
depend on the number of rows. Every task sums its part of the normal equations; the sums have a fixed
size. The raw scores of rows that the ridge has not seen are counted in bins of fixed number, and the pooled
bins give a rising map from raw score to probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkeval.llm.common import append, fewer, fresh, struct

WHITE = [9, 10, 11, 12, 13, 32]
PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
FEATURES = (
    "log_chars", "log_words", "word_length", "word_spread", "longest", "upper", "digits", "white",
    "sentence_marks", "quotes", "exclaims", "symbols", "other_marks", "beyond_ascii", "distinct_words",
    "top_word", "repeated_pairs", "repeated_lines", "line_words", "entropy", "marked_ends", "capital_words",
)
WIDTH = 384  # random features
GAMMA = 0.6  # of the kernel, over the square root of the number of statistics
RIDGE = 1e-3  # per training row
BINS = 2048
FOLDS = 5  # one of them calibrates
GROUPS = 64  # of tasks, whose sums are added first
LOW, HIGH = -1.0, 2.0  # raw scores that the bins divide


def statistics(text: str | None) -> list[float]:
    """Numbers about a text that need nothing but the text; an empty or null one has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = len(raw), len(words)
    share = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.float64, w)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def part(chars) -> float:
        return float(counts[[ord(c) if isinstance(c, str) else c for c in chars]].sum()) / n

    sentence, quotes, symbols = ".,;:?", "'\"()-", "#*$%&|<>"
    rest = [c for c in PUNCTUATION if chr(c) not in sentence + quotes + symbols + "!"]
    return [
        np.log1p(n),
        np.log1p(w),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        float(counts[65:91].sum()) / n,
        float(counts[48:58].sum()) / n,
        part(WHITE),
        part(sentence),
        part(quotes),
        part("!"),
        part(symbols),
        part(rest),
        float(counts[128:].sum()) / n,
        len(seen) / w,
        max(seen.values()) / w,
        sum(k - 1 for k in pairs.values()) / max(1, w - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(w / max(1, len(lines)))),
        float(-(share * np.log(share)).sum()),
        sum(x[-1] in b"!#*$%&|<>" for x in words) / w,
        sum(65 <= x[0] <= 90 for x in words) / w,
    ]


@dataclass(frozen=True)
class Model:
    """All of fixed size, whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    points: np.ndarray  # raw scores and their calibrated values, both rising
    values: np.ndarray


def _basis(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    spread = GAMMA / np.sqrt(len(FEATURES))
    return rng.normal(0, spread, (len(FEATURES), WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features of rows of statistics: cosines, the statistics themselves, and one."""
    directions, phases = _basis()
    z = np.clip((x - mean) / scale, -6, 6)
    waves = np.sqrt(2 / WIDTH) * np.cos(z @ directions + phases)
    return np.hstack([waves, 0.1 * z, np.ones((len(z), 1))])


def featurize(df: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """Add ``into``: the statistics of ``text``; a null text has those of an empty one. Repeated rows get
    equal statistics, an empty table stays empty, other columns stay (one named ``into`` is replaced)."""
    held = fresh(df, "_statistics")
    done = append(
        df, held, struct(x="array<double>"), lambda c: [(statistics(t),) for t in c[text]], [text]
    )
    return done.withColumn(into, F.col(f"{held}.x")).drop(held)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _sum_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Z'Z and Z'y. A task gives one row per feature, and there are only so many tasks as the cluster has
    use for. The rows of a feature are added in two levels, ``GROUPS`` groups of tasks first, each time in
    any order after being sorted, so that the sum does not depend on the order of arrival."""
    width = WIDTH + len(FEATURES) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = fourier(_matrix(batch, "x"), mean, scale)
                y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                total += z.T @ np.hstack([z, y[:, None]])
        if total.any():
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(width), pa.int32()),
                    pa.array([group] * width, pa.int32()),
                    pa.array(list(total), pa.list_(pa.float64())),
                ],
                names=["row", "part", "sums"],
            )

    def added(table: pa.Table) -> pa.Table:
        sums = np.sort(np.array(table["sums"].to_pylist()), axis=0).sum(axis=0)
        kept = {c: table[c][:1] for c in ("row", "part")}
        return pa.table(kept | {"sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "row int, part int, sums array<double>"
    parts = fewer(rows).mapInArrow(part, schema).groupBy("row", "part").applyInArrow(added, schema)
    found = parts.groupBy("row").applyInArrow(added, schema).collect()
    out = np.zeros((width, width + 1))
    for r in found:  # a row per feature, however many documents there are
        out[r["row"]] = r["sums"]
    return out


def raw_scores(x: np.ndarray, model: Model) -> np.ndarray:
    return fourier(x, model.mean, model.scale) @ model.weights


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in blocks])


def fit(rows: DataFrame, x: str = "statistics", y: str = "label") -> Model | None:
    """Fit on rows of statistics and 0/1 labels. None without rows.

    Rows without statistics or label are left out. A row that comes again counts again, and so do labels that
    contradict each other. One row in ``FOLDS``, by a hash of its statistics, is kept from the ridge and
    calibrates it; a table that has no such row is calibrated on all. Other columns are not read.
    """
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("x"), F.lit(FOLDS)) == 0)
    k = len(FEATURES)
    about = rows.agg(
        F.count("*").alias("n"),
        F.count_if("calibrates").alias("calibrating"),
        *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(k)],
    ).first()
    if not about["n"]:
        return None
    mean = np.array([round(about[f"m{i}"], 9) for i in range(k)])
    scale = np.array([round(about[f"s{i}"], 9) or 1.0 for i in range(k)])
    apart = 0 < about["calibrating"] < about["n"]
    learning = about["n"] - about["calibrating"] * apart
    sums = _sum_equations(rows.filter(~F.col("calibrates")) if apart else rows, mean, scale)
    width = len(sums)
    weights = np.linalg.solve(sums[:, :-1] + RIDGE * learning / width * np.eye(width), sums[:, -1])
    model = Model(mean, scale, weights, np.zeros(0), np.zeros(0))
    held = _scored(rows.filter("calibrates") if apart else rows, model, "x", "raw").select("raw", "y")
    edge = (F.col("raw") - LOW) / (HIGH - LOW) * BINS
    bins = held.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(edge))).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").alias("good")
    )
    found = sorted((r["bin"], r["n"], r["good"]) for r in bins.collect())  # BINS rows at most
    at, n, good = (np.array(v, float) for v in zip(*found))
    values = pooled((good + 1e-3 * good.sum() / n.sum()) / (n + 1e-3), n)
    # Even inside a pooled block a higher raw score stays slightly higher.
    return Model(mean, scale, weights, LOW + (at + 0.5) * (HIGH - LOW) / BINS, values)


def _scored(df: DataFrame, model: Model, x: str, into: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_scores(_matrix(batch, x), model) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.round(raw, 6))], names=[*batch.schema.names, into]
            )

    return df.mapInArrow(run, schema)


def score(df: DataFrame, model: Model | None, x: str = "statistics", into: str = "score") -> DataFrame:
    """Add ``into``: the calibrated score, 0 to 1; 0.5 for all rows without a model. Ties in the
    calibration are broken by the raw score, within a thousandth. A column named ``into`` is replaced."""
    if model is None:
        return df.withColumn(into, F.lit(0.5))
    df, held = df.drop(into), fresh(df, "_raw")

    def calibrated(raw: np.ndarray) -> np.ndarray:
        level = np.interp(raw, model.points, model.values)
        tie = (np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW)
        return np.round(0.999 * np.clip(level, 0, 1) + 0.001 * tie, 6)

    scored = _scored(df, model, x, held)
    schema = T.StructType([*scored.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(held)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(calibrated(raw), pa.float64())], names=[*batch.schema.names, into]
            )

    return scored.mapInArrow(run, schema).drop(held)
