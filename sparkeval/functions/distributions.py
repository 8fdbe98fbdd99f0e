"""Distances between two next-token distributions held as arrays (one row per position)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeval.functions.common import ColumnOrName, as_column, let

SMALLEST = 1e-8  # fixed value: probabilities are raised to this before taking the logarithm


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def temperature_scale(logits: ColumnOrName, temperature: float = 1.0) -> Column:
    return F.transform(as_column(logits), lambda x: x.cast("double") / F.lit(float(temperature)))


def _normalizer(z: Column) -> Column:
    """log(sum(exp(z))), shifted by the maximum."""
    return let(
        F.array_max(z),
        lambda top: top + F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))),
    )


def log_softmax(logits: ColumnOrName, temperature: float = 1.0) -> Column:
    def shifted(z: Column) -> Column:
        return let(_normalizer(z), lambda norm: F.transform(z, lambda x: x - norm))

    return let(temperature_scale(logits, temperature), shifted)


def log_probs(probs: ColumnOrName) -> Column:
    return F.transform(
        as_column(probs), lambda p: F.log(F.greatest(p.cast("double"), F.lit(SMALLEST)))
    )


def top_k_ids(teacher: ColumnOrName, k: int) -> Column:
    """0-based ids of the k largest entries, best first; the lowest id wins a tie.

    The plain numbers are sorted for the k-th largest; only entries from there on are ranked with their ids.
    """

    def largest(x: Column) -> Column:
        cut = F.try_element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
        places = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
        ids = let(cut, lambda c: F.filter(places, lambda i: F.get(x, i) >= c))
        ranked = F.array_sort(F.transform(ids, lambda i: F.struct((-F.get(x, i)).alias("v"), i.alias("id"))))
        return F.transform(F.slice(ranked, 1, k), lambda r: r["id"])

    return let(as_column(teacher), largest)


def gather(values: ColumnOrName, ids: Column) -> Column:
    values = as_column(values)
    return F.transform(ids, lambda i: F.get(values, i))


def pointwise(log_s: Column, log_t: Column, beta: float) -> Column:
    """One vocabulary entry's share of the generalized Jensen-Shannon divergence."""
    if beta == 0:
        return F.exp(log_t) * (log_t - log_s)
    if beta == 1:
        return F.exp(log_s) * (log_s - log_t)
    a, b = log_s + math.log1p(-beta), log_t + math.log(beta)
    top = F.greatest(a, b)
    log_m = top + F.log(F.exp(a - top) + F.exp(b - top))
    return beta * F.exp(log_t) * (log_t - log_m) + (1 - beta) * F.exp(log_s) * (log_s - log_m)


def _log_pair(
    student: Column, teacher: Column, temperature: float, top_k: int | None, are_probs: bool
) -> Column:
    """Struct of both sides' log-probabilities over the entries that count."""
    if are_probs:
        return F.struct(log_probs(student).alias("s"), log_probs(teacher).alias("t"))

    def normalized(s: Column, t: Column) -> Column:
        return F.struct(
            log_softmax(s, temperature).alias("s"), log_softmax(t, temperature).alias("t")
        )

    if top_k is None or top_k <= 0:
        return normalized(student, teacher)
    kept = F.struct(student.alias("s"), teacher.alias("t"), top_k_ids(teacher, top_k).alias("k"))
    return let(kept, lambda r: normalized(gather(r["s"], r["k"]), gather(r["t"], r["k"])))


def divergence_terms(
    student: ColumnOrName,
    teacher: ColumnOrName,
    beta: float = 0.5,
    temperature: float = 1.0,
    top_k: int | None = None,
    are_probs: bool = False,
) -> Column:
    """Array with one term per vocabulary entry (per kept entry with ``top_k``).

    Probabilities as input ignore temperature and top-k.
    """
    logs = _log_pair(as_column(student), as_column(teacher), temperature, top_k, are_probs)
    return let(logs, lambda p: F.zip_with(p["s"], p["t"], lambda s, t: pointwise(s, t, beta)))


def divergence(
    student: ColumnOrName,
    teacher: ColumnOrName,
    beta: float = 0.5,
    temperature: float = 1.0,
    top_k: int | None = None,
    are_probs: bool = False,
) -> Column:
    """Generalized Jensen-Shannon divergence of one position, summed over the vocabulary.

    ``beta=0`` is KL(teacher || student), ``beta=1`` is KL(student || teacher). In between the sum is
    taken as the difference of entropies, which needs half the exponentials of the sum of the terms.
    """
    if beta in (0, 1):
        return _total(divergence_terms(student, teacher, beta, temperature, top_k, are_probs))
    logs = _log_pair(as_column(student), as_column(teacher), temperature, top_k, are_probs)

    def product(x: Column, y: Column) -> Column:
        return x * y

    def weight_log_weight(x: Column, y: Column) -> Column:
        return (x + y) * F.coalesce(F.log(x + y), F.lit(0.0))

    def entropies(p: Column) -> Column:
        weighted = F.struct(
            F.transform(p["t"], lambda v: beta * F.exp(v)).alias("t"),
            F.transform(p["s"], lambda v: (1 - beta) * F.exp(v)).alias("s"),
        )
        return let(
            weighted,
            lambda w: _total(F.zip_with(w["t"], p["t"], product))
            + _total(F.zip_with(w["s"], p["s"], product))
            - _total(F.zip_with(w["t"], w["s"], weight_log_weight)),
        )

    return let(logs, entropies)


def sampled_logprob(
    logits: ColumnOrName, token: ColumnOrName, temperature: float = 1.0
) -> Column:
    """Log-probability of one token; only the normaliser and that entry are computed."""

    def pick(z: Column) -> Column:
        return F.get(z, as_column(token)) - _normalizer(z)

    return let(temperature_scale(logits, temperature), pick)
