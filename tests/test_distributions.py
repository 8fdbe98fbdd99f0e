"""Divergences against numpy, and their properties."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkeval.functions import distributions as D
from sparkeval.operators import distributions as O
from sparkeval.operators import shards as H

SIZE = 12
RNG = np.random.default_rng(4)
STUDENT = RNG.normal(0, 3, (60, SIZE))
TEACHER = RNG.normal(0, 3, (60, SIZE))
LABELS = [-100 if i % 5 == 0 else int(i % SIZE) for i in range(60)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        (i // 6, i % 6, LABELS[i], i % SIZE, s.tolist(), t.tolist())
        for i, (s, t) in enumerate(zip(STUDENT, TEACHER))
    ]
    schema = "seq_id int, pos int, label int, token_id int, student array<double>, teacher array<double>"
    return spark.createDataFrame(rows, schema).cache()


def log_softmax(z):
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def cells(ls, lt, beta):
    if beta == 0:
        return np.exp(lt) * (lt - ls)
    if beta == 1:
        return np.exp(ls) * (ls - lt)
    m = np.logaddexp(ls + np.log(1 - beta), lt + np.log(beta))
    return beta * np.exp(lt) * (lt - m) + (1 - beta) * np.exp(ls) * (ls - m)


def expected(beta, temperature=1.0, top_k=None):
    s, t = STUDENT / temperature, TEACHER / temperature
    if top_k:
        kept = np.argsort(-t, axis=1, kind="stable")[:, :top_k]
        s, t = np.take_along_axis(s, kept, 1), np.take_along_axis(t, kept, 1)
    return cells(log_softmax(s), log_softmax(t), beta)


def values(df, column):
    rows = df.select("seq_id", "pos", column.alias("v")).orderBy("seq_id", "pos").collect()
    return np.array([r.v for r in rows])


@pytest.mark.parametrize("beta", [0, 0.1, 0.5, 0.9, 1])
@pytest.mark.parametrize("temperature, top_k", [(1.0, None), (0.7, None), (1.0, 4), (1.1, SIZE)])
def test_divergence(pairs, beta, temperature, top_k):
    want = expected(beta, temperature, top_k)
    got = values(pairs, D.divergence("student", "teacher", beta, temperature, top_k))
    assert np.abs(got - want.sum(1)).max() < 1e-12
    long = O.divergence_long(O.explode_vocabulary(pairs), beta, temperature, top_k)
    assert np.abs(values(long, F.col("divergence")) - want.sum(1)).max() < 1e-12


def test_terms(pairs):
    got = values(pairs, D.divergence_terms("student", "teacher", 0.3))
    assert np.abs(got - expected(0.3)).max() < 1e-12


def test_properties(pairs):
    jsd = values(pairs, D.divergence("student", "teacher", 0.5))
    assert jsd.min() > 0 and jsd.max() <= np.log(2) + 1e-12
    assert np.abs(values(pairs, D.divergence("student", "student", 0.5))).max() < 1e-14
    mirrored = values(pairs, D.divergence("teacher", "student", 0.7))
    assert np.abs(values(pairs, D.divergence("student", "teacher", 0.3)) - mirrored).max() < 1e-12
    assert np.abs(values(pairs, D.divergence("student", "teacher", 0.5, top_k=SIZE)) - jsd).max() < 1e-12


def test_far_apart(spark):
    """Probabilities that underflow add nothing."""
    df = spark.createDataFrame([([0.0, -900.0, -900.0], [-900.0, 0.0, -900.0])], "s array<double>, t array<double>")
    assert df.select(D.divergence("s", "t", 0.5)).first()[0] == pytest.approx(np.log(2))


def test_probabilities(spark):
    p, q = [0.5, 0.5, 0.0], [0.2, 0.3, 0.5]
    df = spark.createDataFrame([(p, q)], "s array<double>, t array<double>")
    for beta in (0, 0.4, 1):
        logs = [np.log(np.maximum(x, 1e-8)) for x in (np.array(p), np.array(q))]
        got = df.select(D.divergence("s", "t", beta, temperature=9, top_k=1, are_probs=True)).first()[0]
        assert got == pytest.approx(cells(*logs, beta).sum())


def test_top_k_tie_takes_the_lowest_id(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 2.0],)], "t array<double>")
    assert df.select(D.top_k_ids("t", 2)).first()[0] == [1, 2]


def test_reductions(pairs):
    rows = pairs.select("seq_id", "pos", "label", D.divergence("student", "teacher").alias("divergence"))
    rows = rows.withColumn("cells", F.lit(SIZE))
    keep = np.array(LABELS) != -100
    total = expected(0.5).sum(1)[keep].sum()
    loss = lambda *a, **k: O.reduce_divergence(rows, *a, **k).first()[0]
    assert loss() == pytest.approx(total / keep.sum())
    assert loss("sum") == pytest.approx(total)
    assert loss("mean", vocabulary="cells") == pytest.approx(total / (keep.sum() * SIZE))
    assert loss(label=None) == pytest.approx(expected(0.5).sum() / 10)
    assert O.reduce_divergence(rows, "none").count() == keep.sum()
    assert O.reduce_divergence(rows.withColumn("label", F.lit(-100))).first()[0] is None
    with pytest.raises(ValueError):
        loss("median")
    with pytest.raises(ValueError):
        loss("mean")


def test_sampled_token(pairs):
    out = O.token_advantage(pairs, temperature=1.1).orderBy("seq_id", "pos").collect()
    ls, lt = log_softmax(STUDENT / 1.1), log_softmax(TEACHER / 1.1)
    token = np.arange(60) % SIZE
    s, t = ls[np.arange(60), token], lt[np.arange(60), token]
    assert np.abs(np.array([r.student_logprob for r in out]) - s).max() < 1e-12
    assert np.abs(np.array([r.advantage for r in out]) - (t - s)).max() < 1e-12
    keep = np.array(LABELS) != -100
    objective = O.pg_objective(O.token_advantage(pairs, temperature=1.1)).first()[0]
    assert objective == pytest.approx(-np.mean(((t - s) * s)[keep]))


def test_gather(pairs):
    found = O.gather_token(O.explode_vocabulary(pairs), pairs).orderBy("seq_id", "pos").collect()
    assert [r.s for r in found] == [STUDENT[i, i % SIZE] for i in range(60)]


def test_ema_update(spark):
    state = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "name string, values array<double>")
    params = spark.createDataFrame([("a", [2.0, 4.0]), ("c", [9.0])], "name string, values array<double>")
    got = {r.name: r["values"] for r in O.ema_update(state, params, 0.9).collect()}
    assert got == {"a": pytest.approx([1.1, 2.2]), "b": [3.0]}


def test_gather_in_place_equals_gather_of_cells(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.choice([None, -1, 0, 3, 4, 5]), [rng.random() for _ in range(5)], [rng.random() for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id int, pos int, token_id int, student array<double>, teacher array<double>")
    got = O.gather(df, "token_id")
    want = O.gather_token(O.explode_vocabulary(df), df)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    assert got.count() == sum(r[2] is not None and 0 <= r[2] < 5 for r in rows)
    assert O.gather(df.limit(0), "token_id").count() == 0


@pytest.mark.parametrize(("beta", "top_k", "size"), [(0.5, None, 3), (0, None, 1), (1, None, 100), (0.3, 4, 3), (0.5, 20, 2)])
def test_sharded_divergence(spark, beta, top_k, size):
    """Far values, ties and a null position; no window and no more than a shard of entries in an array."""
    rng = random.Random(9)
    rows = [(seq, pos, token, rng.choice([0.0, 1.5, rng.uniform(-700, 700)]), rng.choice([0.0, rng.gauss(0, 3)]))
            for seq in (1, 2, None) for pos in (0, 1) for token in range(11)]
    cells = spark.createDataFrame(rows, "seq_id int, pos int, token_id int, s double, t double").repartition(5)
    out = H.divergence_sharded(cells, beta, 0.7, top_k, size)
    got = {(r.seq_id, r.pos): r.divergence for r in out.collect()}
    want = {(r.seq_id, r.pos): r.divergence for r in O.divergence_long(cells, beta, 0.7, top_k).collect()}
    assert len(got) == 6 and got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert max(r.n for r in H.shards(cells, size).select(F.size("cells").alias("n")).collect()) <= size
    assert H.divergence_sharded(cells.limit(0), beta, 0.7, top_k, size).count() == 0


def test_sharded_top_k(spark):
    rng = random.Random(2)
    rows = [(1, 0, token, 0.0, float(rng.randrange(5))) for token in range(50)]
    cells = spark.createDataFrame(rows, "seq_id int, pos int, token_id int, s double, t double")
    for k in (1, 7, 60):
        got = [c.token_id for c in H.top_k_sharded(cells, k, 8).first().cells]
        assert got == [r[2] for r in sorted(rows, key=lambda r: (-r[4], r[2]))][:k]
