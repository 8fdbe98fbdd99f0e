"""Language profiles, exact clusters and whitening, against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import SF, odd_texts

from sparkeval.llm import centroids, exact, language, queries, whitening

# Plain versions -----------------------------------------------------------------------------------


def slow_bundle(text):
    """The vector of a text, letter by letter."""
    total = np.zeros(language.DIMENSIONS, np.int64)
    run = [0]
    for char in (text or "").lower() + " ":
        run.append(ord(char) if char.isalpha() else 0)
        run = run[-3:] if run[-2:] != [0, 0] else [0]
        if len(run) == 3 and run[1]:
            vector = np.ones(language.DIMENSIONS, np.int64)
            for place, code in enumerate(run):
                vector *= np.roll(language.letter_vector(code).astype(np.int64), 2 - place)
            total += vector
    return total


def cosine(a, b):
    norm = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / norm if norm else 0.0


def slow_clusters(rows, dimensions=64, k=8, rounds=10, seed=3):
    """(id, cluster, distance, inertia of the cluster, inertia, hash) per kept vector, by full distances."""
    kept = [
        (i, [math.floor(1024 * x) for x in map(float, v)])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    points = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def placed():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds if kept else 0):
        label = [c for _, c in placed()]
        for c in set(label):
            own = [v for (_, v), at in zip(kept, label) if at == c]
            points[c] = [sum(column) // len(own) for column in zip(*own)]
    ends = placed() if kept else []
    sums = {c: sum(d for d, at in ends if at == c) for _, c in ends}
    hashes = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((str(i), c, d, sums[c], sum(sums.values()), hashes[c]) for (i, _), (d, c) in zip(kept, ends))


def slow_whitening(rows):
    """n, sums, covariance (exact, then divided), x by id."""
    xs = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)])
    return n, sums, cov, xs, fit


# Languages ----------------------------------------------------------------------------------------


def test_bundles_equal_the_slow_ones():
    texts = [t for t in odd_texts() if t is None or len(t) < 5000] + ["İstanbul ǅ ét \ud800 x", "a", "a b"]
    doc, gram, count = language.grams_of(texts)
    got = language.bundles(doc, gram, count, len(texts))
    for text, vector in zip(texts, got):
        assert (vector == slow_bundle(text)).all(), text
    alone = [language.bundles(*language.grams_of([t]), 1)[0] for t in texts]
    assert (np.array(alone) == got).all()


def test_large_alphabets_count_alike():
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(3000))
    _, gram, count = language.grams_of([text])
    want = {}
    padded = "\0" + text + "\0"
    for i in range(len(text)):
        key = tuple(padded[i : i + 3])
        want[key] = want.get(key, 0) + 1
    got = {tuple(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)): c for g, c in zip(gram.tolist(), count.tolist())}
    assert got == want


def test_languages_of_odd_rows(llm_spark, odd):
    rows = [("en", "the cat and the dog"), ("en", "this and that"), ("de", "der hund und die katze"), (None, "el perro"),
            ("es", None), ("fr", "123"), ("de", "")]
    model = language.fit(llm_spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert model.names == ["de", "en"]
    want = np.zeros((2, language.DIMENSIONS))
    for name, text in rows:
        if name in ("en", "de") and text:
            doc, gram, count = language.grams_of([text])
            share = np.rint(count * (language.WEIGHT / count.sum()))
            want[model.names.index(name)] += share @ language.gram_vectors(gram).astype(float)
    assert np.allclose(model.prototypes, want / np.linalg.norm(want, axis=1, keepdims=True))
    done = language.identify(odd, model, into="label")
    assert sorted(done.columns) == sorted(odd.columns)
    for r in done.collect():
        vector = slow_bundle(r.text) if r.text is None or len(r.text) < 5000 else None
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.label.language, r.label.score) == ("und", 0)
        elif vector is not None:
            scores = [cosine(vector, p) for p in model.prototypes]
            assert r.label.language == model.names[int(np.argmax(scores))]
            assert abs(r.label.score - max(0, max(scores))) < 1e-9
    assert language.identify(odd.limit(0), model).count() == 0
    none = language.fit(llm_spark.createDataFrame(rows[3:], "lang string, text string"))
    assert none.names == [] and {r.language.language for r in language.identify(odd, none).collect()} == {"und"}


def test_language_query(llm_spark):
    got = {r.doc_id: r for r in queries.op11_language_id(llm_spark, SF).collect()}
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in held}
    right = [got[r.doc_id].lang_pred == r.lang for r in held if any(c.isalpha() for c in r.text or "")]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in got.values())
    model = language.fit(llm_spark.createDataFrame([r for r in docs if r not in held]))
    for r in docs[:25]:
        scores = [cosine(slow_bundle(r.text), p) for p in model.prototypes]
        assert got[r.doc_id].lang_pred == model.names[int(np.argmax(scores))]
        assert abs(got[r.doc_id].score - max(0, *scores)) < 1e-9


# Clusters -----------------------------------------------------------------------------------------


def plain(rows):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)


def vectors(n, d, seed, spread=3):
    """Coarse values, so that distances tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-spread, spread + 1) / 1024 for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("wide", [1, 1 << 40])
def test_nearest_with_ties(wide):
    rng = np.random.default_rng(4)
    for k, d in ((1, 1), (2, 3), (8, 5), (13, 4)):
        points = (rng.integers(-2, 3, (k, d)).astype(object) * wide).tolist()
        x = rng.integers(-3, 4, (200, d)) * wide
        label, best = centroids.Centroids(points).nearest(x)
        for v, c, far in zip(x.tolist(), label, best):
            assert (int(far), int(c)) == min((sum((a - b) ** 2 for a, b in zip(v, p)), i) for i, p in enumerate(points))


def test_the_walk_stops_early():
    """Far centroids are not measured once the frontier is farther than the nearest."""
    measured = []

    class Watched(centroids.Centroids):
        @staticmethod
        def _measured(x, values, row, centre, label, best):
            measured.append(len(row))
            centroids.Centroids._measured(x, values, row, centre, label, best)

    points = [[1000 * c] * 3 for c in range(50)]
    label, _ = Watched(points).nearest(np.array([[2001, 1999, 2003]]))
    assert label.tolist() == [2] and sum(measured) <= 3


def test_clusters_against_full_distances(llm_spark):
    rows = vectors(150, 4, 1) + [(7, [0.0] * 4), (7, [1 / 1024] * 4), (None, [0.001] * 4), (None, [0.002] * 4)]
    rows += [(900, None), (901, [0.0] * 3), (902, [0.0, None, 0.0, 0.0]), (903, [0.0, float("nan"), 0.0, 0.0]),
             (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = llm_spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, v array<double>, cluster int").repartition(5)
    got = centroids.clusters(df, "vec_id", "v", dimensions=4).collect()
    assert plain(got) == slow_clusters(rows, 4)
    assert centroids.clusters(df.limit(0), "vec_id", "v").count() == 0
    few = [(i, [float(i)] * 4) for i in range(3)]
    got = centroids.clusters(llm_spark.createDataFrame(few, "vec_id long, v array<double>"), "vec_id", "v", dimensions=4)
    assert plain(got.collect()) == slow_clusters(few, 4)


def test_clusters_of_huge_values(llm_spark):
    rows = [(i, [v, -v]) for i, v in enumerate([3e38, 2.9e38, 1e300, 1.7e308, 1.0, 2.0, -1e18, 5e-324])]
    df = llm_spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = centroids.clusters(df, "vec_id", "v", dimensions=2, k=3).collect()
    assert len(got) == len(rows) and {r.cluster for r in got} <= {0, 1, 2}
    assert centroids.scaled(np.array([[1e300]]), 1024).tolist() == [[int(1e300) * 1024]]
    assert all(r.inertia is None for r in got if r.distance is None)


def test_clustering_query(llm_spark):
    rows = [(r.vec_id, r.embedding) for r in llm_spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_centroid_clustering(llm_spark, SF).collect()
    assert plain(got) == slow_clusters(rows)


def test_limbs_are_exact(llm_spark):
    rng = random.Random(8)
    values = [rng.randrange(-(1 << b), 1 << b) for b in (1, 31, 32, 33, 63, 64, 200) for _ in range(5)] + [0, -(1 << 32), 1 << 32]
    parts = llm_spark.range(0, 4, 1, 4).mapInArrow(
        lambda batches: (exact.limbs([(i, 0) for i in range(len(values))], values) for _ in batches), exact.LIMBS
    )
    assert exact.summed(parts) == {(i, 0): 4 * v for i, v in enumerate(values)}


# Whitening ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [0, 1, 700, 1 << 40, 1 << 60])
def test_products_bit_by_bit(spread):
    rng = random.Random(spread)
    for n in (1, 63, 64, 65, 300):
        x = np.array([[rng.randrange(-spread, spread + 1), 5, rng.randrange(0, spread + 2)] for _ in range(n)], np.int64)
        found, sums = whitening.products(x)
        rows = x.tolist()
        assert sums.tolist() == [sum(r[i] for r in rows) for i in range(3)]
        assert found.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]


def check_whitening(got, rows, components):
    n, sums, cov, xs, fit = slow_whitening(rows)
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9
    assert sorted(by) == list(range(1, components + 1))
    deviation = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in xs)
    for c, own in by.items():
        assert sorted((str(r.vec_id), r.deviation) for r in own) == deviation
        axis = vectors_[:, c - 1] / math.sqrt(values[c - 1])
        want = sorted((str(i), float((np.array(x) - np.array(sums) / n) @ axis)) for i, x in xs)
        have = sorted((str(r.vec_id), r.whitened) for r in own)
        sign = 1 if sum(a[1] * b[1] for a, b in zip(want, have)) > 0 else -1
        assert max(abs(a[1] - sign * b[1]) for a, b in zip(want, have)) < 1e-6


def test_whitening_of_odd_rows(llm_spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, j + 1) for j in range(5)]) for i in range(80)]
    good += [good[3], (None, good[4][1]), (1000, good[5][1])]
    odd_rows = [(900, None), (901, [0.0] * 4), (902, [None] + [0.0] * 4), (903, [float("nan")] * 5), (904, []),
                (905, [float("-inf")] * 5), (906, [1e30] * 5)]
    df = llm_spark.createDataFrame([(*r, "a") for r in good + odd_rows], "vec_id long, v array<double>, component string")
    check_whitening(whitening.whitened(df.repartition(4), "vec_id", "v").collect(), good, 5)
    assert whitening.whitened(df.limit(0), "vec_id", "v").count() == 0
    one = whitening.whitened(df.filter("vec_id = 1"), "vec_id", "v").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(c, 1, 0, None, None) for c in range(1, 6)]
    flat = llm_spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id long, v array<float>")
    ranks = whitening.whitened(flat, "vec_id", "v").collect()
    assert all((r.whitened is None) == (r.component == 2) for r in ranks) and len(ranks) == 18


def test_whitening_query(llm_spark):
    rows = [(r.vec_id, r.embedding) for r in llm_spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op13_embedding_whitening(llm_spark, SF).collect(), rows, 16)
