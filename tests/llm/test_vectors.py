"""Whitening and clustering against plain integer models, on ordinary and on awkward vectors."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tessera.llm import clustering, whitening
from tessera.llm.vector_blocks import fits_long

#: ``id``, ``v``, ``values`` and ``cluster`` are names that the operators use themselves.
SCHEMA = "vec_id bigint, embedding array<float>, id string, v int, values binary, cluster string, n bigint"
DIM = 4


def make(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, b"x", "x", 9) for i, v in rows], SCHEMA)


def ordinary(n=600, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=DIM).astype(np.float32)]) for i in range(n)]


#: Vectors to drop, copies of one vector, shared and missing ids, zero and negative entries.
AWKWARD = [
    (1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan"), 0.0, 0.0, 0.0]), (1003, [float("inf"), 0.0, 0.0, 0.0]), (1004, []), (1005, [1.0, 2.0]),
    (1006, [0.5, -0.5, 0.25, -0.0]), (1006, [0.5, -0.5, 0.25, -0.0]), (1006, [0.25, 0.0, 0.0, 1.0]), (None, [0.5, 0.5, 0.5, 0.5]), (None, [-3.0, 0.001, 2.0, 1.0]),
    *((2000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(300)),
]
LARGE = [(3000, [3e7, -2.0, 1.0, 0.0]), (3001, [3e7, -2.0, 1.5, 0.0]), (3002, [-1e30, 1e20, 0.0, 5.0]), (3003, [3e38, 3e38, -3e38, 0.0])]


def plain_kept(rows):
    return [(i, v) for i, v in rows if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)]


def whole(x, scale):
    """floor(scale * x) of a 32-bit float as an integer."""
    n, d = float(np.float32(x)).as_integer_ratio()
    return n * scale // d


def plain_clusters(rows, k, rounds, scale, salt):
    found = [(i, [whole(x, scale) for x in v], v) for i, v in plain_kept(rows)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    centroids = [v for _, v, _ in sorted(found, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v, _ in found:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else c for i, c in enumerate(centroids)]
    at = [(i, *near(v)) for i, v, _ in found]
    inertia = Counter()
    for _, d, c in at:
        inertia[c] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, fits_long(d), fits_long(inertia[c]), fits_long(sum(inertia.values())), digests[c]) for i, d, c in at)


@pytest.mark.parametrize("rows", [ordinary() + AWKWARD, ordinary(50) + AWKWARD + LARGE, LARGE, AWKWARD[:7]])
def test_clusters(spark, rows):
    got = clustering.cluster(make(spark, rows).repartition(5), k=6, rounds=3, scale=256, dim=DIM, salt="2")
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, 6, 3, 256, "2")


def test_ties_go_to_the_smaller_number():
    centroids = clustering.Centroids([[2, 0], [0, 0], [2, 0], [10**12, 0]], 2)
    label, distance, _ = centroids.nearest(np.array([[1.0, 0.0], [2.0, 5.0], [1e12 + 3, 0.0]]))
    assert label.tolist() == [0, 0, 3] and distance.tolist() == [1, 25, 9]


def test_products_are_exact_up_to_the_bound():
    rng = np.random.default_rng(1)
    top = clustering.tame_bound(64) - 1
    x, c = (rng.choice([-top, top - 1, top, 0, 1], (30, 64)) for _ in range(2))
    centroids = clustering.Centroids([[int(v) for v in r] for r in c], 64)
    label, distance, tame = centroids.nearest(x.astype(np.float64))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)), i) for i, s in enumerate(c)) for r in x]
    assert tame.all() and list(zip(distance.tolist(), label.tolist(), strict=True)) == want


def test_no_vectors(spark):
    for rows in ([], AWKWARD[:5]):
        empty = make(spark, rows)
        assert clustering.cluster(empty, k=6, rounds=3, scale=256, dim=DIM, salt="2").count() == 0
        assert whitening.whiten(empty, scale=1024, offset=100_000, components=8).count() == 0


def plain_scatter(rows, scale, offset):
    x = [[whole(c, scale) + offset for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    cross = [[sum(r[i] * r[j] for r in x) for j in range(DIM)] for i in range(DIM)]
    covariance = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / n**2 for j in range(DIM)] for i in range(DIM)])
    return x, n, sums, covariance


@pytest.mark.parametrize("rows", [ordinary() + AWKWARD, ordinary(100) + LARGE[:2], ordinary(40, 8) + LARGE])
def test_whitening(spark, rows):
    got = whitening.whiten(make(spark, rows).repartition(5), scale=1024, offset=100_000, components=3).toPandas()
    kept = plain_kept(rows)
    x, n, sums, covariance = plain_scatter(kept, 1024, 100_000)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    shown = [c for c in range(3) if values[c] > values[0] * DIM * np.finfo(float).eps]
    assert sorted(got["component"].unique()) == [c + 1 for c in shown] and set(got["n"]) == {n}
    off = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    for c in shown:
        part = got[got["component"] == c + 1]
        assert np.allclose(part["explained"], values[c] / np.trace(covariance), rtol=1e-9)
        mine, plain = np.sort(np.abs(part["whitened"])), np.sort(np.abs(off @ vectors[:, c] / math.sqrt(values[c])))
        assert np.allclose(mine, plain, atol=1e-6)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-4


def test_deviation_is_exact_and_the_shift_is_free(spark):
    rows = plain_kept(given := ordinary(300) + AWKWARD + LARGE[:2])
    x, n, sums, _ = plain_scatter(rows, 1024, 100_000)
    want = Counter((i, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for (i, _), r in zip(rows, x, strict=True))
    for shift in (None, 0, 77):
        got = whitening.whiten(make(spark, given).repartition(3), scale=1024, offset=100_000, components=1, shift=shift)
        assert Counter((r["vec_id"], r["deviation"] if r["deviation"] is not None else int(r["deviation_digits"])) for r in got.collect()) == want


def test_vectors_that_do_not_vary(spark):
    assert whitening.whiten(make(spark, [(1, [1.0, 2.0, 3.0, 4.0])] * 5), scale=1024, offset=100_000, components=8).count() == 0
    line = whitening.whiten(make(spark, [(i, [float(i), 2.0, 3.0, 4.0]) for i in range(5)]), scale=1024, offset=100_000, components=8)
    assert line.count() == 5 and line.where("component = 1 AND explained = 1").count() == 5
