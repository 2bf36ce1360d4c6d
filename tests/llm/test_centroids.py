"""Centroid clusters against exact arithmetic on plain integers."""

import hashlib
import math
import random

import numpy as np

from chronoweave.llm import centroids

NAN, INF = float("nan"), float("inf")


def plain(rows, k=16, rounds=3):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(middle)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                middle[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i if i is not None else -1, j, d) for i, (d, j) in ((i, near(v)) for i, v in kept)), middle


def clustered(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, middle, counts = centroids.cluster(df, **how)
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in found.collect()), middle.tolist(), counts


def test_bounds_are_never_above_the_distance():
    rng = np.random.default_rng(1)
    for scale in (1, 30, 10_000, centroids.MOST):
        x = rng.integers(-scale, scale + 1, (200, 64))
        c = np.concatenate([x[:5], rng.integers(-scale, scale + 1, (11, 64))])
        cluster, best, _ = centroids.nearest(x, centroids.segment_norms(x), c)
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (best == d.min(axis=1)).all() and (cluster == d.argmin(axis=1)).all()


def test_distant_centroids_are_not_computed():
    rng = np.random.default_rng(2)
    c = rng.integers(-5, 6, (16, 64)) * np.array([1 + 40 * j for j in range(16)])[:, None]
    x = c[rng.integers(0, 16, 500)] + rng.integers(-2, 3, (500, 64))
    cluster, _, exact = centroids.nearest(x, centroids.segment_norms(x), c)
    assert exact < 500 * 16 / 2 and (cluster == ((x[:, None, :] - c) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_random_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5 - 2, 0.4) for _ in range(64)]) for i in range(150)]
    found, middle, counts = clustered(spark, rows)
    assert (found, middle) == plain(rows) and counts["exact"] <= counts["bounds"]


def test_odd_vectors(spark):
    rows = [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [NAN] + [0.0] * 63), (5, [INF] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, [0.5] * 64), (7, [0.5] * 64), (7, [0.25] * 64), (None, [-0.01] * 64), (8, [1e300, -1e300] * 32), (9, []), (10, [0.0] * 64)]
    found, middle, _ = clustered(spark, rows)
    assert (found, middle) == plain(rows) and len(middle) == 6 and len(found) == 6


def test_ties_take_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    found, middle, _ = clustered(spark, rows)
    assert (found, middle) == plain(rows) and len(middle) == 16 and len({j for _, j, _ in found}) == 2


def test_few_and_no_vectors(spark):
    assert clustered(spark, [(1, None)]) == ([], [], {"vectors": 0, "bounds": 0, "exact": 0})
    assert clustered(spark, []) == ([], [], {"vectors": 0, "bounds": 0, "exact": 0})
    assert clustered(spark, [(3, [0.5] * 64)])[0] == [(3, 0, 0)]
