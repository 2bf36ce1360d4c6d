"""Exact search with cells that are skipped, against all products."""

import numpy as np
import pytest

from chronoweave.operators import gallery


def frame(spark, vecs, **cols):
    names = [*cols, "vec"]
    rows = list(zip(*(c.tolist() for c in cols.values()), [v if v is None else [float(x) for x in v] for v in vecs], strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names[:-1]) + ", vec array<double>")


def searched(spark, queries, shots, k, **how):
    ids = np.arange(len(shots))
    found, counts = gallery.nearest_counted(frame(spark, queries, query=np.arange(len(queries)) * 3), frame(spark, shots, row=ids, subject=ids % 4), k, **how)
    out = {}
    for r in found.orderBy("query", "nth").collect():
        out.setdefault(r["query"], []).append((r["row"], r["subject"], round(r["score"], 9)))
    return out, counts


def product(queries, shots, k):
    scores = queries @ shots.T
    return {int(3 * i): [(int(j), int(j % 4), round(float(row[j]), 9)) for j in np.argsort(-row, kind="stable")[:k]] for i, row in enumerate(scores)}


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_random_vectors(spark, block):
    rng = np.random.default_rng(block)
    queries, shots = rng.normal(size=(23, 6)), rng.normal(size=(300, 6)) * rng.uniform(0, 3, (300, 1))
    found, counts = searched(spark, queries, shots, 5, block=block, pivots=9)
    assert found == product(queries, shots, 5) and counts["compared"] <= counts["pairs"]


def test_far_cells_are_skipped(spark):
    rng = np.random.default_rng(3)
    middles = np.eye(8) * 10
    shots = middles[rng.integers(0, 8, 400)] + rng.normal(0, 0.1, (400, 8))
    queries = middles[rng.integers(0, 8, 30)] + rng.normal(0, 0.1, (30, 8))
    found, counts = searched(spark, queries, shots, 4, block=20, pivots=32)
    assert found == product(queries, shots, 4) and counts["compared"] < counts["pairs"] / 2


def test_ties_and_few_shots(spark):
    shots = np.ones((9, 3))
    queries = np.array([[1.0, 0, 0], [0, 0, 0], [-1, -1, -1]])
    assert searched(spark, queries, shots, 4, block=2, pivots=3)[0] == product(queries, shots, 4)
    assert searched(spark, queries, shots[:2], 5, block=4)[0] == product(queries, shots[:2], 5)


def test_nothing_to_find_or_to_ask(spark):
    one = np.ones((1, 2))
    assert searched(spark, one, [None], 3) == ({}, {"pairs": 0, "compared": 0})
    assert searched(spark, [None], one, 3)[0] == {}
