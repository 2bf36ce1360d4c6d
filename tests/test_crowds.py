"""Crowded frames and many draws: what is kept does not grow with all pairs."""

import hashlib
import random

import pytest

from chronoweave.operators import evaluate, tracks

BOXES = "session string, frame long, {} long, x1 double, y1 double, x2 double, y2 double"


def boxes(n, seed):
    rng = random.Random(seed)
    at = lambda: (float(rng.randrange(30)), float(rng.randrange(30)))
    return [("s", i % 2, i, x, y, x + rng.choice([20, 30]), y + rng.choice([20, 45])) for i, (x, y) in enumerate(at() for _ in range(n))]


def written_rows(monkeypatch):
    rows, real = {}, tracks.written
    monkeypatch.setattr(tracks, "written", lambda df, name: rows.setdefault(name, real(df, name)))
    return rows


def test_crowded_frames_keep_no_unclear_boxes(spark, monkeypatch):
    """Every small box lies in two equal large ones but one, which alone is looked at again."""
    rows = written_rows(monkeypatch)
    persons = [("s", 0, t, 0.0, 0.0, 60.0, 100.0) for t in range(40)] + [("s", 0, 99, 200.0, 0.0, 260.0, 100.0)]
    faces = [("s", 0, f, 20.0, 10.0, 40.0, 30.0) for f in range(30)] + [("s", 0, 77, 220.0, 10.0, 240.0, 30.0)]
    found = tracks.associate(spark.createDataFrame(faces, BOXES.format("face")), spark.createDataFrame(persons, BOXES.format("track")))
    assert [tuple(r) for r in found.collect()] == [("s", 0, 77, 99, 1.0)]
    assert rows["clear-boxes"].count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_best_matches_take_the_smaller_of_equals(spark, seed):
    left, right = boxes(30, seed), boxes(60, seed + 10)

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inner = max(0.0, w) * max(0.0, h)
        area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
        return inner / (area(a) + area(b) - inner)

    want = {}
    for a in left:
        best = max(((iou(a, b), -b[2]) for b in right if b[1] == a[1]), default=(0.0, 0))
        if best[0] > 0.3:
            want[a[2]] = (-best[1], round(best[0], 9))
    df = tracks.best_matches(spark.createDataFrame(left, BOXES.format("track")), spark.createDataFrame(right, BOXES.format("track")))
    assert "SortAggregate" not in df._jdf.queryExecution().toString()
    assert {r["track"]: (r["other"], round(r["iou"], 9)) for r in df.collect()} == want


def test_draws_are_dealt_and_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "DRAWN", 50)
    values = {100 + i: float(i * i % 17) for i in range(40)}
    df = spark.createDataFrame(list(values.items()), "pid long, value double")
    order = [values[k] for k in sorted(values)]
    drawn = lambda d: [order[int(hashlib.md5(f"x|{d}|{i}".encode()).hexdigest()[:12], 16) % 40] for i in range(40)]
    found = evaluate.drawn_means(df, 6, "x")
    assert {r["draw"]: round(r["mean"], 9) for r in found.collect()} == {d: round(sum(drawn(d)) / 40, 9) for d in range(6)}
