"""Composed slices against walks over whole sessions."""

import random

import pytest

from chronoweave.operators import chains, windows


def walked(frames, threshold, fallback, most):
    out, last = [], None
    for f, scene in sorted(frames):
        if last is None or scene > threshold or f - last >= fallback:
            out.append(f)
            last = f
    return out[:most]


@pytest.mark.parametrize(("fallback", "size"), [(1, 7), (5, 8), (12, 16), (40, 8), (1000, 16)])
def test_choices_do_not_depend_on_slices(spark, fallback, size):
    rng = random.Random(fallback)
    sessions = {"a": [(f, rng.random()) for f in range(300) if rng.random() < 0.6], "b": [(f * 9, 0.1) for f in range(60)], "c": [(5, 0.99)], "d": [(f, rng.choice([0.1, 0.95])) for f in range(-40, 80)]}
    df = spark.createDataFrame([(s, f, x) for s, rows in sessions.items() for f, x in rows], "session string, frame long, scene double")
    got = {}
    for r in chains.spaced_or_hot(df, 0.9, fallback, 50, size).orderBy("session", "nth").collect():
        got.setdefault(r["session"], []).append((r["frame"], r["nth"]))
    assert got == {s: [(f, i) for i, f in enumerate(walked(rows, 0.9, fallback, 50))] for s, rows in sessions.items()}


@pytest.mark.parametrize(("quiet", "cap"), [(3, 10), (1, 4), (5, 3), (4, None), (2, 1), (6, 200)])
def test_windows_are_those_of_the_fold(spark, quiet, cap):
    rng = random.Random(quiet)
    sessions = {s: sorted({f for f in range(260) if rng.random() < p}) for s, p in (("a", 0.9), ("b", 0.5), ("c", 0.2), ("d", 1.0))}
    rows = [(s, f, int(f in on)) for s, on in sessions.items() for f in range(min(on), 280)]
    df = spark.createDataFrame(rows, "session string, frame long, n long")
    got = sorted(tuple(r) for r in windows.capped_windows(df, quiet, cap).collect())
    want = sorted((s, *w) for s, on in sessions.items() for w in windows.fold_windows(((f, f in on) for f in range(min(on), 280)), quiet, cap))
    assert got == want


def test_stretches_do_not_depend_on_slices(spark):
    rng = random.Random(1)
    on = sorted({f for f in range(400) if rng.random() < 0.5})
    df = spark.createDataFrame([("a", 0, f) for f in on], "session string, part long, frame long")
    plain = None
    for size in (7, 16, 4096):
        got = sorted((r["first"], r["last"], r["closed"]) for r in chains.capped_stretches(df, 20, size).collect())
        plain = plain or got
        assert got == plain
    assert chains.capped_stretches(df.limit(0), 20).count() == 0


def test_short_parts_are_not_composed(spark, monkeypatch):
    """Only parts that reach over a slice's end are composed, however many others there are."""
    composed, real = [], chains._composed
    monkeypatch.setattr(chains, "_composed", lambda maps, by: composed.extend(tuple(r) for r in maps.select(*by, "__slice").collect()) or real(maps, by))
    rows = [("a", part, part * 40 + f) for part in range(50) for f in (0, 1, 2, 9)] + [("b", 0, f) for f in range(395, 410)]
    df = spark.createDataFrame(rows, "session string, part long, frame long")
    got = sorted((r["session"], r["part"], r["first"], r["last"], r["closed"]) for r in chains.capped_stretches(df, 5, 400).collect())
    short = [w for part in range(50) for w in (("a", part, part * 40, part * 40 + 9, True),)]
    assert got == short + [("b", 0, 395, 399, True), ("b", 0, 400, 404, True), ("b", 0, 405, 409, True)]
    assert sorted(composed) == [("b", 0, 0), ("b", 0, 1)]
