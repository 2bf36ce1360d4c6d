"""Keyed state: the same rows however a stream is dealt over batches, and sessions that expire."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import gallery
from chronoweave.operators.windows import fold_windows
from chronoweave.params import Params
from chronoweave.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FRAMES = "session string, frame long, ts timestamp"
SEEN = "session string, seq long, ts timestamp, vec array<double>, ok boolean"


class Feed:
    """A folder that a stream reads, filled one file after another."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        self.put([])

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def frame_rows(frames):
    return [(s, f, START + timedelta(seconds=f)) for s, f in frames]


def windows_told(spark, tmp_path, batches, late="60 seconds", idle_ms=1_000_000, quiet=4, cap=9):
    feed, folder = Feed(spark, tmp_path / "in", FRAMES), str(tmp_path / "run")
    stream = stateful.capped_windows(feed.stream(), quiet, cap, int(START.timestamp() * 1000), 1000, late, idle_ms)
    out = None
    for rows in batches:
        feed.put(frame_rows(rows))
        out = stateful.drained(stream, "test", folder)
    return sorted(tuple(r) for r in out.collect())


def batch_windows(frames, quiet=4, cap=9):
    out = []
    for session in {s for s, _ in frames}:
        on = {f for s, f in frames if s == session}
        out += [(session, *w) for w in fold_windows(((f, f in on) for f in range(min(on), max(on) + 1)), quiet, cap)]
    return sorted(out)


END = [("end", 10_000_000)]


@pytest.mark.parametrize("parts", [1, 3])
def test_windows_do_not_depend_on_batches(spark, tmp_path, parts):
    rng = random.Random(2)
    frames = [(s, f) for s in ("a", "b", "c") for f in range(240) if rng.random() < 0.45]
    # frames come out of order by up to the watermark's delay
    dealt = sorted(frames, key=lambda x: x[1] + rng.randint(0, 40))
    batches = [dealt[i * len(dealt) // parts : (i + 1) * len(dealt) // parts] for i in range(parts)]
    told = windows_told(spark, tmp_path, [*batches, END])
    assert [w for w in told if w[0] != "end"] == batch_windows(frames)


def test_late_frames_are_left_out(spark, tmp_path):
    told = windows_told(spark, tmp_path, [[("a", 1), ("a", 2)], [("a", 500)], [("a", 3)], END])
    assert [w for w in told if w[0] == "a"] == [("a", 1, 5, 5), ("a", 500, 500, 1)]


def test_a_session_that_is_over_starts_afresh(spark, tmp_path):
    told = windows_told(spark, tmp_path, [[("a", 1), ("a", 2)], [("x", 5000)], [("a", 6000)], END], idle_ms=1_000_000)
    assert [w for w in told if w[0] == "a"] == [("a", 1, 2, 2), ("a", 6000, 6000, 1)]


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    base = np.eye(6)
    return [(base[rng.integers(0, 5)] + rng.normal(0, 0.12, 6)).tolist() for _ in range(n)]


def seen_rows(n, session="a", first=0, minutes=0):
    return [(session, first + i, START + timedelta(minutes=minutes, seconds=first + i), v, (first + i) % 4 != 0) for i, v in enumerate(vectors(n, first))]


P = Params().with_(negative_size=5, max_shots=3)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def galleries(spark, tmp_path, batches, idle_ms=3_600_000):
    feed, folder = Feed(spark, tmp_path / "in", SEEN), str(tmp_path / "run")
    stream = stateful.enrolments(feed.stream(), P, idle_ms, "10 seconds")
    for rows in batches:
        feed.put(rows)
        out = stateful.drained(stream, "test", folder)
    return told(out)


def test_two_batches_equal_one(spark, tmp_path):
    rows = seen_rows(60) + seen_rows(30, "b")
    once = galleries(spark, tmp_path / "one", [rows])
    halves = [[r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20]]
    assert galleries(spark, tmp_path / "two", halves) == once
    batch = gallery.enrolments(spark.createDataFrame(rows, SEEN), P)
    assert told(batch.select(*(F.col(c.split()[0]) for c in gallery.ENROLLED.split(", ")))) == once


def test_an_expired_gallery_starts_afresh(spark, tmp_path):
    early, late = seen_rows(20), [("a", 100 + r[1], r[2] + timedelta(hours=3), r[3], r[4]) for r in seen_rows(20)]
    alone = [(r[0], r[1] - 100, *r[2:]) for r in galleries(spark, tmp_path / "alone", [late])]
    # a timer lets the state go before the rows come, or the rows themselves tell that it is over
    with_timer = galleries(spark, tmp_path / "timer", [early, [("other", 1, START + timedelta(hours=2), [1.0] * 6, True)], late])
    at_once = galleries(spark, tmp_path / "gap", [early + late])
    for got in (with_timer, at_once):
        assert [(r[0], r[1] - 100, *r[2:]) for r in got if r[0] == "a" and r[1] >= 100] == alone
        assert len(got) >= 40


def test_late_rows_are_left_out_and_settings_come_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    rows = seen_rows(10)
    assert galleries(spark, tmp_path, [rows, rows[3:5]]) == galleries(spark, tmp_path / "once", [rows])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
