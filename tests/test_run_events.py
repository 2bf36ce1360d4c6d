"""The run's events: one pass over sightings, one shuffle of vectors, and no rows for frames without tracks."""

import os

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import identify
from chronoweave.operators import tracks as T
from chronoweave.plans import catalogue
from chronoweave.sources import adapters as A

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_frames_without_tracks_need_no_rows(spark):
    rows = [("a", 1, 7), ("a", 2, 7), ("a", 2, 8), ("a", 6, 7), ("a", 7, 9), ("b", 5, 1)]
    found = spark.createDataFrame(rows, "session string, frame long, track long")
    want = [
        ("a", 1, "count_change"), ("a", 1, "new_track:7"), ("a", 2, "count_change"), ("a", 2, "new_track:8"), ("a", 2, "track_left:8"), ("a", 3, "count_change"),
        ("a", 6, "count_change"), ("a", 6, "track_left:7"), ("a", 7, "new_track:9"), ("a", 7, "track_left:9"), ("b", 5, "count_change"), ("b", 5, "new_track:1"), ("b", 5, "track_left:1"),
    ]
    sparse = found.groupBy("session", "frame").agg(F.count(F.lit(1)).alias("n"))
    spans = found.groupBy(*T.KEY).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    for df in (T.frame_events(found), T.frame_events(found, sparse), T.frame_events(found, A.frames(found)), T.frame_events(found, spans=spans)):
        assert sorted(map(tuple, df.collect())) == want


def test_sightings_without_a_track_count_nothing_and_move_no_number(spark):
    found = spark.createDataFrame([("a", 1, 7), ("a", 2, None), ("a", 3, 7)], "session string, frame long, track long")
    got = [(r["frame"], r["event"]) for r in T.frame_events(found).collect() if r["event"]]
    assert sorted(got) == [(1, "count_change"), (1, "new_track:7"), (2, "count_change"), (3, "count_change"), (3, "track_left:7")]
    tracks = spark.createDataFrame([("a", None, None), ("a", 7, 1)], "session string, track long, first long")
    assert {r["track"]: r["nth"] for r in identify.ordered(tracks).collect()} == {7: 1, None: 2}


@tables
def test_tracks_are_told_in_one_pass(spark):
    found = A.sightings(spark, SF)
    passed = {(r["session"], r["track"]) for r in T.lifespans(found, catalogue.RUN).collect()}
    best = {(r["session"], r["track"]): r["best_frame"] for r in T.best_evidence(found, catalogue.RUN).collect()}
    seen = {}
    for r in found.collect():
        seen.setdefault((r["session"], r["track"]), {})[r["frame"]] = r
    got = T.overviews(found, catalogue.RUN).collect()
    assert len(got) == len(seen) == len(best) and {r["skipped"] for r in got} == {True, False}
    for r in got:
        key = r["session"], r["track"]
        at = seen[key][best[key]]
        assert (r["first"], r["last"], r["skipped"], r["best_frame"]) == (min(seen[key]), max(seen[key]), key not in passed, best[key])
        assert (r["k"], r["best_quality"], r["user"]) == (at["k"], at["quality"], at["user"])


@tables
def test_vectors_are_shuffled_once(spark, monkeypatch, capsys):
    written, wide = catalogue.written, []

    def kept(df, name, **options):
        wide.extend([name] if "vec" in df.columns else [])
        return written(df, name, **options)

    monkeypatch.setattr(catalogue, "written", kept)
    events = catalogue.q93_run_events(spark, SF)
    capsys.readouterr()
    events.explain()
    plan = capsys.readouterr().out
    assert not wide and plan.count("FlatMapGroupsIn") == 1 and "sequence(" not in plan
