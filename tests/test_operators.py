"""Worked examples of the operators' rules, and folds against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import geometry as G
from chronoweave.functions import quality as Q
from chronoweave.functions import vectors as V
from chronoweave.functions.providers import Registry
from chronoweave.operators import evaluate, gallery, keyframes, resolve, tracks, windows
from chronoweave.params import Params


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_windows_of_the_worked_example(spark):
    active = [1, 1, 0, 1, 1, 0, 0, 1, 1, 1]
    frames = spark.createDataFrame([("s", i, a) for i, a in enumerate(active)], "session string, frame long, n long")
    assert rows(windows.capped_windows(frames, 2, 4), "first") == [("s", 0, 3, 4), ("s", 4, 5, 2), ("s", 7, 9, 3)]
    assert windows.fold_windows(list(enumerate(map(bool, active))), 2, 4) == [(0, 3, 4), (4, 5, 2), (7, 9, 3)]


def test_windows_split_at_gaps_equal_one_fold(spark):
    rng = random.Random(7)
    data, want = [], []
    for s in range(40):
        on = [rng.random() < 0.3 for _ in range(60)]
        quiet, cap = 3, 7
        data += [(f"s{s}", i, int(a)) for i, a in enumerate(on)]
        want += [(f"s{s}", *w) for w in windows.fold_windows(enumerate(on), quiet, cap)]
    got = rows(windows.capped_windows(spark.createDataFrame(data, "session string, frame long, n long"), 3, 7), "session", "first")
    assert got == sorted(want)


def test_idle_sessions_get_one_window(spark):
    frames = spark.createDataFrame([("s", 0, 0), ("s", 1, 0)], "session string, frame long, n long")
    assert rows(windows.whole_if_idle(windows.capped_windows(frames, 2, 4), frames), "first") == [("s", 0, 1, 2)]


def test_conflicts_split_first_fit(spark):
    t = spark.createDataFrame([("s", 1, 1, 0, 5), ("s", 1, 2, 3, 7), ("s", 1, 3, 8, 10)], "session string, subject long, track long, first long, last long")
    assert rows(resolve.split_conflicts(t).select("track", "new_subject", "split"), "track") == [(1, 1, True), (2, 2, True), (3, 1, True)]


def test_stitching_example(spark):
    data = [("s", 1, 10, 0, 2, [1.0, 0.0], True), ("s", 2, None, 3, 5, [0.99, 0.01], True), ("s", 3, None, 6, 8, [-1.0, 0.0], False)]
    t = spark.createDataFrame(data, "session string, track long, subject long, first long, last long, vec array<double>, ok boolean")
    got = {r["track"]: (r["subject"], r["decision"]) for r in resolve.stitch(t, Params(stitch=0.8, stitch_local=0.9)).collect()}
    assert got == {2: (10, "stitched"), 3: (11, "local")}


def test_routes_merge_into_one_subject(spark):
    data = [("s", 1, 7, 100, None), ("s", 2, None, 100, None), ("s", 3, 7, None, 55), ("s", 4, None, None, 55), ("s", 5, None, None, None)]
    got = rows(resolve.merged_tracks(spark.createDataFrame(data, "session string, track long, body long, face long, gait long")).select("track", "subject", "merge_routes", "merge_agree", "cross_merged"), "track")
    assert got[:4] == [(1, 7, "body,face,gait", 3, False), (2, 7, "body,face,gait", 3, True), (3, 7, "body,face,gait", 3, False), (4, 7, "body,face,gait", 3, True)]
    assert got[4] == (5, None, "", 0, False)


def test_candidates_keep_spaced_best(spark):
    make = lambda seq: spark.createDataFrame([("s", 1, f, s) for f, s in seq], "session string, track long, frame long, quality double")
    p = Params(candidates=3, candidate_gap=2)
    kept = keyframes.spaced_candidates(make([(0, 5.0), (1, 10.0), (3, 8.0), (6, 7.0)]), ["session", "track"], "quality", p)
    assert sorted(r["frame"] for r in kept.collect()) == [1, 3, 6]
    best = spark.createDataFrame([("s", 1, 4)], "session string, track long, best_frame long")
    full = keyframes.with_fallback(kept, best, ["session", "track"], p).collect()
    assert len(full) == 3 and 4 in [r["frame"] for r in full]
    gone = keyframes.spaced_candidates(make([(10, 100.0), (11, 150.0), (12, 90.0)]), ["session", "track"], "quality", p)
    assert [r["frame"] for r in gone.collect()] == [11]


def shown(group, p):
    """The frames of a group worth showing, by the rule: events and their neighbours and each track's best frame always,
    of the others those unlike the one shown before; too many are thinned, events last."""
    order = [r["frame"] for r in group]
    events = {r["frame"] for r in group if r["has_event"]}
    always = {f for i, f in enumerate(order) if events & set(order[max(0, i - p.context) : i + p.context + 1])}
    for t in {t for r in group for t in r["tracks"]}:
        always.add(min((-r["tracks"][t], r["frame"]) for r in group if t in r["tracks"])[1])
    chosen, before = [], None
    for r in group:
        now = r["signature"]
        alike = before is not None and now is not None and 1 - sum(a * b for a, b in zip(before, now, strict=True)) / (math.hypot(*before) * math.hypot(*now)) < p.same_signature
        if r["frame"] in always or not alike:
            chosen.append(r["frame"])
            before = now

    def evenly(items, k):
        if k >= len(items):
            return items
        return [] if k <= 0 else items[len(items) // 2 : len(items) // 2 + 1] if k == 1 else [items[round(i * (len(items) - 1) / (k - 1))] for i in range(k)]

    if len(chosen) <= p.max_keyframes:
        return chosen
    first = [f for f in chosen if f in events]
    return evenly(first, p.max_keyframes) if len(first) >= p.max_keyframes else sorted(first + evenly([f for f in chosen if f not in events], p.max_keyframes - len(first)))


def test_keyframes_equal_the_plain_rule(spark):
    rng, frames, found, want = random.Random(3), [], [], []
    p = Params(max_keyframes=6)
    for w in range(30):
        group = []
        for f in range(rng.randrange(1, 18)):
            s = None if rng.random() < 0.2 else [1.0, rng.choice([0.0, 0.1, 0.9]), 0.0]
            group.append({"frame": f, "has_event": rng.random() < 0.25, "signature": s, "tracks": {t: rng.choice([1.0, 2.0, 3.0]) for t in range(3) if rng.random() < 0.3}})
        frames += [(w, r["frame"], r["has_event"], r["signature"]) for r in group]
        found += [(w, r["frame"], t, q) for r in group for t, q in r["tracks"].items()]
        want += [(w, f) for f in shown(group, p)]
    a = spark.createDataFrame(frames, "window long, frame long, has_event boolean, signature array<double>")
    b = spark.createDataFrame(found, "window long, frame long, track long, quality double")
    assert rows(keyframes.select_keyframes(a, b, ["window"], p), "window", "frame") == sorted(want)


def test_ambiguous_faces_are_left_out(spark):
    faces = spark.createDataFrame([("s", 0, 1, 20.0, 10.0, 40.0, 30.0)], "session string, frame long, face long, x1 double, y1 double, x2 double, y2 double")
    one = [("s", 0, 1, 0.0, 0.0, 60.0, 100.0)]
    schema = "session string, frame long, track long, x1 double, y1 double, x2 double, y2 double"
    assert rows(tracks.associate(faces, spark.createDataFrame(one, schema)), "face") == [("s", 0, 1, 1, 1.0)]
    assert tracks.associate(faces, spark.createDataFrame([*one, ("s", 0, 2, 0.0, 0.0, 60.0, 100.0)], schema)).count() == 0


def test_face_tree_at_the_boundaries(spark):
    at = lambda x, y: (F.lit(x), F.lit(y))
    points = [at(30.0, 35.0), at(70.0, 35.0), at(50.0, 48.0), at(36.0, 72.0), at(64.0, 72.0)]
    df = spark.createDataFrame([(80.0, 0.25), (19.0, 0.9), (20.0, 0.9), (27.0, 0.9), (28.0, 0.9)], "size double, fiqa double")
    face = Q.Face(F.col("size"), F.col("size"), F.lit(0.98), points, F.lit(120.0), F.col("fiqa"))
    got = rows(df.select("size", face.category(), face.eligibility(), face.reason(), F.array_contains(face.defects(), "low_fiqa")), F.desc("size"))
    assert got[0] == (80.0, "marginal", "direct", None, True)
    assert [g[2] for g in got[1:]] == ["direct", "recoverable", "recoverable", "unusable"]


def test_region_gate_and_scores(spark):
    df = spark.createDataFrame([(None, None, None), (1.0, 100.0, 1.0), (2000.0, 1.0, 1.0), (2000.0, 50.0, 9.0), (2000.0, 50.0, 2.0)], "area double, blur double, aspect double")
    assert [r[0] for r in df.select(Q.region_reason(F.col("area"), F.col("blur"), F.col("aspect"))).collect()] == [None, "too_small", "too_blurry", "bad_aspect_ratio", None]
    one = spark.range(1)
    assert one.select(Q.body_quality(F.lit(50.0), F.lit(20000.0))).first()[0] == 50.0
    assert one.select(G.clock(F.lit(3661.5))).first()[0] == "01:01:02"
    assert one.select(V.stable_hue(F.lit(None).cast("string"))).first()[0] == 205
    colours = one.select(*(V.colour_class(*map(F.lit, c)) for c in ((255, 0, 0), (10, 10, 10), (250, 250, 250), (0, 0, 255), (90, 50, 20)))).first()
    assert list(colours) == ["red", "black", "white", "blue", "brown"]


def test_even_pick(spark):
    items = F.array(*map(F.lit, range(10)))
    got = spark.range(1).select(*(keyframes.even_pick(items, k) for k in (0, 1, 3, 4, 10, 12))).first()
    assert [list(g) for g in got] == [[], [5], [0, 4, 9], [0, 3, 6, 9], list(range(10)), list(range(10))]


def test_enrolment_in_order(spark):
    data = [("s", 0, [1.0, 0.0], True), ("s", 1, [0.99, 0.05], True), ("s", 2, [0.0, 1.0], False), ("s", 3, [0.0, 1.0], True), ("s", 4, [0.7, 0.72], True)]
    got = rows(gallery.enrolments(spark.createDataFrame(data, "session string, seq long, vec array<double>, ok boolean")).select("seq", "decision", "subject", "enrolled", "shots"), "seq")
    assert got[0] == (0, "new", 1, True, 1) and got[1] == (1, "hit", 1, False, 2)
    assert got[2][1:4] == ("new", None, False) and got[3] == (3, "new", 2, True, 1)
    assert got[4][1] in ("grey", "hit")


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    q = [(i, vec()) for i in range(30)]
    s = [(i, i % 3, vec()) for i in range(50)]
    got = rows(gallery.nearest(spark.createDataFrame(q, "query long, vec array<double>"), spark.createDataFrame(s, "row long, subject long, vec array<double>"), 4, block=7).select("query", "nth", "row"), "query", "nth")
    want = []
    for i, v in q:
        ranked = sorted(s, key=lambda t: (-sum(a * b for a, b in zip(v, t[2], strict=True)), t[0]))[:4]
        want += [(i, n + 1, t[0]) for n, t in enumerate(ranked)]
    assert got == want


def test_paired_transitions(spark):
    schema = "sample_id string, pred string, right boolean, genuine boolean, confidence double"
    before = spark.createDataFrame([("a", "x", False, True, 0.6), ("b", "y", True, True, 0.6), ("c", None, False, False, 0.2)], schema)
    after = spark.createDataFrame([("a", "z", True, True, 0.6), ("b", "w", False, True, 0.6), ("c", "q", False, False, 0.7)], schema)
    r = evaluate.transitions(before, after).first()
    assert (r["changed"], r["improved"], r["degraded"], r["false_accept_up"], r["false_accept_down"]) == (3, 1, 1, 1, 0)


def test_resampling_is_repeatable(spark):
    c = spark.createDataFrame([(str(i), float(i % 5)) for i in range(40)], "pid string, value double")
    a, b = (rows(evaluate.resampled(c, 20, 5), "draw") for _ in range(2))
    assert a == b and abs(sum(m for _, m in a) / 20 - 2.0) < 0.3
    assert 0 < evaluate.sign_flip(c, 50, 1).first()[0] < 0.1


def test_registry_isolates_failures(spark):
    r = Registry()
    r.register("Up_Case", lambda: lambda s: s.str.upper(), aliases=("u",))
    r.register("broken", lambda: 1 / 0)
    with pytest.raises(ValueError):
        r.register("off", lambda: None)
    with pytest.raises(ValueError):
        r.register("up-case", lambda: None)
    assert r.names() == ["broken", "up-case"] and r.get("broken") is None and "broken" in r.errors
    assert r.get("u")(pd.Series(["a"])).tolist() == ["A"]
    df = spark.createDataFrame([("a",)], "t string")
    assert df.select(r.apply("off", F.col("t"), "string")).first()[0] == "a"


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        Params(candidates=0)
    with pytest.raises(TypeError):
        Params().with_(nothing=1)
    assert Params().with_(hit=None).hit == 0.6 and Params().quiet_frames() == 4 and Params(window_seconds=0).window_frames() is None


def test_grades_of_evidence(spark):
    """A face that may be used as it is comes before one that has to be restored, whatever its detection says."""
    from chronoweave.operators import attach

    options = [("s", 1, 0, 5, "recoverable", "poor", 0.2, 0.9, 0.99), ("s", 1, 3, 6, "direct", "clear", 0.8, 0.9, 0.8), ("s", 2, 4, 7, None, None, None, None, None), ("s", 2, 2, 8, "odd", None, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(options, "session string, track long, frame long, face long, eligibility string, category string, quality double, association double, det double")
    assert rows(attach.best_faces(df).select("track", "face"), "track") == [(1, 6), (2, 7)]


def test_attached_faces(spark):
    """Skipped, not seen, same frame, similar and unlike bodies; a face counts for the person that it lies in."""
    from chronoweave.operators import attach

    box = lambda t, f: ("s", f, t, 100.0 * t, 0.0, 100.0 * t + 60, 100.0)
    face = lambda t, f, e="direct", c="clear": ("s", f, 10 + t, 100.0 * t + 20, 10.0, 100.0 * t + 40, 30.0, 0.9, 0.8, c, e, True)
    persons = spark.createDataFrame([box(t, f) for t in range(1, 7) for f in (0, 1)], "session string, frame long, track long, x1 double, y1 double, x2 double, y2 double")
    faces = spark.createDataFrame([face(2, 0), face(3, 1), face(4, 1), face(5, 1, "recoverable", "poor"), face(6, 1)], "session string, frame long, face long, x1 double, y1 double, x2 double, y2 double, det double, quality double, category string, eligibility string, restored boolean")
    tracks_ = spark.createDataFrame([("s", t, 0, t == 1) for t in range(1, 7)] + [("s", 9, 0, False)], "session string, track long, best_frame long, skipped boolean")
    candidates = spark.createDataFrame([("s", t, f) for t in range(1, 7) for f in (0, 1)], "session string, track long, frame long")
    bodies = [("s", t, f, [1.0, 0.1 * f]) for t in (2, 3, 5) for f in (0, 1)] + [("s", 4, 0, [1.0, 0.0]), ("s", 4, 1, [0.0, 1.0]), ("s", 6, 1, [1.0, 0.0])]
    vectors = spark.createDataFrame(bodies, "session string, track long, frame long, vec array<double>")
    got = {r["track"]: (r["status"], r["face"], r["consistency"], r["match_source"], r["match_ready"], r["can_enroll"]) for r in attach.attach_faces(tracks_, candidates, faces, persons, vectors).collect()}
    assert got == {
        1: ("track_skipped", None, None, "none", False, False), 9: ("not_detected", None, None, "none", False, False), 2: ("observed", 12, "same_frame", "original", True, True),
        3: ("observed", 13, "passed", "original", True, True), 4: ("track_consistency_failed", 14, "failed", "none", False, False), 5: ("observed", 15, "passed", "superres", True, False),
        6: ("track_consistency_failed", 16, "body_embedding_unavailable", "none", False, False),
    }


def test_texts_of_reports(spark):
    from chronoweave.operators import context

    windows_ = spark.createDataFrame([(1, "00:00", "00:30", "alert", "somebody came"), (2, "00:30", "01:00", None, "")], "window long, begins string, ends string, level string, summary string")
    reports = spark.createDataFrame([(1, 2, "00:20", "B", True, "took it"), (1, 1, "00:10", "A", False, "waited")], "window long, nth long, time string, subject string, abnormal boolean, action string")
    assert rows(context.timeline(windows_, reports), "window") == [(1, "[窗1 00:00~00:30] 告警=alert\n  概述：somebody came\n  - 00:10 A：waited\n  - 00:20 B：⚠took it", 2), (2, "[窗2 00:30~01:00] 告警=normal", 0)]
    assert context.NAMES["car"] == "汽车" and context.NAMES["suitcase"] == "行李箱/箱子"


def test_colours_and_class_lists(spark):
    df = spark.createDataFrame([("red", "红"), ("red", " RED "), ("blue", "红"), (None, "red"), ("gray", None)], "found string, wanted string")
    assert [r[0] for r in df.select(V.colour_matches(F.col("found"), F.col("wanted"))).collect()] == [True, True, False, False, False]
    lists = spark.createDataFrame([(" car, bus,,car ",), (None,)], "t string")
    assert [r[0] for r in lists.select(V.class_set(F.col("t"))).collect()] == [["car", "bus"], []]


def test_slices_carry_what_came_before(spark):
    from chronoweave.operators import slices

    rng = random.Random(8)
    data = [(s, f, rng.randrange(5)) for s in "ab" for f in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(data, "session string, frame long, v long")
    want, last, total = [], {}, {}
    for s, f, v in data:
        total[s] = total.get(s, 0) + v
        want.append((s, f, last.get(s), total[s]))
        last[s] = v
    for frames in (1, 7, 4096):
        got = slices.with_running_sum(slices.with_before(df, ["v"], frames=frames), F.col("v"), "total", frames=frames)
        assert rows(got.select("session", "frame", "before.v", "total"), "session", "frame") == want


def test_providers_fall_back_and_tell(spark):
    r = Registry()

    def broken():
        raise OSError("no model")

    def picky(values):
        if (values > 2).any():
            raise ValueError("too large")
        return values * 10

    r.register("first", broken)
    r.register("second", lambda: picky)
    df = spark.createDataFrame([(1,), (2,)], "n long").coalesce(1)
    told = lambda names, d: {(x["n"], x["t"]["value"], x["t"]["error"]) for x in d.select("n", r.told(names, F.col("n"), "long").alias("t")).collect()}
    assert told(["second"], df) == {(1, 10, None), (2, 20, None)}
    assert {(n, v) for n, v, e in told(["first", "second"], df) if "no model" in e} == {(1, 10), (2, 20)}
    many = spark.createDataFrame([(3,)], "n long")
    assert [(n, v, "too large" in e) for n, v, e in told(["second"], many)] == [(3, 3, True)]
    assert [x[0] for x in many.select(r.apply("second", F.col("n"), "long")).collect()] == [3]


def test_files_as_tables(spark, tmp_path):
    """Listings leave other files out, images come with their content, and documents are written one a row."""
    from chronoweave.sources import files

    for name, data in (("a.MP4", b"x" * 1048576), ("b.txt", b"no"), ("0007-F.jpg", b"jpeg"), ("c.mov", b"x")):
        (tmp_path / name).write_bytes(data)
    assert rows(files.listing(spark, str(tmp_path)), "name") == [("a.MP4", 1.0), ("c.mov", 0.0)]
    image = files.images(spark, str(tmp_path)).first()
    assert image["name"] == "0007-F.jpg" and image["uri"] == "data:image/jpeg;base64,anBlZw=="
    files.write_json(spark.createDataFrame([(1, "é"), (2, None)], "n long, t string"), str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out")), "n") == [(1, "é"), (2, None)]


def test_sessions_without_scenes_are_stepped_through(spark):
    frames = spark.createDataFrame([("s", f, 0.1) for f in range(0, 50, 5)], "session string, frame long, scene double")
    got = rows(keyframes.adaptive_frames(frames, 0.9, 20, 24), "frame")
    assert got == [("s", 0), ("s", 20), ("s", 40)]
    assert [r[1] for r in rows(keyframes.adaptive_frames(frames, 0.05, 20, 1), "frame")] == [25]


def test_evidence_is_told_without_pixels(spark):
    from chronoweave.operators import attach

    df = spark.createDataFrame([(1, b"p", [0.5], "x")], "track long, crop binary, embedding array<double>, status string")
    assert attach.public_evidence(df).columns == ["track", "status"]


def test_hundredths_are_those_of_the_double(spark):
    from chronoweave.operators.context import hundredths

    rows = [(k / 1000,) for k in range(1001)] + [(1.005,), (0.0,), (2.675,), (7.125,)]
    for x, got in spark.createDataFrame(rows, "x double").select("x", hundredths(F.col("x"))).collect():
        assert got == round(x, 2), x


def test_busy_times_and_free_numbers_are_those_of_a_scan():
    rng = random.Random(8)
    busy, seen = resolve.Busy(), []
    for _ in range(400):
        a = rng.randint(0, 300)
        span = (a, a + rng.randint(0, 6))
        assert busy.during(*span) == any(span[0] <= z and x <= span[1] for x, z in seen)
        if rng.random() < 0.4:
            busy.add(*span)
            seen.append(span)
    assert busy.starts == sorted(busy.starts) and all(z < x for z, x in zip(busy.ends, busy.starts[1:], strict=False))
    spans = sorted((a, a + rng.randint(0, 40)) for a in (rng.randint(0, 200) for _ in range(300)))
    groups, want = [], []
    for a, z in spans:
        at = next((i for i, end in enumerate(groups) if end < a), len(groups))
        groups[at : at + 1] = [z]
        want.append(at)
    assert resolve.first_free(*map(np.array, zip(*spans, strict=True))).tolist() == want


def test_many_overlapping_tracks_are_swept_quickly(spark):
    import time

    df = spark.range(100_000).select(F.lit("s").alias("session"), F.lit(1).cast("long").alias("subject"), F.col("id").alias("track"), F.col("id").alias("first"), (F.col("id") + 100_000).alias("last"))
    began = time.perf_counter()
    assert resolve.first_fit(df).agg(F.max("part")).first()[0] == 99_999
    assert time.perf_counter() - began < 60
