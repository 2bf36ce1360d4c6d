"""Face records: which bodies' vectors are asked for."""

from chronoweave.operators import attach


def test_only_bodies_that_are_compared_are_asked_for(spark):
    """A face of the best frame needs no vector; one of another frame needs those of both frames."""
    box = lambda t, f: ("s", f, t, 100.0 * t, 0.0, 100.0 * t + 60, 100.0)
    face = lambda t, f: ("s", f, 10 + t, 100.0 * t + 20, 10.0, 100.0 * t + 40, 30.0, 0.9, 0.8, "clear", "direct", True)
    persons = spark.createDataFrame([box(t, f) for t in (1, 2, 3) for f in (0, 1)], "session string, frame long, track long, x1 double, y1 double, x2 double, y2 double")
    faces = spark.createDataFrame([face(1, 0), face(2, 1)], "session string, frame long, face long, x1 double, y1 double, x2 double, y2 double, det double, quality double, category string, eligibility string, restored boolean")
    tracks = spark.createDataFrame([("s", t, 0, False) for t in (1, 2, 3)], "session string, track long, best_frame long, skipped boolean")
    candidates = spark.createDataFrame([("s", t, f) for t in (1, 2, 3) for f in (0, 1)], "session string, track long, frame long")
    bodies = spark.createDataFrame([("s", t, f, [1.0, 0.1 * f]) for t in (1, 2, 3) for f in (0, 1)], "session string, track long, frame long, vec array<double>")
    asked = []

    def vectors(at):
        asked.extend(tuple(r) for r in at.select("track", "frame").collect())
        return bodies.join(at, ["session", "track", "frame"], "left_semi")

    made = attach.attach_faces(tracks, candidates, faces, persons, vectors)
    given = attach.attach_faces(tracks, candidates, faces, persons, bodies)
    assert sorted(asked) == [(2, 0), (2, 1)]
    assert sorted(map(repr, made.collect())) == sorted(map(repr, given.collect()))
    assert {r["track"]: r["consistency"] for r in made.collect()} == {1: "same_frame", 2: "passed", 3: None}
