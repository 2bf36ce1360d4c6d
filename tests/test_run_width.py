"""The identity run: vectors, which are most of a row, stand in no table that later steps write or shuffle."""

from chronoweave.operators import identify


def test_bodies_are_told_without_their_vectors(spark, monkeypatch):
    written, wide = identify.written, []

    def kept(df, name, **options):
        wide.extend([name] if "vec" in df.columns else [])
        return written(df, name, **options)

    monkeypatch.setattr(identify, "written", kept)
    rows = [("s", 1, 1, 0, 1, False, [1.0, 0.0], True), ("s", 2, 2, 2, 3, False, [1.0, 0.0], True), ("s", 3, 3, 4, 5, True, None, True)]
    tracks = spark.createDataFrame(rows, "session string, track long, nth long, first long, last long, skipped boolean, vec array<double>, ok boolean")
    got = identify.body_identities(tracks)
    assert {r["track"]: (r["body"], r["decision"]) for r in got.collect()} == {1: (1, "new"), 2: (1, "hit"), 3: (None, None)}
    assert not wide and "vec" not in got.columns
