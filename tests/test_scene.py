"""Texts of a window are dealt once."""

from chronoweave.operators import context


def test_texts_are_shuffled_once(spark):
    lines = [("s", 0, f, None, n, t) for f in range(3) for n, t in enumerate(("Camera 1", f"at {f}", " "))]
    df = context.scene_context(spark.createDataFrame(lines, "session string, window long, frame long, at string, line long, text string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    (row,) = df.collect()
    assert (row["n_frames"], row["n_static"], row["omitted"]) == (3, 1, 0)
    assert "Camera 1" in row["text"] and "- frame#2 @ None：at 2" in row["text"]
