"""Windows over streams: native sessions by gap, and windows by gap and cap with state per session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.windows import Folder


def session_windows(events: DataFrame, key: str = "session", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): events at most `gap` apart, batch or stream; ts must be a timestamp with a zone.

    Events later than `late` behind the newest are dropped in a stream; results come as sessions close (append) or grow.
    """
    watched = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = watched.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def timed_windows(events: DataFrame, width: str, slide: str | None = None, key: str = "session", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): events in windows of fixed width, one after the other or every `slide`, batch or stream."""
    watched = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = watched.groupBy(key, F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def capped_windows(frames: DataFrame, quiet: int, cap: int | None, timeout: bool = True) -> DataFrame:
    """(session, first, last, n_frames, late) from a stream of active frames (session, frame): the batch rule, kept as state.

    A session's state is its open window and newest frame. Frames that are not newer are late and only counted; frames
    between two active ones are inactive. A window is told when it closes; `late` tells the frames dropped so far.
    With `timeout` a session that is quiet for an hour of processing time closes its window.
    """
    quiet = max(1, quiet)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.getOption or (None, None, 0, 0, None, 0)
        folder, newest, late = Folder(quiet, cap, tuple(kept[:4])), kept[4], kept[5]
        out = []
        if state.hasTimedOut:
            out += folder.close()
            state.remove()
        else:
            frames_in = sorted({int(f) for pdf in batches for f in pdf["frame"]})
            for frame in frames_in:
                if newest is not None and frame <= newest:
                    late += 1
                    continue
                if newest is not None:
                    for idle in range(newest + 1, min(frame, newest + quiet + 1)):
                        out += folder.step(idle, False)
                out += folder.step(frame, True)
                newest = frame
            state.update((*folder.state(), newest, late))
            if timeout:
                state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame([(key[0], *w, late) for w in out], columns=["session", "first", "last", "n_frames", "late"])

    return frames.groupBy("session").applyInPandasWithState(
        step, "session string, first long, last long, n_frames long, late long",
        "start long, end long, size long, gap long, newest long, late long",
        "append", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout,
    )


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now and return what it told, from a table in the shared folder.

    Executors write every batch there; in complete mode only the last one, which has every result, counts.
    """
    from chronoweave.session import shared_dir

    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    told: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/told/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        told[:] = [path] if mode == "complete" else [p for p in told if p != path] + [path]

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*told) if told else spark.createDataFrame([], stream.schema)
