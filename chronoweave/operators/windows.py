"""Activity windows: sessions of active frames by gap, windows that also have a cap, and their roll-up."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.chains import capped_stretches
from chronoweave.operators.slices import FRAMES, KEY, slice_of
from chronoweave.session import written


def gap_sessions(active: DataFrame, quiet: int) -> DataFrame:
    """active (session, frame, ...) with `part`: active frames at most `quiet` apart belong together, parts count from 1.

    Rows are dealt once, by slice of a session; a slice's gaps are counted there, and one row a slice, with its first and last
    frame, tells where its first part stands among the session's. Frames must not repeat within a session.
    """
    rows = active.withColumn("__slice", slice_of("frame"))
    within = W.partitionBy(*KEY).orderBy("frame")
    apart = F.coalesce(F.col("frame") - F.lag("frame").over(within) > quiet, F.lit(False)).cast("int")
    rows = rows.withColumn("__apart", apart).withColumn("__own", F.sum("__apart").over(within.rowsBetween(W.unboundedPreceding, 0)))
    slices = rows.groupBy(*KEY).agg(F.min("frame").alias("__lo"), F.max("frame").alias("__hi"), F.max("__own").alias("__gaps"))
    by = W.partitionBy("session").orderBy("__slice")
    fresh = F.when(F.col("__lo") - F.lag("__hi").over(by) <= quiet, 0).otherwise(1)
    slices = slices.withColumn("__fresh", fresh)
    before = F.coalesce(F.sum(F.col("__fresh") + F.col("__gaps")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("__fresh")
    slices = slices.select(*KEY, before.alias("__base"))
    return rows.join(slices, KEY).withColumn("part", F.col("__base") + F.col("__own")).drop("__slice", "__apart", "__own", "__base")


class Folder:
    """The fold that cuts one session's frames, given in order, into windows.

    An active frame joins the window, and closes it once it has `cap` frames. An inactive one joins an open window as a
    bridge until `quiet` of them in a row close it; the last of these stays out. Frames with no window open are passed.
    """

    def __init__(self, quiet: int, cap: int | None, state: tuple | None = None) -> None:
        self.quiet, self.cap = max(1, quiet), cap
        self.start, self.end, self.size, self.gap = state or (None, None, 0, 0)

    def state(self) -> tuple:
        return self.start, self.end, self.size, self.gap

    def close(self) -> Iterator[tuple[int, int, int]]:
        if self.size:
            yield self.start, self.end, self.size
        self.start, self.end, self.size, self.gap = None, None, 0, 0

    def step(self, frame: int, active: bool) -> Iterator[tuple[int, int, int]]:
        if active:
            self.start = frame if not self.size else self.start
            self.end, self.size, self.gap = frame, self.size + 1, 0
            if self.cap and self.size >= self.cap:
                yield from self.close()
        elif self.size:
            self.gap += 1
            if self.gap >= self.quiet:
                yield from self.close()
            else:
                self.end, self.size = frame, self.size + 1


def fold_windows(rows: Iterable[tuple[int, bool]], quiet: int, cap: int | None) -> list[tuple[int, int, int]]:
    """(first frame, last frame, frames) of each window of one session."""
    folder, out = Folder(quiet, cap), []
    for frame, active in rows:
        out += folder.step(frame, active)
    return [*out, *folder.close()]


def capped_windows(frames: DataFrame, quiet: int, cap: int | None) -> DataFrame:
    """(session, first, last, n_frames) from frames (session, frame, n): windows by gap and cap.

    Frames of a session that come after a gap of `quiet` start afresh whatever came before. Between such gaps a window ends
    with the first active frame that is its cap-th or a later one, and the next begins with the active frame after it;
    these ends are found over slices that are composed (operators.chains), so a session that never pauses is no fold of
    its own. A window that the cap does not end goes on for the inactive frames that no gap has closed yet.
    """
    quiet = max(1, quiet)
    active = written(gap_sessions(frames.where("n > 0").select("session", "frame"), quiet), "active")
    if cap:
        cut = capped_stretches(active, cap)
    else:
        cut = active.groupBy("session", "part").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).withColumn("closed", F.lit(False))
    end = frames.groupBy("session").agg(F.max("frame").alias("end"))
    on = F.least(F.col("last") + quiet - 1, F.col("end"))
    last = F.when(F.col("closed"), F.col("last")).otherwise(on)
    return cut.join(end, "session").select("session", "first", last.alias("last")).withColumn("n_frames", F.col("last") - F.col("first") + 1)


def whole_if_idle(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """windows, and for sessions that have none one window over all their frames."""
    every = frames.groupBy("session").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n_frames"))
    return windows.unionByName(every.join(windows, "session", "left_anti"))


def covered_frames(windows: DataFrame) -> DataFrame:
    """(session, frame): the frames of all windows, each once."""
    return windows.select("session", F.explode(F.sequence("first", "last")).alias("frame")).distinct()


def members(windows: DataFrame, found: DataFrame) -> DataFrame:
    """found (session, frame, ...) with the window that each row falls in: `first` and `last`; others are left out.

    The window is the last one that begins at or before the frame, found by a running "last window" over both tables in
    order of frames, slice by slice of a session: a window stands in every slice that it reaches into. No join of ranges.
    """
    cols = [c for c in found.columns if c not in ("session", "frame")]
    a = found.select("session", "frame", slice_of("frame").alias("__slice"), F.lit(1).alias("__kind"), F.struct(*cols).alias("__row") if cols else F.lit(None).alias("__row"), F.lit(None).cast("struct<first:bigint,last:bigint>").alias("__win"))
    reached = windows.select("session", F.col("first").cast("long"), F.col("last").cast("long")).withColumn("__slice", F.explode(F.sequence(slice_of("first"), slice_of("last"))))
    begins = F.greatest("first", F.col("__slice") * FRAMES)
    b = reached.select("session", begins.alias("frame"), "__slice", F.lit(0).alias("__kind"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct("first", "last").alias("__win"))
    w = W.partitionBy(*KEY).orderBy("frame", "__kind", "__win.first").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__win", F.last("__win", True).over(w)).where("__kind = 1 and frame <= __win.last")
    return both.select("session", "frame", *([f"__row.{c}" for c in cols]), "__win.first", "__win.last")


def window_summary(windows: DataFrame, found: DataFrame, events: DataFrame) -> DataFrame:
    """Per window: its frames, detections, tracks, best quality, and the kinds of its events, sorted and distinct."""
    inside = members(windows, found.select("session", "frame", "track", "quality")).groupBy("session", "first").agg(F.count(F.lit(1)).alias("n_detections"), F.count_distinct("track").alias("n_tracks"), F.max("quality").alias("best_quality"))
    kinds = members(windows, events.select("session", "frame", F.split("event", ":")[0].alias("kind"))).groupBy("session", "first").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count(F.lit(1)).alias("n_events"))
    return (
        windows.join(inside, ["session", "first"], "left").join(kinds, ["session", "first"], "left")
        .select("session", "first", "last", "n_frames", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), "best_quality", F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
    )
