"""Stateful streams with keyed state and event-time timers: windows by gap and cap, and galleries that expire."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chronoweave.operators.gallery import ENROLLED, Gallery
from chronoweave.operators.windows import Folder
from chronoweave.params import DEFAULT, Params
from chronoweave.session import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WINDOWS = "session string, first long, last long, n_frames long"


class _Windows(StatefulProcessor):
    """One session: its open window, and the active frames that the watermark has not passed yet."""

    def __init__(self, quiet: int, cap: int | None, idle_ms: int, origin_ms: int, frame_ms: int) -> None:
        self.quiet, self.cap, self.idle_ms, self.origin_ms, self.frame_ms = max(1, quiet), cap, idle_ms, origin_ms, frame_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, end long, size long, gap long, newest long")
        self.waiting = handle.getMapState("waiting", "frame long", "due long")

    def _wake_at(self, due: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)

    def _ends(self, frame: int) -> int:
        return self.origin_ms + (frame + 1) * self.frame_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.window.get() if self.window.exists() else None
        newest = held[4] if held else None
        for pdf in rows:
            for frame in sorted({int(f) for f in pdf["frame"].dropna()}):
                if newest is None or frame > newest:
                    self.waiting.updateValue((frame,), (self._ends(frame),))
        due = [d for _, (d,) in self.waiting.iterator()] if self.waiting.exists() else []
        if due:
            self._wake_at(min(due))
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("session", "object"), ("first", "int64"), ("last", "int64"), ("n_frames", "int64"))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.window.get() if self.window.exists() else (None, None, 0, 0, None)
        folder, newest, out = Folder(self.quiet, self.cap, tuple(held[:4])), held[4], []
        waiting = sorted((f, d) for (f,), (d,) in self.waiting.iterator()) if self.waiting.exists() else []
        for frame, due in waiting:
            if due > now:
                break
            if newest is not None and self._ends(newest) + self.idle_ms < self._ends(frame):
                out += folder.close()  # it had ended before this frame came
            elif newest is not None:
                for still in range(newest + 1, min(frame, newest + self.quiet + 1)):
                    out += folder.step(still, False)
            out += folder.step(frame, True)
            newest = frame
            self.waiting.removeKey((frame,))
        later = [d for _, d in waiting if d > now]
        if not later and newest is not None and self._ends(newest) + self.idle_ms <= now:
            out += folder.close()
            self.window.clear()
        else:
            if newest is not None:
                self.window.update((*folder.state(), newest))
            self._wake_at(min(later) if later else self._ends(newest) + self.idle_ms)
        yield pd.DataFrame([(key[0], *w) for w in out], columns=["session", "first", "last", "n_frames"])

    def close(self) -> None:
        pass


def capped_windows(frames: DataFrame, quiet: int, cap: int | None, origin_ms: int, frame_ms: int, late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """(session, first, last, n_frames) from a stream of active frames (session, frame, ts): the batch rule, in append mode.

    A frame ends at origin_ms + (frame + 1) * frame_ms and is folded, in order of frames, once the watermark (`late` behind
    the newest ts) has passed its end, so the rows do not depend on how frames are dealt over batches. Frames older than what
    has been folded are late and left out. A window is told as soon as what follows closes it. A session that has nothing
    for idle_ms of event time is over: a timer closes its window at its last active frame and lets its state go; what
    comes after that starts afresh.
    """
    watched = frames.withWatermark("ts", late).select("session", "frame", "ts")
    processor = _Windows(quiet, cap, idle_ms, origin_ms, frame_ms)
    return watched.groupBy("session").transformWithStateInPandas(processor, WINDOWS, "Append", "EventTime")


class _Galleries(StatefulProcessor):
    """One session's gallery: its shots, its refused vectors, and the newest row seen."""

    def __init__(self, p: Params, idle_ms: int) -> None:
        self.p, self.idle_ms = p, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.shots = handle.getListState("shots", "owner long, vec array<double>")
        self.refused = handle.getListState("refused", "vec array<double>")
        self.subjects = handle.getMapState("subjects", "subject long", "shots long")
        self.newest = handle.getValueState("newest", "seq long, ms long")

    def _forget(self) -> None:
        for state in (self.shots, self.refused, self.subjects, self.newest):
            state.clear()

    def _gallery(self) -> Gallery:
        gallery = Gallery(self.p)
        for owner, vec in self.shots.get() if self.shots.exists() else ():
            gallery.vectors.append(np.asarray(vec, dtype=np.float64))
            gallery.owners.append(int(owner))
        gallery.shots = {int(s): int(n) for (s,), (n,) in self.subjects.iterator()} if self.subjects.exists() else {}
        gallery.negatives = [np.asarray(v, dtype=np.float64) for (v,) in self.refused.get()] if self.refused.exists() else []
        return gallery

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        newest, last_ms = self.newest.get() if self.newest.exists() else (None, None)
        gallery, out = self._gallery(), []
        stored, changed, refused = len(gallery.vectors), set(), list(gallery.negatives)
        for r in batch.itertuples():
            if newest is not None and r.seq <= newest:
                continue
            ms = int(r.ts.value // 1_000_000)
            if last_ms is not None and ms - last_ms > self.idle_ms:
                self._forget()
                gallery, stored, changed, refused = Gallery(self.p), 0, set(), []
            newest, last_ms = int(r.seq), ms if last_ms is None else max(ms, last_ms)
            v = np.asarray(r.vec, dtype=np.float64)
            size = float(np.linalg.norm(v))
            before = len(gallery.vectors)
            out.append({"session": key[0], "seq": newest} | gallery.enrol(v / size if size else v, bool(r.ok)))
            changed |= set(gallery.owners[before:])
        for owner, vec in zip(gallery.owners[stored:], gallery.vectors[stored:], strict=True):
            self.shots.appendValue((owner, vec.tolist()))
        for subject in changed:
            self.subjects.updateValue((subject,), (gallery.shots[subject],))
        if [id(v) for v in gallery.negatives] != [id(v) for v in refused]:
            self.refused.put([(v.tolist(),) for v in gallery.negatives])
        if newest is not None:
            self.newest.update((newest, last_ms))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last_ms + self.idle_ms + 1)
        columns = [c.split()[0] for c in ENROLLED.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"subject": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield pd.DataFrame(columns=[c.split()[0] for c in ENROLLED.split(", ")])

    def close(self) -> None:
        pass


def enrolments(seen: DataFrame, p: Params = DEFAULT, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """The rule of operators.gallery.enrolments over a stream of (session, seq, ts, vec, ok), in append mode.

    A batch's rows are taken in order of seq; rows no newer than the session's newest one are late and left out. The state
    is added to, shot by shot, and not written anew. A session that has nothing for more than idle_ms of event time is over:
    its gallery is let go by a timer, and what comes after starts with an empty one, whether or not the timer came first.
    """
    watched = seen.withWatermark("ts", late).select("session", "seq", "ts", "vec", "ok")
    return watched.groupBy("session").transformWithStateInPandas(_Galleries(p, idle_ms), ENROLLED, "Append", "EventTime")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs this store; a query keeps the store that it started with, so the caller's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drained(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a stateful stream over what its sources have now and return all that it has told so far, from the shared folder.

    With the same folder a later call goes on from where the last one ended.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/told/batch={number}")

    with _rocksdb(spark):
        query = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/told").select(*stream.columns)


def told_to_the_end(source: DataFrame, through, name: str, end: str = "2200-01-01 00:00:00") -> DataFrame:
    """What through(stream) has told once source, a stream of (session, frame, ts), has no more to come.

    After source is drained, a mark of its end moves the watermark past every timer: a row of no session in a folder of
    its own, which is read in the same run of state.
    """
    spark = source.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    marks = spark.createDataFrame([], source.schema)
    marks.write.parquet(f"{folder}/end")
    stream = through(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{folder}/end")))
    drained(stream, name, folder)
    mark = {f.name: F.lit(None).cast(f.dataType) for f in source.schema.fields} | {"ts": F.lit(end).cast("timestamp")}
    spark.range(1).select(*(c.alias(k) for k, c in mark.items())).write.mode("append").parquet(f"{folder}/end")
    return drained(stream, name, folder).where("session is not null")
