"""Choices that each depend on the one before, without a walk over a session: slices become maps that are composed.

What a slice of frames does to a choice depends only on the number that is carried into it (from which frame on the next
choice is due). A slice is turned into the map from that number to the one it passes on, slices in parallel; the maps,
one row a slice and each no longer than the reach of a choice, are composed in order; and with the number that enters it
each slice is walked again, in parallel. No task holds more than a slice, or more than a session's maps.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.slices import FRAMES, slice_of
from chronoweave.session import written

#: Stands for nothing that is carried on.
NONE = int(np.iinfo(np.int64).min)

MAPS = "dues array<long>, passed array<long>, counts array<long>"


def _composed(maps: DataFrame, by: list[str]) -> DataFrame:
    """(by, __slice, due, before) from (by, __slice, dues, passed, counts): what enters each slice, null for nothing yet, and
    how many choices were made before it. An entering number picks the first of dues that is not below it; nothing picks the
    first; a number above all dues goes on unchanged. passed is NONE where nothing is carried on."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        due, before, out = None, 0, []
        for r in pdf.sort_values("__slice").itertuples(index=False):
            at, dues = r[len(by)], r.dues
            out.append((*key, at, due, before))
            k = 0 if due is None else bisect.bisect_left(dues, due)
            if k < len(dues):
                before += int(r.counts[k])
                due = None if r.passed[k] == NONE else int(r.passed[k])
        return pd.DataFrame(out, columns=[*by, "__slice", "due", "before"]).astype({"due": "Int64"})

    kinds = ", ".join(f"{c} {dict(maps.dtypes)[c]}" for c in by)
    return maps.groupBy(*by).applyInPandas(fold, f"{kinds}, __slice long, due long, before long")


def _links(frames: np.ndarray, hot: np.ndarray, fallback: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each frame as a choice: the next choice (len(frames) for none), the last one from here on, and their number."""
    n = len(frames)
    after = np.full(n + 1, n)
    for i in range(n - 1, -1, -1):
        after[i] = i if hot[i] else after[i + 1]
    follow = np.minimum(after[1:], np.searchsorted(frames, frames + fallback))
    last, count = np.arange(n), np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        if follow[i] < n:
            last[i], count[i] = last[follow[i]], count[follow[i]] + 1
    return follow, last, count


def spaced_or_hot(frames: DataFrame, threshold: float, fallback: int, most: int, size: int = FRAMES) -> DataFrame:
    """(session, frame, nth): of frames (session, frame, scene) the first, and then each whose scene is above threshold or
    that is `fallback` or more after the last choice; at most `most` of a session. Frames must not repeat in a session."""
    rows = frames.select("session", "frame", "scene", slice_of("frame", size).alias("__slice"))

    def read(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("frame")
        return pdf["frame"].to_numpy(np.int64), (pdf["scene"] > threshold).to_numpy(bool)

    def mapped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, hot = read(pdf)
        _, last, count = _links(at, hot, fallback)
        # what enters is due at the latest `fallback` after the slice's beginning, and a hot frame is a choice in any case
        reach = min(len(at), int(np.searchsorted(at, key[1] * size + fallback)) + 1, int(np.argmax(hot)) + 1 if hot.any() else len(at))
        dues = at[:reach].copy()
        if hot[reach - 1]:
            dues[-1] = np.iinfo(np.int64).max
        return pd.DataFrame({"session": [key[0]], "__slice": [key[1]], "dues": [dues], "passed": [at[last[:reach]] + fallback], "counts": [count[:reach]]})

    def chosen(key: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        (due, before), (at, hot), out = (entry["due"].iloc[0], int(entry["before"].iloc[0])), read(pdf), []
        follow, _, _ = _links(at, hot, fallback)
        first_hot = int(np.argmax(hot)) if hot.any() else len(at)
        i = 0 if pd.isna(due) else min(first_hot, int(np.searchsorted(at, int(due))))
        while i < len(at) and before + len(out) < most:
            out.append(at[i])
            i = follow[i]
        return pd.DataFrame({"session": key[0], "frame": np.array(out, np.int64), "nth": np.arange(before, before + len(out))})

    key = ["session", "__slice"]
    entries = _composed(rows.groupBy(*key).applyInPandas(mapped, f"session {dict(rows.dtypes)['session']}, __slice long, {MAPS}"), ["session"])
    return rows.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(chosen, f"session {dict(rows.dtypes)['session']}, frame long, nth long")


def capped_stretches(active: DataFrame, cap: int, size: int = FRAMES) -> DataFrame:
    """(session, part, first, last): each part's active frames (session, part, frame) cut into windows: one begins with the
    first frame that none holds, and ends with the first frame that is its cap-th or later, counting from its beginning
    whether frames are active or not; the last one of a part ends with the part. Frames must not repeat in a part.

    A slice of a part is one row with its frames, and Python takes many such rows at a time, as parts may be short and many;
    only parts that reach over a slice's end are composed.
    """
    by, key = ["session", "part"], ["session", "part", "__slice"]
    rows = active.select(*by, "frame", slice_of("frame", size).alias("__slice")).groupBy(*key).agg(F.array_sort(F.collect_list("frame")).alias("at"))
    rows = written(rows, "stretches")
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by)

    def ends(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, at + cap - 1)

    def led(at: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        n, end = len(at), ends(at)
        # what a window that begins at place i leads to: the frame where an open one is due at the slice's end, or none
        leads = np.full(n + 2, NONE, np.int64)
        for i in range(n - 1, -1, -1):
            leads[i] = at[i] + cap - 1 if end[i] >= n else leads[end[i] + 1]
        reach = min(n, int(np.searchsorted(at, number * size + cap)) + 1)
        # nothing open picks the first entry, which begins at place 0; one that is due at frame k ends there, and the next begins
        return np.concatenate([[NONE], at[:reach]]), np.concatenate([[leads[0]], leads[1 : reach + 1]])

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [led(np.asarray(at, np.int64), number) for at, number in zip(pdf["at"], pdf["__slice"], strict=True)]
            out = pdf[key].assign(dues=pd.Series([d for d, _ in found], index=pdf.index, dtype=object), passed=pd.Series([p for _, p in found], index=pdf.index, dtype=object))
            yield out.assign(counts=pd.Series([np.zeros(len(d), np.int64) for d, _ in found], index=pdf.index, dtype=object))

    def windows(at: np.ndarray, due: float | None) -> Iterator[tuple[int, int, bool]]:
        end, i = ends(at), 0
        if not pd.isna(due):
            k = int(np.searchsorted(at, int(due)))
            yield int(due) - cap + 1, at[k] if k < len(at) else at[-1], k < len(at)
            i = k + 1
        while i < len(at):
            yield at[i], at[end[i]] if end[i] < len(at) else at[-1], end[i] < len(at)
            i = end[i] + 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [list(windows(np.asarray(at, np.int64), due)) for at, due in zip(pdf["at"], pdf["due"], strict=True)]
            again = [len(f) for f in found]
            flat = pd.DataFrame([w for f in found for w in f], columns=["first", "last", "closed"])
            yield pd.DataFrame({"session": pdf["session"].repeat(again).to_numpy(), "part": pdf["part"].repeat(again).to_numpy()}).join(flat)

    reaching = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    maps = rows.join(reaching, by, "left_semi").mapInPandas(mapped, f"{kinds}, __slice long, {MAPS}")
    # frames are told from due as text, which no batch turns into doubles where some are missing
    entries = _composed(maps, by).select(*key, F.col("due").cast("string").alias("due"))
    pieces = rows.join(entries, key, "left").mapInPandas(cut, f"{kinds}, first long, last long, closed boolean")
    return pieces.groupBy(*by, "first").agg(F.max("last").alias("last"), F.bool_or("closed").alias("closed"))
