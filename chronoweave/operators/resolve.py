"""Resolving who is who: components over routes, time conflicts, stitching, and roll-ups of persons."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import geometry as G
from chronoweave.functions import vectors as V
from chronoweave.operators.windows import members
from chronoweave.params import DEFAULT, Params
from chronoweave.session import written

MOST_ROUNDS = 60
ROUTES = ("body", "face", "gait")


def components(edges: DataFrame, by: str = "session", u: str = "u", v: str = "v") -> DataFrame:
    """(by, node, component): for every node of an edge the smallest node that it is connected with.

    Rounds of the smallest label among neighbours and then that label's own label, each written, until none changes.
    """
    two = edges.select(by, F.col(u).alias("node"), F.col(v).alias("other")).where("node <> other")
    both = written(two.unionByName(two.select(by, F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy(by, "node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(by, F.col("node").alias("other"), F.col("component").alias("c")), [by, "other"])
        best = labels.join(near.groupBy(by, "node").agg(F.min("c").alias("c")), [by, "node"])
        above = labels.select(by, F.col("node").alias("c"), F.col("component").alias("above"))
        step = best.join(above, [by, "c"], "left").select(by, "node", F.col("component").alias("old"), F.least("component", "c", F.coalesce("above", "c")).alias("component"))
        step = written(step, "labels")
        labels = step.select(by, "node", "component")
        if step.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def route_edges(tracks: DataFrame) -> DataFrame:
    """(session, route, u, v): each track with the first one that shares a local id on a route. A hub costs n edges."""
    ids = tracks.select("session", "track", F.explode(F.array(*(F.struct(F.lit(r).alias("route"), F.col(r).cast("long").alias("id")) for r in ROUTES))).alias("r")).where("r.id is not null").select("session", "track", "r.route", "r.id")
    first = ids.groupBy("session", "route", "id").agg(F.min("track").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return ids.join(first, ["session", "route", "id"]).where("track <> u").select("session", "route", "u", F.col("track").alias("v"))


def merge_ids(body: Column, face_ok: Column, face: Column, gait_decision: Column, gait: Column) -> dict[str, Column]:
    """The local ids by which routes may merge tracks: a body's own, a face's that passes the strict predicate
    (attach.face_route), and a gait's that was a hit."""
    return {"body": body, "face": F.when(F.coalesce(face_ok, F.lit(False)), face), "gait": F.when(F.coalesce(gait_decision == "hit", F.lit(False)), gait)}


def merged_tracks(tracks: DataFrame) -> DataFrame:
    """Per track: its component over all routes, the component's size and routes, and its subject.

    tracks: session, track, and an id or null for each route, as merge_ids lets them count; `subject` is what the track is
    known as so far (its body id where there is no such column), and `nth` the order of a session's tracks (the track's
    number where there is none). A component of two or more takes its smallest subject; one without any gets a new one,
    numbered on from the session's largest in the order of first tracks. Tracks on their own keep what they have.
    """
    if "subject" not in tracks.columns:
        tracks = tracks.withColumn("subject", F.col("body"))
    if "nth" not in tracks.columns:
        tracks = tracks.withColumn("nth", F.col("track"))
    edges = written(route_edges(tracks), "route-edges")
    parts = components(edges, "session").select("session", F.col("node").alias("track"), "component")
    with_part = tracks.join(parts, ["session", "track"], "left")
    on = edges.join(parts, (edges["session"] == parts["session"]) & (edges["u"] == parts["track"])).select(parts["session"], "component", "route")
    routes = on.groupBy("session", "component").agg(F.array_join(F.array_sort(F.collect_set("route")), ",").alias("merge_routes"), F.count_distinct("route").alias("merge_agree"))
    groups = with_part.where("component is not null").groupBy("session", "component").agg(F.count(F.lit(1)).alias("n_tracks"), F.min("subject").alias("own"), F.min("nth").alias("begins"))
    top = tracks.groupBy("session").agg(F.coalesce(F.max("subject"), F.lit(0)).alias("top"))
    minted = F.row_number().over(W.partitionBy("session", F.col("own").isNull()).orderBy("begins"))
    groups = groups.join(top, "session").withColumn("canonical", F.coalesce("own", F.col("top") + minted)).select("session", "component", "n_tracks", "canonical")
    out = with_part.join(groups, ["session", "component"], "left").join(routes, ["session", "component"], "left")
    changed = F.col("canonical").isNotNull() & ~F.col("subject").eqNullSafe(F.col("canonical"))
    return out.select("session", "track", F.coalesce("component", "track").alias("component"), F.coalesce("n_tracks", F.lit(1)).alias("n_tracks"), F.coalesce("canonical", F.col("subject").cast("long")).alias("subject"), F.coalesce("merge_routes", F.lit("")).alias("merge_routes"), F.coalesce("merge_agree", F.lit(0)).alias("merge_agree"), changed.alias("cross_merged"))


def first_fit(tracks: DataFrame) -> DataFrame:
    """tracks (session, subject, track, first, last) with `part`: the first group of its subject that it overlaps in time with nothing of.

    In order of (first, last, track) a group is free if its last end is before the track's start. Where nothing of a
    subject goes on, all groups are free whatever came before, so a subject's history is cut there, and each stretch is
    swept on its own: ends that have passed give their group's number back, and the smallest free number is taken, so a
    stretch of n tracks costs n log n, however many of them overlap.
    """
    order = W.partitionBy("session", "subject").orderBy("first", "last", "track")
    ended = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    tracks = tracks.withColumn("__fresh", F.when(ended >= F.col("first"), 0).otherwise(1)).withColumn("__stretch", F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("first", "last", "track"))))).alias("rows")
    folded = tracks.groupBy("session", "subject", "__stretch").agg(rows).select("session", F.col("subject").cast("long"), *(F.col(f"rows.{c}").alias(c) for c in ("first", "last", "track")))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [first_free(first, last) for first, last in zip(pdf["first"], pdf["last"], strict=True)]
            sizes = [len(p) for p in parts]
            yield pd.DataFrame({"session": pdf["session"].repeat(sizes), "subject": pdf["subject"].repeat(sizes), "track": np.concatenate([*pdf["track"], np.empty(0, np.int64)]), "part": np.concatenate([*parts, np.empty(0, np.int64)])})

    return folded.mapInPandas(sweep, f"session {dict(tracks.dtypes)['session']}, subject long, track long, part long")


def first_free(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each interval, in order of starts, the smallest number that no interval holds that reaches into it."""
    going: list[tuple[int, int]] = []
    free: list[int] = []
    out = np.empty(len(first), np.int64)
    for i, (start, end) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        while going and going[0][0] < start:
            heapq.heappush(free, heapq.heappop(going)[1])
        number = heapq.heappop(free) if free else len(going)
        heapq.heappush(going, (end, number))
        out[i] = number
    return out


def split_conflicts(tracks: DataFrame) -> DataFrame:
    """Per track its subject after tracks that overlap in time are told apart, and whether its subject was split.

    The first group keeps the subject; others get numbers on from the session's largest, in order of (subject, group), or of
    (subject's first track, group) where tracks have a column nth that orders a session's tracks.
    """
    parts = first_fit(tracks)
    extra = parts.where("part > 0").select("session", "subject", "part").distinct()
    top = tracks.groupBy("session").agg(F.max("subject").alias("top"))
    if "nth" in tracks.columns:
        extra = extra.join(tracks.groupBy("session", "subject").agg(F.min("nth").alias("begins")), ["session", "subject"])
    nth = F.row_number().over(W.partitionBy("session").orderBy("begins" if "nth" in tracks.columns else "subject", "part"))
    extra = extra.join(top, "session").select("session", "subject", "part", (F.col("top") + nth).cast("long").alias("new_subject"))
    split = extra.select("session", "subject").distinct().withColumn("split", F.lit(True))
    out = parts.join(extra, ["session", "subject", "part"], "left").join(split, ["session", "subject"], "left")
    return out.select("session", "track", "subject", "part", F.coalesce("new_subject", "subject").alias("new_subject"), F.coalesce("split", F.lit(False)).alias("split"))


def overlaps(tracks: DataFrame, by: str = "subject", span: int = 64) -> DataFrame:
    """(by, a, b): pairs of tracks of a group whose closed intervals share a point.

    Intervals meet by (group, slot of time) in the slot where the later one starts, so each pair is found once and a
    long history is many small joins instead of one of all with all.
    """
    slots = F.sequence(F.floor(F.col("first") / span), F.floor(F.col("last") / span))
    left = tracks.select(by, F.col("track").alias("a"), F.col("first").alias("a1"), F.col("last").alias("a2"), F.explode(slots).alias("slot"))
    right = tracks.select(by, F.col("track").alias("b"), F.col("first").alias("b1"), F.col("last").alias("b2"), F.floor(F.col("first") / span).alias("slot"))
    later = (F.col("b1") > F.col("a1")) | ((F.col("b1") == F.col("a1")) & (F.col("b") > F.col("a")))
    return left.join(right, [by, "slot"]).where(later & (F.col("b1") <= F.col("a2"))).select(by, "a", "b", (F.least("a2", "b2") - F.col("b1") + 1).alias("shared"))


def stitch_once(tracks: DataFrame, p: Params = DEFAULT, span: int = 64) -> DataFrame:
    """Orphans (no subject) joined to the nearest subject of their session that no member overlaps in time; one pass.

    tracks: session, track, subject, first, last, vec, ok. Subjects are what they are before the pass: joining does not
    move their centroids, so all orphans are handled at once. Who is busy is found by slots of `span` frames. See `stitch`
    for the rule that updates.
    """
    known = tracks.where("subject is not null")
    parts = known.select("session", "subject", F.posexplode("vec").alias("at", "x")).groupBy("session", "subject", "at").agg(F.avg("x").alias("x"))
    means = parts.groupBy("session", "subject").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("session", "subject", V.unit(F.col("v.x")).alias("mean"))
    orphans = tracks.where("subject is null").select("session", "track", "first", "last", "ok", V.unit(F.col("vec")).alias("v"))
    slots = lambda: F.explode(F.sequence(F.floor(F.col("first") / span), F.floor(F.col("last") / span))).alias("slot")
    at = known.select("session", "subject", F.col("first").alias("f"), F.col("last").alias("l"), slots())
    busy = orphans.select("session", "track", "first", "last", slots()).join(at, ["session", "slot"]).where("first <= l and f <= last").select("session", "track", "subject").distinct()
    pairs = orphans.join(means, "session").join(busy, ["session", "track", "subject"], "left_anti")
    scored = pairs.withColumn("score", V.dot(F.col("v"), F.col("mean")))
    best = scored.groupBy("session", "track").agg(F.max_by(F.struct("subject", "score", "ok"), F.struct("score", -F.col("subject"))).alias("b"))
    bar = F.when(F.coalesce("b.ok", F.lit(False)), p.stitch).otherwise(max(p.stitch, p.stitch_local))
    return best.where(F.col("b.score") >= bar).select("session", "track", "b.subject", F.round("b.score", 4).alias("score"))


STITCHED = "session string, track long, subject long, decision string, score double"


def stitch(tracks: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session, track, subject, decision, score) of each orphan, in order of first frames, each join moving the centroid.

    First to subjects at least `stitch` near (`stitch_local` for poor quality), then what is left among itself; groups
    get new subjects in order of the first frame of their smallest track. A session's tracks are one fold, as each join
    moves what the next one is compared with; a group costs one row of a matrix and one place in its list of busy times,
    however many members it has.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(subject=pdf["subject"].astype(object).where(pdf["subject"].notna(), None)).to_dict("records")
        return pd.DataFrame([(pdf["session"].iloc[0], *told) for told in stitched(rows, p)], columns=["session", "track", "subject", "decision", "score"])

    return tracks.select("session", "track", "subject", "first", "last", "vec", "ok").groupBy("session").applyInPandas(fold, STITCHED)


def _unit(v: np.ndarray) -> np.ndarray:
    size = math.sqrt(v @ v)
    return v / size if size > 0 else v


class Busy:
    """When someone is seen: intervals, those that share a point united, found by halving."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def during(self, first: int, last: int) -> bool:
        """Whether any interval shares a point with this one."""
        i = bisect.bisect_right(self.starts, last)
        return i > 0 and self.ends[i - 1] >= first

    def add(self, first: int, last: int) -> None:
        i, j = bisect.bisect_left(self.ends, first), bisect.bisect_right(self.starts, last)
        if i < j:
            first, last = min(first, self.starts[i]), max(last, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [first], [last]


class Pool:
    """Groups in the order in which they begin: the sums of their vectors, their middles at length 1 in one matrix that grows by
    doubling, and when they are seen."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.places: dict[int, int] = {}
        self.busy: list[Busy] = []
        self.sums = self.middles = np.empty((0, 0))

    def add(self, key: int, vec: np.ndarray, first: int, last: int) -> None:
        at = self.places.get(key)
        if at is None:
            at = self.places[key] = len(self.keys)
            self.keys.append(key)
            self.busy.append(Busy())
            if at >= len(self.sums):
                grown = np.zeros((max(8, 2 * at), len(vec)))
                self.sums, self.middles = (np.concatenate([x.reshape(-1, len(vec)), grown[len(x) :]]) for x in (self.sums, self.middles))
        self.sums[at] += vec
        self.middles[at] = _unit(self.sums[at])
        self.busy[at].add(first, last)

    def nearest(self, vec: np.ndarray, first: int, last: int) -> tuple[int | None, float]:
        """The group of the highest inner product (above -1; the first among equals) that is not seen at that time."""
        scores = self.middles[: len(self.keys)] @ _unit(vec) if self.keys else np.empty(0)
        while len(scores):
            at = int(scores.argmax())
            if not scores[at] > -1.0:
                break
            if not self.busy[at].during(first, last):
                return self.keys[at], float(scores[at])
            scores[at] = -np.inf
        return None, -1.0


def stitched(rows: list[dict], p: Params = DEFAULT) -> list[tuple]:
    """(track, subject, decision, score) of the orphans of one session's rows (track, subject or None, first, last, vec, ok)."""
    rows = sorted(rows, key=lambda r: (r["first"], r["track"]))
    groups, clusters = Pool(), Pool()
    for r in rows:
        r["vec"] = np.asarray(r["vec"], dtype=np.float64)
        if r["subject"] is not None:
            groups.add(int(r["subject"]), r["vec"], r["first"], r["last"])
    local, out, best_of = [], {}, {}
    orphans = [r for r in rows if r["subject"] is None]
    for r in orphans:
        s, score = groups.nearest(r["vec"], r["first"], r["last"])
        if s is not None and score >= (p.stitch if r["ok"] else max(p.stitch, p.stitch_local)):
            groups.add(s, r["vec"], r["first"], r["last"])
            out[r["track"]] = (s, "stitched", round(score, 4))
        else:
            local.append(r)
    members: dict[int, list[dict]] = {}
    for r in local:
        c, score = clusters.nearest(r["vec"], r["first"], r["last"])
        if c is not None and score >= max(p.stitch, p.stitch_local):
            best_of[c] = max(best_of.get(c, -1.0), score)
        else:
            c = len(members)
        members.setdefault(c, []).append(r)
        clusters.add(c, r["vec"], r["first"], r["last"])
    first_of = {r["track"]: r["first"] for r in rows}
    number = max(groups.keys, default=0)
    for c, ms in sorted(members.items(), key=lambda g: first_of[min(m["track"] for m in g[1])]):
        number += 1
        for m in ms:
            out[m["track"]] = (number, "local_stitched" if len(ms) > 1 else "local", round(best_of[c], 4) if c in best_of else None)
    return [(r["track"], *out[r["track"]]) for r in orphans]


def persons(tracks: DataFrame) -> DataFrame:
    """Tracks (session, track, subject, first, score, decision, split, merge_routes) rolled up by subject, or by track without one.

    The representative is the track with the best score, the one seen first among equals. One track keeps its own
    decision; several are local_stitched if any is local, conflict_split if any was split, else a hit.
    """
    key = F.coalesce(F.concat(F.lit("subject:"), "subject"), F.concat(F.lit("track:"), "track"))
    rep = F.max_by(F.struct("track", "score", "decision"), F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("first"), -F.col("track")))
    local = F.bool_or(F.col("decision").isin("local", "local_stitched"))
    every = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("merge_routes", ","))))), ",")
    out = tracks.groupBy("session", key.alias("person")).agg(rep.alias("r"), F.count(F.lit(1)).alias("n_tracks"), F.array_join(F.array_sort(F.collect_list("track")), ",").alias("tracks"), F.bool_or("split").alias("was_split"), local.alias("local"), F.regexp_replace(every, "^,", "").alias("merge_routes"), F.min("first").alias("first"))
    several = F.when(F.col("local"), "local_stitched").when(F.col("was_split"), "conflict_split").otherwise("hit")
    decision = F.when(F.col("n_tracks") == 1, F.col("r.decision")).otherwise(several)
    return out.select("session", "person", "n_tracks", "tracks", F.col("r.track").alias("track"), F.when(F.col("r.score") > 0, F.round("r.score", 4)).alias("score"), decision.alias("decision"), (~(F.col("local") | F.col("was_split"))).alias("reused"), "merge_routes", "first")


def merge_decisions(tracks: DataFrame, merged: DataFrame) -> DataFrame:
    """tracks (session, track, decision, reused) after merged_tracks: a track whose subject changed counts as reused, and
    is merged unless it was a hit or stitched."""
    changed = F.coalesce("cross_merged", F.lit(False))
    rows = tracks.join(merged.select("session", "track", "subject", "merge_routes", "merge_agree", "cross_merged"), ["session", "track"], "left")
    firm = F.coalesce(F.col("decision").isin("hit", "stitched"), F.lit(False))
    return rows.select("session", "track", "subject", F.when(changed & ~firm, "merged").otherwise(F.col("decision")).alias("decision"), (changed | F.coalesce("reused", F.lit(False))).alias("reused"), "merge_routes", "merge_agree")


def route_subjects(tracks: DataFrame, face_ok: Column) -> DataFrame:
    """(session, track, route, subject): under which subject each route of a track stands. tracks: session, track, subject
    and a local id or null for each route; face_ok says whether a face passes the strict predicate."""
    known = {"body": F.col("body").isNotNull(), "face": face_ok, "gait": F.col("gait").isNotNull()}
    routes = F.array_compact(F.array(*(F.when(ok, F.lit(r)) for r, ok in known.items())))
    return tracks.where("subject is not null").select("session", "track", F.explode(routes).alias("route"), "subject")


# How merged persons are described.
KINDS, ROUTE_NAMES = ("本视频本地subject", "时间冲突拆分subject", "同一人"), {"face": "人脸库", "body": "人形库", "gait": "步态库"}


def merged_attributes(n: Column, local: Column, split: Column, routes: Column) -> Column:
    """What a person of several tracks is: how many tracks, of which kind, and the routes (sorted array) that link them."""
    kind = F.when(local, KINDS[0]).when(split, KINDS[1]).otherwise(KINDS[2])
    names = F.create_map(*[F.lit(x) for pair in ROUTE_NAMES.items() for x in pair])
    linked = F.when(F.size(routes) > 0, F.concat(F.lit("跨track印证："), F.array_join(F.transform(routes, lambda r: F.coalesce(F.element_at(names, r), r)), "+")))
    return F.array_compact(F.array(F.concat(F.lit("由"), n, F.lit("条轨迹合并("), kind, F.lit(")")), linked))


def window_persons(windows: DataFrame, found: DataFrame, identities: DataFrame, width: float, height: float) -> DataFrame:
    """The persons of each window: tracks that are in it, rolled up by subject, or by track without one.

    found: session, frame, track and a box; identities: session, track, subject, score, decision, reused, local, split, merge_routes,
    face, gait, fused, and the box of the best frame (bx1 to by2). The representative is the first track with the best
    score. The path is that of all tracks in the window by (frame, track); the box is the representative's in the
    window's last frame, else its best one; face and gait are the first ones known in order of tracks, fused the most
    confident. A single track keeps its own decision, reuse and score, whatever that is; of several the best score is
    told, rounded, if it is above 0. attributes says of several how many there are, of which kind and by which routes.
    """
    x, y = G.centre(G.box(), width, height)
    box = F.array("x1", "y1", "x2", "y2")
    inside = members(windows, found.select("session", "frame", "track", x.alias("x"), y.alias("y"), box.alias("box"))).withColumnRenamed("first", "window")
    per_track = inside.groupBy("session", "window", "track").agg(
        F.array_sort(F.collect_list(F.struct("frame", "track", "x", "y"))).alias("points"), F.max(F.when(F.col("frame") == F.col("last"), F.col("box"))).alias("last_box"),
    )
    rows = per_track.join(identities, ["session", "track"])
    key = F.coalesce(F.concat(F.lit("subject:"), "subject"), F.concat(F.lit("track:"), "track"))
    best = F.coalesce("last_box", F.array("bx1", "by1", "bx2", "by2"))
    rep = F.max_by(F.struct("track", "subject", "decision", "reused", best.alias("box")), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("track")))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("track")))
    routes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("merge_routes", F.lit("")), ","), lambda r: r != "")))))
    out = rows.groupBy("session", "window", key.alias("person")).agg(
        rep.alias("r"), F.array_sort(F.collect_list("track")).alias("tracks"), F.array_sort(F.flatten(F.collect_list("points"))).alias("points"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"),
        first("face").alias("face"), first("gait").alias("gait"), F.max("fused").alias("fused"), routes.alias("merge_routes"),
        F.bool_or(F.coalesce("local", F.lit(False))).alias("local"), F.bool_or(F.coalesce("split", F.lit(False))).alias("split"), F.max("score").alias("own_score"),
    )
    one = F.size("tracks") == 1
    several = F.when(F.col("local"), "local_stitched").when(F.col("split"), "conflict_split").otherwise("hit")
    return out.select(
        "session", "window", "person", F.col("r.track").alias("track"), "tracks", F.col("r.subject").alias("subject"), F.when(one, F.col("r.decision")).otherwise(several).alias("decision"),
        F.when(one, F.col("r.reused")).otherwise(~(F.col("local") | F.col("split"))).alias("reused"), F.when(one, F.col("own_score")).when(F.col("score") > 0, F.round("score", 4)).alias("score"),
        "face", "gait", "fused", F.array_join("merge_routes", ",").alias("merge_routes"), F.size("merge_routes").cast("long").alias("merge_agree"),
        F.when(one, F.array().cast("array<string>")).otherwise(merged_attributes(F.size("tracks"), F.col("local"), F.col("split"), F.col("merge_routes"))).alias("attributes"), F.col("r.box").alias("box"), F.transform("points", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("path"),
    )


def subject_gallery(tracks: DataFrame) -> DataFrame:
    """Per subject ('?' for none): tracks, whether any was merged across routes, best score and the track that has it."""
    return tracks.groupBy("session", F.coalesce(F.col("subject").cast("string"), F.lit("?")).alias("subject")).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.bool_or("cross_merged").alias("any_merged"), F.max("score").alias("best_score"), F.max_by("track", F.struct("score", -F.col("track"))).alias("best_track"))
