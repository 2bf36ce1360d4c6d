"""The identity run: from tracks and their vectors to who is who, each step taking what the one before it decided."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import quality as Q
from chronoweave.functions import vectors as V
from chronoweave.operators import attach, gallery, resolve
from chronoweave.operators.tracks import KEY
from chronoweave.params import DEFAULT, Params
from chronoweave.session import written


def ordered(tracks: DataFrame) -> DataFrame:
    """tracks with nth, the order in which a session's tracks appear: by (first frame, track); sightings without a track come last."""
    return tracks.withColumn("nth", F.row_number().over(W.partitionBy("session").orderBy(F.col("track").isNull(), "first", "track")).cast("long"))


#: What the fold over bodies tells of a track: the gallery's answer, and whom an orphan was stitched to.
TOLD = {"body": "long", "told": "string", "score": "double", "joined": "long", "stitched": "string", "stitch_score": "double"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def body_identities(tracks: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """tracks with body (the gallery's number), quality-checked enrolment's decision and score, then stitched orphans.

    tracks: session, track, nth, first, last, skipped, vec, ok. Tracks that are skipped or have no vector stay unknown. Columns
    added: body, subject, decision, score, reused, local, cross_merged, stitch_score. Both steps are told by one fold over a
    session's tracks, as the second needs the first one's answers and the same vectors: vec, which is most of a row, is
    shuffled once and nothing after the fold has it.
    """
    kept = tracks.drop("vec").columns
    known = F.when(~F.col("skipped"), F.col("vec")).alias("vec")

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        seen = rows.filter(pc.is_valid(rows["vec"]))
        vecs = V.matrix(seen["vec"])
        told = gallery.enrolled(vecs, seen["ok"].to_pylist(), [True] * len(seen), p)
        columns = (seen[c].to_pylist() for c in ("track", "first", "last", "ok"))
        ids = [{"track": t, "first": a, "last": z, "ok": ok, "vec": v, "subject": r["subject"]} for t, a, z, ok, v, r in zip(*columns, vecs, told, strict=True)]
        answers = {x["track"]: (r["subject"], r["decision"], r["score"]) for x, r in zip(ids, told, strict=True)}
        joined = {t: rest for t, *rest in resolve.stitched(ids, p)}
        every = [(*answers.get(t, (None,) * 3), *joined.get(t, (None,) * 3)) for t in rows["track"].to_pylist()]
        new = [pa.array(column, _ARROW[of]) for column, of in zip(zip(*every, strict=True), TOLD.values(), strict=True)]
        return pa.table([*rows.select(kept).columns, *new], names=[*kept, *TOLD])

    shape = tracks.drop("vec").schema
    for name, of in TOLD.items():
        shape = shape.add(name, of)
    both = tracks.select(*kept, known).groupBy("session").applyInArrow(fold, shape).withColumn("score", F.round("score", 4))
    decision = F.coalesce("stitched", "told")
    return both.select(
        *kept, "body", F.coalesce("joined", "body").alias("subject"), decision.alias("decision"), "score", "stitch_score",
        F.coalesce(decision.isin("hit", "stitched"), F.lit(False)).alias("reused"), F.coalesce(decision.isin("local", "local_stitched"), F.lit(False)).alias("local"),
        F.coalesce(decision == "local_stitched", F.lit(False)).alias("cross_merged"),
    )


def identity_hits(bodies: DataFrame) -> DataFrame:
    """(session, frame, event): identity_hit in the first frame of each track that is known again after stitching."""
    hits = bodies.where("reused and subject is not null")
    return hits.select("session", F.col("first").alias("frame"), F.concat(F.lit("identity_hit:主体#"), "subject").alias("event"))


def gait_identities(gaits: DataFrame, order: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session, track, gait, gait_decision, gait_score) of gaits (session, track, n_frames, vec): those with enough frames,
    through a gallery of their own that takes every quality."""
    rows = gaits.where((F.col("n_frames") >= p.gait_frames) & F.col("vec").isNotNull()).join(order.select(*KEY, "nth"), KEY)
    told = gallery.enrolments(rows.select("session", F.col("nth").alias("seq"), "vec", F.lit(True).alias("ok")), p)
    told = told.select("session", F.col("seq").alias("nth"), F.col("subject").alias("gait"), F.col("decision").alias("gait_decision"), F.round("score", 4).alias("gait_score"))
    return order.select(*KEY, "nth").join(told, ["session", "nth"]).drop("nth")


def resolved(bodies: DataFrame, faces: DataFrame, gaits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The identities: bodies merged over routes, split where one subject is in two places at once, and fused.

    bodies as body_identities has them; faces: session, track and the columns of attach.matched_faces; gaits as
    gait_identities has them. Adds merge_routes, merge_agree, split, canonical ids per route, and the fused confidence. Merging
    comes first and may give one subject tracks that overlap; splitting then has the last word on subjects, while the
    ids per route stay those of the merge.
    """
    face = faces.select(*KEY, *(F.col(c).alias(f"face_{c}") for c in ("status", "eligibility", "category", "quality", "consistency", "match_ready", "matched", "local", "match_score", "det", "frame")))
    rows = bodies.drop("vec").join(face, KEY, "left").join(gaits, KEY, "left")
    strict = attach.face_route(F.col("face_matched"), F.col("face_match_ready"), F.col("face_eligibility"), F.col("face_category"), F.col("face_consistency"), F.col("face_local"))
    rows = written(rows.withColumn("face_ok", strict), "routes")
    ids = resolve.merge_ids(F.col("body"), F.col("face_ok"), F.col("face_local"), F.col("gait_decision"), F.col("gait"))
    merged = resolve.merged_tracks(rows.select(*KEY, "nth", "subject", *(c.alias(k) for k, c in ids.items())))
    merged = merged.select(*KEY, F.col("subject").alias("canonical"), "merge_routes", "merge_agree", F.col("cross_merged").alias("changed"))
    alone = rows.groupBy("session").agg((F.count(F.lit(1)) < 2).alias("alone"))
    rows = rows.join(merged, KEY).join(alone, "session")
    firm = F.coalesce(F.col("decision").isin("hit", "stitched"), F.lit(False))
    rows = rows.withColumns({
        "decision": F.when(F.col("changed") & ~firm, "merged").otherwise(F.col("decision")), "reused": F.col("reused") | F.col("changed"), "cross_merged": F.col("cross_merged") | F.col("changed"),
        "route_body": F.when(F.col("body").isNotNull() & ~F.col("alone"), F.col("canonical")), "route_face": F.when(F.col("face_ok") & ~F.col("alone"), F.col("canonical")), "route_gait": F.when(F.col("gait").isNotNull() & ~F.col("alone"), F.col("canonical")),
    }).drop("subject", "changed", "alone")
    rows = written(rows, "merged")
    told = resolve.split_conflicts(rows.where("canonical is not null").select("session", F.col("canonical").alias("subject"), "track", "first", "last", "nth"))
    rows = rows.join(told.select(*KEY, F.col("new_subject").alias("subject"), "split"), KEY, "left").withColumn("split", F.coalesce("split", F.lit(False)))
    rows = rows.withColumn("decision", F.when(F.col("split") & (F.col("decision") == "hit"), "conflict_split").otherwise(F.col("decision"))).withColumn("reused", F.col("reused") & ~F.col("split"))
    record = {k: F.col(f"face_{c}") for k, c in (("matched", "matched"), ("match_ready", "match_ready"), ("category", "category"), ("quality_score", "quality"), ("match_score", "match_score"), ("score", "det"))}
    route = {"body": F.col("route_body"), "face": F.col("route_face"), "gait": F.col("route_gait")}
    fused = Q.fused_confidence(F.col("subject"), F.col("score"), F.col("decision"), record, F.when(F.col("gait_decision").isNotNull(), F.coalesce("gait_score", F.lit(0.0))), route, p)
    return rows.withColumns({k: fused[k] for k in ("confidence", "resolved", "multi_source", "agreed", "primary", "cues")})


def window_identities(windows: DataFrame, found: DataFrame, identities: DataFrame, best: DataFrame, width: float, height: float) -> DataFrame:
    """The persons of each window from a run's identities; best: session, track and the box of the best frame (bx1 to by2)."""
    rows = identities.select(
        *KEY, "subject", "score", "decision", "reused", "local", "split", "merge_routes", F.col("face_local").alias("face"), "gait", F.col("confidence").alias("fused"),
    ).join(best, KEY)
    return resolve.window_persons(windows, found, rows, width, height)
