"""Faces for tracks: candidates, associations, the best evidence of each track, whether it fits the body, and what it may do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import quality as Q
from chronoweave.functions import vectors as V
from chronoweave.operators.gallery import enrolments
from chronoweave.operators.tracks import KEY, associate
from chronoweave.params import DEFAULT, Params
from chronoweave.session import written

# Grades from the least on; unknown ones count as the grade in brackets of `rank`.
ELIGIBILITY = ("none", "unusable", "recoverable", "direct")
CATEGORY = ("none", "poor", "marginal", "clear")


def rank(value: Column, grades: tuple[str, ...], missing: str) -> Column:
    """A grade's place in its order; null counts as `missing`, unknown ones as the least."""
    return F.greatest(F.array_position(F.array(*map(F.lit, grades)), F.coalesce(value, F.lit(missing))) - 1, F.lit(0))


def evidence_rank() -> Column:
    """Order of evaluated faces: eligibility, category, quality, association, detection, earlier frame."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    grades = rank(F.col("eligibility"), ELIGIBILITY, "unusable").alias("e"), rank(F.col("category"), CATEGORY, "poor").alias("c")
    return F.struct(*grades, number("quality"), number("association"), number("det"), (-F.col("frame")).alias("f"))


def best_faces(options: DataFrame) -> DataFrame:
    """Per track the highest by evidence_rank of its evaluated faces; all columns of options."""
    rest = [c for c in options.columns if c not in KEY]
    return options.groupBy(*KEY).agg(F.max_by(F.struct(*rest), evidence_rank()).alias("b")).select(*KEY, "b.*")


def best_embedded(faces: DataFrame) -> DataFrame:
    """Of the faces that have a vector, each image's one of the highest quality (the smallest face among equals)."""
    rest = [c for c in faces.columns if c != "image"]
    order = F.struct(F.coalesce("quality", F.lit(0.0)).alias("quality"), (-F.col("face")).alias("face"))
    return faces.where("vec is not null").groupBy("image").agg(F.max_by(F.struct(*rest), order).alias("b")).select("image", "b.*")


# Columns of evidence that leave no process.
PRIVATE = ("crop", "person_crop", "embedding", "_face", "_aligned")


def public_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence without its pixels and vectors."""
    return evidence.drop(*PRIVATE)


def consistency(same_frame: Column, body: Column, candidate: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """Status and score of a face's body against its track's: same_frame (1), passed or failed by cosine; no vector fails."""
    size = V.norm(body) * V.norm(candidate)
    score = F.round(F.when(size > 0, V.dot(body, candidate) / size).otherwise(-1.0), 4)
    exact = F.when(size > 0, V.dot(body, candidate) / size).otherwise(-1.0)
    status = (
        F.when(same_frame, "same_frame").when(body.isNull(), "body_embedding_unavailable").when(candidate.isNull(), "person_crop_unavailable")
        .when(exact >= p.face_consistency, "passed").otherwise("failed")
    )
    return status, F.when(same_frame, 1.0).when(status.isin("passed", "failed"), score)


def face_route(matched: Column, match_ready: Column, eligibility: Column, category: Column, status: Column, local: Column) -> Column:
    """The strict predicate of the face route: null local ids and anything unknown do not pass."""
    good = matched & match_ready & (eligibility == "direct") & (category == "clear") & status.isin("same_frame", "passed") & local.isNotNull()
    return F.coalesce(good, F.lit(False))


def _first_error(failures: DataFrame, stage: str, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the errors of one stage; of several for one key the first by text."""
    return failures.where(F.col("stage") == stage).groupBy(*keys).agg(F.min("error").alias(name))


def attach_faces(
    tracks: DataFrame, candidates: DataFrame, faces: DataFrame, persons: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame],
    p: Params = DEFAULT, gate: Callable[[Column, Column, Column, Column], Column] = Q.gallery_reason, failures: DataFrame | None = None,
) -> DataFrame:
    """One face record per track: status, the chosen face, how it fits the body, and whether it may match and enrol.

    tracks: session, track, best_frame, skipped; candidates: session, track, frame, and round (the frame's number where there is
    no such column), which orders a track's candidates; faces: session, frame, face, a box, det, quality, category, eligibility,
    restored; persons: session, frame, track and a box, all of a frame's; vectors: session, track, frame, vec of bodies, or a
    function that makes them for the (session, track, frame) asked about: only a face of another frame than the best is
    compared with its body. A track without candidates has its best frame as the only one. Faces are matched with all persons of a frame, not only those
    asked about. The best of a track's faces is chosen, checked against the body's vector, and graded; `gate` says why a
    face may not enter the gallery. Records that are not consistent are kept but do not match.

    failures: session, frame, stage, error. A frame whose detection failed (stage detect) has no faces: a track that is left
    with none then has status detector_error and the error of its last candidate that failed. A chosen frame that cannot be
    read again (open) gives face_frame_unavailable, one whose face cannot be finished (finalize) face_finalize_error; both
    keep what was seen and do not match. One frame's failure touches no other frame.
    """
    asked = tracks.where("not skipped")
    if "round" not in candidates.columns:
        candidates = candidates.withColumn("round", F.col("frame"))
    have = candidates.groupBy(*KEY, "frame").agg(F.min("round").cast("long").alias("round"))
    fallback = asked.join(have, KEY, "left_anti").select(*KEY, F.col("best_frame").alias("frame"), F.lit(0).cast("long").alias("round"))
    targets = have.join(asked.select(*KEY), KEY, "left_semi").unionByName(fallback)
    if failures is None:
        failures = tracks.select("session", F.lit(0).cast("long").alias("frame"), F.lit("").alias("stage"), F.lit("").alias("error")).limit(0)
    undetected = _first_error(failures, "detect", ["session", "frame"], "error")
    seen = faces.join(undetected, ["session", "frame"], "left_anti")
    frames = targets.select("session", "frame").distinct()
    in_frames = lambda df: df.join(frames, ["session", "frame"], "left_semi")
    matched = associate(in_frames(seen), in_frames(persons), p).withColumnRenamed("score", "association")
    options = targets.drop("round").join(matched, [*KEY, "frame"]).join(seen.drop("x1", "y1", "x2", "y2"), ["session", "frame", "face"])
    chosen = written(tracks.select(*KEY, "best_frame", "skipped").join(best_faces(options), KEY, "left"), "chosen")
    blind = targets.join(undetected, ["session", "frame"]).groupBy(*KEY).agg(F.max_by("error", F.struct("round", "frame")).alias("detect_error"))
    compared = chosen.where("frame <> best_frame")
    both = compared.select(*KEY, "frame").unionByName(compared.select(*KEY, F.col("best_frame").alias("frame")))
    bodies = vectors(both) if callable(vectors) else vectors.join(both, [*KEY, "frame"], "left_semi")
    bodies = written(bodies.select(*KEY, "frame", "vec"), "body-vectors")
    body = bodies.select(*KEY, F.col("frame").alias("best_frame"), F.col("vec").alias("body"))
    own = bodies.select(*KEY, "frame", F.col("vec").alias("candidate"))
    rows = chosen.join(body, [*KEY, "best_frame"], "left").join(own, [*KEY, "frame"], "left").join(blind, KEY, "left")
    for stage in ("open", "finalize"):
        rows = rows.join(_first_error(failures, stage, ["session", "frame"], f"{stage}_error"), ["session", "frame"], "left")
    status, score = consistency(F.col("frame") == F.col("best_frame"), F.col("body"), F.col("candidate"), p)
    found, unread = F.col("frame").isNotNull(), F.col("open_error").isNotNull()
    fits = F.coalesce(status.isin("same_frame", "passed"), F.lit(False)) & found & ~unread
    consistent = fits & F.col("finalize_error").isNull()
    source = F.when(consistent, Q.match_source(F.col("eligibility"), F.col("restored"))).otherwise("none")
    can_enroll = (F.col("eligibility") == "direct") & (F.col("category") == "clear")
    state = (
        F.when(F.col("skipped"), "track_skipped").when(~found & F.col("detect_error").isNotNull(), "detector_error").when(~found, "not_detected")
        .when(unread, "face_frame_unavailable").when(~fits, "track_consistency_failed").when(~consistent, "face_finalize_error").otherwise("observed")
    )
    error = F.when(F.col("skipped"), F.lit(None).cast("string")).when(~found, F.col("detect_error")).when(unread, F.col("open_error")).when(fits, F.col("finalize_error"))
    reason = gate(F.col("eligibility"), F.col("category"), source == "superres", can_enroll)
    checked = found & ~unread
    return rows.select(
        *KEY, state.alias("status"), "frame", "face", "eligibility", "category", "quality", "association", F.when(checked, status).alias("consistency"), F.when(checked, score).alias("consistency_score"),
        source.alias("match_source"), (consistent & (source != "none")).alias("match_ready"), F.coalesce(consistent & (source == "original") & reason.isNull(), F.lit(False)).alias("can_enroll"), F.when(consistent, reason).alias("gallery_reason"),
        "det", error.alias("error"),
    )


def matched_faces(records: DataFrame, vectors: DataFrame, order: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """records of attach_faces with the face gallery's answer: matched, local (the gallery's number), match_score and enrolled.

    vectors: session, frame, face, vec; a face without one is not match_ready. order: session, track, nth, in which a session's
    tracks come to the gallery, which starts empty. Only a clear, direct face seen without restoration may become a
    subject or add to one; a hit needs face_hit, poor ones no more than that.
    """
    rows = records.join(order.select(*KEY, "nth"), KEY).join(vectors.select("session", "frame", "face", "vec"), ["session", "frame", "face"], "left")
    rows = rows.withColumn("match_ready", F.coalesce(F.col("match_ready") & F.col("vec").isNotNull(), F.lit(False)))
    rows = written(rows.withColumn("vec", F.when(F.col("match_ready"), F.col("vec"))), "seen-faces")
    ok = F.col("gallery_reason").isNull()
    seen = rows.where("match_ready").select("session", F.col("nth").alias("seq"), "vec", ok.alias("ok"), "can_enroll")
    told = enrolments(seen.withColumnRenamed("can_enroll", "auto"), p.with_(hit=p.face_hit, new=p.face_new, low_quality_hit=p.face_hit))
    told = told.select("session", F.col("seq").alias("nth"), (F.col("decision") == "hit").alias("matched"), F.col("subject").alias("local"), F.round("score", 4).alias("match_score"), "enrolled")
    out = rows.drop("vec").join(told, ["session", "nth"], "left").drop("nth")
    return out.withColumns({"matched": F.coalesce("matched", F.lit(False)), "enrolled": F.coalesce("enrolled", F.lit(False))})
