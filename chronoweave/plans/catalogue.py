"""The registered queries over the reference's operators; their SQL is in chronoweave.plans.oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import geometry as G
from chronoweave.functions import quality as Q
from chronoweave.functions import vectors as V
from chronoweave.operators import attach, context, evaluate, gallery, identify, keyframes, resolve, tracks, windows
from chronoweave.params import Params
from chronoweave.plans.oracles import ORACLES
from chronoweave.session import read_table, written
from chronoweave.sources import adapters as A
from chronoweave.sources import files
from chronoweave.streaming import stateful
from chronoweave.streaming import windows as stream_windows

#: Thresholds for the driver's tables, whose vectors carry no groups and whose frames are ten minutes long.
P = Params().with_(hit=0.30, new=0.20, vote=0.25, margin=0.01, track_min_frames=3, top_k=30, max_keyframes=12)
QUIET, CAP = 10, 60


def q01_frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = A.observations(spark, sf_dir).select("session", "frame")
    return keyframes.sampled(frames, F.col("frame") * A.FRAME_SECONDS, 7200.0)


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observations(spark, sf_dir).groupBy("session", "frame").agg(F.max("conf").alias("scene"))


def q02_adaptive_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes.adaptive(_scenes(spark, sf_dir), 0.97, 12, 1 << 30)


def q03_label_counts_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.label_counts(A.observations(spark, sf_dir))


def q04_track_lifespan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.lifespans(A.observations(spark, sf_dir), P)


def q05_track_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.best_evidence(A.detections(spark, sf_dir), P)


def q06_frame_semantic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.frame_events(A.detections(spark, sf_dir))


def q07_gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = A.observations(spark, sf_dir).select("session", "frame").distinct()
    parts = windows.gap_sessions(active, QUIET)
    return parts.groupBy("session", "part").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n_active"))


#: Windows, detections and frames: a query cuts them once and passes them along.
Cut = tuple[DataFrame, DataFrame, DataFrame]


def _windows(spark: SparkSession, sf_dir: str) -> Cut:
    """Windows (written, as they are read more than once), detections and frames."""
    found = A.detections(spark, sf_dir)
    frames = written(A.frames(found), "frames")
    return written(windows.whole_if_idle(windows.capped_windows(frames, QUIET, CAP), frames), "windows"), found, frames


def q08_capped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)[0]


def q09_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_windows, found, frames = _windows(spark, sf_dir)
    return windows.window_summary(found_windows, found, tracks.frame_events(found, frames))


def q10_object_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _things(_windows(spark, sf_dir))


def _things(cut: Cut) -> DataFrame:
    found_windows, found, _ = cut
    return context.object_context(found_windows, found, A.WIDTH, A.HEIGHT, P)


def q11_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = G.box()
    cx, cy = G.centre(box, A.WIDTH, A.HEIGHT)
    normed = G.norm_box(box, A.WIDTH, A.HEIGHT)
    x1, y1, x2, y2, ok = G.crop(box, 100.0, 100.0)
    torso = G.region(box, "torso")
    rows = A.detections(spark, sf_dir)
    return rows.select(
        "event_id", cx.alias("cx"), cy.alias("cy"), *(F.element_at(normed, i + 1).alias(f"n{i}") for i in range(4)),
        *(c.alias(n) for n, c in zip(("cx1", "cy1", "cx2", "cy2"), (x1, y1, x2, y2), strict=True)), ok.alias("crop_ok"),
        *(c.alias(n) for n, c in zip(("tx1", "ty1", "tx2", "ty2"), torso, strict=True)), G.clock(F.col("frame") * 1.5).alias("clock"),
    )


def q12_iou_prev_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.previous_overlap(A.detections(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


def q13_iou_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons of each frame with the best of all other objects in it."""
    found = A.detections(spark, sf_dir)
    return tracks.best_matches(found.where("label = 'person'"), found.where("label <> 'person'"), P.match_iou).withColumn("iou", F.round("iou", 6))


def q14_interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.overlaps(A.intervals(spark, sf_dir))


def _subject_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.intervals(spark, sf_dir).withColumn("session", F.concat(F.lit("s"), F.col("subject") % 25))


def q15_interval_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.split_conflicts(_subject_tracks(spark, sf_dir))


def q16_trajectory_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.directions(A.detections(spark, sf_dir), A.WIDTH, A.HEIGHT, P)


def q17_quality_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.reasons(A.detections(spark, sf_dir), P)


def _faces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Q.Face]:
    """Faces made up from the events' numbers: size, five points, score, blur and rating."""
    rows = A.detections(spark, sf_dir)
    k, t = F.col("k"), F.col("track")
    rows = rows.select(
        "event_id", (10 + k * 1.0).alias("w"), (12 + t * 1.0).alias("h"), (k / 100.0 * 0.6 + 0.4).alias("det"),
        F.when(k % 7 != 0, F.col("quality")).alias("blur"), F.when(t % 5 != 0, (t % 10) / 10.0).alias("fiqa"),
        (50.0 + (k - 50) * 0.5).alias("nx"), (48.0 + (t % 30 - 15)).alias("ny"),
    )
    at = lambda x, y: (F.lit(x), F.lit(y))
    points = [at(30.0, 35.0), at(70.0, 35.0), (F.col("nx"), F.col("ny")), at(36.0, 72.0), at(64.0, 72.0)]
    return rows, Q.Face(F.col("w"), F.col("h"), F.col("det"), points, F.col("blur"), F.col("fiqa"), P)


def q18_face_quality_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, face = _faces(spark, sf_dir)
    graded = rows.select(
        "event_id", face.frontal.alias("frontal"), face.yaw.alias("yaw"), face.pitch.alias("pitch"), face.category().alias("category"),
        F.concat_ws(",", face.defects()).alias("defects"), face.reason().alias("reason"), face.score().alias("quality"), face.eligibility().alias("eligibility"), face.can_enroll().alias("can_enroll"),
    )
    refused = Q.gallery_reason(F.col("eligibility"), F.col("category"), F.lit(False), F.col("can_enroll"))
    return graded.withColumn("gallery_reason", refused).withColumn("band", Q.confidence_band(F.col("quality")))


def _nearest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 100, against all the others."""
    probes = A.shots(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "subject", "vec")
    found = gallery.nearest(probes, A.shots(spark, sf_dir).withColumnRenamed("vec_id", "row"), P.top_k + 1).where("query <> row")
    nth = F.row_number().over(W.partitionBy("query").orderBy("nth")).cast("long")
    return probes, found.withColumn("nth", nth).where(F.col("nth") <= P.top_k)


def q19_knn_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


def q20_subject_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery.candidates(_nearest(spark, sf_dir)[1], P).withColumn("score", F.round("score", 6))


def q21_identity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, found = _nearest(spark, sf_dir)
    return gallery.decisions(probes, gallery.candidates(found, P), P)


def q22_rank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, found = _nearest(spark, sf_dir)
    return evaluate.rank_k(found, probes)


def _numbers(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


def q23_subject_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(gallery.centroids(A.shots(spark, sf_dir)), "subject", "n")


def q24_weighted_fusion_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("subject") == 3, 0.0).otherwise(F.col("vec_id") % 7 / 5.0)
    return _numbers(gallery.weighted_centroids(A.shots(spark, sf_dir), weight), "subject")


def q25_open_set_enrol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 64 vectors each, so that their number grows with the table."""
    shots = A.shots(spark, sf_dir)
    return gallery.enrolments(shots.select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / 64)).alias("session"), F.col("vec_id").alias("seq"), "vec", (F.col("vec_id") % 5 != 0).alias("ok")), P)


def _vector_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    subject = F.when(i % 3 != 0, F.col("subject"))
    return A.shots(spark, sf_dir).select(F.concat(F.lit("s"), F.floor(i / 100)).alias("session"), i.alias("track"), subject.alias("subject"), (i * 37 % 500).alias("first"), (i * 37 % 500 + i % 11).alias("last"), "vec", (i % 2 == 0).alias("ok"))


def q26_stitch_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.stitch_once(_vector_tracks(spark, sf_dir), P.with_(stitch=0.05, stitch_local=0.10))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merged_tracks(written(A.routes(spark, sf_dir), "routes"))


def q27_cross_route_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("session", "track", "component", "n_tracks")


def q28_identity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.routes(spark, sf_dir)
    null = F.lit(None).cast("double")
    n = F.col("n")
    face = {
        "matched": F.when(F.col("face").isNotNull(), n % 3 == 0), "match_ready": F.when(F.col("face").isNotNull(), n % 5 != 0),
        "category": F.when(n % 4 == 0, "clear").otherwise("poor"), "quality_score": F.when(n % 7 != 0, (n % 11) / 10.0).otherwise(null),
        "match_score": F.when(n % 3 == 0, (n % 13) / 13.0).otherwise(null), "score": (n % 6) / 6.0,
    }
    gait = F.when(F.col("gait").isNotNull(), (n % 9) / 8.0)
    decision = F.when(n % 3 == 0, "hit").when(n % 3 == 1, "stitched").otherwise("grey")
    ids = {"face": F.col("face") % 7, "body": F.col("track") % 7, "gait": F.col("gait") % 7}
    fused = Q.fused_confidence(F.col("track") % 7, F.col("q") / 500.0, decision, face, gait, ids, P)
    rest = {k: v for k, v in fused.items() if k not in ("cues", "strengths")}
    return rows.select("session", "track", *(c.alias(k) for k, c in rest.items()), F.concat_ws(",", fused["cues"]).alias("cues"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir).drop("component", "n_tracks", "merge_agree")
    rows = A.routes(spark, sf_dir).select("session", "track", "first", "q", "n").join(merged, ["session", "track"])
    decision = F.when(F.col("n") % 4 == 0, "local").when(F.col("cross_merged"), "merged").otherwise("hit")
    return rows.select("session", "track", "subject", "first", (F.col("q") / 500.0).alias("score"), decision.alias("decision"), (F.col("n") % 9 == 0).alias("split"), "merge_routes", "cross_merged")


def q29_person_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.persons(_resolved(spark, sf_dir))


def q30_subject_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.subject_gallery(_resolved(spark, sf_dir))


def _window_frames(spark: SparkSession, sf_dir: str, cut: Cut | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames of each window with an event mark and a signature, and the detections in it."""
    found_windows, found, frames = cut or _windows(spark, sf_dir)
    signature = found.groupBy("session", "frame").agg(F.array(F.lit(1.0), F.sum("k") / 40.0, F.max("x1") / 20.0).alias("signature"), F.max(F.col("k") >= 90).alias("marked"))
    rows = windows.members(found_windows, frames.join(signature, ["session", "frame"], "left"))
    rows = rows.select("session", F.col("first").alias("window"), "frame", F.coalesce("marked", F.lit(False)).alias("has_event"), "signature")
    inside = windows.members(found_windows, found.select("session", "frame", "track", "quality")).withColumnRenamed("first", "window").drop("last")
    return rows, inside


def q31_keyframe_events_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, inside = _window_frames(spark, sf_dir)
    best = keyframes.track_best(inside, ["session", "window"]).withColumn("best", F.lit(True))
    marked = keyframes.with_context(rows, ["session", "window"]).join(best, ["session", "window", "frame"], "left")
    return marked.select("session", "window", "frame", "has_event", "near", F.coalesce("best", F.lit(False)).alias("best"))


def q32_keyframe_even_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _window_frames(spark, sf_dir)
    return keyframes.capped(rows, ["session", "window"], P.max_keyframes)


def q33_keyframes_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes.select_keyframes(*_window_frames(spark, sf_dir), ["session", "window"], P)


def q34_temporal_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes.spaced_candidates(A.detections(spark, sf_dir), ["session", "track"], "quality", P.with_(candidate_gap=30))


def q35_spatial_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _window_frames(spark, sf_dir)
    shown = rows.where("has_event").select("session", "window", "frame")
    return context.grounding(shown, A.detections(spark, sf_dir), A.WIDTH, A.HEIGHT)


def q36_scene_text_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.scene_text(A.text_lines(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def q37_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("conv_id") * 1000 + F.col("turn")
    rows = _turns(spark, sf_dir).select(F.concat(F.col("role"), F.lit("#"), F.col("conv_id") % 20).alias("subject"), place.alias("place"), F.concat(F.col("conv_id"), F.lit("~"), F.col("turn")).alias("range"))
    return context.roster(rows)


def q38_timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as windows: whole turns as reports, the first turn as summary, and a level made up from the turns."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("window"), F.col("turn").alias("nth"), F.concat(F.lit("t"), "turn").alias("time"), F.col("role").alias("subject"), (F.col("turn") % 3 == 2).alias("abnormal"), F.col("text").alias("action"))
    level = F.when(F.bool_or("abnormal"), "alert").when(F.count(F.lit(1)) > 2, "attention")
    summary = F.when(F.col("window") % 2 == 0, F.min_by("action", F.struct("nth", "action")))
    found = turns.groupBy("window").agg(F.min("nth").alias("begins"), F.max("nth").alias("ends"), level.alias("level"), summary.alias("summary"))
    return context.timeline(found, turns)


def q39_max_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.observations(spark, sf_dir).select("session", "track", F.when(F.col("k") >= 97, "alert").when(F.col("k") >= 85, "attention").when(F.col("k") >= 5, "normal").alias("level"))
    return context.highest_alert(rows, ["session", "track"])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def q40_accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_labelled(spark, sf_dir).select(F.col("lang").alias("route"), F.col("source").alias("bin"), (F.col("quality") == 1).alias("right")))


def q41_calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration(_labelled(spark, sf_dir).select("lang", F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("good")), ["lang"])


def q42_paired_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    side = lambda right, by: labels.select(F.col("doc_id").alias("sample_id"), F.when(right, "yes").otherwise("no").alias("pred"), right.alias("right"), (F.col("toxic") == 0).alias("genuine"), (F.col("doc_id") % by / float(by)).alias("confidence"))
    return evaluate.transitions(side(F.col("quality") == 1, 10), side((F.col("quality") + F.col("doc_id")) % 3 == 1, 7))


def q43_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    present = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(read_table(spark, sf_dir, "benchmark").select(-1 - F.col("item_id")))
    return evaluate.coverage(expected, present, "id")


def q44_route_semijoin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.detections(spark, sf_dir)
    live = tracks.lifespans(found, P).select("session", "track")
    skipped = found.where("k = 0").select("session", "track").distinct()
    return found.join(live, ["session", "track"], "left_semi").join(skipped, ["session", "track"], "left_anti").select("session", "frame", "track", "event_id")


def q45_id_switch_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.switches(A.detections(spark, sf_dir))


def q46_dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.dominant(A.observations(spark, sf_dir))


def _utc(ts: str = "ts") -> Column:
    return F.col(ts).cast("timestamp")


def q47_session_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events at most half an hour apart, told by a stream over the table once it has read all of it."""
    return _told(stream_windows.session_windows(_event_stream(spark, sf_dir), late="60 days"), "q47")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.readStream.schema(read_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")  # a pattern: the table is a file or a folder
    return events.select(F.col("event_type").alias("session"), _utc().alias("ts"))


def _told(stream: DataFrame, name: str) -> DataFrame:
    told = stream_windows.drained(stream, name, "complete")
    return told.select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def q48_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.payload(q09_window_summary(spark, sf_dir))


def q49_face_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes made of all detections matched with the large boxes of all detections of their frame."""
    found = A.detections(spark, sf_dir)
    faces = found.select("session", "frame", F.col("track").alias("face"), "x1", "y1", (F.col("x1") + 12).alias("x2"), (F.col("y1") + 14).alias("y2"))
    return tracks.associate(faces, found, P)


def q50_stitch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.stitch(_vector_tracks(spark, sf_dir), P.with_(stitch=0.05, stitch_local=0.10))


def q51_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.observations(spark, sf_dir).select(F.col("track").alias("pid"), F.col("event_id"))
    return evaluate.seeded_sample(rows, "pid", "event_id", 20, 3, "seed")


def q52_cross_route_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("session", "track", "subject", "merge_routes", "merge_agree", "cross_merged")


def _face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes of all detections, with grades made up from the events' numbers."""
    return _graded_faces(A.detections(spark, sf_dir))


def _graded_faces(found: DataFrame) -> DataFrame:
    k = F.col("k")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), by % len(names) + 1)
    return found.select(
        "session", "frame", F.col("track").alias("face"), "x1", "y1", (F.col("x1") + 12).alias("x2"), (F.col("y1") + 14).alias("y2"), (k / 100.0).alias("det"), (k % 11 / 10.0).alias("quality"),
        pick(("poor", "marginal", "clear"), k).alias("category"), pick(("unusable", "recoverable", "direct", "direct"), k).alias("eligibility"), (k % 2 == 0).alias("restored"),
    )


def q53_face_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face record of each track: its three best frames are looked at, and bodies have vectors made up of numbers."""
    found = A.detections(spark, sf_dir)
    best = tracks.best_evidence(found, P).select("session", "track", "best_frame", (F.col("track") % 13 == 0).alias("skipped"))
    nth = F.row_number().over(W.partitionBy("session", "track").orderBy(F.desc("quality"), "frame"))
    candidates = found.where("track % 7 <> 0").withColumn("nth", nth).where(F.col("nth") <= P.candidates).select("session", "track", "frame")
    vectors = found.where("k % 10 <> 0").select("session", "track", "frame", F.array(F.col("k") % 7 - 3.0, F.col("track") % 5 - 2.0, F.lit(1.0)).alias("vec"))
    return attach.attach_faces(best, candidates, _face_rows(spark, sf_dir), found, vectors, P).drop("det", "error")


def q54_best_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _face_rows(spark, sf_dir).select(F.concat("session", F.lit("/"), "frame").alias("image"), "face", "quality", F.when(F.col("eligibility") != "unusable", F.array("det")).alias("vec"))
    return attach.best_embedded(faces).select("image", "face", "quality")


def q55_merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = A.routes(spark, sf_dir).select("session", "track", F.when(n % 4 == 0, "hit").when(n % 4 == 1, "stitched").when(n % 4 == 2, "grey").alias("decision"), (n % 6 == 0).alias("reused"))
    return resolve.merge_decisions(rows, _merged(spark, sf_dir))


def q56_route_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = A.routes(spark, sf_dir).join(_merged(spark, sf_dir).select("session", "track", "subject"), ["session", "track"])
    status = F.when(n % 5 == 0, "failed").when(n % 5 == 1, "same_frame").otherwise("passed")
    strict = attach.face_route(n % 2 == 0, n % 3 != 0, F.when(n % 7 != 0, "direct").otherwise("recoverable"), F.when(n % 4 != 3, "clear").otherwise("poor"), status, F.col("face"))
    return resolve.route_subjects(rows, strict)


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.detections(spark, sf_dir).select("session", "frame").distinct().withColumn("at", G.clock(F.col("frame") * 1.5))


def q57_object_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thing_texts(spark, sf_dir, _windows(spark, sf_dir))


def _thing_texts(spark: SparkSession, sf_dir: str, cut: Cut) -> DataFrame:
    return context.object_text(_things(cut), _clocks(spark, sf_dir))


def q58_grounding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.grounding_text(q35_spatial_grounding(spark, sf_dir))


def _window_persons(spark: SparkSession, sf_dir: str, cut: Cut | None = None) -> DataFrame:
    found_windows, found, _ = cut or _windows(spark, sf_dir)
    t, n = F.col("track"), F.col("n")
    best = found.groupBy("session", "track").agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), "frame").alias("b")).select("session", "track", *(F.col(f"b.{c}").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    ids = A.routes(spark, sf_dir).select(
        "session", "track", F.when(n % 5 != 0, t % 9).alias("subject"), F.when(n % 7 != 0, F.col("q") / 500.0).alias("score"), F.when(n % 3 == 0, "hit").when(n % 3 == 1, "grey").otherwise("new").alias("decision"), (n % 2 == 0).alias("reused"),
        (t % 17 == 0).alias("local"), (t % 19 == 0).alias("split"), F.when(n % 4 == 0, "body,face").when(n % 4 == 1, "gait").alias("merge_routes"), F.when(t % 4 == 0, t).alias("face"), F.when(t % 3 == 0, t).alias("gait"), F.when(n % 2 == 0, n / 10.0).alias("fused"),
    )
    return resolve.window_persons(found_windows, found, ids.join(best, ["session", "track"]), A.WIDTH, A.HEIGHT)


def q59_window_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p: F.concat(p["x"], F.lit(","), p["y"])
    return _window_persons(spark, sf_dir).select(
        "session", "window", "person", "track", F.array_join("tracks", ",").alias("tracks"), "subject", "decision", "reused", "score", "face", "gait", "fused", "merge_routes",
        F.array_join("box", ",").alias("box"), F.array_join(F.transform("path", text), ";").alias("path"),
    )


def q60_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.path_summary(_window_persons(spark, sf_dir), 5, P)


def _identity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _window_persons(spark, sf_dir)
    nth = F.row_number().over(W.partitionBy("session", "window").orderBy("track"))
    has = lambda c: F.col(c).isNotNull()
    quality = F.when(F.col("face") % 8 == 0, "clear").otherwise("poor")
    cues = context.cue_text(has("face"), F.col("face") % 8 == 0, quality, F.col("face") % 10 / 10.0, has("score"), F.col("score"), has("gait"), F.col("gait") % 10 / 10.0)
    fused = context.fused_text(F.col("fused"), F.size("tracks") > 1, F.replace("merge_routes", F.lit(","), F.lit("+")))
    frame = F.when(F.col("track") % 2 == 0, F.col("window"))
    evidence = context.evidence_text(frame, F.lit("a"), F.col("face"), F.lit("b"))
    rows = people.select("session", "window", nth.alias("nth"), "track", F.when(F.col("track") % 11 == 0, F.concat(F.lit("n"), "track")).alias("name"), "subject", "decision", "reused", "box", fused.alias("fused"), cues.alias("cues"), evidence.alias("evidence"), F.lit(None).cast("string").alias("path"))
    return context.identity_lines(rows)


def q61_identity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identity_lines(spark, sf_dir)


def q62_window_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked about each window: its event frames with their times, and the text of its objects."""
    cut = _windows(spark, sf_dir)
    return context.window_requests(cut[0].withColumnRenamed("first", "window"), _shown(spark, sf_dir, cut), {"objects": _thing_texts(spark, sf_dir, cut)})


def q63_person_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.person_rows(A.observations(spark, sf_dir)).select("session", "frame", "track", "event_id")


def q64_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.text_lines(spark, sf_dir).withColumn("conf", F.length("text") * 37 % 100 / 100.0)
    return context.read_text(lines, P).select("session", "frame", "line", "text", "conf", "nth")


def q65_gait_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.sequences(A.detections(spark, sf_dir), P.gait_frames).withColumn("frames", F.array_join("frames", ","))


def q66_colour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, asked = F.col("k"), F.element_at(F.array(*map(F.lit, (" Red ", "红", "green", "绿", "蓝", "grey", "黑"))), F.col("track").cast("int") % 7 + 1)
    found = V.colour_class(F.lit(k * 37 % 256).cast("double"), F.lit(k * 91 % 256).cast("double"), F.lit(k * 53 % 256).cast("double"))
    rows = A.observations(spark, sf_dir).select("event_id", found.alias("colour"), asked.alias("asked"))
    return rows.withColumn("matches", V.colour_matches(F.col("colour"), F.col("asked")))


def q67_gallery_with_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against a gallery of the subjects under 5 and the others as distractors."""
    rows = A.shots(spark, sf_dir).withColumnRenamed("vec_id", "row")
    probes = rows.where("row % 100 = 0").select(F.col("row").alias("query"), "vec")
    return gallery.nearest(probes, gallery.with_distractors(rows.where("subject < 5"), rows.where("subject >= 5")), 10).withColumn("score", F.round("score", 6))


def q68_changing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.text_lines(spark, sf_dir)
    return context.changing_text(lines, context.scene_text(lines))


def q69_gate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose label is in a list given as text."""
    wanted = V.class_set(F.lit(" car, bus,,truck ,car"))
    return A.detections(spark, sf_dir).where(F.array_contains(wanted, F.col("label"))).select("session", "frame", "track", "label")


def q70_threshold_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_for(q41_calibration_curve(spark, sf_dir), ["lang"], 0.5)


def q71_reject_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reject_curve(q41_calibration_curve(spark, sf_dir))


def q72_object_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.object_tracks(A.detections(spark, sf_dir), P)


def q73_track_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and middles of each track, spelled as texts in order of frames."""
    found = tracks.paths(A.detections(spark, sf_dir))
    box = lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))
    point = lambda c: F.concat(c["frame"], F.lit(":"), c["x"], F.lit(","), c["y"])
    return found.select("session", "track", F.array_join(F.transform(F.map_entries("boxes"), box), ";").alias("boxes"), F.array_join(F.transform("centres", point), ";").alias("centres"))


def q74_gallery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery.gallery_stats(A.shots(spark, sf_dir))


def q75_stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stage_times(A.observations(spark, sf_dir).select(F.concat("session", F.lit("/"), "label").alias("stage"), F.col("k").alias("seconds")))


def q76_first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _window_frames(spark, sf_dir)
    return keyframes.first_frames(rows, ["session", "window"], P.max_keyframes).select("session", "window", "frame")


def q77_text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrangles of text read from a crop, as upright boxes of the whole frame."""
    rows = A.observations(spark, sf_dir)
    at = lambda x, y: F.array(F.col("x1") + x, F.col("y1") + y)
    corners = F.array(at(0, F.col("k") % 5), at(F.col("k") % 30, 0), at(F.col("k") % 30 + 2, 9), at(-1.0, 10))
    x1, y1, x2, y2 = context.box_of_points(corners, F.col("track") % 8, F.col("track") % 3)
    return rows.select("event_id", x1.alias("left"), y1.alias("top"), x2.alias("right"), y2.alias("bottom"))


def q78_match_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which image of a face is matched, whether a restored one's rating will do, and how promising its region looks."""
    faces = _face_rows(spark, sf_dir)
    ok, why = Q.restored_ok(F.when(F.col("quality") > 0.1, F.col("quality")), P)
    proxy = Q.proxy_quality(F.col("quality"), F.col("x2") - F.col("x1") + F.col("face"), F.col("y2") + 1, F.col("det"), F.col("x1") == 0)
    return faces.select("session", "frame", "face", Q.match_source(F.col("eligibility"), F.col("restored")).alias("source"), ok.alias("rating_ok"), why.alias("why"), proxy.alias("proxy"))


def q79_parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON as it is or in a fenced block, parsed."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("told: ```json\n"), "props", F.lit("\n``` end"))).when(F.col("event_id") % 7 == 0, "no json").otherwise(F.col("props"))
    return read_table(spark, sf_dir, "events").select("event_id", V.parsed_json(text, "k int")["k"].alias("k"))


def q80_label_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable colour angle for each part's name, and its content as a data URI and back."""
    parts = read_table(spark, sf_dir, "part")
    uri = V.data_uri("text/plain", F.encode("p_name", "UTF-8"))
    return parts.select("p_partkey", V.stable_hue(F.when(F.col("p_partkey") % 9 != 0, F.col("p_name"))).cast("long").alias("hue"), uri.alias("uri"), F.decode(V.from_data_uri(uri), "UTF-8").alias("back"))


def q81_labelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made up of vectors' numbers: the id that they begin with, the mark at their end, and whether they are safe."""
    i = F.col("vec_id")
    name = F.concat(F.when(i % 4 != 0, F.concat(i % 300, F.lit("-"))).otherwise(""), F.lit("img"), F.when(i % 3 == 0, "-F").when(i % 3 == 1, "-f").otherwise(""), F.when(i % 5 == 0, ".mp4").when(i % 5 == 1, "/../x.MP4").otherwise(".JPG"))
    pid, marked = files.labelled_name(name)
    return A.shots(spark, sf_dir).select("vec_id", name.alias("name"), pid.alias("pid"), marked.alias("marked"), files.safe_name(name).alias("safe"))


def q82_checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the right size, whether they are finite, and their length."""
    vec = V.checked(F.col("vec"), 64)
    return A.shots(spark, sf_dir).select("vec_id", V.finite(vec).alias("finite"), F.round(V.norm(vec), 6).alias("norm"), F.round(V.dot(V.unit(vec), V.unit(vec)), 6).alias("one"))


def q83_torso_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torsos from key points made up of the events' numbers, where shoulders and hips can tell."""
    k, t = F.col("k"), F.col("track")
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda x, y, sure: (F.col("x1") + wide * F.lit(x), F.col("y1") + high * F.lit(y), sure)
    sure = lambda by: F.when(k % by == 0, 0.25).otherwise(0.75)
    shoulders = [at(0.25, 0.25, sure(3)), at(0.75, 0.25, sure(4))]
    hips = [at(0.375, 0.75, F.when(t % 3 == 0, 0.25).otherwise(0.75)), at(0.625, 0.75, F.when(t % 2 == 0, 0.25).otherwise(0.75))]
    rows = A.detections(spark, sf_dir).select("event_id", G.torso_from_points(G.box(), shoulders, hips).alias("t")).where("t is not null")
    return rows.select("event_id", *(F.round(f"t.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")), "t.source")


def q84_adaptive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 24 frames of each session, chosen by scene."""
    scenes = _scenes(spark, sf_dir)
    return keyframes.adaptive_frames(scenes, 0.97, 12, 24)


def q85_exposed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery.exposed(q20_subject_candidates(spark, sf_dir)).select("query", "subject", "nth")


def q86_sliding_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of an hour that begin every half hour, told by a stream once it has read the whole table."""
    return _told(stream_windows.timed_windows(_event_stream(spark, sf_dir), "60 minutes", "30 minutes", late="60 days"), "q86")


def q87_covered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.covered_frames(_windows(spark, sf_dir)[0])


def q88_manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment")
    return rows.select("c_custkey", files.manifest_hash(rows).alias("hash"))


def q89_limited_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 steps of two hours of each session."""
    frames = A.observations(spark, sf_dir).select("session", "frame")
    return keyframes.sampled(frames, F.col("frame") * A.FRAME_SECONDS, 7200.0, 40)


#: The identity run's thresholds for sightings, whose tracks have few frames.
RUN = Params().with_(gait_frames=5, candidate_gap=4, stitch=0.6, stitch_local=0.7)


def _run_tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sightings (written), and their tracks with gate and best frame, in order of appearance (written)."""
    found = written(A.sightings(spark, sf_dir), "sightings")
    return found, written(identify.ordered(tracks.overviews(found, RUN).withColumn("ok", F.col("k") % 4 != 0)), "tracks")


def _run_bodies(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The tracks' identities by their bodies, whose vectors stand in no table: they are made on the way to the fold."""
    return identify.body_identities(_body_vectors(spark, sf_dir, rows, F.col("best_frame")), RUN)


def _body_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, frame: Column) -> DataFrame:
    return A.mixed_vectors(spark, sf_dir, rows, F.col("user"), F.col("track") * 37 + frame, F.col("k") % 10 * 0.12)


def _run_faces(spark: SparkSession, sf_dir: str, found: DataFrame, rows: DataFrame) -> DataFrame:
    """The face record of each track with the gallery's answer: two candidate frames each, some of which fail."""
    faces = _graded_faces(found)
    candidates = keyframes.spaced_candidates(found.where("track % 7 <> 0"), ["session", "track"], "quality", RUN.with_(candidates=2)).select("session", "track", "frame", F.col("nth").alias("round"))
    at = ["session", "track", "frame"]
    bodies = lambda asked: _body_vectors(spark, sf_dir, found.where("k % 10 <> 9").select(*at, "user", "k").join(asked, at, "left_semi"), F.col("frame"))
    frames = found.select("session", "frame").distinct()
    fails = lambda by, stage: frames.where(F.col("frame") % by == 0).select("session", "frame", F.lit(stage).alias("stage"), F.concat(F.lit(f"{stage}: "), "frame").alias("error"))
    failures = fails(7, "detect").unionByName(fails(11, "open")).unionByName(fails(13, "finalize"))
    records = attach.attach_faces(rows.select("session", "track", "best_frame", "skipped"), candidates, faces, found, bodies, RUN.with_(face_consistency=0.5), failures=failures)
    records = written(records, "records")
    asked = records.where("match_ready").select("session", "frame", F.col("face").alias("track")).distinct()
    seen = found.where("k % 12 <> 5").select(*at, "user", "k").join(asked, at, "left_semi")
    vectors = A.mixed_vectors(spark, sf_dir, seen, F.col("user") * 3 + 1, F.col("track") * 41 + F.col("frame"), F.col("k") % 8 * 0.2)
    return written(attach.matched_faces(records, vectors.select("session", "frame", F.col("track").alias("face"), "vec"), rows, RUN), "faces")


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The identity run from detections and vectors on: sightings, tracks after stitching, and the identities (written)."""
    found, rows = _run_tracks(spark, sf_dir)
    bodies = written(_run_bodies(spark, sf_dir, rows), "bodies")
    walks = found.groupBy("session", "track").agg(F.count_distinct("frame").alias("n_frames"), F.max("user").alias("user"), F.max("k").alias("k"))
    walks = A.mixed_vectors(spark, sf_dir, walks.join(rows.where("not skipped").select("session", "track"), ["session", "track"]), F.col("user") * 5 + 2, F.col("track") * 43, F.col("k") % 7 * 0.2)
    gaits = identify.gait_identities(walks, rows, RUN)
    return found, bodies, written(identify.resolved(bodies, _run_faces(spark, sf_dir, found, rows), gaits, RUN), "identities")


def q90_identity_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track's identity after enrolment, stitching, faces, gait, merging, splitting and fusion."""
    return _run(spark, sf_dir)[2].select(
        "session", "track", "nth", "skipped", "body", "subject", "decision", "score", "stitch_score", "reused", "local", "cross_merged", "split", "face_status", "face_local", "face_matched", "face_match_score",
        "gait", "gait_decision", "merge_routes", "merge_agree", "route_body", "route_face", "route_gait", "confidence", "resolved", "multi_source", "agreed", "primary", F.array_join("cues", ",").alias("cues"),
    )


def q91_run_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persons of each window, from detections and vectors in one run."""
    found, _, identities = _run(spark, sf_dir)
    frames = written(A.frames(found), "frames")
    cut = written(windows.whole_if_idle(windows.capped_windows(frames, QUIET, CAP), frames), "windows")
    at = tracks.best_evidence(found, RUN).select("session", "track", F.col("best_frame").alias("frame"))
    best = found.join(at, ["session", "track", "frame"]).select("session", "track", *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    people = identify.window_identities(cut, found, identities, best, A.WIDTH, A.HEIGHT)
    text = lambda p: F.concat(p["x"], F.lit(","), p["y"])
    return people.select(
        "session", "window", "person", "track", F.array_join("tracks", ",").alias("tracks"), "subject", "decision", "reused", "score", "face", "gait", "fused", "merge_routes", "merge_agree",
        F.array_join("attributes", "|").alias("attributes"), F.array_join("box", ",").alias("box"), F.array_join(F.transform("path", text), ";").alias("path"),
    )


def q92_run_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face records of the run: what failed, what was chosen, and what the face gallery said."""
    return _run_faces(spark, sf_dir, *_run_tracks(spark, sf_dir))


def q93_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the run's frames, those of things and of known persons included."""
    found, rows = _run_tracks(spark, sf_dir)
    events = tracks.frame_events(found, spans=rows).unionByName(tracks.object_events(found, RUN))
    return events.unionByName(identify.identity_hits(_run_bodies(spark, sf_dir, rows)))


def q94_object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of frames and of things over the detections."""
    found = A.detections(spark, sf_dir)
    return tracks.frame_events(found).unionByName(tracks.object_events(found, P))


def q95_capped_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q08's windows, told by a stream over the events whose timers close what stays open."""
    events = spark.readStream.schema(read_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")
    frames = events.select(F.col("event_type").alias("session"), A.frame_of().alias("frame"), _utc().alias("ts"))
    cut = lambda stream: stateful.capped_windows(stream, QUIET, CAP, A.EPOCH_MS, A.FRAME_SECONDS * 1000, late="60 days", idle_ms=365 * 86_400_000)
    return stateful.told_to_the_end(frames, cut, "q95")


def _user_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observations(spark, sf_dir).groupBy(F.col("track").alias("pid")).agg(F.avg("quality").alias("value"))


def q96_bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of users' mean qualities over 200 draws of as many users as there are, with replacement."""
    return evaluate.drawn_means(_user_means(spark, sf_dir), 200, "b7").withColumn("mean", F.round("mean", 6))


def q97_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.interval(evaluate.drawn_means(_user_means(spark, sf_dir), 200, "b7"))
    return found.select("draws", *(F.round(c, 6).alias(c) for c in ("low", "high", "centre")))


def q98_fallback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spaced candidates of each track with its best frame among them."""
    found, p = A.detections(spark, sf_dir), P.with_(candidate_gap=30)
    return keyframes.with_fallback(keyframes.spaced_candidates(found, ["session", "track"], "quality", p), tracks.best_evidence(found, P), ["session", "track"], p)


def q99_scene_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each forty documents of a source, as seen in a window's frames."""
    at = F.when(F.col("frame") % 4 != 0, G.clock(F.col("frame") * 1.0))
    return context.scene_context(A.text_lines(spark, sf_dir).withColumns({"window": F.floor(F.col("frame") / 40) * 40, "at": at}))


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities made up from the events' numbers, as in q59."""
    n = F.col("n")
    return A.routes(spark, sf_dir).select("session", "track", F.when(n % 5 != 0, F.col("track") % 9).alias("subject"), F.when(n % 3 == 0, "hit").when(n % 3 == 1, "grey").otherwise("new").alias("decision"))


def _shown(spark: SparkSession, sf_dir: str, cut: Cut | None = None) -> DataFrame:
    rows, _ = _window_frames(spark, sf_dir, cut)
    return rows.where("has_event").select("session", "window", "frame", F.when(F.col("frame") % 4 != 0, G.clock(F.col("frame") * 1.5)).alias("at"))


def q100_identity_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is where in each event frame, by subject."""
    rows = context.identity_grounding(_shown(spark, sf_dir), A.detections(spark, sf_dir), _standing(spark, sf_dir), A.WIDTH, A.HEIGHT)
    return rows.select("session", "window", "frame", "track", "subject", "label", "decision", *(F.array_join(c, ",").alias(c) for c in ("box", "norm", "middle")))


def q101_identity_grounding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of q100's persons and of the persons' paths, three persons a frame and five paths a window at most."""
    cut = _windows(spark, sf_dir)
    shown = _shown(spark, sf_dir, cut)
    rows = context.identity_grounding(shown, cut[1], _standing(spark, sf_dir), A.WIDTH, A.HEIGHT)
    return context.identity_grounding_text(shown, rows, _window_persons(spark, sf_dir, cut), 3, 5, P)


def q102_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their events, persons and things, as whole documents."""
    cut = found_windows, found, frames = _windows(spark, sf_dir)
    events = windows.members(found_windows, tracks.frame_events(found, frames)).select("session", F.col("first").alias("window"), F.col("event").alias("nth"), F.col("event").alias("item")).distinct()
    people = _window_persons(spark, sf_dir, cut).select("session", "window", F.col("track").alias("nth"), F.struct("track", "tracks", "subject", "decision", "score", "box").alias("item"))
    things = _things(cut).select("session", "window", "nth", F.struct("track", "label", "frames_present", "direction", "conf").alias("item"))
    head = {"schema": F.lit(2), "size": F.array(F.lit(A.WIDTH), F.lit(A.HEIGHT))}
    return context.documents(found_windows.withColumnRenamed("first", "window"), {"events": events, "people": people, "objects": things}, head)


def q103_person_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What persons' lines say of paths, colours and attributes."""
    colour = F.when(F.col("track") % 3 == 0, F.lit("red"))
    return _window_persons(spark, sf_dir).select("session", "window", "person", context.path_text(F.col("path")).alias("path"), context.attribute_text(colour, F.col("attributes")).alias("attributes"))


def q104_roster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who appears when in each ten conversations: users by conversation, assistants' turns as ranges."""
    turns = _turns(spark, sf_dir).select(F.floor(F.col("conv_id") / 10).alias("session"), F.concat(F.lit("主体#"), F.col("conv_id") % 7).alias("subject"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), F.concat(F.col("conv_id"), F.lit("~"), F.col("turn")).alias("range"), "role", "turn")
    return context.roster_text(turns, turns.where("role = 'assistant' and turn > 4"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}

__all__ = ["ORACLES", "QUERIES"]
