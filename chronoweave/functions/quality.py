"""Column functions that grade evidence: region quality, the face quality tree, confidence bands and fused confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.params import DEFAULT, Params


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def body_quality(blur: Column, area: Column, p: Params = DEFAULT) -> Column:
    return blur * F.least(F.lit(1.0), area / p.reference_area)


def proxy_quality(sharpness: Column, width: Column, head_height: Column, conf: Column, clipped: Column) -> Column:
    """How promising a region is before anything is read from it; a region that the frame cuts off counts for less."""
    size = F.least(F.lit(1.0), width * head_height / 6000)
    return sharpness * size * clamp(conf) * F.when(clipped, 0.65).otherwise(1.0)


def region_reason(area: Column, blur: Column, aspect: Column, p: Params = DEFAULT) -> Column:
    """Why a region is refused (null: it is accepted); unknown quality is accepted."""
    return (
        F.when(area.isNull() & blur.isNull() & aspect.isNull(), F.lit(None).cast("string"))
        .when(area < p.min_area, "too_small")
        .when(blur < p.min_blur, "too_blurry")
        .when((aspect < p.aspect_low) | (aspect > p.aspect_high), "bad_aspect_ratio")
    )


class Face:
    """The quality tree of a face from its size, five key points, detection score, blur and rating, as columns."""

    def __init__(self, width: Column, height: Column, det: Column, points: list[tuple[Column, Column]] | None, blur: Column, fiqa: Column, p: Params = DEFAULT) -> None:
        zero = F.lit(0.0)
        self.p, self.det, self.blur, self.fiqa = p, det, blur, fiqa
        self.short, self.area = F.least(width, height), width * height
        if points:
            (lx, ly), (rx, ry), (nx, ny), (mx, my), (qx, qy) = points
            eye_x, eye_y, mouth_y = (lx + rx) / 2, (ly + ry) / 2, (my + qy) / 2
            apart = F.hypot(rx - lx, ry - ly)
            apart = F.when(apart == 0, 1.0).otherwise(apart)
            tall = mouth_y - eye_y
            within = lambda c: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c))
            self.frontal = F.greatest(zero, 1 - F.abs(nx - eye_x) / apart)
            self.yaw = within((nx - eye_x) / (apart / 2) * 90)
            self.pitch = F.when(F.abs(tall) < 1e-3, 0.0).otherwise(within(((ny - eye_y) / tall - 0.5) * 200))
        else:
            self.frontal = self.yaw = self.pitch = zero
        self.yaw_bad = F.abs(self.yaw) >= p.yaw_max
        self.pitch_bad = (self.pitch <= -p.pitch_down) | (self.pitch >= p.pitch_up)
        self.angle_clear = (F.abs(self.yaw) <= p.yaw_clear) & (F.abs(self.pitch) <= p.pitch_clear)
        self.det_bad = det < p.face_min_det
        self.blur_bad = F.coalesce(blur < p.face_min_blur, F.lit(False))
        self.degraded = F.coalesce(blur < p.face_clear_blur, F.lit(False))
        self.size_bad = self.short < p.face_min_size

    def category(self) -> Column:
        poor = self.yaw_bad | self.pitch_bad | self.blur_bad | self.det_bad | self.size_bad
        return F.when(poor, "poor").when(self.angle_clear & ~self.degraded & ~self.det_bad, "clear").otherwise("marginal")

    def defects(self) -> Column:
        p = self.p
        found = F.array(
            F.when(self.size_bad, "small_face"),
            F.when(self.yaw_bad, "extreme_yaw").when(F.abs(self.yaw) > p.yaw_clear, "pose_yaw"),
            F.when(self.pitch_bad, "extreme_pitch").when(F.abs(self.pitch) > p.pitch_clear, "pose_pitch"),
            F.when(self.degraded, "blur"),
            F.when(self.det_bad, "low_detection"),
            F.when(self.fiqa < p.fiqa_clear, "low_fiqa"),
            F.when(self.fiqa.isNull(), "fiqa_unavailable"),
        )
        return F.array_compact(found)

    def reason(self) -> Column:
        return (
            F.when(self.size_bad, "too_small").when(self.yaw_bad, "yaw_extreme")
            .when(self.pitch <= -self.p.pitch_down, "pitch_down").when(self.pitch >= self.p.pitch_up, "pitch_up")
            .when(self.blur_bad | self.det_bad, "too_blurry")
        )

    def score(self) -> Column:
        p = self.p
        sharp = F.when(self.blur.isNull(), 1.0).otherwise(F.least(F.lit(1.0), self.blur / p.face_clear_blur))
        return self.det * (0.5 + 0.5 * self.frontal) * (0.5 + 0.5 * F.least(F.lit(1.0), self.area / p.face_reference_area)) * sharp

    def eligibility(self) -> Column:
        p = self.p
        small_enough = (self.short >= p.face_recoverable_size) & (self.short <= p.face_enhance_size)
        return (
            F.when(self.yaw_bad | self.pitch_bad | self.det_bad | (self.short < p.face_recoverable_size), "unusable")
            .when(self.size_bad, "recoverable")
            .when((self.blur_bad | self.degraded) & small_enough, "recoverable")
            .when(self.blur_bad, "unusable")
            .otherwise("direct")
        )

    def can_enroll(self) -> Column:
        return (self.eligibility() == "direct") & (self.category() == "clear")


def gallery_reason(eligibility: Column, category: Column, enhanced: Column, can_enroll: Column) -> Column:
    """Why a face may not enter the gallery; null: it may."""
    return (
        F.when(eligibility.isNull() & category.isNull(), "missing_face_quality")
        .when(F.coalesce(enhanced, F.lit(False)), "restored_face_not_enrollable")
        .when(~eligibility.eqNullSafe(F.lit("direct")), "face_not_direct")
        .when(~category.eqNullSafe(F.lit("clear")) | ~F.coalesce(can_enroll, F.lit(False)), "face_not_clear")
    )


def match_source(eligibility: Column, restored: Column) -> Column:
    """Which image a face is matched by: itself, a restored one where only that can do, or none."""
    return F.when(eligibility == "direct", "original").when((eligibility == "recoverable") & F.coalesce(restored, F.lit(False)), "superres").otherwise("none")


def restored_ok(fiqa: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """Whether a restored face's rating will do, and why not."""
    missing = fiqa.isNull() | F.isnan(fiqa) | (F.abs(fiqa) == float('inf'))
    reason = F.when(missing, "fiqa_unavailable_or_nonfinite").when(fiqa < p.fiqa_poor, "fiqa_below_poor_threshold")
    return reason.isNull(), reason


# Names of the confidence bands.
BANDS = ("高", "中", "低", "无", "未知")


def confidence_band(score: Column) -> Column:
    high, middle, low, none, unknown = BANDS
    return F.when(score.isNull(), unknown).when(score >= 0.75, high).when(score >= 0.55, middle).when(score > 0, low).otherwise(none)


def fused_confidence(subject: Column, body_score: Column, decision: Column, face: dict[str, Column], gait_score: Column, route_ids: dict[str, Column], p: Params = DEFAULT) -> dict[str, Column]:
    """Confidence from face, body and gait by weight; body's weight counts in every case, so a face alone is held back.

    face: matched, match_ready, category, quality_score, match_score, score (null columns where there is no face).
    """
    zero = F.lit(0.0)
    ready = F.coalesce(face["match_ready"], face["matched"], F.lit(False))
    graded = F.lit(p.face_weight) * (p.quality_floor + (1 - p.quality_floor) * clamp(face["quality_score"]))
    plain = F.lit(p.face_weight) * F.when(face["category"] == "clear", 1.0).otherwise(p.blurry_factor)
    face_w = F.when(ready, F.when(face["quality_score"].isNotNull(), graded).otherwise(plain)).otherwise(0.0)
    face_s = F.coalesce(face["match_score"], face["score"], zero)
    face_s = clamp(F.when(F.coalesce(face["matched"], F.lit(False)), F.greatest(face_s, F.lit(0.6))).otherwise(face_s))
    face_s = F.when(ready, face_s).otherwise(0.0)
    body_s = F.coalesce(body_score, zero)
    body_s = clamp(F.when(decision.isin("hit", "stitched"), F.greatest(body_s, F.lit(0.5))).otherwise(body_s))
    body_w, gait_w = F.lit(p.body_weight), F.when(gait_score.isNotNull(), p.gait_weight).otherwise(0.0)
    gait_s = clamp(F.coalesce(gait_score, zero))
    parts = {"face": (face_s, face_w), "body": (body_s, body_w), "gait": (gait_s, gait_w)}
    total = face_w + body_w + gait_w
    plain_conf = (face_s * face_w + body_s * body_w + gait_s * gait_w) / total
    active = {k: (s > 0) & (w > 0) for k, (s, w) in parts.items()}
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    multi = count(active.values()) >= 2
    same = [active[k] & F.coalesce(route_ids[k] == subject, F.lit(False)) for k in parts]
    agreed = count(same) >= 2
    conf = F.when(agreed, F.least(F.lit(1.0), plain_conf + p.agree_bonus)).otherwise(plain_conf)
    best = F.greatest(*(s * w for s, w in parts.values()))
    primary = F.when(best > 0, F.coalesce(*(F.when(s * w == best, k) for k, (s, w) in parts.items())))
    cues = F.array_compact(F.array(*(F.when(a, k) for k, a in active.items())))
    return {"confidence": F.round(conf, 4), "resolved": conf >= p.resolve, "multi_source": multi, "agreed": agreed, "primary": primary, "cues": cues, "strengths": F.array(*(F.round(s, 3) for s, _ in parts.values()))}
