"""Thresholds of the operators, as one frozen value that is passed along; no global settings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Every threshold has the default that the rule cards name; `with_` overrides some, ignoring None."""

    # search and decision
    top_k: int = 30
    hit: float = 0.6
    new: float = 0.4
    low_quality_hit: float = 0.88
    vote: float = 0.55
    vote_share: float = 0.5
    margin: float = 0.03
    max_shots: int = 8
    negative_similarity: float = 0.92
    negative_size: int = 256
    consistency: bool = True
    # quality of a region
    min_area: float = 1600.0
    min_blur: float = 20.0
    aspect_low: float = 0.8
    aspect_high: float = 4.0
    reference_area: float = 20000.0
    # quality of a face
    face_min_det: float = 0.5
    face_min_size: float = 28.0
    face_recoverable_size: float = 20.0
    face_enhance_size: float = 90.0
    face_min_blur: float = 15.0
    face_clear_blur: float = 60.0
    face_reference_area: float = 10000.0
    yaw_clear: float = 25.0
    yaw_max: float = 80.0
    pitch_clear: float = 20.0
    pitch_down: float = 35.0
    pitch_up: float = 50.0
    fiqa_poor: float = 0.3
    fiqa_clear: float = 0.6
    # association of small boxes with large ones
    contain: float = 0.6
    head_low: float = -0.05
    head_high: float = 0.48
    ambiguity: float = 0.08
    match_iou: float = 0.3
    face_consistency: float = 0.82
    face_hit: float = 0.45
    face_new: float = 0.30
    gait_frames: int = 10
    # evidence
    candidates: int = 3
    candidate_gap: int = 2
    # tracks and windows
    track_min_frames: int = 3
    track_min_quality: float = 0.0
    quiet_seconds: float = 2.0
    window_seconds: float = 30.0
    fps: float = 2.0
    max_keyframes: int = 24
    context: int = 1
    same_signature: float = 0.06
    # resolution and fusion
    stitch: float = 0.45
    stitch_local: float = 0.82
    face_weight: float = 0.5
    body_weight: float = 0.3
    gait_weight: float = 0.2
    blurry_factor: float = 0.35
    quality_floor: float = 0.3
    agree_bonus: float = 0.15
    resolve: float = 0.5
    # objects and text
    object_classes: tuple[str, ...] = ("backpack", "handbag", "suitcase", "car", "truck", "bus", "motorcycle", "bicycle")
    object_min_conf: float = 0.35
    object_min_frames: int = 2
    text_min_conf: float = 0.5
    moved: float = 0.05

    def __post_init__(self) -> None:
        if not 0 < self.face_recoverable_size <= self.face_min_size <= self.face_enhance_size:
            raise ValueError("sizes must rise: recoverable, minimum, enhanced")
        if self.candidates < 1 or self.candidate_gap < 1 or self.top_k < 1:
            raise ValueError("candidates, candidate_gap and top_k must be at least 1")

    def with_(self, **changes) -> Params:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"no such threshold: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    def quiet_frames(self) -> int:
        return max(1, round(self.quiet_seconds * self.fps))

    def window_frames(self) -> int | None:
        n = round(self.window_seconds * self.fps)
        return n if n > 0 else None


DEFAULT = Params()
