"""Column functions over boxes and points: centres, normalised boxes, overlap, regions, directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.params import DEFAULT, Params

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def centre(b: Box, width: Column | float, height: Column | float, digits: int = 3) -> tuple[Column, Column]:
    """The box's middle as a share of the frame; frames narrower than 1 count as 1."""
    x = F.round((b[0] + b[2]) / 2 / F.greatest(F.lit(1.0), F.lit(width)), digits)
    y = F.round((b[1] + b[3]) / 2 / F.greatest(F.lit(1.0), F.lit(height)), digits)
    return x, y


def norm_box(b: Box, width: Column | float, height: Column | float) -> Column:
    """The box as shares of the frame, clamped to it, 4 digits; empty without a box or a frame."""
    w, h = F.lit(width), F.lit(height)
    part = lambda v, of: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / of)), 4)
    known = b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull() & b[3].isNotNull() & (w > 0) & (h > 0)
    return F.when(known, F.array(part(b[0], w), part(b[1], h), part(b[2], w), part(b[3], h))).otherwise(F.array().cast("array<double>"))


def centre_of(normed: Column) -> Column:
    at = lambda i: F.element_at(normed, i)
    middle = F.array(F.round((at(1) + at(3)) / 2, 4), F.round((at(2) + at(4)) / 2, 4))
    return F.when(F.size(normed) == 4, middle).otherwise(F.array().cast("array<double>"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def containment(inner: Box, outer: Box) -> Column:
    """The share of the inner box that lies in the outer one."""
    return overlap(inner, outer) / F.greatest(area(inner), F.lit(1e-6))


def admissible(face: Box, person: Box, p: Params = DEFAULT) -> Column:
    """Whether a small box may belong to a large one: middle inside, high enough, contained enough."""
    mid_x = (face[0] + face[2]) / 2
    ratio = ((face[1] + face[3]) / 2 - person[1]) / F.greatest(person[3] - person[1], F.lit(1e-6))
    return mid_x.between(person[0], person[2]) & ratio.between(p.head_low, p.head_high) & (containment(face, person) >= p.contain)


def crop(b: Box, width: Column | float, height: Column | float, least: int = 4) -> tuple[Column, Column, Column, Column, Column]:
    """The box cut to whole pixels within the frame, and whether at least `least` pixels are left each way."""
    w, h = F.lit(width), F.lit(height)
    inside = lambda v, of: F.greatest(F.lit(0), F.least(of.cast("int"), v.cast("int")))
    x1, y1, x2, y2 = inside(b[0], w), inside(b[1], h), inside(b[2], w), inside(b[3], h)
    return x1, y1, x2, y2, (x2 - x1 >= least) & (y2 - y1 >= least)


def region(b: Box, name: str) -> Box:
    """A part of a box in whole pixels: whole, upper or lower half, or torso (42 to 82 % of the height, 18 % off each side)."""
    x1, y1, x2, y2 = (c.cast("int") for c in b)
    w, h = x2 - x1, y2 - y1
    share = lambda of, f: (of * F.lit(f)).cast("int")
    half = F.greatest(F.lit(1), share(h, 0.5))
    parts = {
        "whole": (x1, y1, x2, y2),
        "upper": (x1, y1, x2, y1 + half),
        "lower": (x1, y2 - half, x2, y2),
        "torso": (x1 + share(w, 0.18), y1 + share(h, 0.42), x2 - share(w, 0.18), y1 + share(h, 0.82)),
    }
    return parts[name]


def torso_from_points(b: Box, shoulders: list[tuple[Column, Column, Column]], hips: list[tuple[Column, Column, Column]], least_conf: float = 0.5) -> Column:
    """The torso (x1, y1, x2, y2, source) from key points (x, y, confidence), left and right; null where they can't tell.

    Shoulders must be seen and in the upper 55 % of the box; hips, where seen, end the torso, else one and a half
    shoulder widths below them do. What is thinner than 4 pixels or a tenth of the box's height is refused.
    """
    seen = lambda p: F.coalesce(p[2] >= least_conf, F.lit(False))
    (l, r), height = shoulders, b[3] - b[1]

    def mean_y(pair: list[tuple[Column, Column, Column]]) -> Column:
        a, z = pair
        return F.when(seen(a) & seen(z), (a[1] + z[1]) / 2).when(seen(a), a[1]).when(seen(z), z[1])

    top_y, both = mean_y(shoulders), seen(l) & seen(r)
    middle = F.when(seen(l), l[0]).otherwise(r[0])
    wide = F.when(both, F.abs(l[0] - r[0])).otherwise((b[2] - b[0]) * 0.5)
    left = F.when(both, F.least(l[0], r[0])).otherwise(middle - wide * 0.5) - wide * 0.1
    right = F.when(both, F.greatest(l[0], r[0])).otherwise(middle + wide * 0.5) + wide * 0.1
    hip_y = mean_y(hips)
    bottom = F.coalesce(hip_y, F.least(b[3], top_y + wide * 1.5))
    x1, x2 = F.greatest(b[0], left), F.least(b[2], right)
    y1, y2 = F.greatest(b[1], top_y + height * 0.02), F.least(b[3], bottom)
    good = top_y.isNotNull() & (top_y - b[1] <= 0.55 * height) & (wide >= 4) & (hip_y.isNull() | (hip_y > top_y + 4))
    good = good & (x2 - x1 >= 4) & (y2 - y1 >= F.greatest(F.lit(4.0), 0.1 * height))
    found = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.when(hip_y.isNotNull(), "pose_full").otherwise("pose_shoulders").alias("source"))
    return F.when(good, found)


def direction(first_x: Column, first_y: Column, last_x: Column, last_y: Column, points: Column, p: Params = DEFAULT) -> Column:
    """Where a path leads: right or left, then down or up, joined by +; mostly_static; unknown with fewer than 2 points."""
    dx, dy = last_x - first_x, last_y - first_y
    across = F.when(dx >= p.moved, "right").when(dx <= -p.moved, "left")
    along = F.when(dy >= p.moved, "down").when(dy <= -p.moved, "up")
    way = F.concat_ws("+", across, along)
    return F.when(points < 2, "unknown").when(way == "", "mostly_static").otherwise(way)


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS, rounded half to even."""
    s = F.bround(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))


def frame_seconds(index: Column, step: Column | float) -> Column:
    return F.round(index * F.lit(step), 3)
