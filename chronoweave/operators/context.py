"""Contexts for reports: where things are, what was there, what text was seen, who appears when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import geometry as G
from chronoweave.functions import quality as Q
from chronoweave.functions import vectors as V
from chronoweave.operators.windows import members
from chronoweave.params import DEFAULT, Params

# Names of things in reports.
NAMES = {"backpack": "背包", "handbag": "手提包", "suitcase": "行李箱/箱子", "car": "汽车", "truck": "卡车", "bus": "公交车", "motorcycle": "摩托车", "bicycle": "自行车"}


def named(label: Column) -> Column:
    pairs = [F.lit(x) for pair in NAMES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), label)


def object_context(windows: DataFrame, found: DataFrame, width: float, height: float, p: Params = DEFAULT) -> DataFrame:
    """Things of each window: track, label, frames present, first and last frame in it, direction, confidence.

    Label and confidence are the track's over all frames (the most recent label, the highest confidence); presence, times
    and direction are the window's. A thing has to be in enough of its frames. nth: the order in which reports list them.
    """
    things = found.where((F.col("label") != "person") & F.col("label").isin(*p.object_classes) & F.col("track").isNotNull() & (F.col("conf") >= p.object_min_conf))
    over = things.groupBy("session", "track").agg(F.max("conf").alias("conf"), F.max_by("label", "frame").alias("label"))
    x, y = G.centre(G.box(), width, height)
    inside = members(windows, things.select("session", "frame", "track", x.alias("x"), y.alias("y")))
    at = lambda f, c: f(c, "frame")
    rows = inside.groupBy("session", F.col("first").alias("window"), "track").agg(
        F.count_distinct("frame").alias("frames_present"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        *(at(F.min_by, c).alias(f"{c}0") for c in "xy"), *(at(F.max_by, c).alias(f"{c}1") for c in "xy"),
    ).where(F.col("frames_present") >= p.object_min_frames)
    way = G.direction(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("frames_present"), p)
    nth = F.row_number().over(W.partitionBy("session", "window").orderBy(F.desc("frames_present"), "first_frame", "track"))
    return rows.join(over, ["session", "track"]).select("session", "window", "track", "label", "frames_present", "first_frame", "last_frame", way.alias("direction"), F.round("conf", 3).alias("conf"), nth.cast("long").alias("nth"))


def object_text(context: DataFrame, clocks: DataFrame, most: int = 20) -> DataFrame:
    """One text a window: its first `most` things, each with where it was first and last seen and whether it moved, and how
    many more there are. clocks: session, frame, at (the frame's time as text)."""
    first, last = (clocks.select("session", F.col("frame").alias(f"{c}_frame"), F.col("at").alias(f"{c}_at")) for c in ("first", "last"))
    still = F.col("direction").isin("mostly_static", "unknown")
    motion = F.when(still, "基本静止").otherwise(F.concat(F.lit("移动("), "direction", F.lit(")，疑似被搬动/取走/放下")))
    line = F.concat(
        F.lit("- "), named(F.col("label")), F.lit("("), "label", F.lit(") track#"), "track", F.lit("：frame#"), "first_frame", F.lit("@"), "first_at",
        F.lit(" → frame#"), "last_frame", F.lit("@"), "last_at", F.lit("（共"), "frames_present", F.lit("帧）；"), motion,
    )
    seen = context.join(first, ["session", "first_frame"]).join(last, ["session", "last_frame"])
    rows = F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", line.alias("line")))))
    return seen.groupBy("session", "window").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))


def grounding(keyframes: DataFrame, found: DataFrame, width: float, height: float) -> DataFrame:
    """What is where in each keyframe: normalised box and middle of every detection. keyframes: session, window, frame."""
    rows = keyframes.join(found, ["session", "frame"])
    box = G.norm_box(G.box(), width, height)
    middle = G.centre_of(box)
    part = lambda c, i: F.element_at(c, i)
    return rows.select("session", "window", "frame", "track", "label", *(part(box, i).alias(f"n{i}") for i in (1, 2, 3, 4)), part(middle, 1).alias("cx"), part(middle, 2).alias("cy"))


def grounding_text(rows: DataFrame, most: int = 24) -> DataFrame:
    """One text a keyframe: its detections in order of tracks, at most `most`, and how many more there are."""
    box = F.concat(F.lit("["), F.concat_ws(", ", *(f"n{i}" for i in (1, 2, 3, 4))), F.lit("]"))
    item = F.concat("label", F.lit("#"), "track", F.lit(" bbox_norm="), box, F.lit(" center=["), "cx", F.lit(", "), "cy", F.lit("]"))
    items = F.array_sort(F.collect_list(F.struct("track", item.alias("item"))))
    joined = F.array_join(F.transform(F.slice(items, 1, most), lambda r: r["item"]), "\n")
    return rows.groupBy("session", "window", "frame").agg(joined.alias("text"), F.count(F.lit(1)).alias("n_objects"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))


# What stands around where persons are.
GROUNDING = {
    "head": "【关键帧空间 grounding（坐标辅助理解，不要求模型重新检测）】", "coord": "坐标约定：bbox=[x1,y1,x2,y2] pixels; bbox_norm/center_norm normalized to 0..1 from top-left",
    "paths": "【跨帧轨迹摘要】", "more": ("  ... ", " more objects omitted"), "more_paths": ("... ", " more trajectories omitted"),
}


def who(subject: Column, track: Column) -> Column:
    """How a person is called beside coordinates: by subject, or by track without one."""
    return F.when(subject.isNotNull(), F.concat(F.lit("subject#"), subject)).otherwise(F.concat(F.lit("track#"), track))


def identity_grounding(keyframes: DataFrame, found: DataFrame, identities: DataFrame, width: float, height: float) -> DataFrame:
    """Who is where in each keyframe: label, subject and decision of each person, the box in pixels and as shares, its middle.

    keyframes: session, window, frame; found: session, frame, track and a box; identities: session, track, subject, decision. A
    track without identity is called by its number. A keyframe without persons has no row here.
    """
    rows = keyframes.join(found.select("session", "frame", "track", "x1", "y1", "x2", "y2"), ["session", "frame"]).join(identities.select("session", "track", "subject", "decision"), ["session", "track"], "left")
    pixels = F.array(*(F.round(c, 1) for c in ("x1", "y1", "x2", "y2")))
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    middle = F.array(F.round(x / width, 4), F.round(y / height, 4))
    return rows.select("session", "window", "frame", "track", "subject", who(F.col("subject"), F.col("track")).alias("label"), "decision", pixels.alias("box"), G.norm_box(G.box(), width, height).alias("norm"), middle.alias("middle"))


def identity_grounding_text(keyframes: DataFrame, rows: DataFrame, paths: DataFrame, most: int = 24, most_paths: int = 40, p: Params = DEFAULT) -> DataFrame:
    """(session, window, text): a head, each keyframe with its persons (at most `most`, and how many more), then the persons'
    paths (at most most_paths, and how many more).

    keyframes: session, window, frame, at; rows of identity_grounding; paths: session, window, track, tracks (array), subject and
    path (array of x, y), those without points being left out. Persons of a frame are told in order of tracks, paths by
    representative. Windows with neither have no row.
    """
    by = ["session", "window"]
    numbers = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda v: v.cast("string")), ", "), F.lit("]"))
    item = F.concat(F.lit("  "), "label", F.lit(" track="), "track", F.lit(" bbox_norm="), numbers(F.col("norm")), F.lit(" center="), numbers(F.col("middle")))
    told = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda r: r["told"])
    items = rows.groupBy(*by, "frame").agg(told(F.struct("track", item.alias("told"))).alias("items"))
    none = F.array().cast("array<string>")
    rest = lambda n, words: F.when(n > 0, F.array(F.concat(F.lit(words[0]), n, F.lit(words[1])))).otherwise(none)
    each = keyframes.select(*by, "frame", "at").join(items, [*by, "frame"], "left").withColumn("items", F.coalesce("items", none))
    head = F.concat(F.lit("- frame#"), "frame", F.lit(" @ "), F.coalesce("at", F.lit("None")), F.lit("："), F.size("items"), F.lit(" objects"))
    lines = F.concat(F.array(head), F.slice("items", 1, most), rest(F.size("items") - most, GROUNDING["more"]))
    frames = each.groupBy(*by).agg(F.flatten(told(F.struct("frame", lines.alias("told")))).alias("frames"))
    n, at = F.size("path"), lambda i: F.element_at("path", i)
    shown = F.when(n >= 3, F.array(at(1), at((F.floor(n / 2) + 1).cast("int")), at(-1))).otherwise(F.col("path"))
    points = F.concat(F.lit("["), F.array_join(F.transform(shown, lambda q: F.concat(F.lit("["), F.round(q["x"], 4), F.lit(", "), F.round(q["y"], 4), F.lit("]"))), ", "), F.lit("]"))
    way = G.direction(at(1)["x"], at(1)["y"], at(-1)["x"], at(-1)["y"], n, p)
    line = F.concat(F.lit("- "), who(F.col("subject"), F.col("track")), F.lit(" tracks="), numbers(F.col("tracks")), F.lit(" direction="), way, F.lit(" path="), points)
    walked = paths.where(n > 0).groupBy(*by).agg(told(F.struct("track", line.alias("told"))).alias("paths"))
    both = frames.join(walked, by, "full")
    body = F.concat(
        F.array(F.lit(GROUNDING["head"]), F.lit(GROUNDING["coord"])), F.coalesce("frames", none),
        F.when(F.col("paths").isNotNull(), F.concat(F.array(F.lit(GROUNDING["paths"])), F.slice("paths", 1, most_paths), rest(F.size("paths") - most_paths, GROUNDING["more_paths"]))).otherwise(none),
    )
    return both.select(*by, F.array_join(body, "\n").alias("text"))


def hundredths(x: Column) -> Column:
    """A share of the frame (at least 0, under 8) to two places, by the number that the double really is and halves to even:
    0.575 is a little less than that and gives 0.57. Counted in units of 2**-60, which such doubles are."""
    unit = 1 << 60
    whole = F.floor(x * float(unit)).cast("decimal(20,0)") * F.lit(100)
    low = F.floor(x * 100) - 1  # near enough to begin from
    rest = lambda t: whole - t.cast("decimal(20,0)") * F.lit(unit).cast("decimal(20,0)")
    t = F.when(rest(low + 2) >= 0, low + 2).when(rest(low + 1) >= 0, low + 1).otherwise(low)
    half = F.lit(unit // 2).cast("decimal(20,0)")
    return (t + F.when((rest(t) > half) | ((rest(t) == half) & (t % 2 == 1)), 1).otherwise(0)) / 100.0


def path_text(path: Column) -> Column:
    """First, middle and last point of a path as persons' lines tell them; null without points."""
    n, at = F.size(path), lambda i: F.element_at(path, i)
    shown = F.when(n >= 3, F.array(at(1), at((F.floor(n / 2) + 1).cast("int")), at(-1))).otherwise(path)
    return F.when(n > 0, F.concat(F.lit("  轨迹: "), F.array_join(F.transform(shown, lambda q: F.concat(F.lit("("), hundredths(q["x"]), F.lit(","), hundredths(q["y"]), F.lit(")"))), " → ")))


def attribute_text(colour: Column, attributes: Column) -> Column:
    """A person's main colour and attributes (array) as lines tell them; null where there are neither."""
    own = F.when(F.coalesce(colour, F.lit("")) != "", F.concat(F.lit("主色:"), colour))
    rest = F.when(F.size(attributes) > 0, F.concat(F.lit("属性:"), F.array_join(attributes, "/")))
    return F.nullif(F.concat_ws(" | ", own, rest), F.lit(""))


def path_summary(people: DataFrame, most: int = 40, p: Params = DEFAULT) -> DataFrame:
    """Where each person of a window went: points, direction, and first, middle and last point; nth orders a window's people.

    people: session, window, person, track and path (array of x, y as shares of the frame, in order). Those without a
    path are left out; what is beyond the first `most` of a window is not told, and omitted says how many that are.
    """
    n = F.size("path")
    at = lambda i: F.element_at("path", i)
    point = lambda q: F.concat(F.lit("["), F.round(q["x"], 4), F.lit(", "), F.round(q["y"], 4), F.lit("]"))
    shown = F.when(n >= 3, F.array(at(1), at((F.floor(n / 2) + 1).cast("int")), at(-1))).otherwise(F.col("path"))
    way = G.direction(at(1)["x"], at(1)["y"], at(-1)["x"], at(-1)["y"], n, p)
    each = W.partitionBy("session", "window")
    rows = people.where(n > 0).select("session", "window", "person", "track", n.cast("long").alias("points"), way.alias("direction"), F.array_join(F.transform(shown, point), " ").alias("path_sample"))
    rows = rows.withColumn("nth", F.row_number().over(each.orderBy("track")).cast("long")).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(each) - most, F.lit(0)))
    return rows.where(F.col("nth") <= most)


def box_of_points(points: Column, left: Column | int = 0, top: Column | int = 0) -> tuple[Column, Column, Column, Column]:
    """The upright box around a quadrangle (array of arrays x, y), moved by where its crop began."""
    xs, ys = F.transform(points, lambda q: q[0]), F.transform(points, lambda q: q[1])
    return F.array_min(xs) + left, F.array_min(ys) + top, F.array_max(xs) + left, F.array_max(ys) + top


def scene_text(lines: DataFrame) -> DataFrame:
    """Distinct texts of each session: in how many frames, whether it counts as static, and how it is first spelt.

    lines: session, frame, line, text. Texts are the same if they differ in white space and case only; empty ones are
    passed over. With n frames that have text, a text is static if n >= 2 and it is in max(2, whole part of 0.6 n) or more.
    """
    rows = lines.select("session", "frame", "line", V.stripped(F.col("text")).alias("text"), V.text_key(F.col("text")).alias("key")).where("key <> ''")
    n = rows.groupBy("session").agg(F.count_distinct("frame").alias("n_frames"))
    first = F.min_by("text", F.struct("frame", "line")).alias("display")
    keys = rows.groupBy("session", "key").agg(F.count_distinct("frame").alias("n_seen"), first)
    need = F.greatest(F.lit(2), F.floor(F.col("n_frames") * 0.6).cast("long"))
    return keys.join(n, "session").select("session", F.md5("key").alias("key"), "n_seen", "n_frames", ((F.col("n_frames") >= 2) & (F.col("n_seen") >= need)).alias("static"), "display")


def changing_text(lines: DataFrame, static: DataFrame, most: int = 24) -> DataFrame:
    """The first `most` frames of each session that have text that is not static, with that text, stripped; omitted tells how
    many frames more there are. lines as in scene_text."""
    key = F.md5(V.text_key(F.col("text")))
    fixed = static.where("static").select("session", "key")
    rows = lines.withColumns({"key": key, "text": V.stripped(F.col("text"))}).where(V.text_key(F.col("text")) != "").join(fixed, ["session", "key"], "left_anti")
    firsts = rows.groupBy("session", "frame", "key").agg(F.min(F.struct("line", "text")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), " | ")
    frames = firsts.groupBy("session", "frame").agg(joined.alias("text"))
    total = frames.groupBy("session").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
    return frames.withColumn("nth", F.row_number().over(W.partitionBy("session").orderBy("frame"))).where(F.col("nth") <= most).join(total, "session")


# What stands around the texts of a window.
SCENE = {"head": "【画面文字（OCR，逐关键帧；场景级，不代表任何人的身份）】", "static": "固定文字（贯穿多帧，如摄像头名/地点）：", "changing": "逐帧文字（多为时间戳/动态信息，frame#与 grounding 一一对应）：", "more": ("  ... 其余 ", " 帧文字省略")}


def scene_context(lines: DataFrame, most: int = 24) -> DataFrame:
    """(session, window, text, n_frames, n_static, omitted): the text seen in each window's keyframes.

    lines: session, window, frame, at, line, text. Static texts stand once, in order of where they are seen first; then
    comes a line for each of the first `most` frames that have other texts, and how many frames more there are. Texts are
    stripped; within a frame those that differ in white space and case only count once. Windows without text have no row.
    A window's keyframes are few, so its lines are put together in one row.
    """
    by = ["session", "window"]
    rows = lines.select(*by, "frame", "at", "line", "text").repartition(*by)  # once: all that follows is within windows
    rows = rows.select(*by, "frame", "at", "line", V.stripped(F.col("text")).alias("text"), V.text_key(F.col("text")).alias("key")).where("key <> ''")
    once = rows.groupBy(*by, "frame", "key").agg(F.min(F.struct("line", "text", "at")).alias("r")).select(*by, "frame", "key", "r.*")
    same = W.partitionBy(*by, "key")
    once = once.withColumns({"n_seen": F.count(F.lit(1)).over(same), "first": F.min(F.struct("frame", "line", "text")).over(same)})
    once = once.withColumn("n_frames", F.size(F.collect_set("frame").over(W.partitionBy(*by))).cast("long"))
    need = F.greatest(F.lit(2), F.floor(F.col("n_frames") * 0.6).cast("long"))
    once = once.withColumn("static", (F.col("n_frames") >= 2) & (F.col("n_seen") >= need))
    in_order = lambda c: F.array_sort(F.collect_list(c))
    told = once.groupBy(*by, "frame", "n_frames").agg(
        F.max(F.when(~F.col("static"), F.col("at"))).alias("at"), F.collect_list(F.when(F.col("static"), F.col("first"))).alias("fixed"),
        F.transform(in_order(F.when(~F.col("static"), F.struct("line", "text"))), lambda r: r["text"]).alias("texts"),
    )
    anchor = F.concat(F.lit("- frame#"), "frame", F.lit(" @ "), F.coalesce("at", F.lit("None")), F.lit("："), F.array_join("texts", " | "))
    out = told.groupBy(*by, "n_frames").agg(
        F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fixed")))), lambda r: r["text"]).alias("fixed"),
        F.transform(in_order(F.when(F.size("texts") > 0, F.struct("frame", anchor.alias("told")))), lambda r: r["told"]).alias("changing"),
    )
    out = out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("fixed", "changing")})
    none = F.array().cast("array<string>")
    left = F.size("changing") - most
    parts = F.concat(
        F.array(F.lit(SCENE["head"])), F.when(F.col("fixed").isNotNull(), F.array(F.concat(F.lit(SCENE["static"]), F.array_join("fixed", " | ")))).otherwise(none),
        F.when(F.col("changing").isNotNull(), F.concat(F.array(F.lit(SCENE["changing"])), F.slice("changing", 1, most))).otherwise(none),
        F.when(left > 0, F.array(F.concat(F.lit(SCENE["more"][0]), left, F.lit(SCENE["more"][1])))).otherwise(none),
    )
    return out.select(*by, F.array_join(parts, "\n").alias("text"), "n_frames", F.coalesce(F.size("fixed"), F.lit(0)).cast("long").alias("n_static"), F.coalesce(F.greatest(left, F.lit(0)), F.lit(0)).cast("long").alias("omitted"))


def roster(appearances: DataFrame) -> DataFrame:
    """Per subject the ranges in which it appears, in order. appearances: subject, place (order), range."""
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("place", "range"))), lambda r: r["range"])
    return appearances.groupBy("subject").agg(F.array_join(ranges, ", ").alias("ranges"), F.count(F.lit(1)).alias("n"))


# What rosters say.
ROSTER = {"line": "：出现于 ", "none": "（无可用身份）"}


def roster_text(sessions: DataFrame, appearances: DataFrame) -> DataFrame:
    """(session, text, n_subjects): a line for each subject of a session with the ranges in which it appears, subjects in
    order of their first appearance; a session without any is told to have none.

    sessions: session; appearances: session, subject, place (order, unique in a session), range.
    """
    each = appearances.groupBy("session", "subject").agg(F.min("place").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("place", "range"))), lambda r: r["range"]).alias("ranges"))
    line = F.concat(F.lit("- "), "subject", F.lit(ROSTER["line"]), F.array_join("ranges", ", "))
    texts = each.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_subjects"))
    out = sessions.select("session").distinct().join(texts, "session", "left")
    return out.select("session", F.coalesce("text", F.lit(ROSTER["none"])).alias("text"), F.coalesce("n_subjects", F.lit(0)).alias("n_subjects"))


def timeline(windows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each window's text: a head with its range and level, its summary if there is one, and its reports in order.

    windows: window, begins, ends, level, summary; reports: window, nth, time, subject, abnormal, action. A window
    without reports has its head alone; a null level is normal.
    """
    mark = F.when(F.coalesce("abnormal", F.lit(False)), "⚠").otherwise("")
    line = F.concat(F.lit("  - "), "time", F.lit(" "), "subject", F.lit("："), mark, "action")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda r: r["line"])
    lines = reports.groupBy("window").agg(rows.alias("lines"))
    head = F.concat(F.lit("[窗"), "window", F.lit(" "), "begins", F.lit("~"), "ends", F.lit("] 告警="), F.coalesce("level", F.lit(LEVELS[0])))
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.array(F.concat(F.lit("  概述："), "summary"))).otherwise(F.array().cast("array<string>"))
    told = F.coalesce("lines", F.array().cast("array<string>"))
    joined = windows.join(lines, "window", "left")
    return joined.select("window", F.array_join(F.concat(F.array(head), summary, told), "\n").alias("text"), F.size(told).cast("long").alias("n_lines"))


# Levels of alert, from the least on.
LEVELS = ("normal", "attention", "alert")


def highest_alert(reports: DataFrame, by: list[str]) -> DataFrame:
    """The highest level among each group's reports; unknown ones count as normal."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(0))
    top = F.max(F.greatest(rank, F.lit(1))).cast("int")
    return reports.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, LEVELS)), top).alias("level"), F.count(F.lit(1)).alias("n"))


def label_text(name: Column, subject: Column, decision: Column) -> Column:
    """How a person is called in reports: a known name, else the subject's number and standing, else unknown."""
    standing = F.when(decision == "new", "新主体").when(decision == "grey", "待定").otherwise("已知")
    number = F.concat(F.lit("主体#"), subject.cast("string"), F.lit("（"), standing, F.lit("）"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit("（库内身份）"))).when(subject.isNotNull(), number).otherwise("未识别人物")


# What persons' lines say.
CUES = {"matched": "人脸命中", "seen": "人脸存在", "none": "人脸:无/不可用", "body": "人形ReID", "gait": "步态"}


def cue_text(face: Column, matched: Column, face_quality: Column, face_score: Column, body: Column, body_score: Column, gait: Column, gait_score: Column) -> Column:
    """What the three routes know of a person; face, body and gait say whether there is such a record."""
    band = Q.confidence_band
    seen = F.concat_ws("·", F.when(F.coalesce(matched, F.lit(False)), CUES["matched"]).otherwise(CUES["seen"]), band(face_score), face_quality)
    return F.concat_ws("；", F.when(face, seen).otherwise(CUES["none"]), F.when(body, F.concat(F.lit(CUES["body"] + "·"), band(body_score))), F.when(gait, F.concat(F.lit(CUES["gait"] + "·"), band(gait_score))))


def fused_text(confidence: Column, multi_source: Column, sources: Column) -> Column:
    """How sure the fused identity is and which routes it comes from (sources joined by +); null without a confidence."""
    many = F.when(F.coalesce(multi_source, F.lit(False)), "·多路线参与").otherwise("")
    of = F.when(F.coalesce(sources, F.lit("")) != "", F.concat(F.lit("·来源:"), sources)).otherwise("")
    return F.concat(F.lit("融合身份·"), Q.confidence_band(confidence), F.lit("("), confidence, F.lit(")"), many, of)


def identity_lines(people: DataFrame) -> DataFrame:
    """One text a window: its persons' lines. people: session, window, nth, track, name, subject, decision, reused, box (array),
    fused, cues, evidence, path and, where there is such a column, attributes (texts, null where there is none)."""
    head = F.concat(
        F.lit("  #"), "nth", F.lit(" "), label_text(F.col("name"), F.col("subject"), F.col("decision")), F.lit("  track="), "track",
        F.when(F.coalesce("reused", F.lit(False)), " ♻回头客").otherwise(""), F.lit("  box=["), F.array_join(F.transform("box", lambda v: F.round(v, 1).cast("string")), ", "), F.lit("]"),
    )
    extra = F.concat_ws(" | ", "fused", "cues", "evidence", *(["attributes"] if "attributes" in people.columns else []))
    line = F.concat(head, F.when(extra != "", F.concat(F.lit("\n      "), extra)).otherwise(""), F.coalesce("path", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda r: r["line"])
    return people.groupBy("session", "window").agg(F.array_join(rows, "\n").alias("text"), F.count(F.lit(1)).alias("n_people"))


def evidence_text(body_frame: Column, body_at: Column, face_frame: Column, face_at: Column) -> Column:
    """The frames that a person's body and face were taken from; null where there is neither."""
    part = lambda name, frame, at: F.when(frame.isNotNull(), F.concat(F.lit(f"{name}证据frame#"), frame, F.lit("@"), at))
    return F.nullif(F.concat_ws("；", part("人形", body_frame, body_at), part("人脸", face_frame, face_at)), F.lit(""))


def window_requests(windows: DataFrame, keyframes: DataFrame, texts: dict[str, DataFrame]) -> DataFrame:
    """What a reporter is asked about each window: the labels of its keyframes in order, and the texts that go with it.

    windows: session, window; keyframes: session, window, frame, at; texts: a name and (session, window, text) each, null
    where a window has none. A window without keyframes is not asked about: answered is true, and summary says so.
    """
    label = lambda r, i: F.concat(F.lit("[关键帧 "), i + 1, F.when(r["at"].isNotNull(), F.concat(F.lit(" @ "), r["at"])).otherwise(""), F.lit("]"))
    shown = keyframes.groupBy("session", "window").agg(F.array_sort(F.collect_list(F.struct("frame", "at"))).alias("frames"))
    out = windows.select("session", "window").join(shown, ["session", "window"], "left")
    for name, table in texts.items():
        out = out.join(table.select("session", "window", F.col("text").alias(name)), ["session", "window"], "left")
    n = F.coalesce(F.size("frames"), F.lit(0))
    labels = F.coalesce(F.array_join(F.transform("frames", label), "\n"), F.lit(""))
    return out.select("session", "window", n.cast("long").alias("n_frames"), labels.alias("frames"), (n == 0).alias("answered"), F.when(n == 0, "（无关键帧）").alias("summary"), *texts)


def read_text(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Read lines that are not empty and sure enough, stripped, the surest first (nth); lines: session, frame, line, text, conf."""
    kept = lines.where((F.coalesce("text", F.lit("")) != "") & (F.col("conf") >= p.text_min_conf)).withColumn("text", V.stripped(F.col("text")))
    nth = F.row_number().over(W.partitionBy("session", "frame").orderBy(F.desc("conf"), "line"))
    return kept.withColumn("nth", nth.cast("long"))


#: Windows of a payload document start in one stretch of so many frames.
PAYLOAD_FRAMES = 4096


def documents(windows: DataFrame, parts: dict[str, DataFrame], head: dict[str, Column] | None = None, frames: int = PAYLOAD_FRAMES) -> DataFrame:
    """The whole document of each session as JSON, assembled from the bottom up: (session, part, document, n_windows).

    windows: session, window and what else a window tells; parts: a name and (session, window, nth, item) each, of which a
    window holds the items in order of nth, or an empty list; head: what stands before the windows. Nulls are written. A
    session has a document for each stretch of `frames` frames in which windows start, so no row holds a session; a
    window's parts are as bounded as a window is.
    """
    by = ["session", "window"]
    out = windows
    for name, items in parts.items():
        held = items.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda r: r["item"]).alias(name))
        out = out.join(held, by, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    rows = F.array_sort(F.collect_list(F.struct("window", *[c for c in out.columns if c not in by])))
    folded = out.groupBy("session", F.floor(F.col("window") / frames).alias("part")).agg(rows.alias("windows"), F.count(F.lit(1)).alias("n_windows"))
    whole = F.struct("session", "part", *(c.alias(k) for k, c in (head or {}).items()), "windows")
    return folded.select("session", "part", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"), "n_windows")


def payload(windows: DataFrame, key: str = "session", frames: int = PAYLOAD_FRAMES) -> DataFrame:
    """JSON documents of each session: its windows in order, as an array of objects, and their number.

    A session has a document for each stretch of `frames` frames in which windows start (part), so that a long session is
    many documents of bounded size. windows has `first`, the frame where each one starts.
    """
    cols = [c for c in windows.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    part = F.floor(F.col("first") / frames).alias("part")
    return windows.groupBy(key, part).agg(F.to_json(rows).alias("payload"), F.count(F.lit(1)).alias("n_windows"))
