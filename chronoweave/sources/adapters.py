"""The driver's tables in the roles of the engine: detections, frames, shots, text lines, reports, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import read_table

#: Length of a frame, and size of the picture that boxes are in.
FRAME_SECONDS = 600
WIDTH, HEIGHT = 120.0, 140.0
LABELS = ("person", "car", "truck", "bus", "backpack")

_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
#: The same instant in milliseconds since 1970.
EPOCH_MS = 1_704_067_200_000


def frame_of(ts: str = "ts", seconds: int = FRAME_SECONDS) -> Column:
    """Whole frames since the start of 2024; a timestamp without a zone is read as UTC."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})") / F.lit(seconds * 1_000_000)).cast("long")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: session, frame, track, k, quality and a box derived from whole numbers."""
    events = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("event_id", F.col("event_type").alias("session"), frame_of().alias("frame"), F.col("user_id").alias("track"), k.alias("k"), F.col("value").alias("quality"))
    return rows.select("*", *_seen("track"))


def _seen(user: str) -> list[Column]:
    """Box, confidence and label, which the event's k and its user tell."""
    x1, y1 = F.col("k") * 7 % 60, F.col("k") * 13 % 40
    return [
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 20 + F.col("k") % 30).cast("double").alias("x2"), (y1 + 40 + F.col(user) % 50).cast("double").alias("y2"),
        (F.col("k") / 100.0).alias("conf"), F.element_at(F.array(*map(F.lit, LABELS)), F.col("k") % len(LABELS) + 1).alias("label"),
    ]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one row per session, frame and track: the one of the best quality."""
    best = F.max_by(F.struct("event_id", "k", "quality", "x1", "y1", "x2", "y2", "conf", "label"), F.struct("quality", -F.col("event_id"))).alias("b")
    return observations(spark, sf_dir).groupBy("session", "frame", "track").agg(best).select("session", "frame", "track", "b.*")


DETECTIONS_SQL = """o as (select event_id, event_type as session, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 600000000)::bigint as frame,
  user_id as track, json_extract(props, '$.k')::int as k, value as quality from events),
d as (select * from (select *, (k * 7 % 60)::double as x1, (k * 13 % 40)::double as y1, (k * 7 % 60 + 20 + k % 30)::double as x2,
  (k * 13 % 40 + 40 + track % 50)::double as y2, k::double / 100.0::double as conf, ['person', 'car', 'truck', 'bus', 'backpack'][k % 5 + 1] as label,
  row_number() over (partition by session, frame, track order by quality desc, event_id) as nth from o) where nth = 1)"""


def frames(found: DataFrame) -> DataFrame:
    """Every frame of each session between its first and last one, with the number of tracks in it."""
    counts = found.groupBy("session", "frame").agg(F.count_distinct("track").alias("n"))
    spans = counts.groupBy("session").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    spine = spans.select("session", F.explode(F.sequence("lo", "hi")).alias("frame"))
    return spine.join(counts, ["session", "frame"], "left").select("session", "frame", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, subject and the vector as doubles."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("subject"), F.col("embedding").cast("array<double>").alias("vec"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as text seen in frames: session, frame, line, text."""
    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("frame"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    return lines.select("session", "frame", F.col("line").cast("long"), "text")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed intervals of days per customer: from the order to its last shipment, at least 40 days on."""
    orders, items = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    shipped = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    both = orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"])
    first = day("o_orderdate")
    return both.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("track"), first.cast("long").alias("first"), F.greatest(first + 40, F.least(day("last"), first + 400)).cast("long").alias("last"))


INTERVALS_SQL = """iv as (select o_custkey as subject, o_orderkey as track, date_diff('day', date '1992-01-01', o_orderdate::date)::bigint as first,
  greatest(date_diff('day', date '1992-01-01', o_orderdate::date) + 40, least(date_diff('day', date '1992-01-01', last::date), date_diff('day', date '1992-01-01', o_orderdate::date) + 400))::bigint as last
  from orders join (select l_orderkey, max(l_shipdate) as last from lineitem group by 1) on o_orderkey = l_orderkey)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the events with up to three local ids each, that link them across routes: body, face and gait."""
    tracks = observations(spark, sf_dir).groupBy("session", "track").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.count(F.lit(1)).alias("n"), F.max("quality").alias("q"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    return tracks.select(
        "session", "track", "first", "last", "q", "n",
        F.when(F.col("track") % 3 == 0, F.col("track") % 40 * 100 + F.col("k0") % 4).alias("body"),
        F.when(F.col("k1") % 2 == 0, F.col("track") % 25 * 100 + F.col("k1") % 4).alias("face"),
        F.when(F.col("n") % 2 == 0, F.col("track") % 30 * 100 + F.col("n") % 8).alias("gait"),
    )


ROUTES_SQL = """o as (select event_id, event_type as session, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 600000000)::bigint as frame,
  user_id as track, json_extract(props, '$.k')::int as k, value as quality from events),
tr as (select session, track, min(k) as k0, max(k) as k1, count(*) as n, max(quality) as q, min(frame) as first, max(frame) as last from o group by 1, 2),
ro as (select session, track, first, last, q, n, case when track % 3 = 0 then (track % 40 * 100 + k0 % 4)::bigint end as body,
  case when k1 % 2 = 0 then (track % 25 * 100 + k1 % 4)::bigint end as face, case when n % 2 = 0 then (track % 30 * 100 + n % 8)::bigint end as gait from tr)"""


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str = "nth") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


#: Users of a session of sightings, and days of a track of one user.
USERS, TRACK_DAYS = 8, 3


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in sessions whose number grows with the users: eight users share one, and each user has a track for every
    three days, so that tracks of one user follow each other and those of others overlap them. At most one row per session,
    frame and track, the one of the best quality.

    Few rows share their key, so they are dealt before they are compared and sorted once, by whole numbers first; what k and
    user tell is added after that."""
    rows = observations(spark, sf_dir).select("event_id", F.col("track").alias("user"), "frame", "k", "quality")
    days = F.floor(F.col("frame") * FRAME_SECONDS / 86_400 / TRACK_DAYS)
    rows = rows.withColumns({"session": F.concat(F.lit("s"), F.floor(F.col("user") / USERS)), "track": F.col("user") * 10 + days})
    best = F.max_by(F.struct("event_id", "user", "k", "quality"), F.struct("quality", -F.col("event_id"))).alias("b")
    rows = rows.repartition("track", "frame", "session").groupBy("track", "frame", "session").agg(best).select("session", "frame", "track", "b.*")
    return rows.select("*", *_seen("user"))


def mixed_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, own: Column, other: Column, weight: Column, out: str = "vec") -> DataFrame:
    """rows with a vector of the embeddings by the number `own`, and `weight` of another one by `other`, added up: rows with
    the same own number are alike, the less the higher their weights."""
    every = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__id"), F.col("embedding").alias("__vec"))
    n = every.count()
    pick = lambda df, by, name: df.withColumn("__id", F.pmod(by, F.lit(n))).join(every.withColumnRenamed("__vec", name), "__id").drop("__id")
    both = pick(pick(rows.withColumn("__w", weight.cast("double")), own, "__a"), other, "__b")
    return both.withColumn(out, F.zip_with("__a", "__b", lambda a, b: a.cast("double") + F.col("__w") * b.cast("double"))).drop("__a", "__b", "__w")
