"""Rows of a long session next to each other without one sort of the session: slices of frames, with what is carried over.

A slice is so many frames of a session. Rows are ordered within slices, in parallel; only one row a slice is ordered by
session, which tells each slice what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import written

FRAMES = 4096
KEY = ["session", "__slice"]


def slice_of(frame: Column | str, frames: int = FRAMES) -> Column:
    return F.floor((F.col(frame) if isinstance(frame, str) else frame) / frames).cast("long")


def with_before(df: DataFrame, cols: list[str], out: str = "before", frames: int = FRAMES) -> DataFrame:
    """df (session, frame, ...) with `out`, a struct of cols of the row with the next smaller frame of its session; null
    for the first. Frames must not repeat within a session."""
    rows = df.withColumn("__slice", slice_of("frame", frames))
    held = F.struct(*cols)
    lagged = rows.withColumn("__near", F.lag(held).over(W.partitionBy(*KEY).orderBy("frame")))
    lasts = rows.groupBy(*KEY).agg(F.max_by(held, "frame").alias("__last"))
    carried = lasts.select(*KEY, F.lag("__last").over(W.partitionBy("session").orderBy("__slice")).alias("__carried"))
    return lagged.join(carried, KEY).withColumn(out, F.coalesce("__near", "__carried")).drop("__slice", "__near", "__carried")


def with_running_sum(df: DataFrame, value: Column, out: str, frames: int = FRAMES) -> DataFrame:
    """df (session, frame, ...) with `out`, the sum of value over the session's rows up to this one, in order of frames."""
    rows = df.withColumn("__slice", slice_of("frame", frames)).withColumn("__value", value)
    sums = rows.groupBy(*KEY).agg(F.sum("__value").alias("__sum"))
    earlier = W.partitionBy("session").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*KEY, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    own = F.sum("__value").over(W.partitionBy(*KEY).orderBy("frame"))
    return rows.withColumn("__own", own).join(base, KEY).withColumn(out, F.col("__base") + F.col("__own")).drop("__slice", "__value", "__own", "__base")


def in_order(df: DataFrame, order: list[str], out: str, rows: int = 100_000) -> DataFrame:
    """df with `out`, its rows' numbers from 0 in the order of these columns (nulls first): rows are cut into ranges of about
    `rows`, written and counted, so no task sorts them all. Rows that are equal in all of the columns are numbered as they come."""
    ranges = max(1, -(-df.count() // rows))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(before, "__range").withColumn(out, F.col("__base") + F.col("__own")).drop("__range", "__own", "__base")
