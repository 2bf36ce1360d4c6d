"""Ranks within keys that no single task has to sort whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import written

ROWS_PER_BLOCK = 5_000


def ranked(df: DataFrame, key: str, order: list[Column], salt: list[Column], rows_per_block: int = ROWS_PER_BLOCK, out: str = "rank", few_keys: bool = False) -> DataFrame:
    """Add `out`: each row's number from 0 within `key`, gapless and the same in every run.

    A key's rows are dealt by a hash of `salt` over blocks of about rows_per_block rows; the blocks are numbered one
    after the other and each block is sorted by `order`, every other one in reverse so that neighbours at a seam are
    alike. A key with a third of all rows is thus spread over as many tasks as its size asks for. `key` must not be
    null; rows with equal order and salt are interchangeable.

    The counts per key are joined by key, broadcast if few_keys says that their number is bounded; rows are then dealt
    by (key, block), never by key alone; the offsets per (key, block) come from counts, not from rows.
    """
    blocks = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block)).cast("long").alias("__blocks"))
    dealt = df.join(F.broadcast(blocks) if few_keys else blocks, key).withColumn("__block", F.pmod(F.xxhash64(*salt), F.col("__blocks")))
    dealt = dealt if few_keys else dealt.repartition(key, "__block")
    offsets = dealt.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select(key, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.col("__n").alias("__size"))
    within = W.partitionBy(key, "__block").orderBy(*order)
    numbered = dealt.withColumn("__rn", F.row_number().over(within) - 1).join(offsets, [key, "__block"])
    rank = F.when(F.col("__block") % 2 == 0, F.col("__rn")).otherwise(F.col("__size") - 1 - F.col("__rn"))
    return numbered.withColumn(out, F.col("__offset") + rank).drop("__blocks", "__block", "__offset", "__size", "__rn")


def ranked_in_order(df: DataFrame, key: str, order: list[Column], rows_per_block: int = ROWS_PER_BLOCK, out: str = "rank") -> DataFrame:
    """Add `out`: each row's number from 0 within `key` in exactly the order `order`, whatever the key's size.

    All rows are cut into ranges of about rows_per_block rows by (key, order), and the ranges are written; a row's number
    is the count of its key's rows in earlier ranges and its place in its own. Rows that are equal in all of that are
    numbered as they come, so they too are spread over ranges. `key` must not be null.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranges = max(1, -(-df.count() // rows_per_block))
    dealt = written(tied.repartitionByRange(ranges, F.col(key).asc(), *order, F.col("__tie").asc()).withColumn("__block", F.spark_partition_id()), "ranges")
    before = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(key, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = W.partitionBy(key, "__block").orderBy(*order, F.col("__tie").asc())
    numbered = dealt.withColumn("__rn", F.row_number().over(within) - 1).join(offsets, [key, "__block"])
    return numbered.withColumn(out, F.col("__offset") + F.col("__rn")).drop("__tie", "__block", "__offset", "__rn")
