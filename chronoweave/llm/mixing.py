"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.ranking import ROWS_PER_BLOCK, ranked_in_order
from chronoweave.session import read_table, written

#: No source gives more than so many times its size.
MOST_COPIES = 3
#: Expected copies are counted in units of 1 / UNIT, so that prefix sums are exact integers.
UNIT = 1 << 24
#: Source tables up to so many rows (a few dozen bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", most: int = MOST_COPIES) -> DataFrame:
    """One row per source: its size, weight (1, 2, 3, repeating by code point, null last) and target.

    Targets share the total by weight, none above `most` times its source's size; resharing the excess until none is
    above ends where all open sources get the same amount per weight. In order of limit per weight, the sources that
    reach their limit come first, so the level is found with running sums over the sources.
    """
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    weighed = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("limit", F.lit(most) * F.col("source_size"))
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), F.col(source).asc_nulls_last())
    below, onward = by_limit.rowsBetween(W.unboundedPreceding, -1), by_limit.rowsBetween(0, W.unboundedFollowing)
    every = by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(below), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("weight").over(onward)).withColumn("open", F.col("limit") >= F.col("level") * F.col("weight"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce(final, F.lit(0.0)))
    return level.select(source, "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, size: Column, source: str = "source", ties: list[str] | None = None, seed: str = "", most: int = MOST_COPIES, targets: DataFrame | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """docs with size, source_size, target and copies: how many times the mix takes the row (0 to `most`).

    Within a source each document is expected target / source_size times. Documents are ranked by size (then `ties`),
    the rank's multiple of that expectation is the prefix sum, one random offset per source is added, and a document is
    taken once for each whole number its stretch crosses. Sorting by size keeps a source's words within about one
    document of its target. Ranks are counted over ranges of rows_per_block rows, so no source is sorted by one task.
    Sizes must not be negative; a null size counts as 0; a null source is a source of its own. Sources without words
    have target 0. An empty table gives an empty table. Rows that repeat an id count each for itself. Columns of docs named
    size, source_size, target or copies are replaced (`size` and `ties` may name them), others pass through; the names __src,
    __size, __u, __tie and __block are taken.
    """
    ties = ties or []
    taken = [c for c in ("size", "source_size", "target", "copies") if c not in (*ties, source)]
    sized = docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("long")).drop(*taken).withColumnRenamed("__size", "size")
    per_source = written(source_targets(sized.select(source, "size"), source, "size", most) if targets is None else targets, "targets")
    name = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("-"))
    chance = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    offset = F.conv(F.substring(F.md5(F.concat(name(F.col(source)), F.lit(seed))), 1, 6), 16, 10).cast("long")
    per_source = per_source.select(name(F.col(source)).alias("__src"), "source_size", "target", chance.cast("long").alias("__step"), offset.alias("__u"))
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    keyed = sized.withColumn("__src", name(F.col(source)))
    order = [F.col("size").asc(), *[F.col(t).asc_nulls_last() for t in ties]]
    rows = ranked_in_order(keyed, "__src", order, rows_per_block, "__rank").join(per_source, "__src")
    whole = F.shiftright((F.col("__rank") + 1) * F.col("__step") + F.col("__u"), 24) - F.shiftright(F.col("__rank") * F.col("__step") + F.col("__u"), 24)
    return rows.withColumn("copies", whole).drop("__src", "__step", "__u", "__rank")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; null texts have size 0, and documents without a source are a source of their own."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    mixed = mix_sources(sizes, F.col("size"), ties=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from t),
l as (select *, sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over (o rows between current row and unbounded following) as onward from w
  window o as (order by (3 * source_size)::double / weight, source nulls last)),
v as (select *, rest::double / onward as level from l),
f as (select max(case when 3 * source_size >= level * weight then level end) as final from v),
g as (select source, source_size, least((3 * source_size)::double, weight * coalesce(final, 0.0)) as target from w, f),
s as (select *, case when source_size > 0 then floor(target / source_size * 16777216) else 0 end::bigint as step,
  ('0x' || substr(md5(coalesce('s' || source, '-')), 1, 6))::bigint as u from g),
r as (select d.doc_id, d.size, s.source_size, s.target, s.step, s.u, row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as rk
  from d join s on d.source is not distinct from s.source)
select doc_id, size, source_size, target, size * (((rk + 1) * step + u) // 16777216 - (rk * step + u) // 16777216) as taken from r
"""
