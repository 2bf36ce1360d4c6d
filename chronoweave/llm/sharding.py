"""Shards of near equal bytes: groups that must stay together, largest first, each to the least-loaded shard through a heap."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.ranking import ranked, ranked_in_order
from chronoweave.session import emptied, read_table, written

SHARDS = 40
#: What a document weighs besides its text's bytes.
OVERHEAD = 16
#: A group with more than 1/APART of a mean shard's bytes is scheduled alone, at most SHARDS * APART of them; so is one with
#: more than 1/FREQUENT of all rows, at most FREQUENT of them. These are all that is broadcast.
APART, FREQUENT = 256, 512
#: Of the smaller groups, those whose sizes agree in so many leading bits are one class (at most 2**(BITS - 1) for each power of two).
BITS = 6

Run = tuple[int, int, list[int]]  # from which rank on, how many groups, and the shards that take turns


def schedule(items: list[tuple[float, int]], shards: int) -> tuple[list[list[Run]], list[float]]:
    """Longest processing time first for items (size, how many groups of that size), sizes descending: the runs of each
    item, and the shards' loads.

    The heap gives each group to the least-loaded shard, of equal ones to the lowest number. Many groups of one size are
    given out in runs: shards that are within one group of the least-loaded one take turns, so whole turns up to the next
    shard's load are counted instead of walked; an item costs at most about 2 * shards runs, whatever its number of groups.
    """
    heap = [(0.0, j) for j in range(shards)]
    out = []
    for size, n in items:
        runs, at = [], 0
        while at < n:
            load, least = heap[0]
            if n - at == 1:
                heapq.heapreplace(heap, (load + size, least))
                runs.append((at, 1, [least]))
                break
            order = sorted(heap)
            near = max(1, bisect.bisect_left(order, (load + size, -1)))
            turns = (n - at) // near
            if near < shards and size > 0:
                turns = min(turns, max(1, int((order[near][0] - load) // size)))
            taken = turns * near if turns else n - at
            members = [j for _, j in order[:near]]
            runs.append((at, taken, members))
            heap = [(x + size * (taken // near + (i < taken % near)), j) if i < near else (x, j) for i, (x, j) in enumerate(order)]
            heapq.heapify(heap)
            at += taken
        out.append(runs)
    loads = [0.0] * shards
    for load, j in heap:
        loads[j] = load
    return out, loads


def size_class(size: Column) -> Column:
    """The size without all but its BITS leading bits."""
    low = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def _turn(runs: dict[int, list[Run]]):
    firsts = {c: [r[0] for r in of] for c, of in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = []
            for c, rank in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                first, _, members = runs[c][bisect.bisect_right(firsts[c], rank) - 1]
                shards.append(members[(rank - first) % len(members)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.int32())], ["__group", "shard"])

    return run


def assign_shards(rows: DataFrame, group: Column, size: Column, shards: int = SHARDS, order: list[str] | None = None) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (from 0 within the shard, gapless).

    Rows with equal `group` (null is a group of its own) stay in one shard; `size` is a row's weight, at least 0, null
    counts as 0. Groups are summed before they are shuffled. Large and frequent groups, at most shards * APART + FREQUENT,
    are scheduled one by one by their exact sums. All others are smaller than 1/APART of a mean shard; they are scheduled by
    class of size with the class's mean, and dealt in order of size by the runs of the plan. A class's sizes differ by less
    than 1/32, so what the loads depart from the plan is about the size of the largest of these groups; the plan itself is
    that of the heap. A group that is larger than a mean shard fills its shard alone, as it must stay together.

    A group's rows are dealt in blocks when they are numbered, by hash of all columns of `order` (which should tell rows
    apart; default: all), so a shard that holds a third of all rows is numbered by many tasks. Columns of rows named shard
    or slot are replaced, others pass through; __group, __size and names of `ranking` are taken. Rows that repeat an id count
    each. An empty table gives an empty table.
    """
    rows = rows.withColumns({"__group": F.coalesce(F.sha2(group.cast("string"), 256), F.lit("")), "__size": F.coalesce(size.cast("long"), F.lit(0).cast("long"))}).drop("shard", "slot")
    rows = written(rows, "rows")
    groups = written(rows.groupBy("__group").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__n")), "groups")
    total = groups.agg(F.sum("__bytes").alias("bytes"), F.sum("__n").alias("n")).first()
    apart = (F.col("__bytes") * shards * APART > F.lit(total["bytes"] or 0)) | (F.col("__n") * FREQUENT > F.lit(total["n"] or 0))
    alone = groups.where(apart).select("__group", "__bytes").collect()
    small = groups.where(~apart).select("__group", "__bytes", size_class(F.col("__bytes")).alias("__class"))
    classes = small.groupBy("__class").agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("bytes")).collect()

    items = [(float(r["__bytes"]), 1, r["__group"], None) for r in alone] + [(r["bytes"] / r["n"], r["n"], "", r["__class"]) for r in classes]
    items.sort(key=lambda x: (-x[0], x[2]))
    plan, _ = schedule([x[:2] for x in items], shards)
    single = [(x[2], runs[0][2][0]) for x, runs in zip(items, plan, strict=True) if x[3] is None]
    by_class = {x[3]: runs for x, runs in zip(items, plan, strict=True) if x[3] is not None}

    dealt = ranked_in_order(small, "__class", [F.col("__bytes").desc(), F.col("__group").asc()], out="__rank")
    dealt = dealt.select("__group", "__class", "__rank").mapInArrow(_turn(by_class), "__group string, shard int")
    known = rows.sparkSession.createDataFrame(single, "__group string, __alone int")
    marked = rows.join(F.broadcast(known), "__group", "left")
    one = marked.where("__alone is not null").withColumnRenamed("__alone", "shard")
    rest = marked.where("__alone is null").drop("__alone").join(dealt, "__group")
    placed = written(one.unionByName(rest).drop("__group", "__size"), "placed")
    tell = [F.col(c) for c in order or [c for c in placed.columns if c != "shard"]]
    numbered = ranked(placed, "shard", [c.asc_nulls_last() for c in tell], tell, out="slot", few_keys=True)
    for done in (rows, groups):
        emptied(done)
    return numbered


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and OVERHEAD."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def write_shards(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, rows_per_file: int = 50_000) -> DataFrame:
    """Write docs as Parquet into `folder`, one folder a shard, in order of slots and in files of about rows_per_file rows;
    returns the table as it is read back. Equal texts stand in one shard."""
    small = docs.select(F.monotonically_increasing_id().alias("__row"), *[c for c in docs.columns if c not in ("shard", "slot")])
    small = written(small, "docs")
    found = assign_shards(small.select("__row", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__text"), text_size(F.col(text)).alias("__bytes")), F.col("__text"), F.col("__bytes"), shards, ["__row"])
    part = F.floor(F.col("slot") / rows_per_file)
    rows = small.join(found.select("__row", "shard", "slot"), "__row").drop("__row").withColumn("__part", part)
    rows.repartition("shard", "__part").sortWithinPartitions("shard", "slot").drop("__part").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def op12_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents, by the law of near equal bytes; null texts are empty ones and equal to them."""
    docs = read_table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("__text"))
    placed = assign_shards(rows, F.col("__text"), F.col("size"), SHARDS, ["doc_id", "__text"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
