"""Exact duplicates, with the frequent digests split off by Misra-Gries summaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import read_table, written

#: Counters of each summary: any digest with more than 1/COUNTERS of the rows is found, so at most COUNTERS are broadcast.
COUNTERS = 512

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; runs of ASCII white space become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def misra_gries(counts: Counter, k: int) -> Counter:
    """Merge step: keep at most k counters by taking the (k+1)-th largest count off all of them."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({key: n - cut for key, n in counts.items() if n > cut})


def _summarise(key: str, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            total.update(pdf[key].value_counts(sort=False).to_dict())
            total = misra_gries(total, k)
        yield pd.DataFrame({key: pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    return run


def heavy_hitters(rows: DataFrame, key: str, value: str, k: int = COUNTERS) -> DataFrame:
    """At most k rows (key, min of value, count): every key with more than 1/k of the rows, counts exact.

    One pass of summaries with 4 k counters, one per partition. Each undercounts by at most a 4k-th of its rows, so the
    counters of a key over n/k sum to more than 3/4 n/k; as all counters sum to at most n, fewer than 4/3 k candidates
    pass that bar and are broadcast. A second pass counts them exactly, and those over n/k, at most k, are returned.
    """
    summaries = rows.select(key).mapInPandas(_summarise(key, 4 * k), f"{key} string, n long")
    total = rows.count()
    candidates = summaries.groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") * 4 * k > F.lit(3 * total)).select(key)
    exact = rows.join(F.broadcast(candidates), key, "left_semi").groupBy(key).agg(F.min(value).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return exact.where(F.col("group_size") * k > total)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Digests are computed once and written. Frequent digests (Misra-Gries, then counted exactly) are broadcast, at most
    k rows, and answer their rows on the map side; the rest is shuffled once by digest, and none of its groups has more
    than 1/k of the rows.
    Null text is empty text; a null doc_id sorts after all others and is kept only if its whole group has none; of rows
    that repeat the smallest doc_id all are marked kept. An empty table gives an empty table. Other columns are not read.
    """
    digests = written(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256")), "digests")
    heavy = written(heavy_hitters(digests, "text_sha256", "doc_id", k), "heavy")
    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    equal = W.partitionBy("text_sha256")
    rest = marked.where(F.col("group_size").isNull()).select("doc_id", "text_sha256")
    rest = rest.select("doc_id", "text_sha256", F.min("doc_id").over(equal).alias("keep_id"), F.count(F.lit(1)).over(equal).alias("group_size"))
    both = marked.where(F.col("group_size").isNotNull()).unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents, null texts as empty ones."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
