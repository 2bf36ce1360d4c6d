"""Rows by a list of ids, without moving their texts while the list is short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import written

#: So many ids are sent to every executor at most (8 bytes each, about 50 MB as a hash table). Of more, texts are dealt by id.
MOST_BROADCAST = 1 << 20


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int = MOST_BROADCAST) -> DataFrame:
    """The rows whose `key` is in ids (left_semi) or not in it (left_anti, null keys included), with rows' columns.

    ids has the one column `key`, without repeats; it is written and counted, and broadcast only if it holds no more than
    `most`. Beyond that the join is Spark's choice; the rows are the same.
    """
    held = written(ids.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()), "ids")
    return rows.join(F.broadcast(held) if held.count() <= most else held, key, how)
