"""Connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import written

MOST_ROUNDS = 60


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node that is reachable.

    Rounds of taking the smallest label among neighbours, then the label's own label, which halves the way that is
    left; each round is written and the last one changes nothing. Labels are pre-aggregated before each shuffle.
    """
    both = edges.select(F.col(u).alias("node"), F.col(v).alias("other")).where("node <> other")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        best = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        up = best.select(F.col("node").alias("up"), F.col("c").alias("above"))
        jumped = best.join(up, best["c"] == up["up"], "left")
        new = written(jumped.select("node", F.col("component").alias("old"), F.least("c", F.coalesce("above", "c")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
