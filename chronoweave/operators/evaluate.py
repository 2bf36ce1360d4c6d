"""Evaluation: rank-k hits, accuracy by groups, calibration, paired outcomes, coverage, samples and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.slices import in_order
from chronoweave.session import written

#: Draws with replacement that a task makes.
DRAWN = 2_000_000


def rank_k(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, n_probe, rate): of the queries with results, the share in % with a right subject among their k best."""
    rows = found.join(truth.select("query", F.col("subject").alias("right")), "query").withColumn("ok", F.col("subject") == F.col("right"))
    hits = rows.groupBy("query").agg(*(F.bool_or(F.col("ok") & (F.col("nth") <= k)).alias(f"at{k}") for k in ks))
    ladder = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"at{k}").alias("hit")) for k in ks)))
    return hits.select(ladder.alias("r")).select("r.*").groupBy("k").agg(F.count(F.lit(1)).alias("n_probe"), F.round(F.avg(F.col("hit").cast("double")) * 100, 2).alias("rate"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """Right, total and rate in % by route and bin, and by route over all bins (bin null)."""
    right = F.sum(F.col("right").cast("long"))
    return outcomes.groupingSets([["route", "bin"], ["route"]], "route", "bin").agg(right.alias("correct"), F.count(F.lit(1)).alias("total"), F.round(right * 100.0 / F.count(F.lit(1)), 2).alias("rank1"))


def calibration(scored: DataFrame, by: list[str], score: str = "score", good: str = "good") -> DataFrame:
    """Precision and coverage of keeping all rows with at least each score that occurs.

    Rows are first counted by score, so the running sums go over distinct scores of a group and not over rows.
    """
    counts = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(good).cast("long")).alias("g"))
    down = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    run = counts.withColumn("kept", F.sum("n").over(down)).withColumn("right", F.sum("g").over(down))
    total = F.sum("n").over(W.partitionBy(*by))
    return run.select(*by, F.col(score).alias("threshold"), "kept", F.round(F.col("right") / F.col("kept"), 6).alias("precision"), F.round(F.col("kept") / total, 6).alias("coverage"))


def threshold_for(curve: DataFrame, by: list[str], precision: float) -> DataFrame:
    """The lowest threshold of each group whose precision will do."""
    return curve.where(F.col("precision") >= precision).groupBy(*by).agg(F.min("threshold").alias("threshold"), F.max("coverage").alias("coverage"))


def reject_curve(curve: DataFrame) -> DataFrame:
    """A calibration curve told from the other side: the share rejected below each threshold, and the errors among the kept."""
    return curve.select(*[c for c in curve.columns if c not in ("precision", "coverage")], F.round(1 - F.col("coverage"), 6).alias("rejected"), F.round(1 - F.col("precision"), 6).alias("error"))


def transitions(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """What changed between paired outcomes (sample_id, pred, right, genuine, confidence), in one row of counts."""
    a, b = (d.select("sample_id", *(F.col(c).alias(f"{p}_{c}") for c in ("pred", "right", "genuine", "confidence"))) for d, p in ((before, "a"), (after, "b")))
    accepted = lambda p: ~F.col(f"{p}_genuine") & (F.col(f"{p}_confidence") >= threshold)
    both = a.join(b, "sample_id")
    return both.agg(
        F.count(F.lit(1)).alias("paired"), F.count_if(~F.col("a_pred").eqNullSafe(F.col("b_pred"))).alias("changed"),
        F.count_if(~F.col("a_right") & F.col("b_right")).alias("improved"), F.count_if(F.col("a_right") & ~F.col("b_right")).alias("degraded"),
        F.count_if(~accepted("a") & accepted("b")).alias("false_accept_up"), F.count_if(accepted("a") & ~accepted("b")).alias("false_accept_down"),
    )


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, status): missing where only expected has it, extra where only present has it."""
    e, p = expected.select(key).distinct(), present.select(key).distinct()
    return e.join(p, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(p.join(e, key, "left_anti").withColumn("status", F.lit("extra")))


def seeded_sample(rows: DataFrame, group: str, item: str, groups: int, items: int, seed: str) -> DataFrame:
    """At most `items` rows of each of at most `groups` groups, chosen by a hash that depends on the seed only."""
    order = lambda c: F.md5(F.concat_ws("|", F.lit(seed), F.col(c).cast("string")))
    chosen = rows.select(group).distinct().orderBy(order(group), group).limit(groups)
    nth = F.row_number().over(W.partitionBy(group).orderBy(order(item), item))
    return rows.join(chosen, group, "left_semi").withColumn("__n", nth).where(F.col("__n") <= items).drop("__n")


def resampled(clusters: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, mean): means over clusters (pid, value) by the Poisson bootstrap, for intervals; the same in every run.

    Instead of drawing as many clusters as there are with replacement, each one's weight in a draw is Poisson with mean 1,
    found from a hash: what draws with replacement tend to, and clusters need not meet in one place to be drawn.
    """
    u = (F.pmod(F.xxhash64("pid", "draw", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    steps, term, total = [], 2.718281828459045**-1, 0.0
    for k in range(12):
        total += term
        steps.append(F.when(F.lit(total) < u, 1).otherwise(0))
        term /= k + 1
    weight = sum(steps[1:], steps[0])
    drawn = clusters.select("pid", "value", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight)
    return drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def drawn_means(clusters: DataFrame, draws: int, seed: str) -> DataFrame:
    """(draw, mean): in each draw as many clusters as there are, with replacement, and the mean of their values.

    clusters: pid (each once) and value. Cluster number i of n, in order of pid, stands for place i of every draw; the cluster
    drawn there is the first 48 bits of md5 of `seed|draw|place`, modulo n. Places and draws are dealt to as many tasks as keep
    about DRAWN draws each, every draw meets its value there and is added up at once, so a task holds a part of the clusters and
    one sum a draw, whatever their numbers. The same in every run; a null value counts as 0.
    """
    rows = written(in_order(clusters.select("pid", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")), ["pid"], "place"), "clusters")
    n = rows.count()
    parts = max(1, -(-n * draws // DRAWN))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("place").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = rows.select("place").repartition(parts, "place").select("place", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.select("draw", F.pmod(bits, F.lit(max(n, 1)).cast("long")).alias("place")).repartition(parts, "place")
    met = drawn.join(rows.select("place", "value").repartition(parts, "place").hint("shuffle_hash"), "place")
    return met.groupBy("draw").agg((F.sum("value") / F.lit(max(n, 1))).alias("mean"))


def interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: the percentile interval of draws' means (low, high; linear between ranks), their mean and number."""
    tail = (1 - level) / 2
    return means.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"), F.avg("mean").alias("centre"), F.count(F.lit(1)).alias("draws"))


def sign_flip(clusters: DataFrame, draws: int, seed: int) -> DataFrame:
    """Two-sided p-value that the clusters' mean differs from 0, by flipping signs at random; one row."""
    sign = F.when(F.pmod(F.xxhash64("pid", "draw", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    drawn = clusters.select("pid", "value", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    means = drawn.groupBy("draw").agg(F.abs(F.avg(sign * F.col("value"))).alias("m"), F.abs(F.avg("value")).alias("seen"))
    return means.agg(((F.count_if(F.col("m") >= F.col("seen") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def stage_times(timings: DataFrame) -> DataFrame:
    """Total and longest time of each stage, longest total first."""
    return timings.groupBy("stage").agg(F.sum("seconds").alias("total"), F.max("seconds").alias("longest")).orderBy(F.desc("total"), "stage")
