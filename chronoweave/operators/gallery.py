"""Vector galleries: exact nearest shots in blocks, candidates by subject, open-set decisions, enrolment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.params import DEFAULT, Params
from chronoweave.session import written

#: Rows of a block; a task holds one block of queries and one of shots.
BLOCK = 4096
#: Middles of cells, drawn from the shots by hash; that many vectors reach the driver and every task.
PIVOTS = 64

_FOUND = "query long, row long, subject long, score double"


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_list()) if len(vecs) else np.empty((0, 0))


def _cells(shots: DataFrame, block: int, pivots: int) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """Shots with their cell (the nearest pivot) and a block in it; the pivots; and of each cell its blocks and its radius, the
    greatest distance of a shot from its pivot."""
    drawn = shots.orderBy(F.xxhash64("row"), "row").limit(pivots).select("vec").collect()
    middles = np.array([r["vec"] for r in drawn], dtype=np.float64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["vec"])
            squares = (x * x).sum(axis=1)[:, None] - 2 * x @ middles.T + (middles * middles).sum(axis=1)
            cell = squares.argmin(axis=1)
            yield pdf.assign(cell=cell, far=np.linalg.norm(x - middles[cell], axis=1))

    placed = written(shots.mapInPandas(place, "row long, subject long, vec array<double>, cell int, far double"), "cells")
    rows = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    known = sorted(({"cell": r["cell"], "blocks": -(-r["n"] // block), "far": r["far"]} for r in rows), key=lambda r: r["cell"])
    blocks = F.create_map(*[F.lit(x) for r in known for x in (r["cell"], r["blocks"])])[F.col("cell")] if known else F.lit(1)
    return placed.drop("far").withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int")), middles, known


def _best_in_blocks(asked: DataFrame, shots: DataFrame, k: int, groups: int) -> DataFrame:
    """(query, row, subject, score): of asked (query, vec, cell, block) the k best shots of each block, ties by row."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query", "int64"), ("row", "int64"), ("subject", "int64"), ("score", "float64"))})
        b = b.sort_values("row")
        scores = _matrix(a["vec"]) @ _matrix(b["vec"]).T
        n = min(k, scores.shape[1])
        order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        flat = order.reshape(-1)
        return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), n), "row": b["row"].to_numpy()[flat], "subject": b["subject"].to_numpy()[flat], "score": np.take_along_axis(scores, order, axis=1).reshape(-1)})

    key = ["cell", "block", "group"]
    left = asked.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
    right = shots.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, _FOUND)


def nearest_counted(queries: DataFrame, shots: DataFrame, k: int = DEFAULT.top_k, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, dict[str, int]]:
    """(query, row, subject, score, nth): the k shots of the highest inner product, exact, ties by row; and how many pairs of a
    query and a block there are and how many of them were compared.

    queries: query, vec; shots: row, subject, vec (arrays of double of one size). Rows whose vector is null are left out.
    Shots are dealt to the nearest of at most `pivots` of them, and each such cell is cut into blocks of about `block` rows. No shot
    of a cell can score more than the query's score with its pivot plus the query's length times the cell's radius (the
    triangle inequality). Each query is first compared with one block of the cell that promises most; cells that cannot reach the
    k-th score found there are skipped, all others are compared. A task holds one block of queries and one of shots;
    what is sent everywhere is the pivots and one row a cell.
    """
    q = queries.where("vec is not null").select("query", "vec")
    s, middles, known = _cells(shots.where("vec is not null").select("row", "subject", "vec"), block, pivots)
    asked = q.count()
    counts = {"pairs": asked * sum(r["blocks"] for r in known), "compared": 0}
    if not known or not asked:
        none = q.sparkSession.createDataFrame([], _FOUND + ", nth long")
        return none, counts
    groups = -(-asked // block)
    at, far, blocks = (np.array([r[c] for r in known]) for c in ("cell", "far", "blocks"))

    def bounds(vecs: pd.Series) -> np.ndarray:
        x = _matrix(vecs)
        reach = np.linalg.norm(x, axis=1)[:, None] * far[None, :]
        most = x @ middles[at].T + reach
        return most + 1e-9 * (1 + np.abs(most) + reach)  # more than the sums' rounding

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = bounds(pdf["vec"]).argmax(axis=1)
            yield pd.DataFrame({"query": pdf["query"], "vec": pdf["vec"], "cell": at[best], "block": pdf["query"].to_numpy() % blocks[best]})

    tried = q.mapInPandas(first, "query long, vec array<double>, cell int, block int")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "row"))
    bar = _best_in_blocks(tried, s, k, groups).withColumn("nth", nth).where(F.col("nth") == k).select("query", F.col("score").alias("bar"))

    def open_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, cell = np.nonzero(bounds(pdf["vec"]) >= pdf["bar"].fillna(-np.inf).to_numpy(np.float64)[:, None])
            yield pd.DataFrame({"query": pdf["query"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row], "cell": at[cell], "blocks": blocks[cell]})

    wanted = q.join(bar, "query", "left").mapInPandas(open_cells, "query long, vec array<double>, cell int, blocks int")
    wanted = written(wanted.select("query", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "asked")
    counts["compared"] = wanted.count()
    return _best_in_blocks(wanted, s, k, groups).withColumn("nth", nth.cast("long")).where(F.col("nth") <= k), counts


def nearest(queries: DataFrame, shots: DataFrame, k: int = DEFAULT.top_k, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The rows of nearest_counted."""
    return nearest_counted(queries, shots, k, block, pivots)[0]


def candidates(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per query and subject: its best score (0 at least), shots over the vote threshold, shots found, and best row."""
    by = found.groupBy("query", "subject").agg(
        F.greatest(F.lit(0.0), F.max("score")).alias("score"), F.count_if(F.col("score") >= p.vote).alias("votes"),
        F.count(F.lit(1)).alias("shots"), F.max_by("row", F.struct("score", -F.col("row"))).alias("best_row"),
    )
    return by.withColumn("best_row", F.when(F.col("score") > 0, F.col("best_row")))


def exposed(cands: DataFrame, most: int = 8) -> DataFrame:
    """The candidates of each query that are shown, in order (nth): the first `most` by score, votes and subject."""
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.desc("votes"), "subject"))
    return cands.withColumn("nth", nth.cast("long")).where(F.col("nth") <= most)


def decisions(queries: DataFrame, cands: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per query: hit, grey or new, the subject if hit, best score, margin to the second, and the reason.

    The best candidate is the first by (score, votes, smaller subject). At or over `hit` it is a hit unless its share of
    the votes is too small or a second with no fewer votes is too near; under `new`, or with no candidate, it is new.
    """
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("votes"), "subject")
    high = F.when(F.col("score") >= p.vote, F.col("votes")).otherwise(0)
    ranked = cands.withColumn("nth", F.row_number().over(order)).withColumn("high", F.sum(high).over(W.partitionBy("query")))
    pick = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    best = ranked.groupBy("query").agg(*(pick(1, c).alias(c) for c in ("subject", "score", "votes", "high")), pick(2, "score").alias("second"), pick(2, "votes").alias("second_votes"))
    rows = queries.select("query").join(best, "query", "left")
    return rows.select("query", *decide(F.col("subject"), F.col("score"), F.col("votes"), F.col("high"), F.col("second"), F.col("second_votes"), p))


def decide(subject: Column, score: Column, votes: Column, high: Column, second: Column, second_votes: Column, p: Params = DEFAULT) -> list[Column]:
    """The decision's columns: decision, subject, score, margin, reason."""
    over = score >= p.hit
    on = F.lit(p.consistency)
    split = on & over & (high > 0) & (votes / high < p.vote_share)
    close = on & over & ~split & second.isNotNull() & (score - second < p.margin) & (votes <= second_votes)
    decision = F.when(score.isNull() | (score < p.new), "new").when(~over | split | F.coalesce(close, F.lit(False)), "grey").otherwise("hit")
    reason = (
        F.when(score.isNull(), "empty_gallery").when(split, "topk_vote_inconsistent").when(close, "top1_margin_too_small")
        .when((score >= p.new) & ~over, "score_between_thresholds").otherwise("top1_score")
    )
    return [decision.alias("decision"), F.when(decision == "hit", subject).alias("subject"), F.round(score, 6).alias("score"), F.round(score - second, 6).alias("margin"), reason.alias("reason")]


def centroids(shots: DataFrame, by: str = "subject") -> DataFrame:
    """(by, n, vec): the mean of each group's vectors at length 1; sums are made per number, before the shuffle."""
    parts = shots.where("vec is not null").select(by, F.posexplode("vec").alias("at", "x")).groupBy(by, "at").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    means = parts.groupBy(by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return means.select(by, "n", V.unit(F.col("v.x")).alias("vec"))


def weighted_centroids(shots: DataFrame, weight: Column, by: str = "subject") -> DataFrame:
    """(by, vec): means weighed by quality (clamped to 0..1), plain where all weights are 0, at length 1."""
    w = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)), F.lit(0.0))
    parts = shots.where("vec is not null").select(by, w.alias("w"), F.posexplode("vec").alias("at", "x")).groupBy(by, "at").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w"), F.avg("x").alias("x"))
    means = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(F.col("x")).alias("x")))).alias("v"))
    return means.select(by, V.unit(F.col("v.x")).alias("vec"))


def with_distractors(shots: DataFrame, distractors: DataFrame) -> DataFrame:
    """A gallery and vectors that belong to nobody in it: subjects of distractors are told apart as negative numbers."""
    return shots.select("row", "subject", "vec").unionByName(distractors.select("row", (-1 - F.col("row")).alias("subject"), "vec"))


def gallery_stats(shots: DataFrame) -> DataFrame:
    """Subjects and shots over all, and each subject's shots (subject null for the total)."""
    return shots.groupingSets([["subject"], []], "subject").agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("shots"))


class Gallery:
    """One session's gallery, filled as vectors come in order."""

    def __init__(self, p: Params = DEFAULT) -> None:
        self.p = p
        self.vectors: list[np.ndarray] = []
        self.owners: list[int] = []
        self.shots: dict[int, int] = {}
        self.negatives: list[np.ndarray] = []
        self._rows = np.empty((0, 0))
        self._filled = 0

    def _matrix(self) -> np.ndarray:
        """vectors as the rows of one matrix, which grows by doubling."""
        n = len(self.vectors)
        if n > len(self._rows):
            grown = np.empty((max(8, 2 * n), len(self.vectors[0])))
            if self._filled:
                grown[: self._filled] = self._rows[: self._filled]
            self._rows = grown
        for i in range(self._filled, n):
            self._rows[i] = self.vectors[i]
        self._filled = n
        return self._rows[:n]

    def identify(self, v: np.ndarray) -> tuple[str, int | None, float, str, bool]:
        """Decision, subject, score, reason, and whether a refused vector like this one was seen (only told)."""
        p = self.p
        told = any(float(v @ n) >= p.negative_similarity for n in self.negatives)
        if not self.vectors:
            return "new", None, 0.0, "empty_gallery", told
        scores = self._matrix() @ v
        top = np.argsort(-scores, kind="stable")[: p.top_k]
        found: dict[int, list[float]] = {}
        for i, score in zip(top.tolist(), scores[top].tolist(), strict=True):
            best = found.setdefault(self.owners[i], [0.0, 0])
            best[0] = max(best[0], score)
            best[1] += score >= p.vote
        ranked = sorted(found.items(), key=lambda c: (-c[1][0], -c[1][1], c[0]))
        subject, (score, votes) = ranked[0]
        if score < p.new:
            return "new", None, score, "top1_score", told
        if score < p.hit:
            return "grey", None, score, "score_between_thresholds", told
        high = sum(c[1] for _, c in ranked if c[0] >= p.vote)
        if p.consistency and high > 0 and votes / high < p.vote_share:
            return "grey", None, score, "topk_vote_inconsistent", told
        if p.consistency and len(ranked) > 1 and score - ranked[1][1][0] < p.margin and votes <= ranked[1][1][1]:
            return "grey", None, score, "top1_margin_too_small", told
        return "hit", subject, score, "top1_score", told

    def _add(self, subject: int, v: np.ndarray) -> None:
        self.vectors.append(v)
        self.owners.append(subject)
        self.shots[subject] = self.shots.get(subject, 0) + 1

    def enrol(self, v: np.ndarray, ok: bool, auto: bool = True) -> dict:
        """Identify and act: a hit may add a shot, a new vector of good quality becomes a subject, others are refused."""
        p = self.p
        decision, subject, score, reason, told = self.identify(v)
        enrolled = rejected = False
        if decision == "hit" and not ok and round(score, 4) < p.low_quality_hit:
            decision, subject, rejected = "grey", None, True
        elif decision == "hit":
            if ok and self.shots[subject] < p.max_shots:
                self._add(subject, v)
        elif decision == "new" and auto:
            if ok:
                subject, enrolled = len(self.shots) + 1, True
                self._add(subject, v)
                self.negatives = [n for n in self.negatives if float(v @ n) < p.negative_similarity]
        else:
            self.negatives = [*self.negatives, v][-p.negative_size :]
        return {"decision": decision, "subject": subject, "score": round(score, 6), "reason": reason, "enrolled": enrolled, "rejected": rejected, "negative": told, "shots": self.shots.get(subject, 0)}


ENROLLED = "session string, seq long, decision string, subject long, score double, reason string, enrolled boolean, rejected boolean, negative boolean, shots long"


_ANSWERS = {
    "decision": pa.string(), "subject": pa.int64(), "score": pa.float64(), "reason": pa.string(), "enrolled": pa.bool_(), "rejected": pa.bool_(), "negative": pa.bool_(), "shots": pa.int64(),
}


def enrolled(vecs: np.ndarray, ok: list[bool], auto: list[bool], p: Params = DEFAULT) -> list[dict]:
    """What a gallery that starts empty says of one session's vectors, the rows of vecs, brought to length 1 in their order."""
    gallery, told = Gallery(p), []
    for v, good, may in zip(vecs, ok, auto, strict=True):
        size = math.sqrt(v @ v)
        told.append(gallery.enrol(v / size if size else v, bool(good), bool(may)))
    return told


def enrolments(seen: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Open-set enrolment of seen (session, seq, vec, ok) in order of seq, each session by itself.

    Routes with other rules pass other thresholds as p, and may say in a column `auto` which vectors may become subjects (a
    face only if it may enrol; all, where there is no such column).

    Who is known depends on all that came before, so a session is one fold; sessions run in parallel, and a fold's
    state is bounded by subjects times max_shots, not by what was seen. Vectors are brought to length 1.
    """

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        told = enrolled(V.matrix(rows["vec"]), rows["ok"].to_pylist(), rows["auto"].to_pylist(), p)
        answers = (pa.array([r[c] for r in told], of) for c, of in _ANSWERS.items())
        return pa.table([rows["session"], rows["seq"], *answers], names=["session", "seq", *_ANSWERS])

    auto = F.col("auto") if "auto" in seen.columns else F.lit(True)
    rows = seen.select(F.col("session").cast("string"), F.col("seq").cast("long"), F.col("vec").cast("array<double>"), "ok", auto.alias("auto"))
    return rows.groupBy("session").applyInArrow(fold, ENROLLED)

