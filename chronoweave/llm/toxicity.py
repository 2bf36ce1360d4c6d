"""Toxicity: disguised words restored by a noisy-channel Viterbi decoder under a character model, then scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.memory import give_back
from chronoweave.session import read_table, small_batches, written

# The alphabet (anything else is a break, number 0) and what a sign may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåçèéêëìíîïñòóôõöùúûüßœæ"
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "&": "a"}

#: About so many labelled documents at most are learned from; a smaller table is used whole.
TRAIN_ROWS = 20_000
#: Features of the classifier, lengths of the character runs that they are, and documents that each must be in.
FEATURES, GRAMS, LEAST_DOCS = 400, (4, 5, 6), 3
FOLDS = 5

SIZE = 64
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x250, dtype=np.uint8)
for _c, _i in _NUMBER.items():
    _TABLE[ord(_c)] = _i

_LETTER = f"[{LETTERS}]"
_SIGN = "[" + re.escape("".join(LEET)) + "]"
_LONG_TOKEN = re.compile(rf"(?<!\S)(?=\S*?({_LETTER})\1\1)\S+")  # tried at the starts of tokens alone, so linear
_SPACED = re.compile(rf"(?<!\S)(?:{_LETTER}|{_SIGN})(?:[ ._*\-/](?:{_LETTER}|{_SIGN})){{2,}}(?=[\s.,;:!?]|$)")
_SEPARATORS = frozenset(" ._*-/")

# Kinds of characters: letters, signs that may stand for one, separators of spaced words, white space.
_IS_LETTER, _IS_SIGN, _IS_SEPARATOR, _IS_WHITE = 1, 2, 4, 8
_KIND = np.zeros(0x3002, dtype=np.uint8)
for _i in range(len(_KIND)):
    _c = chr(_i)
    _KIND[_i] = _IS_LETTER * (_c in LETTERS) + _IS_SIGN * (_c in LEET) + _IS_SEPARATOR * (_c in _SEPARATORS) + _IS_WHITE * _c.isspace()

#: Characters of texts that are looked through at once.
CHUNK = 1 << 18

# The channel: natural logarithms of how likely each disguise is.
KEEP, AS_LETTER, AS_BREAK, ONE_OF_RUN, TWO_OF_RUN, JOINED, APART = -0.05, -1.0, -1.6, -0.3, -1.4, -0.3, -1.4


def numbers(text: str) -> np.ndarray:
    """The text's characters as numbers of the alphabet."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


class CharacterModel:
    """Log probabilities of a character after two others, from trigram counts with back-off to pairs and single ones."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3).reshape(-1).tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest path through a lattice of (string, log probability): Viterbi over the last two characters.

        Each state links back to the one that it came from, and only the best path is spelled, so the work is linear in
        the lattice's length; of equally likely paths the last one by spelling is taken.
        """
        log, number = self.log, _NUMBER
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in [*lattice, [(" ", 0.0)]]:
            best: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for string, cost in options:
                    s, to = score + cost, state
                    for c in string:
                        n = number.get(c, 0)
                        s += log[to * SIZE + n]
                        to = (to % SIZE) * SIZE + n
                    if to not in best or s > best[to][0]:
                        best[to] = (s, (path, string))
            states = best
        top = max(score for score, _ in states.values())
        return max(spelled(path) for score, path in states.values() if score == top).strip()


def spelled(path: tuple | None) -> str:
    """The strings of a path of links, first to last."""
    out = []
    while path is not None:
        path, string = path
        out.append(string)
    return "".join(reversed(out))


def lattice_of(token: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters of a token may stand for."""
    out, i = [], 0
    spaced = len(token) > 2 and token[1] in _SEPARATORS and all(c in _SEPARATORS for c in token[1::2])
    while i < len(token):
        c, run = token[i], 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        i += run
        if spaced and c in _SEPARATORS:
            out.append([("", JOINED), (" ", APART)])
        elif c in _NUMBER:
            if run < 3:
                out.append([(c * run, KEEP)])
            else:
                out.append([(c, ONE_OF_RUN), (c * 2, TWO_OF_RUN)])
        elif c in LEET:
            options = [(x, AS_LETTER) for x in LEET[c]] + [(" ", AS_BREAK)]
            if run > 1:
                options += [(x * 2, AS_LETTER + TWO_OF_RUN) for x in LEET[c]]
            out.append(options)
        else:
            out.append([(" ", KEEP)])
    return out


class Restorer:
    """Restores texts; up to `most` tokens that were decoded before are remembered."""

    def __init__(self, model: CharacterModel, most: int = 50_000) -> None:
        self.model, self.known, self.most = model, {}, most

    def _decoded(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = self.model.decode(lattice_of(token))
            if len(self.known) >= self.most:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = got
        return got

    def _token(self, token: str, long: bool) -> str:
        """A token with a sign beside a letter, or else with a long run of one letter (which signs may leave behind, too)."""
        return self._decoded(token) if long else _LONG_TOKEN.sub(lambda m: self._decoded(m[0]), self._decoded(token))

    def __call__(self, text: str) -> str:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[str]:
        """The texts in lower case with disguised words restored: first spaced ones, then tokens with signs, then long runs.

        Whether and where a text has any is found for many texts at once; only those places are decoded.
        """
        out: list[str] = []
        for part in chunks([t.lower() for t in texts]):
            done, again = self._pass(part, True)
            if again:
                for at, text in zip(again, self._pass([done[i] for i in again], False)[0], strict=True):
                    done[at] = text
            out += done
        return out

    def _pass(self, texts: list[str], spaced: bool) -> tuple[list[str], list[int]]:
        """The texts restored, but those with spaced words (numbers in the second list) only as to these."""
        whole = "\n".join(["", *texts, ""])  # white space around each text, so nothing reaches over its ends
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _KIND[np.minimum(points, len(_KIND) - 1)]
        plain = kind & (_IS_LETTER | _IS_SIGN)
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        spans: list[tuple[int, int, str]] = []
        if spaced:
            at = np.flatnonzero((kind[2:-3] & _IS_SEPARATOR) != 0) + 2  # the first separator
            for step, wanted in ((-1, _IS_LETTER | _IS_SIGN), (1, _IS_LETTER | _IS_SIGN), (2, _IS_SEPARATOR), (3, _IS_LETTER | _IS_SIGN), (-2, _IS_WHITE)):
                at = at[(kind[at + step] & wanted) != 0]
            for start in (at - 1).tolist():
                if not spans or start >= spans[-1][1]:
                    found = _SPACED.match(whole, start)
                    if found:
                        spans.append((start, found.end(), self._decoded(found[0])))
        again = sorted({int(i) for i in np.searchsorted(begins, [s[0] for s in spans], side="right") - 1})
        skip = np.zeros(len(texts) + 1, dtype=bool)
        skip[again] = True
        white = np.flatnonzero(kind & _IS_WHITE)
        signs = np.flatnonzero((plain[:-1] | plain[1:]) == (_IS_LETTER | _IS_SIGN))
        runs = np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (plain[2:] == _IS_LETTER))
        with_signs = np.unique(np.searchsorted(white, signs))
        with_runs = np.setdiff1d(np.searchsorted(white, runs), with_signs)
        for tokens, long in ((with_signs, False), (with_runs, True)):
            starts, ends = white[tokens - 1] + 1, white[tokens]
            free = ~skip[np.searchsorted(begins, starts, side="right") - 1]
            spans += [(a, z, self._token(whole[a:z], long)) for a, z in zip(starts[free].tolist(), ends[free].tolist(), strict=True)]
        spans.sort()
        edges = np.searchsorted([s[0] for s in spans], begins).tolist()
        out = []
        for i, text in enumerate(texts):
            pieces, at = [], int(begins[i])
            for start, end, restored in spans[edges[i] : edges[i + 1]]:
                pieces += [whole[at:start], restored]
                at = end
            out.append("".join([*pieces, whole[at : int(begins[i]) + len(text)]]) if pieces else text)
        return out, again


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Consecutive texts with about `most` characters together, at least one text each."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def closed_up(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as numbers, breaks closed up to one and one around each text; and the text of each character."""
    x = numbers("".join(f" {t} " for t in texts))
    sizes = np.array([len(t) + 2 for t in texts])
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
    keep[np.cumsum(sizes)[:-1]] = True
    return x[keep], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]


def grams_of(text: str) -> np.ndarray:
    """Sorted distinct runs of 4, 5 and 6 characters, breaks closed up to one, packed into numbers."""
    x = closed_up([text])[0].astype(np.int64)
    found = []
    for n in GRAMS:
        if len(x) < n:
            continue
        packed = np.zeros(len(x) - n + 1, dtype=np.int64)
        for i in range(n):
            packed = (packed << 6) | x[i : len(x) - n + 1 + i]
        found.append(packed | (n << 40))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


class Probe:
    """Finds which of some character runs (ascending, as grams_of packs them) texts have.

    A table of slots for the runs' first four characters leaves few places of a text; only these are looked up.
    """

    def __init__(self, features: np.ndarray) -> None:
        self.features = features
        self.shift = np.uint32(32 - min(24, max(16, int(64 * len(features)).bit_length())))
        self.table = np.zeros(1 << (32 - int(self.shift)), dtype=bool)
        rest = 6 * ((features >> 40) - 4)
        self.table[self._slots((features & ((1 << 40) - 1)) >> rest)] = True

    def _slots(self, first: np.ndarray) -> np.ndarray:
        return (first.astype(np.uint32) * np.uint32(0x9E3779B1)) >> self.shift

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) numbers of all runs that texts have, each once, in order."""
        x, of = closed_up(texts)
        none = np.empty(0, dtype=np.int64)
        if len(x) < 4 or not len(self.features):
            return none, none
        first = x.astype(np.int32)
        first = (first[:-3] << 18) | (first[1:-2] << 12) | (first[2:-1] << 6) | first[3:]
        at = np.flatnonzero(self.table[self._slots(first)])
        found = []
        for n in GRAMS:
            here = at[at + n <= len(x)]
            here = here[of[here] == of[here + n - 1]]
            packed = first[here].astype(np.int64)
            for i in range(4, n):
                packed = (packed << 6) | x[here + i]
            packed |= n << 40
            feature = np.minimum(np.searchsorted(self.features, packed), len(self.features) - 1)
            hit = self.features[feature] == packed
            found.append(of[here[hit]].astype(np.int64) * len(self.features) + feature[hit])
        return np.divmod(np.unique(np.concatenate(found)), len(self.features))


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all documents; what is gathered is bounded by the alphabet, not by the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(SIZE**3, dtype=np.int64), [], 0
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    x = numbers(f"  {value.as_py().lower()} ").astype(np.int32)
                    waiting.append((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:])
                    held += len(x)
                    if held > 1 << 20:
                        total += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
                        waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3, dtype=np.int64)
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


@dataclass
class ToxicityModel:
    characters: CharacterModel
    features: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -4.0

    def scores(self, texts: list[str], probe: Probe) -> np.ndarray:
        """Scores of restored texts; probe finds this model's features."""
        total = np.full(len(texts), self.bias)
        start = 0
        for part in chunks(texts):
            of, feature = probe(part)
            total[start : start + len(part)] += np.bincount(of, weights=self.weights[feature], minlength=len(part))
            start += len(part)
        return 1 / (1 + np.exp(-np.clip(total, -60.0, 60.0)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps over rows that count n times; the intercept comes apart."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (y - p)) - penalty * w
        step = np.linalg.solve((z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = TRAIN_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Learn the character model from all documents and the classifier from about `most` labelled ones, chosen by hash.

    Counts of character runs are made on the executors: first those of toxic documents, of which those in enough
    documents are candidates, then how many clean documents have each candidate. The runs with the highest likelihood
    ratio are the features. Only such counts and the sample's feature numbers reach the driver, all bounded by `most`
    and `features`. Labels that are null are left out; where either class is missing, all scores are alike and low.
    """
    characters = CharacterModel(character_counts(docs, text))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.max(label) > 0).cast("long").alias("y"))
    total = known.count()
    share = min(1.0, most / max(total, 1))
    known = known.where(F.pmod(F.xxhash64("__id", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(known, "__id").select("y", "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(characters)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = restore.many([v or "" for v in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["y", "restored"])

    sampled = written(rows.mapInArrow(sample, "y long, restored string"), "sample")
    sizes = {r["y"]: r["n"] for r in sampled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(characters)

    def counted(candidates: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = None if candidates is None else Probe(candidates)
            keys, sums, waiting, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], 0

            def merged() -> tuple[np.ndarray, np.ndarray]:
                k, n = np.unique(np.concatenate(waiting), return_counts=True)
                both, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                return both, np.bincount(back, weights=np.concatenate([sums, n]), minlength=len(both)).astype(np.int64)

            for batch in batches:
                for part in chunks(batch.column(0).to_pylist()):
                    waiting += [grams_of(text) for text in part] if probe is None else [candidates[probe(part)[1]]]
                    held += sum(map(len, part))
                    if held > 1 << 20:
                        keys, sums = merged()
                        waiting, held = [], 0
            if waiting:
                keys, sums = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.int64())], ["gram", "n"])

        return run

    def counts(y: int, candidates: np.ndarray | None, least: int) -> pd.Series:
        part = sampled.where(F.col("y") == y).select("restored").mapInArrow(counted(candidates), "gram long, n long")
        found = part.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
        return pd.Series(found["n"].to_numpy(dtype=np.float64), index=found["gram"].to_numpy(dtype=np.int64)).sort_index()

    t = counts(1, None, max(LEAST_DOCS, toxic // 200))
    if t.empty:
        return ToxicityModel(characters)
    candidates = t.index.to_numpy()
    c = counts(0, candidates, 1).reindex(t.index, fill_value=0.0)
    p, q, both = t / toxic, c / clean, (t + c) / (toxic + clean)
    half = lambda n, of, rate: n * np.log(np.maximum(n, 1e-9) / (of * rate)) + (of - n) * np.log(np.maximum(of - n, 1e-9) / (of * np.maximum(1 - rate, 1e-12)))
    ratio = (half(t, toxic, both) + half(c, clean, both)).where(p > 2 * q, 0.0)
    chosen = np.sort(ratio[ratio > 6].sort_values(ascending=False, kind="stable").index.to_numpy()[:features])
    if not len(chosen):
        return ToxicityModel(characters)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(chosen)
        for batch in batches:
            found = []
            for part in chunks(batch.column(1).to_pylist()):
                of, feature = probe(part)
                found += np.split(feature, np.searchsorted(of, np.arange(1, len(part))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["y", "has"])

    held = sampled.mapInArrow(present, "y long, has array<long>").groupBy("y", "has").count().toPandas()
    held = held.iloc[sorted(range(len(held)), key=lambda i: (held["y"][i], tuple(held["has"][i])))]
    x = np.zeros((len(held), len(chosen)))
    for i, has in enumerate(held["has"]):
        x[i, list(has)] = 1
    weights, bias = _logistic(x, held["y"].to_numpy(dtype=np.float64), held["count"].to_numpy(dtype=np.float64))
    return ToxicityModel(characters, chosen, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """docs with `score` between 0 and 1, from each whole text; null is scored as empty text, repeated rows alike.

    A column of docs that is named as score is replaced; all others pass through. An empty table gives an empty table.
    """
    docs = docs.drop(score)
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    at, names = docs.columns.index(text), [*docs.columns, score]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the model's size is fixed by alphabet and features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        restore, probe = Restorer(known.characters), Probe(known.features)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                scores = known.scores(restore.many([v or "" for v in rows.column(at).to_pylist()]), probe)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names)
        give_back()

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents, null texts as empty ones; a row without doc_id is scored, and is not held out."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
