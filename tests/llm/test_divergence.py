"""Divergence of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least, most):
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", Counter(TERM.findall(lower(text or "")))
        counts[lang, source].update(found)
        langs[lang].update(found)
        df[lang].update(found.keys())
    out = []
    for (lang, source), mine in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, q = p(mine), p(langs[lang])
        pair = [(o, sum(abs(own[t] - other[t]) for t in kept)) for (l, o), c in counts.items() if l == lang and o != source for other in [p(c)]]
        term = [(t, own[t] - q[t]) for t in kept if mine[t] > 0 and own[t] > q[t]]
        for part, found, top in (("pair", pair, len(pair)), ("term", term, most)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["Éa", "éa", "The", "the", "a_b", "x9y", "日本", "it's", "ﬀ", "İx", "zz", "yy", "K"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "", None, "t9", "u", "v", "w"])) for i in range(n)]


def test_rounds_meet_every_pair_once():
    for seats in (2, 4, 8):
        met = [p for r in divergence.rounds(seats) for p in r]
        assert sorted(met) == [(a, b) for a in range(seats) for b in range(a + 1, seats)] and all(len({x for p in r for x in p}) == seats for r in divergence.rounds(seats))


def test_against_plain_counting_in_one_and_in_many_slices(spark):
    rows = corpus(220)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "part", "value", "rank", "seat", "slice")})
    want = plain(rows, 9, 5)
    assert told(divergence.source_divergence(docs, least=9, most=5)) == want
    assert told(divergence.source_divergence(docs, least=9, most=5, seats=4, seat_numbers=4)) == want


def test_odd_tables(spark):
    assert told(divergence.source_divergence(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, None, None, None), (1, "12 34", "en", "a"), (2, "", "en", "b"), (None, "one", "en", "c"), (3, "one two", "de", "only"), (3, "one two", "de", "only")]
    assert told(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA))) == plain(rows, 30, 50)
    assert told(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), least=2)) == plain(rows, 2, 50)


def test_long_texts_are_counted_whole():
    data = ("Ab é " * 300_000 + "x" * 3_000_000).encode()
    assert divergence.count_terms(data) == Counter({b"ab": 300_000, "é".encode(): 300_000, b"x" * 3_000_000: 1})
    assert b"".join(divergence.pieces(data, 1000)) == data


def test_shares_are_exact_for_large_counts():
    counts, total, terms = np.array([0, 7, 10**12, 5 * 10**15]), 6 * 10**15, 3 * 10**6
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


def test_vectors_come_back():
    places, counts = np.array([0, 3, 9]), np.array([5, 1 << 40, 2])
    assert divergence.unpacked(divergence.packed(places, counts), 11).tolist() == [5, 0, 0, 1 << 40, 0, 0, 0, 0, 0, 2, 0]
    assert divergence.unpacked(None, 2).tolist() == [0, 0]
