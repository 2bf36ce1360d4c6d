"""Near-duplicates among documents that share passages and mostly stay below the threshold: parted lists lose no link."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import minhash


def family(n, chosen, edits, seed):
    """Documents of one common passage and `chosen` of twenty, in any order, with up to `edits` words replaced."""
    rng = random.Random(seed)
    drawn = lambda k: [f"w{rng.randrange(20_000)}" for _ in range(k)]
    common, passages = drawn(40), [drawn(rng.randrange(20, 60)) for _ in range(20)]
    out = []
    for i in range(n):
        parts = [common] + [passages[k] for k in sorted(rng.sample(range(20), chosen))]
        words = [w for part in parts for w in part]
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        out.append((i, " ".join(words)))
    return out


def sets_of(docs):
    return {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


def similar(sets, a, b):
    both = len(sets[a] & sets[b])
    return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)


def candidates(spark, docs, wide):
    texts = spark.createDataFrame(docs, "id long, text string")
    members = texts.select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("token"), F.lit(0).alias("weight"))
    found = minhash.by_shingles(members, minhash.mixed_lists(members), texts, minhash.SIMILARITY, wide).collect()
    return [(r["id"], r["other"]) for r in found]


@pytest.mark.parametrize("chosen, edits", [(4, 2), (9, 6)])
def test_parted_lists_lose_no_link(spark, chosen, edits):
    docs = family(150, chosen, edits, chosen)
    docs += [(1000 + i, text) for i, text in family(40, 1, 3, chosen)]
    sets = sets_of(docs)
    ids = sorted(sets)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and similar(sets, a, b)])
    assert len(set(want.values())) < len(ids)
    for wide in (0, minhash.WIDE, 10**9):
        found = candidates(spark, docs, wide)
        assert len(found) == len(set(found)) and all(a < b for a, b in found)
        assert components(ids, [(a, b) for a, b in found if similar(sets, a, b)]) == want


def test_pairs_of_shared_passages_grow_with_the_documents(spark):
    few, many = (len(candidates(spark, family(n, 4, 0, 1), 1)) for n in (150, 600))
    apart = len(candidates(spark, family(600, 4, 0, 1), 10**9))
    assert many < 8 * max(few, 150) and many * 3 < apart


def test_groups_of_shingles(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "b"), (2, "c"), (2, "d"), (3, "d"), (3, "e")]
    size = {1: 4, 2: 3, 3: 2}
    got = minhash.placed_groups(spark.createDataFrame([(i, size[i], ord(t)) for i, t in rows], "id long, size int, token long")).collect()
    assert sorted((r["id"], r["count"], r["before"], r["least"]) for r in got) == [(1, 1, 3, 2), (1, 2, 1, 3), (2, 1, 2, 2), (2, 2, 0, 3), (3, 1, 1, 2)]
