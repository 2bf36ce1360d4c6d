"""Sharding against a plain heap, and on odd tables."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chronoweave.llm import registry, sharding

SF = "/root/testdata/sf0.001"


def heap_loads(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, j = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, j))
    return sorted(x for x, _ in heap)


def test_runs_give_what_the_heap_gives():
    rng = random.Random(3)
    for _ in range(60):
        shards = rng.choice([1, 2, 5, 7])
        sizes = sorted({rng.randint(1, rng.choice([9, 2000])) for _ in range(rng.randint(1, 12))}, reverse=True)
        items = [(float(s), rng.choice([1, 2, 13, 400])) for s in sizes]
        plan, loads = sharding.schedule(items, shards)
        given = defaultdict(float)
        for (size, n), runs in zip(items, plan, strict=True):
            assert [r[0] for r in runs] == [sum(r[1] for r in runs[:i]) for i in range(len(runs))] and sum(r[1] for r in runs) == n
            for _, m, members in runs:
                for i in range(m):
                    given[members[i % len(members)]] += size
        assert sorted(given.get(j, 0.0) for j in range(shards)) == sorted(loads) == heap_loads([s for s, n in items for _ in range(n)], shards)


def checked(rows, shards):
    """rows: (group, size, shard, slot); groups are whole and slots gapless. Returns loads."""
    of, slots, loads = {}, defaultdict(list), Counter()
    for group, size, shard, slot in rows:
        assert of.setdefault(group, shard) == shard and 0 <= shard < shards
        slots[shard].append(slot)
        loads[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [loads[j] for j in range(shards)]


def test_small_groups_are_dealt_evenly_around_large_and_frequent_ones(spark):
    rng = random.Random(5)
    rows = [(f"g{i}", rng.randint(1, 900)) for i in range(4000)] + [("large", 60_000)] * 3 + [("frequent", 1)] * 900 + [("g7", 5)] * 10
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, n long")
    found = sharding.assign_shards(df, F.col("g"), F.col("n"), 6, ["id"]).collect()
    assert len(found) == len(rows)
    loads = checked([(r["g"], r["n"], r["shard"], r["slot"]) for r in found], 6)
    groups = Counter()
    for g, n in rows:
        groups[g] += n
    exact = heap_loads(groups.values(), 6)
    # the departure is about the size of the largest group that is not scheduled alone
    bound = sum(loads) / (6 * sharding.APART)
    assert all(abs(a - b) <= 2 * bound for a, b in zip(sorted(loads), exact, strict=True))


def test_a_group_above_a_mean_shard_stays_together(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"g{i}", 10) for i in range(600)], "id long, g string, n long")
    found = sharding.assign_shards(df, F.col("g"), F.col("n"), 10, ["id"]).collect()
    loads = sorted(checked([(r["g"], r["n"], r["shard"], r["slot"]) for r in found], 10))
    assert loads[-1] == 2000 and loads[0] >= 430 and loads[-2] <= 460


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, None, 7), (None, "a", 7), (3, "", 7), (3, "", 7), (4, "a", 7), (5, "x" * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").withColumns({"shard": F.lit("s"), "slot": F.lit(1.5), "size": F.lit(0)})
    found = sharding.assign_shards(docs, F.col("text"), sharding.text_size(F.col("text")), 3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(r[:2] for r in rows) and {r["rank"] for r in found} == {7} and {r["size"] for r in found} == {0}
    # here null is not the empty text, but one group
    checked([(r["text"], 1, r["shard"], r["slot"]) for r in found], 3)
    assert sharding.assign_shards(docs.limit(0), F.col("text"), F.lit(1), 3).count() == 0
    zero = sharding.assign_shards(docs, F.col("text"), F.lit(None).cast("long"), 3).collect()
    assert len(zero) == len(rows)


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 50}", i % 3) for i in range(400)], "doc_id long, text string, slot int")
    back = sharding.write_shards(docs, str(tmp_path / "out"), shards=4, rows_per_file=30).collect()
    assert sorted(r["doc_id"] for r in back) == list(range(400))
    checked([(r["text"], 1, r["shard"], r["slot"]) for r in back], 4)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in registry.QUERIES["op12_shard_documents"](spark, SF).collect()}
    assert len(found) == len(docs)
    groups, rows = Counter(), []
    for doc_id, text in docs:
        data, r = (text or "").encode(), found[doc_id]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        groups[data] += r["size"]
        rows.append((data, r["size"], r["shard"], r["slot"]))
    loads = checked(rows, 40)
    exact = heap_loads(groups.values(), 40)
    assert max(loads) <= exact[-1] * 1.01 and min(loads) >= exact[0] * 0.98
