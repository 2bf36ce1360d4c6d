"""The training-data operators: brute force, round trips, SQL, and odd inputs (nulls, empty, long, ties, repeats, clashing names)."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import chat, exact_dedup, flac, licenses, line_dedup, media, minhash, mixing, packing, ranking, registry, selecting, suffix_dedup, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "one two\nthree four five six", "en", "a", 10), (4, "one two\nthree four five six", "en", "a", 10),
    (5, LONG, "en", "b", 9), (6, LONG + " x", "en", "b", 9), (7, " \t\n", "de", "b", 3), (8, "é" * 300, "fr", "c", 300), (8, "é" * 300, "fr", "c", 300), (None, "one two\nthree four five six", "en", None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"rank": F.lit(1), "n": F.lit(2), "size": F.lit(3), "length": F.lit(4), "node": F.lit(5)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD) and exact_dedup.exact_dedup(none).count() == 0
    rows = {r["doc_id"]: r for r in got}
    assert (rows[4]["keep_id"], rows[4]["group_size"], rows[4]["kept"]) == (3, 3, False) and rows[None]["keep_id"] == 3
    assert rows[1]["keep_id"] == 1 and rows[2]["keep_id"] == 1 and rows[7]["keep_id"] == 7


def test_heavy_hitters_are_exact(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id long, d string")
    assert [tuple(r) for r in exact_dedup.heavy_hitters(rows, "d", "doc_id", 8).collect()] == [("hot", 0, 1000)]


def removed_lines(docs):
    seen, out = {}, {}
    for key, text in docs:
        keys = line_dedup.line_keys(text)
        gone = set()
        for i, j in line_dedup.windows_of(keys, 3, 50):
            w = tuple(k[1] for k in keys[i : j + 1])
            if w in seen:
                gone |= set(range(i, j + 1))
            seen.setdefault(w, (key, i))
        out[key] = len(gone)
    return out


def test_line_dedup_equals_brute_force(spark, odd, none):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c", "", "d e f", "long " * 60]) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == removed_lines(docs)
    assert all(r["n_lines"] == len(line_dedup.line_keys(docs[r["doc_id"]][1])) for r in got)
    out = line_dedup.dedup_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(2)
    run = [(i, rng.getrandbits(64), 3) for i in range(3)]
    for _ in range(50):
        around = lambda: [(0, rng.getrandbits(64), 3) for _ in range(rng.randrange(5))]
        hashes = lambda keys: {keys[at][1] for at, ws in line_dedup.winnowed(keys).items() for i, j in ws if [k[1] for k in keys[i : j + 1]] == [k[1] for k in run]}
        assert hashes([*around(), *run, *around()]) == hashes([*around(), *run, *around()]) != set()


def repeats_by_force(docs):
    seen, out = set(), {}
    for key, data in docs:
        steps = np.zeros(len(data) + 1, dtype=int)
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                steps[k] += 1
                steps[k + 100] -= 1
            seen.add(w)
        gone = np.cumsum(steps[:-1]) > 0
        out[key] = (int(gone.sum()), bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def test_suffix_dedup_equals_brute_force(spark, odd, none):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.choice([60, 99, 100, 101, 160]))) for _ in range(6)]
    docs = [(i, "".join(rng.choice(pool) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randrange(6)))) for i in range(50)]
    docs += [(90, "z" * 250), (91, "z" * 150)]
    want = repeats_by_force([(i, t.encode()) for i, t in docs])
    got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=700).collect()
    assert {r["doc_id"]: (sum(s["end"] - s["first"] for s in r["spans"]), bytes(r["kept"])) for r in got} == want
    assert suffix_dedup.repeats(odd).count() == len(ODD) and suffix_dedup.repeats(none).count() == 0


def test_the_cover_has_every_distance():
    c = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in c for b in c} == set(range(suffix_dedup.PERIOD))


def shingles(text):
    w = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_equal_brute_force(spark, odd, none):
    rng = random.Random(4)
    docs = []
    for g in range(12):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(words)))
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for how in ({}, {"merged_pairs": 0}, {"merged_pairs": 10**9}):
        got = by_id(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **how))
        assert {i: got[i]["component_id"] for i in got} == {i: find(i) for i in range(len(docs))}
        assert all(got[i]["n_shingles"] == len(sets[i]) for i in got)
    out = minhash.near_duplicates(odd)
    assert out.count() == len(ODD) and minhash.near_duplicates(none).count() == 0
    rows = by_id(out)
    assert rows[6]["component_id"] == 5 and rows[1]["component_id"] == 1 and rows[2]["n_shingles"] == 0


def test_rows_by_ids_are_the_same_beyond_the_broadcast(spark, odd):
    ids = spark.createDataFrame([(1,), (8,), (99,), (None,)], "doc_id long")
    for how, count in (("left_semi", 3), ("left_anti", len(ODD) - 3)):
        for most in (0, 100):
            got = selecting.by_ids(odd, ids, "doc_id", how, most)
            assert got.columns == odd.columns and got.count() == count


def test_near_dedup_stage_keeps_rows_without_id(spark, odd):
    import corpus_pipeline

    left = sorted((r[0] for r in corpus_pipeline.drop_near_duplicates(spark, odd, SF).select("doc_id").collect()), key=str)
    assert left == [1, 2, 3, 5, 7, 8, 8, None]


def test_flac_round_trip_and_damage():
    rng = random.Random(6)
    payloads = [bytes([7]) * 192, bytes(rng.randrange(256) for _ in range(192 * 5)), (b"plain words again and again " * 400)[: 192 * 50], bytes(i % 256 for i in range(192 * 3))]
    for order in (0, 2, 4):
        streams = list(flac.encode(payloads, order))
        assert list(flac.decode(streams)) == payloads
    assert flac.decode_from(streams[2], 192 * 20 + 5)[-1000:] == payloads[2][-1000:]
    bad = bytearray(streams[1])
    bad[-20] ^= 1
    with pytest.raises(flac.FlacError):
        list(flac.decode([bytes(bad)]))


def test_media_columns(odd):
    read = media.decode_column(media.encode_column(odd.select("doc_id", media.padded_payload(F.col("text")).alias("payload")), "payload"))
    for r in read.collect():
        text = next(t for i, t, *_ in ODD if i == r["doc_id"]) or ""
        got = b"".join(bytes(b["pcm"]) for b in r["blocks"])
        assert got == text.encode().ljust(max(192, -(-len(text.encode()) // 192) * 192), b" ")
        assert [b["sample_offset"] for b in r["blocks"]] == list(range(0, len(got), 192 * media.BLOCK_FRAMES))


def test_license_scan(spark, odd, none):
    docs = spark.createDataFrame([(1, "All rights RESERVED. cc by cc-by"), (2, "Released under the MIT License"), (3, "general public"), (4, "rights reserved all rights reserved")], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(docs))
    names = {i: [(n["label"], n["word"]) for n in got[i]["notices"]] for i in got}
    assert names[1] == [("reserved", 0), ("cc-by", 3), ("cc-by", 5)] and names[2] == [("mit", 3)] and names[3] == [] and names[4] == [("reserved", 2)]
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(none).count() == 0


def test_preference_pairs(spark):
    turns = [(1, True, 0, "user", "q"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "q"), (1, False, 1, "assistant", "no"), (2, True, 0, None, None), (None, True, 0, "user", "z")]
    df = spark.createDataFrame(turns, "p long, good boolean, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.preference_pairs(df, F.col("p"), F.col("good")).collect()}
    assert set(got) == {1, 2} and got[1]["n_shared"] == 1 and got[1]["prompt"] == "<|user|>\nq<|end|>\n"
    span = got[1]["chosen_mask"][0]
    assert got[1]["chosen"][span["start"] : span["end"]] == "yes<|end|>" and got[1]["usable"]
    assert got[2]["n_rejected"] == 0 and got[2]["rejected"] == ""


def test_plan_of_bins():
    rng = random.Random(8)
    counts = {}
    for _ in range(3000):
        n = rng.choice([rng.randrange(1, 1025), rng.randrange(1, 200), 1024])
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan_bins(counts)
    placed = {}
    for fill, bins in plan:
        assert sum(n * c for n, c in fill) <= 1024 and sum(c for n, c in fill if 3 * n > 1024) <= 2
        for n, c in fill:
            placed[n] = placed.get(n, 0) + c * bins
    assert placed == counts
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(b for _, b in plan) <= 1.1 * least + 2 and packing.plan_bins({}) == []


def test_packing(odd, none):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd.where("doc_id <> 8")).collect()
    for i, text, *_ in ODD:
        if i in (None, 8):
            continue
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == ids.tobytes() and len(pieces) == -(-len(ids) // 1024)
        assert all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in pieces)
    for seq in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_packing_stage_keeps_ids_and_tells_copies_apart(spark, odd):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.pack(spark, odd.unionByName(odd.where("doc_id = 5")), SF).collect()
    assert len({(r["copy"], r["piece"]) for r in rows}) == len(rows)
    docs = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        docs.setdefault((r["doc_id"], r["copy"]), []).append(bytes(r["ids"]))
    want = [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, t, *_ in [*ODD, ODD[4]]]
    assert sorted(((i, b"".join(p)) for (i, _), p in docs.items()), key=repr) == sorted(want, key=repr)


def test_mixing(spark, odd, none):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, rng.choice("aaab"), rng.randrange(50)) for i in range(2000)] + [(9999, None, 7)], "doc_id long, source string, words long")
    got = mixing.mix_sources(docs, F.col("words"), ties=["doc_id"], rows_per_block=100)
    sums = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("copies").alias("most")).collect()
    for r in sums:
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"] + 160 and r["most"] <= 3 and r["target"] <= 3 * r["size"] + 1e-6
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, mixing.mix_sources(docs, F.col("words"), ties=["doc_id"], rows_per_block=100).collect()), key=repr)
    assert mixing.mix_sources(odd.drop("size"), mixing.n_words(F.col("text")), ties=["doc_id"]).count() == len(ODD)
    assert mixing.mix_sources(none, mixing.n_words(F.col("text"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_mixing_equals_sql_when_sources_pass_one_block(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select doc_id, taken from ({mixing.ORACLE.strip()}) order by doc_id").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_sources(docs, mixing.n_words(F.col("text")), ties=["doc_id"], rows_per_block=7)
    assert [tuple(r) for r in got.select("doc_id", (F.col("copies") * F.col("size")).alias("taken")).orderBy("doc_id").collect()] == want


def test_ranks_in_order_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), rng.choice([3, 3, 3, rng.randrange(90)]), rng.choice([None, rng.randrange(40)])) for _ in range(900)]
    got = ranking.ranked_in_order(spark.createDataFrame(rows, "key string, size long, id long"), "key", [F.col("size").asc(), F.col("id").asc_nulls_last()], 20).collect()
    for key in "ab":
        mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert [(r["size"], r["id"]) for r in mine] == sorted(((s, i) for k, s, i in rows if k == key), key=lambda x: (x[0], x[1] is None, x[1] or 0))
    assert ranking.ranked_in_order(spark.createDataFrame([], "key string, size long"), "key", [F.col("size").asc()]).count() == 0


def test_mixing_stage_takes_rows_without_id_and_repeated_ids_by_row(spark, odd):
    import corpus_pipeline

    def expected(rows):
        sized = spark.createDataFrame([(n, i, s, len((t or "").split())) for n, (i, t, _, s, _) in enumerate(rows)], "nth long, doc_id long, source string, words long")
        copies = {r["nth"]: r["copies"] for r in mixing.mix_sources(sized, F.col("words"), ties=["doc_id", "nth"]).collect()}
        return sorted((rows[n] for n in copies for _ in range(copies[n])), key=repr)

    rows = [(None, f"none {i}", "en", "a", i) for i in range(3)] + [(7, f"text {i}", "en", "b", i) for i in range(4)] + [(8, "same text", "en", None, 9)] * 3
    for given in (rows, ODD):
        got = sorted((tuple(r) for r in corpus_pipeline.mix(spark, spark.createDataFrame(given, DOCS), SF).collect()), key=repr)
        assert got == expected(given)
    assert corpus_pipeline.mix(spark, odd, SF).columns == odd.columns


def test_disguised_words_are_restored():
    words = ("the idiot and the clown are pathetic trash with a moron loser scum worthless " * 50).split()
    counts = np.zeros(toxicity.SIZE**3, dtype=np.int64)
    x = toxicity.numbers("  " + " ".join(words) + " ").astype(np.int64)
    np.add.at(counts, (x[:-2] * 64 + x[1:-1]) * 64 + x[2:], 1)
    restore = toxicity.Restorer(toxicity.CharacterModel(counts))
    assert restore("you 1d10t") == "you idiot" and restore("m o r o n!") .startswith("moron") and restore("trrrrash") == "trash"


def test_toxicity_scores(spark, odd, none):
    rng = random.Random(3)
    words = ["river", "table", "green", "window", "carpet", "light"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" idiot moron scum" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, labels)
    got = by_id(toxicity.score_toxicity(frame, model))
    assert all((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(df.select(*cols).collect()) == plain([r[names.index(c)] for c in cols] for r in cursor.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r[0] for r in docs.select("doc_id").distinct().collect()} <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = packed.groupBy("copy").agg(F.max("piece").alias("last"), F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == docs.count() and all(r["n"] == r["last"] + 1 for r in rows)


def test_long_tokens_of_signs_are_decoded_in_linear_time():
    import time

    restore = toxicity.Restorer(toxicity.CharacterModel(np.arange(64**3) % 97))
    took = {}
    for n in (20_000, 80_000):
        began = time.perf_counter()
        restore("1|" * n + "a" + " b" + "0o" * n)
        took[n] = time.perf_counter() - began
    assert took[80_000] < 8 * took[20_000] + 1


def test_preference_pairs_with_clashing_names(spark):
    rows = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no")]
    df = spark.createDataFrame(rows, "p long, good boolean, turn int, role string, text string")
    plain = chat.preference_pairs(df, F.col("p"), F.col("good")).collect()
    clashing = df.withColumns({c: F.lit("x") for c in ("pair_id", "n_shared", "n_chosen", "n_rejected", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "usable", "c", "r", "at", "spans")})
    assert chat.preference_pairs(clashing, F.col("p"), F.col("good")).collect() == plain and plain[0]["n_shared"] == 1


def test_line_dedup_and_mixing_with_reserved_names(spark):
    """The names that the operators take for themselves are replaced or refused; rows are neither lost nor multiplied."""
    rows = [(1, "one two three\nfour five six\nseven eight nine", "a"), (2, "one two three\nfour five six\nseven eight nine", "b"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("key", "runs", "first", "last", "content", "place", "shared", "fingerprint", "ends", "chosen", "numbers", "hashes")})
    found = line_dedup.dedup_lines(docs).orderBy("doc_id", "text").collect()
    assert len(found) == 3 and {r["content"] for r in found} == {1} and sorted(r["n_removed"] for r in found) == [0, 0, 3]
    mixed = mixing.mix_sources(docs.withColumns({c: F.lit(5) for c in ("weight", "limit", "level", "open", "rank")}), mixing.n_words(F.col("text")), ties=["doc_id"]).collect()
    assert len(mixed) == 3 and {r["weight"] for r in mixed} == {5}
