"""The queries without SQL against brute force over the driver's smallest tables, and every operator on odd tables."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import chat, exact_dedup, flac, licenses, line_dedup, media, minhash, mixing, packing, registry, suffix_dedup, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "one two\nthree four five six", "en", "a", 10), (3, "one two\nthree four five six", "en", "a", 10),
    (4, "w " * 40_000, "en", "b", 9), (5, "é" * 300, "fr", "c", 300), (None, "all rights reserved", "en", None, 1), (None, None, None, "a", None), (6, "\n\n \t", "en", "a", 4),
]
CLASHING = ["rank", "n", "size", "source_size", "target", "copies", "length", "node", "n_lines", "n_removed", "n_runs", "score", "media", "blocks", "payload", "sequence_id", "offset", "piece", "group_size", "keep_id", "kept", "id", "key", "token", "y"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"] or "") for r in rows]


def queried(spark, name):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, SF).collect()}


# --- queries against brute force


@tables
def test_media_query(spark, documents):
    got = queried(spark, "op4_flac_media")
    assert len(got) == len(documents)
    for doc_id, text in documents:
        r, data = got[doc_id], text.encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        stream = next(flac.encode([payload]))
        x = [b - 128 for b in payload]
        cuts = [x[i : i + 192 * media.BLOCK_FRAMES] for i in range(0, len(x), 192 * media.BLOCK_FRAMES)]
        turns = sum((a < 0) != (b < 0) for c in cuts for a, b in itertools.pairwise(c))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert r["feature"] == f"blocks={len(cuts)};level={sum(map(abs, x))};turns={turns}"


@tables
def test_license_query(spark, documents):
    got = queried(spark, "op5_license_scan")
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    for doc_id, text in documents:
        lowered = "".join(c.lower() if c.isascii() else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        every = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for label, p in phrases.items()}
        places = sorted(i for found in every.values() for i in found)
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(k for k, v in every.items() if v))
        others = {label for label, p, _ in licenses.NOTICES if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        assert r["labels"] == ",".join(sorted({k for k, v in every.items() if v} | others))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_score_tells_notices_from_phrases(spark):
    whole = licenses.BASE[1][2]
    docs = spark.createDataFrame([(1, whole), (2, "see the general public license there"), (3, whole[: len(whole) // 2]), (4, "nothing")], "doc_id long, text string")
    best = {r["doc_id"]: max((n["coverage"] for n in r["notices"]), default=0.0) for r in licenses.scan_licenses(docs).collect()}
    assert best[1] == 1.0 > best[3] > best[2] > best[4] == 0.0


@tables
def test_suffix_query(spark, documents):
    got = queried(spark, "op6_suffix_dedup")
    seen = set()
    for doc_id, text in documents:
        data = text.encode()
        steps = np.zeros(len(data) + 1, dtype=int)
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                steps[k] += 1
                steps[k + 100] -= 1
            seen.add(w)
        gone = np.cumsum(steps[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_ties_by_ranks_equal_brute_force():
    rng = random.Random(3)
    for trial in range(40):
        pool = ["".join(rng.choice("ab\0") for _ in range(rng.choice([60, 99, 100, 101, 130, 160]))) for _ in range(4)]
        docs = ["".join(rng.choice(pool) if rng.random() < 0.8 else str(rng.random()) for _ in range(rng.randrange(5))).encode() for _ in range(20)]
        docs += [b"z" * 250, b"z" * 130] * (trial % 5 == 0)
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(docs), dtype=np.uint8)
        at = suffix_dedup.sample_positions(starts, sizes)
        told = suffix_dedup.ties(suffix_dedup.records(data, starts, sizes, at))
        found = {int(p) - d for p, bits in zip(at, told, strict=True) for d in range(31) if int(bits) >> d & 1}
        want, seen = set(), set()
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            for k in range(n - 99):
                w = data[a + k : a + k + 100].tobytes()
                if w in seen:
                    want.add(a + k)
                seen.add(w)
        assert found == want


@pytest.mark.parametrize("most_ranges", [1, 3])
def test_suffix_buckets_beyond_the_ranges(spark, most_ranges):
    """More buckets than ranges: the rest is parted by a hash, with the same rows."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcd ") for _ in range(170)) for _ in range(5)]
    docs = spark.createDataFrame([(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 4)))) for i in range(40)], "doc_id long, text string")
    plain = lambda df: sorted((r["doc_id"], tuple(map(tuple, r["spans"]))) for r in df.collect())
    assert plain(suffix_dedup.repeats(docs, 700, 16, 3, most_ranges)) == plain(suffix_dedup.repeats(docs))


@tables
def test_packing_query(spark, documents):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = registry.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    pieces = {}
    for r in rows:
        pieces[r["doc_id"], r["piece"]] = r
    assert len(pieces) == len(rows)
    total = 0
    for doc_id, text in documents:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            r = pieces.pop((doc_id, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, z - a, zlib.crc32(ids[a:z].tobytes()))
    assert not pieces
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and len(ends) <= -(-total // 1024) * 1.01 + 1


def fewest_bins(lengths, capacity):
    """The least number of bins, by trying every place for each item."""
    best = len(lengths)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[at]:
                place(at + 1, [*rooms[:i], room - lengths[at], *rooms[i + 1 :]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best


def test_plans_are_near_the_least_number_of_bins():
    rng = random.Random(12)
    over = 0
    for _ in range(120):
        lengths = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        made = sum(bins for _, bins in packing.plan_bins(counts, 30))
        least = fewest_bins(lengths, 30)
        assert least <= made <= least + 1
        over += made - least
    assert over <= 12


def decoded_by_force(model, lattice):
    best = (-1e18, "")
    for path in itertools.product(*lattice, [(" ", 0.0)]):
        score, state = sum(cost for _, cost in path), 0
        for string, _ in path:
            for c in string:
                n = toxicity._NUMBER.get(c, 0)
                score += model.log[state * toxicity.SIZE + n]
                state = (state % toxicity.SIZE) * toxicity.SIZE + n
        best = max(best, (score, "".join(s for s, _ in path)))
    return best[0]


def path_score(model, lattice, text):
    """The best score of any path through the lattice that spells the text."""
    scores = [-1e18]
    for path in itertools.product(*lattice, [(" ", 0.0)]):
        if "".join(s for s, _ in path).strip() == text:
            score, state = sum(cost for _, cost in path), 0
            for string, _ in path:
                for c in string:
                    n = toxicity._NUMBER.get(c, 0)
                    score += model.log[state * toxicity.SIZE + n]
                    state = (state % toxicity.SIZE) * toxicity.SIZE + n
            scores.append(score)
    return max(scores)


def test_decoding_equals_all_paths():
    rng = random.Random(21)
    counts = np.zeros(toxicity.SIZE**3, dtype=np.int64)
    words = ("the idiot and the clown are pathetic trash with a moron loser scum all is well " * 30).split()
    x = toxicity.numbers("  " + " ".join(words) + " ").astype(np.int64)
    np.add.at(counts, (x[:-2] * 64 + x[1:-1]) * 64 + x[2:], 1)
    model = toxicity.CharacterModel(counts)
    for _ in range(150):
        token = "".join(rng.choice("aeilmost1340!$@|") * rng.choice([1, 1, 1, 3]) for _ in range(rng.randrange(1, 7)))
        token = rng.choice([token, " ".join(token[:6])])
        lattice = toxicity.lattice_of(token)
        assert abs(path_score(model, lattice, model.decode(lattice)) - decoded_by_force(model, lattice)) < 1e-9


def test_places_found_for_many_texts_are_those_of_each_text():
    """Restoring a batch equals restoring each text by plain searches, one kind of disguise after the other."""
    rng = random.Random(5)
    model = toxicity.CharacterModel(np.ones(toxicity.SIZE**3, dtype=np.int64))
    restore = toxicity.Restorer(model)
    letter, sign = toxicity._LETTER, toxicity._SIGN
    leet = re.compile(rf"(?<!\S)\S*(?:{letter}{sign}|{sign}{letter})\S*")
    decode = lambda m: model.decode(toxicity.lattice_of(m[0]))

    def plainly(text):
        return toxicity._LONG_TOKEN.sub(decode, leet.sub(decode, toxicity._SPACED.sub(decode, text.lower())))

    texts = ["".join(rng.choice("ab c1!4o  ..-__*/\n\tßx€é　") for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert restore.many(texts) == [plainly(t) for t in texts]


def test_probe_finds_the_runs_of_each_text():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc d.") for _ in range(rng.randrange(60))) for _ in range(200)]
    every = np.unique(np.concatenate([toxicity.grams_of(t) for t in texts]))
    chosen = np.sort(rng.sample(every.tolist(), 60))
    of, feature = toxicity.Probe(np.array(chosen))(texts)
    for i, t in enumerate(texts):
        assert feature[of == i].tolist() == np.flatnonzero(np.isin(chosen, toxicity.grams_of(t))).tolist()


@tables
def test_toxicity_query(spark, documents):
    got = queried(spark, "op3_toxicity")
    assert set(got) == {d for d, _ in documents}
    for doc_id, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    again = queried(spark, "op3_toxicity")
    assert {k: v["score"] for k, v in again.items()} == {k: v["score"] for k, v in got.items()}


# --- odd tables: nulls, empty and long texts, repeats, clashing names, no rows


def test_odd_tables_keep_their_rows_and_columns(spark, odd):
    none = odd.where("false")
    names = lambda df, *new: [c for c in df.columns if c not in new]
    lines = line_dedup.dedup_lines(odd)
    assert lines.columns == [*names(odd, "n_lines", "n_removed", "n_runs"), "n_lines", "n_removed", "n_runs"] and lines.count() == len(ODD)
    labels = spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    scored = toxicity.score_toxicity(odd, model)
    assert scored.columns == [*names(odd, "score"), "score"] and scored.count() == len(ODD)
    payload = odd.withColumn("payload", media.padded_payload(F.col("text")))
    stored = media.encode_column(payload, "payload")
    assert stored.columns == [*names(payload, "payload", "media"), "media"]
    read = media.decode_column(stored)
    assert read.columns == [*names(stored, "blocks"), "blocks"] and read.count() == len(ODD)
    mixed = mixing.mix_sources(odd, mixing.n_words(F.col("text")), ties=["doc_id"])
    assert sorted(mixed.columns) == sorted(odd.columns) and mixed.count() == len(ODD) and mixed.agg(F.max("size")).first()[0] == 40_000
    by_own_size = mixing.mix_sources(odd, F.col("size"))
    assert by_own_size.agg(F.min("size"), F.max("size")).first() == (7, 7)
    assert minhash.near_duplicates(odd).count() == suffix_dedup.repeats(odd).count() == exact_dedup.exact_dedup(odd).count() == licenses.scan_licenses(odd).count() == len(ODD)
    for empty in (line_dedup.dedup_lines(none), toxicity.score_toxicity(none, model), media.decode_column(media.encode_column(payload.where("false"), "payload")), mixing.mix_sources(none, F.col("size")), licenses.scan_licenses(none), suffix_dedup.repeats(none), exact_dedup.exact_dedup(none)):
        assert empty.count() == 0


def test_odd_values(spark, odd):
    suffix = {(r["doc_id"], r["n_bytes"]): sum(s["end"] - s["first"] for s in r["spans"]) for r in suffix_dedup.repeats(odd).collect()}
    assert suffix[4, 80_000] == 79_998 and suffix[5, 600] == 598 and suffix[1, 0] == suffix[2, 0] == 0
    found = {(r["doc_id"], r["n_words"], len(r["notices"])) for r in licenses.scan_licenses(odd).collect()}
    assert found == {(1, 0, 0), (2, 0, 0), (3, 6, 0), (4, 40_000, 0), (5, 1, 0), (None, 3, 1), (None, 0, 0), (6, 0, 0)}
    near = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()]
    assert sorted(near, key=repr) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True), (5, 1, 5, True), (None, 1, None, True), (None, 0, None, True), (6, 0, 6, True)], key=repr)


def test_packing_of_null_and_repeated_ids(spark, odd):
    pytest.importorskip("public_tokenizers")
    rows = packing.pack_documents(odd, with_ids=False)
    pieces = rows.collect()
    assert len(pieces) == len(ODD) - 1 + len([r for r in pieces if r["doc_id"] == 4]) and packing.pack_documents(odd.where("false")).count() == 0
    spread = packing.pack_pieces(rows.withColumn("length", F.col("length").cast("int")))
    assert spread.columns == [*(c for c in rows.columns if c not in ("sequence_id", "offset")), "sequence_id", "offset"]
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]


def test_preference_pairs_of_no_rows(spark):
    none = spark.createDataFrame([], "p long, good boolean, turn long, role string, text string")
    assert chat.preference_pairs(none, F.col("p"), F.col("good")).count() == 0


def test_damaged_streams_are_told(spark):
    good = next(flac.encode([bytes(range(192)) * 3]))
    bad = bytearray(good)
    bad[-20] ^= 1
    rows = spark.createDataFrame([(1, good), (2, bytes(bad)), (3, None), (4, b"no stream")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.decode_column(rows, error="wrong").collect()}
    assert got[1]["blocks"] and got[1]["wrong"] is None and got[3]["blocks"] is None and got[3]["wrong"] is None
    assert got[2]["blocks"] is None and got[2]["wrong"] and got[4]["blocks"] is None and got[4]["wrong"]


# --- the pipeline's stages


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_stages_on_odd_tables(spark, plain):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, SF)
        kept[name] = out.collect()
        assert stage(spark, plain.where("false"), SF).count() == 0
        if name != "packing":
            assert out.columns == plain.columns
    ids = lambda name: sorted((r["doc_id"] for r in kept[name]), key=repr)
    every = sorted((r[0] for r in ODD), key=repr)
    assert ids("toxicity") == ids("line dedup") == ids("near dedup") == every
    assert all(r["text"] is None for r in kept["line dedup"] if r["doc_id"] == 2)
    assert {r["doc_id"] for r in kept["mixing"]} <= set(every) and len({(r["copy"], r["piece"]) for r in kept["packing"]}) == len(kept["packing"])


@tables
def test_stages_decide_as_their_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = queried(spark, "op3_toxicity")
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    assert left == {d for d, r in scores.items() if r["score"] < 0.5}
    near = queried(spark, "op2_minhash_near_dedup")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert left == {d for d, r in near.items() if r["kept"]}
    lines = queried(spark, "op1_line_dedup")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert set(got) == {d for d, r in lines.items() if r["n_removed"] == 0 or r["n_removed"] < r["n_lines"]}
    for doc_id, r in got.items():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == lines[doc_id]["kept_sha256"] and r["n_chars"] == len(r["text"])
    taken = {d: r["taken"] // r["size"] if r["size"] else None for d, r in queried(spark, "op10_mix_sources").items()}
    copies = {r["doc_id"]: r["count"] for r in corpus_pipeline.mix(spark, docs, SF).groupBy("doc_id").count().collect()}
    assert all(copies.get(d, 0) == n for d, n in taken.items() if n is not None)
