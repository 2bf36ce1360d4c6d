"""Repeated substrings by blockwise suffix sorting: suffixes are sorted bucket by bucket, ties settled by a difference cover's ranks.

A suffix is a place of a document and the DEPTH bytes from there on. The cover's sample suffixes are sorted by their bytes,
and every other suffix is sorted in the bucket of a sample that stands REACH bytes after it at most: first by the bytes up to
that sample, then by the sample's rank at the depth that is left. For any two suffixes that tie on DEPTH bytes the cover has
a distance at which both have a sample, so they meet in the bucket of that distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.hashing import mixed
from chronoweave.session import emptied, few_bytes, read_table, release, written

#: Bytes of a repeat.
DEPTH = 100
#: A difference cover: any two positions have, fewer than PERIOD bytes on, a pair of sample positions at equal distance.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: The largest distance from a suffix to its sample, and the bytes from the sample on that stay inside the repeat then.
REACH = PERIOD - 1
NAMED = DEPTH - REACH
#: A sample's record: DEPTH bytes from it on, REACH bytes before it (nearest first), and how many of both its document has.
WIDTH = DEPTH + REACH + 2
RECORD = f"S{WIDTH}"
#: Text bytes of a block, samples whose records are made at once, samples of a bucket, bytes that part buckets, most ranges
#: of these, and rounds of sorting buckets. Leading bytes of about so many records of a bucket are drawn.
BLOCK_BYTES, CHUNK_SAMPLES, BUCKET_SAMPLES, LEADING, MOST_RANGES, ROUNDS, DRAWN = 8 << 20, 1 << 17, 1 << 15, 24, 4096, 4, 64

_RNG = np.random.Generator(np.random.PCG64(31))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_STEP = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + DEPTH, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def window_hashes(data: np.ndarray, length: int, positions: np.ndarray) -> np.ndarray:
    """64-bit hashes of the `length` bytes from each of the ascending positions on, a million bytes at a time."""
    out = np.empty(len(positions), dtype=np.uint64)
    for start in range(0, len(data), _STEP):
        a, b = np.searchsorted(positions, [start, start + _STEP])
        if a == b:
            continue
        part = data[start : start + _STEP + length]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
        at = positions[a:b] - start
        out[a:b] = (sums[at + length] - sums[at]) * _DOWN[at]
    return mixed(out)


def sample_positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The cover's positions that have NAMED bytes left, in documents that have DEPTH; counted from each document's start."""
    out = []
    cover = np.array(COVER)
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size >= DEPTH:
            at = (np.arange(0, size, PERIOD)[:, None] + cover).reshape(-1)
            out.append(start + at[at <= size - NAMED])
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def records(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The records of the samples at some positions; what a document does not have is zero."""
    padded = np.concatenate([np.zeros(REACH, dtype=np.uint8), data, np.zeros(DEPTH, dtype=np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, REACH + DEPTH)[at]
    before, after = reach(starts, sizes, at)
    out = np.empty((len(at), WIDTH), dtype=np.uint8)
    out[:, :DEPTH], out[:, DEPTH:-2] = around[:, REACH:], around[:, REACH - 1 :: -1]
    out[:, -2], out[:, -1] = after, before
    for first, size, has in ((0, DEPTH, after), (DEPTH, REACH, before)):
        few = np.flatnonzero(has < size)
        part = out[few, first : first + size]
        part[np.arange(size) >= has[few, None]] = 0
        out[few, first : first + size] = part
    return out.reshape(-1).view(RECORD)


def reach(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes the samples' documents have before them and from them on, REACH and DEPTH at most."""
    document = np.searchsorted(starts, at, side="right") - 1
    return np.minimum(at - starts[document], REACH), np.minimum((starts + sizes)[document] - at, DEPTH)


def distances(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bits of the distances at which a sample's document has a suffix of DEPTH bytes: 1 << distance."""
    least = np.maximum(DEPTH - after.astype(np.int64), 0)
    return np.where(least <= before, (np.int64(2) << before) - (np.int64(1) << np.minimum(least, before)), 0).astype(np.uint32)


def _columns(found: np.ndarray) -> np.ndarray:
    return found.view(np.uint8).reshape(len(found), WIDTH)


def _common(sorted_bytes: np.ndarray) -> np.ndarray:
    """For each row of a matrix of bytes how many it has in common with the row before, from the first one on; 0 for the first."""
    out = np.zeros(len(sorted_bytes), dtype=np.int64)
    for start in range(1, len(out), CHUNK_SAMPLES):
        part = sorted_bytes[start - 1 : start + CHUNK_SAMPLES]
        differ = part[1:] != part[:-1]
        out[start : start + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), sorted_bytes.shape[1])
    return out


def ties(found: np.ndarray) -> np.ndarray:
    """For records in order of their places, bits of the distances at which the suffix is one that an earlier place has.

    The samples are sorted by their bytes. Of equal records the first one answers for the others, all of whose suffixes
    are repeats. Where different records share NAMED bytes, the suffixes at each distance are sorted, one bucket after
    the other: by the bytes before the sample, and by the sample's rank among the prefixes of the depth that is left.
    """
    every = distances(_columns(found)[:, -1].astype(np.int64), _columns(found)[:, -2])
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    del found
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    told = np.zeros(len(order), dtype=np.uint32)
    told[order[~fresh]] = every[order[~fresh]]
    kept, ordered = order[fresh], ordered[fresh]
    common = _common(_columns(ordered)[:, :DEPTH])
    near = common >= NAMED
    in_group = near.copy()
    in_group[:-1] |= near[1:]
    kept, common = kept[in_group], common[in_group]
    if not len(kept):
        return told
    before = np.ascontiguousarray(_columns(ordered)[in_group, DEPTH:-2])
    del ordered
    by_before = np.argsort(before.reshape(-1).view(f"S{REACH}"), kind="stable")
    common_before = _common(before[by_before])
    in_time = np.argsort(kept)
    left = np.empty(len(kept), dtype=np.int64)
    for distance in range(REACH + 1):
        rank = np.cumsum(common < DEPTH - distance)
        left[by_before] = np.cumsum(common_before < distance)
        has = in_time[(every[kept[in_time]] >> np.uint32(distance)) & 1 == 1]
        again = np.ones(len(has), dtype=bool)
        again[np.unique(left[has] * (len(kept) + 1) + rank[has], return_index=True)[1]] = False
        told[kept[has[again]]] |= np.uint32(1 << distance)
    return told


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, doc_ids, sizes, data): documents in order of their ids, joined to about block_bytes; a longer one alone.

    Blocks are numbered in the order of the documents, so that an earlier document never has a later block.
    """
    ordered = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "data"])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py()
                if ids and held + len(data) > block_bytes:
                    yield block()
                    number, ids, parts, held = number + 1, [], [], 0
                ids.append(doc_id)
                parts.append(data)
                held += len(data)
        if ids:
            yield block()

    return ordered.mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, data binary")


def _layout(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.asarray(row["sizes"], dtype=np.int64)
    return np.frombuffer(row["data"], dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _parted(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys, a bucket being a range of keys."""
    edges = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)))
    bounds = [0, *edges.tolist(), len(keys)]
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            yield b, bounds[b], bounds[b + 1]


#: Parquet's writers and readers hold a row group, which is a few blocks so.
FEW_BLOCKS = {"parquet.block.row.count.limit": "2"}
REPLY = "block long, bucket long, bits binary"
_REPLY = [("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]


def _sent(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _shared_names(table: pa.Table) -> pa.Table:
    """Sort one bucket's names; tell each block which of its names another block has."""
    arrays = [np.frombuffer(k.as_buffer(), dtype=np.uint32) for k in table.column("keys")]
    keys = np.concatenate(arrays)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    told = np.zeros(len(keys), dtype=bool)
    told[order[1:]] = same
    told[order[:-1]] |= same
    ends = np.cumsum([len(a) for a in arrays])[:-1]
    bits = [np.packbits(part).tobytes() for part in np.split(told, ends)]
    return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], names=[c for c, _ in _REPLY])


def _answers(replies: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """A truth value for each of the ascending names, from the replies of its bucket."""
    bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True))
    out = np.zeros(len(keys), dtype=bool)
    for b, a, z in _parted(keys, buckets):
        out[a:z] = np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=z - a).astype(bool)
    return out


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Sort one bucket's suffixes; tell each block at which distances each of its records has an earlier one.

    A block sends a bucket one row, with its records in the order of their places.
    """
    in_time = np.argsort(table.column("block").to_numpy())
    parts = [np.frombuffer(x.as_buffer(), dtype=RECORD) for x in table.column("records")]
    sizes = [len(parts[k]) for k in in_time]
    told = ties(np.concatenate([parts[k] for k in in_time]))
    bits = [part.tobytes() for part in np.split(told, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([*(table.column(c).combine_chunks().take(pa.array(in_time)) for c in ("block", "bucket")), pa.array(bits, pa.binary())], names=[c for c, _ in _REPLY])


class Buckets:
    """Which bucket takes a record: a range of its leading bytes, and in ranges of more than a bucket a hash of its NAMED bytes, too.

    leads are the ascending leading bytes of records that were drawn from `total`, each as likely as any other; they part
    the records into `ranges` ranges at most and tell about how many records each has, and so how many buckets of `size` it needs.
    """

    def __init__(self, leads: list[bytes], total: int, ranges: int, size: int) -> None:
        self.edges = np.array(sorted({leads[len(leads) * k // ranges] for k in range(1, ranges)} if leads else ()), dtype=f"S{LEADING}")
        drawn = np.bincount(np.searchsorted(self.edges, np.array(leads, dtype=self.edges.dtype), side="right"), minlength=len(self.edges) + 1)
        self.parts = np.maximum(1, np.rint(drawn * (total / max(1, len(leads)) / size)).astype(np.int64))
        self.first = np.cumsum(self.parts) - self.parts

    @property
    def count(self) -> int:
        return int(self.parts.sum())

    def numbers(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The buckets of the samples at some ascending positions, each of which has LEADING bytes."""
        if not len(at):
            return np.empty(0, dtype=np.int64)
        leads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LEADING)[at])
        ranges = np.searchsorted(self.edges, leads.reshape(-1).view(f"S{LEADING}"), side="right")
        out, parts = self.first[ranges], self.parts[ranges]
        if (split := parts > 1).any():
            out[split] += (window_hashes(data, NAMED, at[split]) % parts[split].astype(np.uint64)).astype(np.int64)
        return out

    def of(self, data: np.ndarray, at: np.ndarray, number: int = 0, rounds: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, indices) of the samples at some ascending positions, for the buckets of one round; buckets and indices ascend."""
        numbers = self.numbers(data, at)
        own = np.flatnonzero(numbers % rounds == number)
        order = own[np.argsort(numbers[own], kind="stable")]
        edges = np.flatnonzero(np.diff(numbers[order])) + 1
        for index in np.split(order, edges) if len(order) else ():
            yield int(numbers[index[0]]), index


def _portions(dealt: Iterator[tuple[int, np.ndarray]], most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """What Buckets.of deals, in lists of `most` samples at most, or of one bucket that has more."""
    out: list[tuple[int, np.ndarray]] = []
    held = 0
    for bucket, index in dealt:
        if out and held + len(index) > most:
            yield out
            out, held = [], 0
        out.append((bucket, index))
        held += len(index)
    if out:
        yield out


def _names(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sample positions and their names; the distinct names in order, and which of these stand more than once."""
    samples = sample_positions(starts, sizes)
    names = window_hashes(data, NAMED, samples)
    ordered = np.sort(names)
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    more = ~np.append(fresh[1:], True)
    return samples, names, ordered[fresh], more[fresh]


def _among(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the names are among the ascending wanted ones; a table of their leading bits leaves few to be looked up."""
    shift = np.uint64(64 - 20)
    table = np.zeros(1 << 20, dtype=bool)
    table[wanted >> shift] = True
    likely = np.flatnonzero(table[names >> shift])
    out = np.zeros(len(names), dtype=bool)
    if len(wanted):
        found = np.minimum(np.searchsorted(wanted, names[likely]), len(wanted) - 1)
        out[likely] = wanted[found] == names[likely]
    return out


def _bits(index: np.ndarray, count: int) -> bytes:
    """One bit for each of `count` samples: which of them are meant."""
    out = np.zeros(count, dtype=bool)
    out[index] = True
    return np.packbits(out).tobytes()


def _chosen(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=count).astype(bool)


def _batched_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _removed(row: dict, told: dict[int, bytes], buckets: Buckets) -> Iterator[dict]:
    """What is left of a block's documents, given the distances at which its records have earlier suffixes.

    A shared sample that is no first one has an equal record earlier in its block, so that all its suffixes are repeats.
    """
    data, starts, sizes = _layout(row)
    samples = sample_positions(starts, sizes)
    shared, first = (_chosen(row[c], len(samples)) for c in ("shared", "first"))
    at, places = samples[shared], samples[first]
    bits = np.zeros(len(places), dtype=np.uint32)
    for bucket, index in buckets.of(data, places):
        bits[index] = np.frombuffer(told[bucket], dtype=np.uint32)
    again = distances(*reach(starts, sizes, at)) if len(at) else np.empty(0, dtype=np.uint32)
    again[first[shared]] = bits
    repeated = np.zeros(len(data) + 1, dtype=bool)
    for distance in range(REACH + 1):
        repeated[at[(again >> np.uint32(distance)) & 1 == 1] - distance] = True
    steps = repeated.astype(np.int32)
    steps[DEPTH:] -= repeated[:-DEPTH]
    gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
    for doc_id, start, size in zip(row["doc_ids"], starts.tolist(), sizes.tolist(), strict=True):
        own = gone[start : start + size]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist()
        spans = [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        yield {"doc_id": doc_id, "n_bytes": size, "spans": spans, "kept": data[start : start + size][~own].tobytes()}


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_samples: int = BUCKET_SAMPLES, rounds: int = ROUNDS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """docs (doc_id, text) as rows: doc_id, n_bytes, n_removed, spans (first, end) of the removed bytes, and kept bytes.

    1. Documents are joined to blocks in order of their ids. 2. Each block names its cover samples (a hash of the NAMED
    bytes from there on) and sends the distinct names to buckets, which answer each block with a bit per name: shared or
    not. A sample whose name nobody shares is in no repeat; equal hashes of different bytes only cost work later.
    3. Of the shared samples the blocks send the distinct records to buckets by their leading bytes, `rounds` sets of
    buckets one after the other. A bucket sorts its samples by their bytes and then, distance by distance, the suffixes
    before them (see ties); equality is always one of bytes. 4. Each block removes what it was told and what it has
    itself earlier.

    A block sends a record about once (once for each CHUNK_SAMPLES samples), so a passage that stands everywhere costs one record per block. Buckets and the
    partitions they and the blocks are dealt over grow in number with the input and not in size; their edges and numbers are
    drawn from a sample of the records, bounded on the driver, which affects only their sizes. Only records that share
    their NAMED bytes must meet in one bucket, so a passage with very many different surroundings still makes a large one.
    Between the rounds Spark's shuffle files are given back, and few blocks or records at a time are sent to Python.
    Null text is empty; texts under DEPTH bytes are kept whole; rows that repeat an id come in the order of a hash of
    their text, null ids last. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    few_bytes(spark)
    base = written(blocks(docs, block_bytes), "blocks", compression="zstd", **FEW_BLOCKS)
    release(spark)
    sizes = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes")).first()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(usual, -(-sizes["n"] // 2))
    name_buckets = max(48, -(-(sizes["bytes"] or 0) // (32 << 20)))

    def name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _batched_rows(batches):
            keys = _names(*_layout(row))[2]
            yield _sent([(b, row["block"], keys[a:z].astype(np.uint32).tobytes()) for b, a, z in _parted(keys, name_buckets)], ["bucket", "block", "keys"])

    names = base.select("block", "sizes", "data").mapInArrow(name_keys, "bucket long, block long, keys binary")
    answers = written(names.repartition(max(usual, name_buckets // 4), "bucket").groupBy("bucket").applyInArrow(_shared_names, REPLY), "names")
    release(spark)

    step = max(1, bucket_samples // DRAWN)

    def mark(block: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            data, starts, lengths = _layout(row)
            samples, names, keys, more = _names(data, starts, lengths)
            shared = np.flatnonzero(_among(names, keys[_answers(replies, keys, name_buckets) | more]))
            first, drawn = [np.empty(0, dtype=np.int64)], []
            chance = np.random.default_rng(row["block"])
            for start in range(0, len(shared), CHUNK_SAMPLES):
                part = shared[start : start + CHUNK_SAMPLES]
                distinct, index = np.unique(records(data, starts, lengths, samples[part]), return_index=True)
                first.append(part[index])
                drawn += [x[:LEADING] for x in distinct[chance.integers(step) :: step].tolist()]
            first = np.concatenate(first)
            out.append((_bits(shared, len(samples)), _bits(first, len(samples)), len(first), drawn))
        kinds = {"shared": pa.binary(), "first": pa.binary(), "records": pa.int64(), "drawn": pa.list_(pa.binary())}
        for (name, kind), values in zip(kinds.items(), zip(*out, strict=True), strict=True):
            block = block.append_column(name, pa.array(values, kind))
        return block

    schema = "block long, doc_ids array<long>, sizes array<long>, data binary, shared binary, first binary, records long, drawn array<binary>"
    both = base.repartition(dealt, "block").groupBy("block").cogroup(answers.repartition(dealt, "block").groupBy("block"))
    marked = written(both.applyInArrow(mark, schema), "marked", compression="zstd", **FEW_BLOCKS)
    emptied(base)
    emptied(answers)
    release(spark)

    total = marked.agg(F.sum("records")).first()[0] or 0
    count = max(1, -(-total // bucket_samples))
    ranges = min(count, most_ranges)
    share = min(1.0, ranges * DRAWN / max(1, marked.agg(F.sum(F.size("drawn"))).first()[0] or 0))
    drawn = marked.select("block", F.posexplode("drawn").alias("n", "lead")).where(F.pmod(F.xxhash64("block", "n"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    buckets = Buckets(sorted(bytes(r["lead"]) for r in drawn.select("lead").collect()), total, ranges, bucket_samples)

    told = None
    for number in range(rounds):

        def send(batches: Iterator[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
            for row in _batched_rows(batches):
                data, starts, lengths = _layout(row)
                samples = sample_positions(starts, lengths)
                places = samples[_chosen(row["first"], len(samples))]
                for some in _portions(buckets.of(data, places, number, rounds), CHUNK_SAMPLES):
                    found = records(data, starts, lengths, places[np.concatenate([i for _, i in some])])
                    parts = np.split(found, np.cumsum([len(i) for _, i in some])[:-1])
                    yield _sent([(b, row["block"], part.tobytes()) for (b, _), part in zip(some, parts, strict=True)], ["bucket", "block", "records"])

        sent = marked.select("block", "sizes", "data", "first").mapInArrow(send, "bucket long, block long, records binary")
        got = written(sent.repartition(max(usual, buckets.count // rounds), "bucket").groupBy("bucket").applyInArrow(_sorted_bucket, REPLY), "suffixes")
        told = got if told is None else told.unionByName(got)
        del sent, got
        release(spark)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def removed(block: pa.Table, replies: pa.Table) -> pa.Table:
        bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True))
        return pa.Table.from_pylist([left for row in block.to_pylist() for left in _removed(row, bits, buckets)], schema=kinds)

    found = "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary"
    return marked.drop("records", "drawn").repartition(dealt, "block").groupBy("block").cogroup(told.repartition(dealt, "block").groupBy("block")).applyInArrow(removed, found)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: how many bytes of its text stand earlier, in how many runs, and what is left, digested. Null
    texts are empty; rows that repeat an id are taken as `repeats` takes them."""
    found = repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
