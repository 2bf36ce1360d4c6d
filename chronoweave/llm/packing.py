"""Packing documents into sequences of bounded length: large items matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.memory import give_back
from chronoweave.llm.ranking import ROWS_PER_BLOCK, ranked
from chronoweave.session import read_table, small_batches, written

CAPACITY = 1024
END_ID = 2
#: Words whose ids a worker keeps at once, and bytes of ids that it gathers before it hands them on.
CACHED_WORDS, GATHERED = 150_000, 1 << 22

_SLOW = re.compile(r"\s\s|[^\S\n ]|<\|endoftext\|>")


@lru_cache(maxsize=2)
def _libraries(tokenizer: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = lambda name: name if "/" in name else public_tokenizers.path(name)
    with open(path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Tokenizer.from_file(path(tokenizer)), fast, {}


def token_ids(text: str, tokenizer: str, ranks: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers.

    No token of this vocabulary's pre-tokeniser spans a space or line break between two other characters, so a text
    without runs of white space is the chain of its words' ids, and a word's ids are kept until the task ends or too many are.
    Other texts are encoded whole.
    """
    whole, fast, known = _libraries(tokenizer, ranks)
    if _SLOW.search(text):
        import numpy as np

        return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    parts = f"\n{text}".replace("\n", " \n").split(" ")[1:]
    out = []
    for n, part in enumerate(parts):
        got = known.get(part) if n else None
        if got is None:
            got = _encode_part(fast, part, n == 0)
            if n:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                known[part] = got
        out.append(got)
    return b"".join(out)


def _encode_part(fast, part: str, first: bool) -> bytes:
    """A part that starts with a line break stands at a line's start (the first one's break was added), others follow a space."""
    word = part[1:] if first else part if part[:1] == "\n" else f" {part}"
    return b"".join(i.to_bytes(4, "little") for i in fast.encode_ordinary(word))


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = True, copy: str | None = None) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 and, if with_ids, the token ids.

    A document is its ids and end_id; null text is empty, so every document has at least one piece. One that is longer
    than capacity is cut from its end into pieces of that length, and the first piece takes what is left. `copy` names a
    whole number that tells rows of one doc_id apart; the pieces have it as copy.
    """
    fields = [("doc_id", pa.int64()), *[("copy", pa.int64())] * bool(copy), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, " + "copy long, " * bool(copy) + "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    shape = pa.schema([*fields, ("ids", pa.binary())] if with_ids else fields)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            keys = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            for key, value in zip(keys, batch.column(0), strict=True):
                ids = token_ids(value.as_py() or "", tokenizer, ranks) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    part = ids[4 * start : 4 * (start + (capacity if k else first))]
                    row = (*key, k, start, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
                held += len(ids)
                if held > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
        _libraries.cache_clear()  # idle workers live on, beside whatever the executor does next
        give_back()

    small_batches(docs.sparkSession)
    named = [F.col(c).cast("long").alias(name) for c, name in ((doc_id, "doc_id"), (copy, "copy")) if c]
    return docs.select(F.col(text).alias("text"), *named).mapInArrow(run, schema)


class _Gaps:
    """Groups of equal bins by the room that is left in them."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, fill: tuple[tuple[int, int], ...], bins: int) -> None:
        if bins:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                bisect.insort(self.gaps, gap)
            self.by_gap[gap].append((fill, bins))

    def tightest(self, length: int) -> tuple[int, tuple[tuple[int, int], ...], int] | None:
        at = bisect.bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        fill, bins = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.pop(at)
        return gap, fill, bins


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Groups of equal bins for so many items of each length: ((length, how many in the bin), ...) and number of bins.

    Of the large items, over a third of the capacity, at most two share a bin: taken from the longest down, each is
    matched with the longest partner that still fits. Then the small items, longest first, go to the bin with the least
    room that takes them, or open a new one. Equal lengths are placed together, so the plan's size and time depend on
    the number of distinct lengths and not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("an item's length must be between 1 and the capacity")
    gaps, large = _Gaps(), sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            gaps.add(capacity - a, ((a, 1),), left.pop(large.pop()))
            continue
        b = large[at]
        if a == b:
            pairs, rest = divmod(left.pop(a), 2)
            gaps.add(capacity - 2 * a, ((a, 2),), pairs)
            large.pop()
            if rest:  # one left over: the next shorter one is its partner
                if large:
                    b = large[-1]
                    gaps.add(capacity - a - b, ((a, 1), (b, 1)), 1)
                    left[b] -= 1
                    if not left[b]:
                        del left[large.pop()]
                else:
                    gaps.add(capacity - a, ((a, 1),), 1)
            continue
        pairs = min(left[a], left[b])
        gaps.add(capacity - a - b, ((a, 1), (b, 1)), pairs)
        for n, where in ((a, len(large) - 1), (b, at)):
            left[n] -= pairs
            if not left[n]:
                del left[n]
                large.pop(where)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        items = left[n]
        while items:
            gap, fill, bins = gaps.tightest(n) or (capacity, (), -(-items // (capacity // n)))
            each = gap // n
            full = min(bins, items // each)
            gaps.add(gap - each * n, (*fill, (n, each)), full)
            items -= full * each
            if full < bins:
                more = min(items, each)  # fewer than fill a bin are left
                items -= more
                if more:
                    gaps.add(gap - more * n, (*fill, (n, more)), 1)
                gaps.add(gap, fill, bins - full - bool(more)) if fill else None
    return sorted((group for groups in gaps.by_gap.values() for group in groups), key=lambda g: (-g[1], g[0]))


def slots(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go by rank: (length, first rank, end rank, first bin, items a bin, offset)."""
    out, ranks, base = [], {}, 0
    for fill, bins in plan:
        offset = 0
        for n, each in fill:
            first = ranks.get(n, 0)
            ranks[n] = first + each * bins
            out.append((n, first, ranks[n], base, each, offset))
            offset += n * each
        base += bins
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: list[str] | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """pieces with sequence_id and offset: which sequence takes each piece, and where in it the piece starts.

    Only the number of pieces of each length, at most `capacity` numbers whatever the data, goes to the driver, which
    plans groups of equal sequences; the plan (a few thousand rows, bounded by capacity) is broadcast, and each piece
    finds its place by its rank among the pieces of its length. Ranks come from blocks, so a very common length is
    spread over many tasks. Lengths must be between 1 and capacity. Pieces that repeat are packed each; an empty table
    gives an empty table. Columns named sequence_id or offset are replaced, others pass through.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    order = order or [c for c in ("doc_id", "copy", "piece") if c in pieces.columns]
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    table = slots(plan_bins(counts, capacity))
    plan = spark.createDataFrame(table, "__len long, __from long, __to long, __base long, __each long, __at long")
    by = [F.col(c) for c in order]
    numbered = ranked(pieces, length, by, by or [F.col(length)], rows_per_block, "__rank", few_keys=True)
    match = (F.col(length) == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    nth = F.col("__rank") - F.col("__from")
    placed = numbered.join(F.broadcast(plan), match)
    return placed.withColumns({
        "sequence_id": F.col("__base") + F.floor(nth / F.col("__each")).cast("long"),
        "offset": F.col("__at") + F.pmod(nth, F.col("__each")) * F.col(length),
    }).drop("__len", "__from", "__to", "__base", "__each", "__at", "__rank")


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = True, copy: str | None = None) -> DataFrame:
    """Tokenise, cut and pack docs; a row per piece. The pieces are written once, for counting and for placing them.

    Null and empty texts have one piece, the end id. Rows that repeat a doc_id, or have none, are packed each; `copy` tells
    their pieces apart. Other columns of docs are not read.
    """
    return pack_pieces(written(token_pieces(docs, text, doc_id, capacity, end_id, tokenizer, ranks, with_ids, copy), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of every row of documents, null texts as empty ones."""
    packed = pack_documents(read_table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
