"""Repeated runs of lines: winnowed line hashes are joined by position, matches extended, later runs deleted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import emptied, read_table, small_batches, written

#: A run is deleted where it repeats if it has so many lines, or else so many words.
MIN_LINES, MIN_WORDS = 3, 50

LINES = "key binary, doc_id long, numbers array<int>, hashes binary, ends array<int>, chosen array<int>"


def line_keys(text: str) -> list[tuple[int, int, int]]:
    """(line number, 128-bit hash, words) of each line that is not blank; white space at the ends and its kind do not count."""
    out = []
    for number, line in enumerate(text.split("\n")):
        words = line.split()
        if words:
            out.append((number, xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass")), len(words)))
    return out


def windows_of(keys: list[tuple[int, int, int]], min_lines: int, min_words: int) -> Iterator[tuple[int, int]]:
    """From each line on, the fewest lines that have min_lines lines or min_words words; none where the text ends first."""
    for i in range(len(keys)):
        words = 0
        for j in range(i, min(i + min_lines, len(keys))):
            words += keys[j][2]
            if words >= min_words or j - i + 1 == min_lines:
                yield i, j
                break


def choices(keys: list[tuple[int, int, int]], min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(first, last, chosen) of each window: the line with its least hash (the last one among equals) is its fingerprint.

    Which line a window selects depends on the window alone, so two equal windows always select the same fingerprint:
    every repeated run that is long enough shares one.
    """
    return [(i, j, min(range(i, j + 1), key=lambda n: (keys[n][1], -n))) for i, j in windows_of(keys, min_lines, min_words)]


def winnowed(keys: list[tuple[int, int, int]], min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> dict[int, list[tuple[int, int]]]:
    """The selected lines, each with the windows that chose it."""
    chosen: dict[int, list[tuple[int, int]]] = {}
    for i, j, at in choices(keys, min_lines, min_words):
        chosen.setdefault(at, []).append((i, j))
    return chosen


def hashed_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines of (__key, doc_id, text) that are not blank: their numbers and hashes, and for each line the last line and the
    chosen one of the window that begins with it (lines with which none begins are at the end and have none). Texts without
    lines have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = line_keys(text or "")
                if found:
                    windows = choices(found, min_lines, min_words)
                    rows.append((key, doc_id, [k[0] for k in found], b"".join(k[1].to_bytes(16, "little") for k in found), [w[1] for w in windows], [w[2] for w in windows]))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "doc_id", "numbers", "hashes", "ends", "chosen"])

    return docs.select("__key", "doc_id", "text").mapInArrow(run, LINES)


def _fingerprint(hashes: bytes, line: int) -> int:
    return (int.from_bytes(hashes[16 * line : 16 * line + 8], "little")) - (1 << 63)


def postings(lines: DataFrame) -> DataFrame:
    """(fingerprint, key): the lines that some window of a document selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_fingerprint(hashes, at), key) for key, hashes, chosen in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at in sorted(set(chosen))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["fingerprint", "key"])

    return lines.select("key", "hashes", "chosen").mapInArrow(run, "fingerprint long, key binary")


def extended(lines: DataFrame) -> DataFrame:
    """The windows around the shared fingerprints (column shared) of each document: content (its lines' hashes, digested),
    place, and the numbers of the first and the last line. A window extends from its fingerprint to both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, doc_id, numbers, hashes, ends, chosen, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = set(shared)
                for i, (j, at) in enumerate(zip(ends, chosen, strict=True)):
                    if _fingerprint(hashes, at) in known:
                        content = hashlib.blake2b(hashes[16 * i : 16 * j + 16], digest_size=16).digest()
                        rows.append((content, key, {"none": doc_id is None, "doc_id": doc_id, "key": key, "first": numbers[i]}, numbers[i], numbers[j]))
            place = pa.struct([("none", pa.bool_()), ("doc_id", pa.int64()), ("key", pa.binary()), ("first", pa.int32())])
            kinds = (pa.binary(), pa.binary(), place, pa.int32(), pa.int32())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["content", "key", "place", "first", "last"])

    held = lines.select("key", "doc_id", "numbers", "hashes", "ends", "chosen", "shared")
    return held.mapInArrow(run, "content binary, key binary, place struct<none:boolean,doc_id:long,key:binary,first:int>, first int, last int")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(key, runs): of each document, the stretches of lines that stand earlier, maximal and in order.

    Only fingerprints, one number each, are posted for all documents; those that stand once lead nowhere. From a joined
    position a match is extended both ways window by window: the windows that hold the fingerprint are compared, each with
    the earliest place at which the same lines stand, and matches that touch or overlap are one longer match. What goes is
    defined by windows: a line goes if any run of lines around it that is long enough stands earlier, wherever that is, so
    a stretch may be covered by several earlier documents; extending against one of them alone would leave lines that
    another one repeats, and against all of them would cost the square of their number. A fingerprint or window that
    stands n times costs n rows; it is counted before it is shuffled, and the joins hold no group together, so that
    adaptive execution can split those on a frequent line.
    """
    posts = written(postings(lines), "postings")
    shared = posts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    joined = written(posts.join(written(shared, "shared"), "fingerprint").select("key", "fingerprint"), "positions")
    wanted = joined.groupBy("key").agg(F.collect_set("fingerprint").alias("shared"))
    windows = written(extended(lines.join(wanted, "key")), "windows")
    earliest = written(windows.groupBy("content").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "earliest")
    later = written(windows.join(earliest, "content").where(F.col("place") > F.col("earliest")).select("key", "first", "last"), "later")
    for done in (posts, joined, windows, earliest):
        emptied(done)
    spans = later.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    return spans.mapInArrow(_merged, "key binary, runs array<struct<first:int,last:int>>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        rows = []
        for spans in batch.column(1).to_pylist():
            runs: list[dict] = []
            for span in spans:
                if runs and span["first"] <= runs[-1]["last"] + 1:
                    runs[-1]["last"] = max(runs[-1]["last"], span["last"])
                else:
                    runs.append(dict(span))
            rows.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["key", "runs"])


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` without its repeated runs, and n_lines, n_removed, n_runs.

    A run of at least min_lines lines, or of fewer with min_words words, is deleted where the same lines stand earlier:
    in a document with a smaller id (null ids come last), or before it in the same one. Lines are what "\\n" parts,
    compared without regard to white space; blank ones do not part a run, and go with the line before them. The deleted
    lines go with one line break each; a text of which nothing is left is empty. Null text stays null. Rows with equal
    id and text are one document and are treated alike, told by 128 bits of a digest of both; of rows with equal ids and
    different texts the order is fixed but not told. Columns named n_lines, n_removed or n_runs are replaced, others pass through; __key and __runs are
    taken. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    small_batches(docs.sparkSession)
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumn("__key", F.unhex(F.md5(key)))
    lines = written(hashed_lines(keyed.select("__key", F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), min_lines, min_words), "lines")
    runs = repeated_runs(lines).select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    joined = keyed.join(runs, "__key", "left").drop("__key")
    rest = [f for f in docs.schema.fields]
    schema = T.StructType([*rest, *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_runs"))])
    at, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value, spans in zip(batch.column(at), batch.column(len(rest)).to_pylist(), strict=True):
                body = value.as_py()
                kept, count = cut(body, [(s["first"], s["last"]) for s in spans or []])
                texts.append(kept)
                counts.append(count)
            columns = [*batch.columns[: len(rest)], *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*docs.columns, "__runs").mapInArrow(run, schema)


def cut(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, tuple[int, int, int]]:
    """The text without the runs of lines and the blank lines after each; lines, removed ones (not blank) and runs."""
    lines = (text or "").split("\n")
    full = sum(bool(line.split()) for line in lines)
    if not runs:
        return text, (full, 0, 0)
    kept, gone, at = [], 0, 0
    for number, line in enumerate(lines):
        while at < len(runs) and number > runs[at][1] and line.split():
            at += 1
        if at < len(runs) and runs[at][0] <= number:
            gone += bool(line.split())
        else:
            kept.append(line)
    return "\n".join(kept), (full, gone, len(runs))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty."""
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Runs are counted over lines that are not blank, as a match spans the blank ones between its lines.
ORACLE = r"""
with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no from documents),
k as (select *, trim(regexp_replace(line, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g')) as body from d),
f as (select doc_id, no, line, body, len(string_split(body, ' ')) as words, row_number() over (partition by doc_id order by no) as i from k where body <> ''),
n as (select *, lead(body) over w as b2, lead(body, 2) over w as b3, lead(words) over w as w2, from f window w as (partition by doc_id order by i)),
v as (select doc_id, i, case when words >= 50 then 0 when words + w2 >= 50 then 1 when b3 is not null then 2 end as more, body, b2, b3 from n),
c as (select doc_id, i, more, row_number() over (partition by more, body, case when more >= 1 then b2 end, case when more = 2 then b3 end order by doc_id, i) as nth from v where more is not null),
g as (select distinct doc_id, i + unnest(range(0, more + 1)) as i from c where nth > 1),
m as (select k.doc_id, k.no, k.line, f.i, g.i is not null as gone from k left join f on f.doc_id = k.doc_id and f.no = k.no left join g on g.doc_id = f.doc_id and g.i = f.i),
r as (select *, coalesce(last_value(case when i is not null then gone end ignore nulls) over (partition by doc_id order by no), false) as out,
  i is not null and gone and not coalesce(lag(gone) over (partition by doc_id, i is null order by no), false) as starts from m)
select doc_id, count(i)::bigint as n_lines, count(*) filter (i is not null and gone)::bigint as n_removed, count(*) filter (starts)::bigint as n_runs,
  sha256(coalesce(string_agg(line, chr(10) order by no) filter (not out), '')) as kept_sha256 from r group by doc_id
"""
