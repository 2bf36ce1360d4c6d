"""How far the sources of a language diverge: groups of terms stay in their seats, compressed peers come round to meet them."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import emptied, read_table, written

#: A language keeps the terms that stand in so many of its documents; a group tells so many terms.
LEAST_DOCS, MOST_TERMS = 30, 50
#: p is 1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V)).
UNIT, SMOOTH = 1_000_000_000, 5
#: Seats of the tournament, an even number; so many less one are the rounds in which seats meet, whatever the number of groups.
SEATS = 8
#: A seat's numbers in one slice of the terms, which is what a meeting holds.
SEAT_NUMBERS = 1 << 20
#: So many counts are held by a task before they are sent on, and so many bytes of a text are cut into terms at once.
HELD_COUNTS, PIECE = 1 << 19, 1 << 20

# ASCII letters and all that is not ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
NOT_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """data in pieces of about `size` bytes, none of which ends inside a term."""
    at = 0
    while at < len(data):
        cut = NOT_TERM.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def count_terms(data: bytes) -> Counter:
    """The terms of a text, A-Z lower-cased, with their numbers."""
    found: Counter = Counter()
    for piece in pieces(data.lower()):
        found.update(TERM.findall(piece))
    return found


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per group, summed up in each task and then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for of, where, body in zip(*batch.columns, strict=True):
                counts = held.setdefault((of.as_py(), where.as_py()), {})
                before = len(counts)
                for term, n in count_terms(body.as_py()).items():
                    entry = counts.get(term)
                    if entry is None:
                        counts[term] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                size += len(counts) - before
                if size >= HELD_COUNTS:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    def told(held: dict[tuple[str, str], dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for (of, where), counts in held.items():
            if counts:
                n, docs = zip(*counts.values(), strict=True)
                same = lambda x, k=len(counts): pa.repeat(pa.scalar(x, pa.string()), k)
                yield pa.RecordBatch.from_arrays([same(of), same(where), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    wanted = docs.select(plain(lang), plain(source), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    each = wanted.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count, in three steps of long division, exact while total + SMOOTH * terms is below 9 * 10^15."""
    whole = total + SMOOTH * terms
    left, out = counts.astype(np.int64) + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: its number of entries, gaps between places and counts, compressed."""
    gaps = np.diff(places.astype(np.int32), prepend=np.int32(0))
    return zlib.compress(np.int32(len(places)).tobytes() + gaps.astype(np.int32).tobytes() + counts.astype(np.int64).tobytes(), 1)


def unpacked(data: bytes | None, width: int) -> np.ndarray:
    """The counts of a packed vector at all `width` places; none for null."""
    out = np.zeros(width, np.int64)
    if data is not None:
        raw = zlib.decompress(data)
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        out[np.cumsum(np.frombuffer(raw, np.int32, n, 4))] = np.frombuffer(raw, np.int64, n, 4 + 4 * n)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [packed(np.array([e["place"] for e in of], np.int64), np.array([e["n"] for e in of], np.int64)) for of in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], ["lang", "slice", "source", "vector"])


TOLD = "lang string, slice int, source string, other string, place int, value long"


def _rows(lang: str, part: int, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(lang, part, *row) for row in found], columns=["lang", "slice", "source", "other", "place", "value"]).astype({"place": "Int32", "slice": "int32"})


def _share_rows(block: pd.DataFrame) -> list[np.ndarray]:
    return [shares(unpacked(v, w), n, t) for v, w, n, t in zip(block["vector"], block["width"], block["total"], block["terms"], strict=True)]


def _home(most: int):
    def home(key: tuple, block: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        """A seat's groups among themselves, both ways, and each one's terms above the language's share, through a heap."""
        if not len(block) or not len(whole):
            return _rows(str(key[0]), int(key[1]), [])
        p, (q,) = _share_rows(block), _share_rows(whole)
        names, found = list(block["source"]), []
        for i, mine in enumerate(p):
            for j in range(i):
                value = int(np.abs(mine - p[j]).sum())
                found += [(names[i], names[j], None, value), (names[j], names[i], None, value)]
            counts = unpacked(block["vector"].iloc[i], len(mine))
            above = np.flatnonzero((counts > 0) & (mine > q))
            best = heapq.nsmallest(most, zip((q[above] - mine[above]).tolist(), above.tolist(), strict=True))
            found += [(names[i], None, place, -value) for value, place in best]
        return _rows(str(key[0]), int(key[1]), found)

    return home


def _meet(key: tuple, block: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    """A seat's groups against a visiting seat's, both ways."""
    found = []
    if len(block) and len(visitors):
        residents = list(zip(block["source"], _share_rows(block), strict=True))
        for i in range(len(visitors)):
            name, (theirs,) = visitors["source"].iloc[i], _share_rows(visitors.iloc[i : i + 1])
            for mine, p in residents:
                value = int(np.abs(p - theirs).sum())
                found += [(mine, name, None, value), (name, mine, None, value)]
    return _rows(str(key[0]), int(key[1]), found)


def rounds(seats: int = SEATS) -> list[list[tuple[int, int]]]:
    """A round-robin tournament by the circle: in each of seats - 1 rounds every seat meets another, and all meet once."""
    ring = list(range(seats))
    out = []
    for _ in range(seats - 1):
        out.append([(min(a, b), max(a, b)) for a, b in zip(ring[: seats // 2], reversed(ring[seats // 2 :]), strict=True)])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, most: int = MOST_TERMS, seats: int = SEATS, seat_numbers: int = SEAT_NUMBERS) -> DataFrame:
    """lang, source, part, item, value, rank: of each (lang, source) group the distance to every other source of the language
    (part pair) and the `most` terms that it has more of than the language (part term).

    Null text, lang and source are ''. A language keeps the terms that at least `least` of its documents have, and cuts them
    into slices so that a seat's groups times a slice's terms is about seat_numbers. Each group is dealt a seat by hash
    and stays there; a seat's part of one slice is one resident block. In the first round a block's groups meet each other
    and the language itself, whose terms each ranks through a heap of its own; then the seats rotate: in each of seats - 1
    rounds half of the seats' compressed vectors travel to the other half, and a meeting counts for both sides. A round is
    written, so a lost executor costs a round. Distances are sums over slices. Nothing is sent to the driver, and every task
    holds one block and one visitor of bounded size (a seat has more than its mean of groups only by chance of the hash).

    A group without terms, or a language without kept ones, has its rows too (value 0 for the latter). A language with one
    source has no pairs. Rows that repeat an id count each, as ids are not read; other columns neither. An empty table gives an
    empty table.
    """
    counts = written(term_counts(docs, text, lang, source), "counts")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(plain(lang).alias("lang"), plain(source).alias("source")).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least).select("lang", "term", "n")
    kept = written(kept, "kept")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total")), "lang", "left")
    langs = langs.na.fill(0, ["terms", "lang_total"])
    slices = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.ceil(F.col("sources") / seats) / seat_numbers)).cast("int")
    langs = written(langs.select("lang", "terms", "lang_total", slices.alias("slices")), "langs")
    sliced = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    terms = written(sliced.select("lang", "slice", "term", "n", (F.row_number().over(W.partitionBy("lang", "slice").orderBy("term")) - 1).alias("place")), "terms")

    own = written(counts.select("lang", "source", "term", "n").join(terms.select("lang", "term", "slice", "place"), ["lang", "term"]), "own")
    entries = lambda rows, *by: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("entries"))
    sparse = lambda rows: rows.mapInArrow(_vectors, "lang string, slice int, source string, vector binary")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("width"))
    seat = F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int").alias("seat")
    places = langs.select("lang", "terms", "lang_total", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(sizes, ["lang", "slice"], "left").na.fill(0, ["width"])
    named = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).select("lang", "source", "total", seat)
    seated = named.join(places.drop("lang_total"), "lang").join(sparse(entries(own, "lang", "slice", "source").select("lang", "slice", "source", "entries")), ["lang", "slice", "source"], "left")
    seated = written(seated, "seated")
    langwide = places.join(sparse(entries(terms, "lang", "slice").select("lang", "slice", F.lit("").alias("source"), "entries")).drop("source"), ["lang", "slice"], "left").withColumnRenamed("lang_total", "total")
    hosts = langwide.withColumn("host", F.explode(F.sequence(F.lit(0), F.lit(seats - 1))))

    blocks = seated.groupBy("lang", "slice", "seat")
    met = [written(blocks.cogroup(hosts.groupBy("lang", "slice", "host")).applyInPandas(_home(most), TOLD), "home")]
    for pairs in rounds(seats):
        host = F.create_map(*[F.lit(x) for home, away in pairs for x in (away, home)])[F.col("seat")]
        visitors = seated.withColumn("host", host).where("host is not null")
        at_home = seated.where(F.col("seat").isin([home for home, _ in pairs]))
        met.append(written(at_home.groupBy("lang", "slice", "seat").cogroup(visitors.groupBy("lang", "slice", "host")).applyInPandas(_meet, TOLD), "met"))
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)

    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = every.where("place is null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    best = met[0].where("place is not null").join(terms.select("lang", "slice", "place", F.col("term").alias("item")), ["lang", "slice", "place"]).select("lang", "source", "item", "value")
    out = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(ranked(best).where(F.col("rank") <= most).withColumn("part", F.lit("term")))
    for done in (counts, kept, own, seated):
        emptied(done)
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of sources of each language of documents, and each source's 50 most distinctive terms."""
    return source_divergence(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text,
  row_number() over () as r from documents),
g as (select distinct lang, source from d),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by all having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
t as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from g left join c using (lang, source) group by all),
p as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v)::hugeint as p,
  1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v)::hugeint as q
  from t join k using (lang) join v using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
u as (select lang, source, 'pair' as part, item, value from f union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u)
select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= 50
"""
