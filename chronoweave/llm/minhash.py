"""Near-duplicates by MinHash: documents posted under their signature's coordinates, collisions counted, links confirmed."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm.components import connected_components
from chronoweave.llm.hashing import mixed, shingle_set
from chronoweave.llm.memory import give_back
from chronoweave.llm.selecting import by_ids
from chronoweave.session import emptied, read_table, small_batches, written

#: Coordinates of a signature, and how many must agree. Two sets of similarity 0.75 agree in 48 of 64 on average; fewer
#: than 32 happens to 3 in a million of such pairs, and far less often to more similar ones.
COORDINATES, MATCHES = 64, 32
SIMILARITY = 75
#: A posting list is merged pair by pair up to so many pairs across components; a longer one is skipped, and its members
#: are compared with its centre first and then looked for by rare shingles.
MERGED_PAIRS = 64
#: A list of documents that share shingles is wide above so many pairs across components for each member, and is parted
#: where that takes at most 1/PARTED of its pairs as rows; at most ROUNDS times. What is left is compared pair by pair.
WIDE, PARTED, ROUNDS = 16, 2, 12
#: Wide lists stay whole while all of them have at most so many times `wide` pairs for each posting, and none more than HEAVY
#: pairs: comparing those is work in proportion to the postings, and a parting is some ten jobs over them.
ENOUGH, HEAVY = 4, 1 << 22

_RNG = np.random.Generator(np.random.PCG64(64))
_ODD = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)[:, None] | np.uint64(1)
_FLIP = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 64 coordinates as 32-bit numbers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[None, at : at + 1024] ^ _FLIP) * _ODD).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, rows = [], [], []
        for value in batch.column(1):
            found = shingle_set(value.as_py() or "")
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
            rows.append(signature(found) if len(found) else None)
        held = pa.array(rows, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), held], ["doc_id", "n_shingles", "digest", "signature"])
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(value.as_py() or "").view(np.int64) for value in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])
    give_back()


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, digest (of the whole shingle set) and signature, both null where there are no words."""
    small_batches(docs.sparkSession)
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return wanted.mapInArrow(_signed, "doc_id long, n_shingles long, digest string, signature array<int>")


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(id, token, weight): the coordinate-value pairs under which a class has to be looked for, and how often all of its
    pairs occur, which is most for what many others are copies of.

    Pairs that only one class has lead nowhere; a class with fewer than `matches` others cannot agree with anyone in
    that many. Of the m others, in one order for all classes (rare ones first), two classes that agree in `matches`
    coordinates have one in common among the first m - matches + 1: only those are posted, and the most frequent
    values, such as those of a passage that many documents share, are skipped.
    """
    token = lambda at, value: F.shiftleft(at.cast("long"), 32).bitwiseOR(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = classes.select("id", F.explode(F.transform("signature", lambda value, at: token(at, value))).alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tokens.join(common, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("by_n"))
    prefix = shared.where(F.size("by_n") >= matches).select("id", F.slice("by_n", 1, F.size("by_n") - (matches - 1)).alias("by_n"), F.aggregate("by_n.n", F.lit(0).cast("long"), lambda acc, n: acc + n).alias("weight"))
    return prefix.select("id", F.explode("by_n.token").alias("token"), "weight")


def collisions(met: DataFrame) -> DataFrame:
    """Pairs a < b of (id, other, coordinate) rows, with the coordinates in which they met as bits."""
    bit = F.coalesce(F.expr("shiftleft(1L, coordinate)"), F.lit(0).cast("long"))
    return met.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.bit_or(bit).alias("met"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, matches: int, similarity: int) -> DataFrame:
    """The pairs (a, b, met) that agree in `matches` coordinates and whose full sets are similar; docs has (id, text).

    What the merged lists counted is taken from met; the coordinates whose lists were skipped are probed in the signatures.
    """
    side = lambda name: classes.select(F.col("id").alias(name), F.col("signature").alias(f"s_{name}"))
    probed = F.size(F.filter("s_a", lambda value, at: F.expr("met").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at)).eqNullSafe(0) & (value == F.get("s_b", at))))
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").where(F.bit_count("met") + probed >= matches).select("a", "b"), "likely")
    ids = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()
    sets = by_ids(docs, ids, "id").select("id", "text").mapInArrow(_sets, "id long, shingles array<long>")
    sets = written(sets, "sets")
    full = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"f_{name}"))
    both = likely.join(full("a"), "a").join(full("b"), "b")
    common = F.size(F.array_intersect("f_a", "f_b"))
    union = F.size("f_a") + F.size("f_b") - F.col("common")
    links = written(both.withColumn("common", common).where(F.col("common") * 100 >= union * similarity).select("a", "b"), "links")
    for done in (likely, sets):
        emptied(done)
    return links


def mixed_lists(members: DataFrame) -> DataFrame:
    """Posting lists that hold more than one component: token, pivot (the member of most weight, the list's centre), largest
    (the component with most members here), n (members) and cross (the list's pairs of members of two components)."""
    drawn = F.struct((-F.col("weight")).alias("drawn"), "id", "component")
    parts = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.min(drawn).alias("first"))
    of = parts.groupBy("token").agg(
        F.min("first").alias("pivot"), F.max_by("component", F.struct("c", "component")).alias("largest"),
        F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("inner"),
    ).where("parts > 1")
    return of.select("token", "pivot", "largest", "n", F.expr("(n * n - inner) div 2").alias("cross"))


def with_pivot(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows (id, other, coordinate): each member of a mixed list with its pivot, unless they are in one component."""
    met = members.join(lists, "token").where("component <> pivot.component")
    return met.select("id", F.col("pivot.id").alias("other"), F.expr("cast(shiftright(token, 32) as int)").alias("coordinate"))


def across(members: DataFrame, lists: DataFrame, more: str = "true") -> DataFrame:
    """All pairs (id, other, token) of a mixed list's members of two components for which `more` holds, which may use size
    and at of the one, size2 and at2 of the other; the largest component meets only those outside it."""
    held = members.join(lists.select("token", "largest"), "token").withColumn("most", F.col("component") == F.col("largest"))
    few = held.where("not most").drop("most", "largest", "weight")
    names = {"id": "other", "component": "its", "size": "size2", "at": "at2"}
    two = held.select("token", "most", *[F.col(a).alias(b) for a, b in names.items() if a in held.columns])
    return few.join(two, "token").where(f"component <> its and (most or id < other) and {more}").select("id", "other", "token")


def placed_groups(each: DataFrame) -> DataFrame:
    """(id, size, group, count, before, least) of (id, size, token) rows: shingles that stand in exactly the same documents are
    one group of `count` shingles, told by 128 bits of those documents' ids; least is the smallest size among them.

    A document's groups are in one order for all documents, rare ones first; before counts what comes before a group in its
    document, where shingles of that document only come before all others.
    """
    ids = (F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), *ids).where("n > 1")
    groups = each.join(shared, "token").groupBy("id", "n", "h1", "h2").agg(F.first("size").alias("size"), F.first("least").alias("least"), F.count(F.lit(1)).alias("count"))
    of = Window.partitionBy("id")
    ordered = of.orderBy("n", "h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("size") - F.sum("count").over(of) + F.sum("count").over(ordered) - F.col("count")
    return groups.select("id", "size", F.xxhash64("n", "h1", "h2").alias("group"), "count", before.alias("before"), "least")


def parted(posted: DataFrame, places: DataFrame, similarity: int, wide: int, enough: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]] | None:
    """Wide lists of posted by the next group that their members share: the lists that stay, the longer ones, pairs,
    and the tables that the first and last of these read.

    A list's token stands for the first groups that two documents share, in the order of all; at is what the member has
    missed up to there, upto where the next group may begin, shared what the token's groups count. Similar documents whose
    token does not suffice share a next group, before which neither misses more than it may: a member is posted under
    each such group. Those for which the token does suffice are similar to the list's smallest member, if to any by the
    token alone, and are paired with that one. None where no list is wide and worth it, or where the wide lists have no more
    than `enough` pairs in all and HEAVY each.
    """
    needed = f"* {100 + similarity} >= (size + {{}}) * {similarity}"
    lists = mixed_lists(posted).where(F.col("cross") > wide * F.col("n")).select("token", "cross")
    smallest = posted.groupBy("token").agg(F.min(F.struct("size", "id", "component")).alias("smallest"))
    lists = written(lists.join(smallest, "token"), "wide")
    all_pairs, most_pairs = lists.agg(F.coalesce(F.sum("cross"), F.lit(0)), F.coalesce(F.max("cross"), F.lit(0))).first()
    if all_pairs <= enough and most_pairs <= HEAVY:
        emptied(lists)
        return None
    step = f"before >= upto and (size - at - before + upto) {needed.format('smallest.size')}"
    steps = posted.join(lists, "token").join(places.select("id", "group", "count", "before"), "id").where(step)
    worth = steps.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.first("cross").alias("cross")).where(F.col("rows") * PARTED <= F.col("cross")).select("token")
    # A list none of whose members has a next group is parted, too: only its sufficient members can be similar.
    worth = written(lists.select("token").exceptAll(steps.select("token").distinct()).union(worth), "worth")
    if worth.isEmpty():
        emptied(lists)
        emptied(worth)
        return None
    chosen = posted.join(lists, "token").join(worth, "token", "left_semi")
    suffices = f"shared {needed.format('smallest.size')} and component <> smallest.component"
    pairs = chosen.where(suffices).select("id", F.col("smallest.id").alias("other"))
    longer = steps.join(worth, "token", "left_semi").select(
        "id", "component", "size", "root", F.xxhash64("token", "group").alias("token"), F.expr("at + before - upto").alias("at"),
        F.expr("before + count").alias("upto"), F.expr("shared + count").alias("shared"), "weight",
    )
    return posted.join(worth, "token", "left_anti"), written(longer, "longer"), written(pairs, "sufficient"), [lists, worth]


def given_up(longer: DataFrame, first: DataFrame) -> DataFrame:
    """(root): the lists of first whose pairs across components are fewer than those of the longer lists that came of them."""
    now = mixed_lists(longer).select("token", "cross").join(longer.select("token", "root").distinct(), "token").groupBy("root").agg(F.sum("cross").alias("now"))
    return now.join(mixed_lists(first).select(F.col("token").alias("root"), "cross"), "root").where("now > cross").select("root")


def by_shingles(members: DataFrame, lists: DataFrame, docs: DataFrame, similarity: int, wide: int = WIDE) -> DataFrame:
    """Pairs (id, other, coordinate null) across components, among all members of the skipped lists, that can be similar at all.

    Similar sets have at least similarity / (100 + similarity) of both sizes in common, and all of that stands at or after
    the first group of shingles they share, in both. Edits make rare shingles, so a document with too many of them has no
    place left for those of a large group. Postings that cannot meet that bound even with the smallest document of their
    list go before the lists are joined. Lists that are still wide, such as those of a passage that many documents share
    which are not similar, are parted by the next groups that two documents share (see parted), and by the next ones, until
    the wide lists have at most ENOUGH * wide pairs for each posting.
    Documents that share many groups meet again under each of them: a list whose parting leaves more pairs than it had itself
    is given up and compared pair by pair as it was, so that parting never adds to the pairs that are joined.
    """
    ids = members.join(lists, "token", "left_semi").select("id", "component").distinct()
    ids = written(ids, "open")
    sets = by_ids(docs, ids.select("id"), "id").select("id", "text").mapInArrow(_sets, "id long, shingles array<long>")
    each = written(sets.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("token")), "shingles")
    places = written(placed_groups(each), "places")
    emptied(each)
    fits = f"(size - before) * {100 + similarity} >= (size + least) * {similarity}"
    first = places.where(fits).select("id", "size", F.col("group").alias("token"), F.col("before").alias("at"), F.expr("before + count").alias("upto"), F.col("count").alias("shared"))
    posted = whole = written(first.join(ids, "id").withColumns({"weight": F.lit(0), "root": F.col("token")}), "placed")
    tables, left, pairs, worse = [places, posted], [], [], []
    enough = ENOUGH * wide * whole.count()
    for _ in range(ROUNDS):
        step = parted(posted, places, similarity, wide, enough)
        if step is None:
            break
        stay, longer, sufficient, read = step
        left.append(stay)
        pairs.append(sufficient)
        worse.append(written(given_up(longer, whole), "given-up"))
        tables += [longer, sufficient, worse[-1], *read]
        posted = longer.join(worse[-1], "root", "left_anti")
    pair = f"least(size - at, size2 - at2) * {100 + similarity} >= (size + size2) * {similarity}"
    left.append(posted)
    if worse:
        roots = functools.reduce(DataFrame.union, worse).distinct()
        left = [*(rows.join(roots, "root", "left_anti") for rows in left), whole.join(roots, "root", "left_semi")]
    for rows in left:
        pairs.append(across(rows, mixed_lists(rows), pair).select("id", "other"))
    met = functools.reduce(DataFrame.union, pairs)
    met = met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    found = written(met.withColumn("coordinate", F.lit(None).cast("int")), "pairs")
    for done in tables:
        emptied(done)
    return found


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", matches: int = MATCHES, similarity: int = SIMILARITY, merged_pairs: int = MERGED_PAIRS, wide: int = WIDE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class, and only classes are compared. Every step is the same at every size:
    1. Classes are posted under the coordinate-value pairs of their prefix. 2. In each list all members are compared with
    one pivot, so a list of n costs n comparisons. 3. Lists that still hold several components are merged pair by pair
    where they have at most merged_pairs pairs across; longer ones are skipped, and their members are looked for by
    their full sets' rare shingles, a bound that no similar pair fails. Collisions are counted in the merged lists and
    probed in the signatures where lists were skipped; pairs of `matches` or more are confirmed on full sets. Links
    inside a component that is known already are not looked for, as they change nothing.

    Null or wordless texts have 0 shingles and are alone. Rows that repeat a doc_id are one document; a row without
    doc_id takes the component of its class if that has one, else null. Other columns of docs are not read. An empty
    table gives an empty table.
    """
    signed = written(signatures(docs, text, doc_id), "signatures")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    posts = written(postings(classes, matches), "postings")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def labelled(links: DataFrame) -> DataFrame:
        return connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")

    members = posts.withColumn("component", F.col("id"))
    links = confirmed(collisions(with_pivot(members, mixed_lists(members))), classes, texts, matches, similarity)
    labels = labelled(links)
    members = written(posts.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    lists = written(mixed_lists(members), "lists")
    merged = across(members, lists.where(F.col("cross") <= merged_pairs)).select("id", "other", F.expr("cast(shiftright(token, 32) as int)").alias("coordinate"))
    looked_for = by_shingles(members, lists.where(F.col("cross") > merged_pairs), texts, similarity, wide)
    found = confirmed(collisions(merged.unionByName(looked_for)), classes, texts, matches, similarity)
    for done in (posts, members, lists, looked_for):
        emptied(done)
    if not found.isEmpty():
        labels = labelled(links.unionByName(found))
    resolved = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("class_component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(resolved, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; null and wordless texts are empty and alone."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, len(sh) as n from s),
x as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r as (select doc_id, doc_id as reach from documents union select r.doc_id, e.b from r join e on r.reach = e.a),
m as (select doc_id, min(reach) as component_id from r group by 1)
select doc_id, n.n::bigint as n_shingles, component_id, doc_id = component_id as kept from n join m using (doc_id)
"""
