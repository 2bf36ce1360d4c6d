"""Clusters around centroids of integer vectors: segment norms bound the distances, exact ones are for what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import emptied, read_table, written

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components of a segment, of which a compressed vector keeps the norm, rounded up to a multiple of 1 / FINE.
SEGMENT, FINE = 8, 256
#: Integers beyond this count as this, so that a squared distance fits 64 bits.
MOST = 1 << 27

VECTORS = "vec_id long, x array<int>, norms array<long>"


def quantised(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers, held within MOST."""
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row of integers as multiples of 1 / FINE, never below the true ones.

    Where a norm is too large for FINE to be exact in 64 bits it is rounded up as a float and one unit is added.
    """
    squares = (x.reshape(len(x), x.shape[1] // SEGMENT, SEGMENT) ** 2).sum(axis=2)
    up = np.ceil(np.sqrt(squares.astype(np.float64)) * FINE).astype(np.int64) + 1
    return np.where(squares == 0, 0, up)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest centroid (the lowest number among equals) and its squared distance; how many exact ones
    were computed.

    |x - c|^2 is at least |x|^2 + |c|^2 - 2 * (sum over segments of |x_s| |c_s|) by Cauchy and Schwarz. The centroid of the
    least bound gets an exact distance first; only centroids whose bound is not above that get one.
    """
    c_norms = segment_norms(centroids)
    cross = np.zeros((len(x), len(centroids)))
    for s in range(norms.shape[1]):
        cross += norms[:, s, None].astype(np.float64) * c_norms[None, :, s].astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :]
    # A few units in the last place of either term cover the rounding of these float sums.
    bound = squares - (2 / FINE**2) * cross - 1e-12 * (squares + cross / FINE**2)
    first = bound.argmin(axis=1)
    best = ((x - centroids[first]) ** 2).sum(axis=1)
    cluster, exact, limit = first.astype(np.int32), len(x), best.copy()
    for j in range(len(centroids)):
        at = np.flatnonzero((bound[:, j] <= limit) & (first != j))
        if len(at):
            exact += len(at)
            d = ((x[at] - centroids[j]) ** 2).sum(axis=1)
            won = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
            best[at[won]], cluster[at[won]] = d[won], j
    return cluster, best, exact


def integer_vectors(rows: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, integers and segment norms of the vectors with exactly COMPONENTS components, none null or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sized = np.array([n == COMPONENTS for n in lists.value_lengths().to_pylist()], dtype=bool)
            ids, lists = batch.column(0).filter(pa.array(sized)), lists.filter(pa.array(sized))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, COMPONENTS)  # null becomes nan
            whole = np.isfinite(values).all(axis=1)
            x = quantised(values[whole])
            norms = segment_norms(x)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(whole)), _lists(x, pa.int32()), _lists(norms, pa.int64())], ["vec_id", "x", "norms"])

    wanted = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    return wanted.mapInArrow(run, VECTORS)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1), kind))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(c.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1) for c in batch.columns[1:3])


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector, and how many exact distances it took (exact, per batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, best, _ = nearest(*_matrices(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums, exact): added up in each task before anything is shuffled, so a task sends one row a cluster."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, exact = np.zeros(k, np.int64), np.zeros((k, COMPONENTS), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, norms = _matrices(batch)
                cluster, _, more = nearest(x, norms, centroids)
                exact[0] += more
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), _lists(sums, pa.int64()), pa.array(exact)], ["cluster", "n", "sums", "exact"])

    told = vectors.mapInArrow(run, "cluster int, n long, sums array<long>, exact long")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(COMPONENTS)]
    return told.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), *each)


def cluster(rows: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, dict[str, int]]:
    """The kept vectors' (vec_id, cluster, distance), written; the centroids; and counts: vectors, bounds and exact distances.

    Components become integers floor(64 * x). The k vectors with the smallest sha256 of `1:<vec_id>` are the first
    centroids, in that order; each round assigns all vectors and moves each centroid that has any to the floor of their
    mean, exactly. The driver holds k centroids and k sums, nothing that grows with the rows.

    Vectors that are null, have another number of components or one that is null or not finite are left out. A row without
    vec_id is clustered but starts no centroid unless the others are too few; rows that repeat one count each, and equal
    hashes are ordered by their integers. Integers beyond 2^27 count as that bound. With fewer than k vectors there are as
    many centroids; an empty table gives an empty table. Other columns are not read.
    """
    vectors = written(integer_vectors(rows, vec, vec_id), "vectors")
    drawn = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("x", drawn.alias("drawn")).orderBy(F.asc_nulls_last("drawn"), "x").limit(k).collect()
    first.sort(key=lambda r: (r["drawn"] is None, r["drawn"] or "", r["x"]))
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), COMPONENTS)
    counts = {"vectors": 0, "bounds": 0, "exact": 0}
    for _ in range(rounds if len(first) else 0):
        told = cluster_sums(vectors, centroids).collect()
        counts["vectors"] = sum(r["n"] for r in told)
        counts["bounds"] += counts["vectors"] * len(first)
        counts["exact"] += sum(r["exact"] for r in told)
        for r in told:
            if r["n"]:
                centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(COMPONENTS)]
    out = written(assigned(vectors, centroids), "assigned")
    emptied(vectors)
    return out, centroids, counts


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kept vector of embeddings; a sum of distances beyond 64 bits is null."""
    found, centroids, _ = cluster(read_table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] or 0 for r in sums)
    total = total if all(r["cluster_inertia"] is not None for r in sums) and total < 1 << 63 else None
    told = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    per = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    parts = [f"""
with kept as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {COMPONENTS}),
c0 as (select row_number() over (order by h, x) - 1 as c, x from (select x, sha256('1:' || vec_id) as h from kept order by h, x limit {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} as (select vec_id, v, x, min(struct_pack(d, c)) as best from (select k.vec_id, k.rowid as v, k.x, c.c, {dot("k.x", "k.x")} + {dot("c.x", "c.x")} - 2 * {dot("k.x", "c.x")} as d
  from (select *, row_number() over () as rowid from kept) k, c{i} c) group by all)""")
        if i < ROUNDS:
            parts.append(f"""
m{i} as (select c, list(m order by i) as x from (select best.c as c, i, floor(sum(e) / count(*)) as m from (select best, unnest(x) as e, generate_subscripts(x, 1) as i from a{i}) group by best.c, i) group by c),
c{i + 1} as (select c.c, coalesce(m.x, c.x) as x from c{i} c left join m{i} m on c.c = m.c)""")
    return ",".join(parts) + f"""
select a.vec_id, best.c::int as cluster, best.d::bigint as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c.x, lambda x: x::bigint), ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.c = best.c
"""


ORACLE = _oracle()
