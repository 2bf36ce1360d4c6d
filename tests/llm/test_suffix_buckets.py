"""The suffix dedup's buckets stay near their size, whatever the records' leading bytes are, and go to Python few at a time."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import suffix_dedup


def drawn(rng, n):
    return "".join(rng.choices("abcdefghijklmnop", k=n))


def even(rng):
    """Records whose leading bytes are spread alike in all blocks."""
    return [drawn(rng, 25_000) for _ in range(40)]


def one_opening(rng):
    """Many records that share their 24 leading bytes and nothing after these."""
    return ["".join(f"in the name of all who are {drawn(rng, 73)}" for _ in range(200)) for _ in range(40)]


@pytest.mark.parametrize("made, size", [(even, 4096), (one_opening, 512)])
def test_no_bucket_has_several_times_its_size(spark, monkeypatch, made, size):
    texts = made(random.Random(6))
    tables = []

    def kept(df, name, plain=suffix_dedup.written, **options):
        out = plain(df, name, **options)
        if name == "suffixes":
            tables.append(out)
        return out

    monkeypatch.setattr(suffix_dedup, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    left = suffix_dedup.repeats(docs, block_bytes=50_000, bucket_samples=size).where("n_bytes > length(kept)").count()
    assert left == len(texts)
    told = [t.groupBy("bucket").agg((F.sum(F.length("bits")) / 4).cast("long").alias("n")) for t in tables]
    sizes = [r["n"] for t in told for r in t.collect()]
    assert sum(sizes) > 20 * size and max(sizes) <= 2.5 * size


def test_portions_of_a_block_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    pool = [drawn(rng, 300) for _ in range(8)]
    docs = spark.createDataFrame([(i, "".join(rng.sample(pool, 3))) for i in range(30)], "doc_id long, text string")
    plain = sorted(map(str, suffix_dedup.repeats(docs, block_bytes=5_000).collect()))
    monkeypatch.setattr(suffix_dedup, "CHUNK_SAMPLES", 40)
    assert sorted(map(str, suffix_dedup.repeats(docs, 5_000, 16, 3).collect())) == plain


def test_blocks_go_to_python_one_at_a_time(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert suffix_dedup.repeats(docs).count() == 1

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    blocks = spark.range(0, 6, 1, 1).select(F.repeat(F.lit("x"), 5 << 20).alias("data"))
    assert blocks.mapInArrow(rows, "n long").agg(F.max("n")).first()[0] == 1
