"""What the suffix dedup writes beside the texts is two bits a sample, however much is repeated."""

import random

from pyspark.sql import functions as F

from chronoweave.llm import suffix_dedup


def test_marks_are_small_beside_the_texts(spark, monkeypatch):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    texts = ["".join(rng.sample(pool, 3)) for _ in range(60)]
    tables = {}

    def kept(df, name, plain=suffix_dedup.written, **options):
        tables[name] = plain(df, name, **options)
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: sum(s["end"] - s["first"] for s in r["spans"]) for r in suffix_dedup.repeats(docs, block_bytes=20_000).collect()}
    assert sum(got.values()) > 0.9 * sum(map(len, texts))
    marked = tables["marked"]
    binary = [c for c, kind in marked.dtypes if kind == "binary" and c != "data"]
    told = marked.agg(F.sum(F.length("data")).alias("data"), *(F.sum(F.length(c)).alias(c) for c in binary)).first()
    assert told["data"] == sum(map(len, texts)) and sum(told[c] for c in binary) <= 0.06 * told["data"]
