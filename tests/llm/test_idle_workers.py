"""Workers outlive their tasks: after packing they hold neither the tokenizer nor its words."""

import pyarrow as pa
from pyspark.sql import functions as F

from chronoweave.llm import packing


def test_packing_leaves_no_words_in_a_worker(spark):
    docs = spark.createDataFrame([(i, f"words of document {i} and more") for i in range(20)], "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing._libraries.cache_info().currsize] * batch.num_rows, pa.int32())], ["n"])

    assert packing.token_pieces(docs).count() == 20
    again = docs.select("doc_id").repartition(4).mapInArrow(held, "n int").agg(F.max("n"))
    assert again.first()[0] == 0
