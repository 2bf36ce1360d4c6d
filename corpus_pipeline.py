"""A corpus pipeline: every stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import line_dedup, minhash, mixing, packing, toxicity
from chronoweave.llm.selecting import by_ids
from chronoweave.session import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels of held-out documents are not learned from.

    A null text scores as an empty one; rows without an id or with a repeated one are scored each for itself.
    """
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels), score="__score")
    return scored.where(F.col("__score") < 0.5).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier go; so do documents of which nothing else is left.

    Null and empty texts have no lines and stay as they are; rows with equal id and text are one document (see dedup_lines).
    """
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without an id all stay."""
    gone = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as many times as the mix of sources takes it; rows without an id or with a repeated one count each for
    itself. Rows without words, null texts among them, move no total: they stand as often as their place in the order has it."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    sizes = written(rows.select("__row", "doc_id", "source", mixing.n_words(F.col("text")).alias("n")), "sizes")
    taken = mixing.mix_sources(sizes, F.col("n"), ties=["doc_id", "__row"]).where("copies > 0").select("__row", "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.join(taken, "__row").select(*docs.columns, times.alias("__copy")).drop("__copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences of 1024 tokens; copy, one number per row of docs,
    tells the pieces of a repeated document's copies apart, with or without an id. Null texts have the end id alone."""
    return packing.pack_documents(docs.withColumn("__copy", F.monotonically_increasing_id()), copy="__copy")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier is not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
