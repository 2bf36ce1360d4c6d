"""Files as tables and tables as files: listings of media, images as text, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.vectors import data_uri

# Suffixes of media files.
SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm")


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """name and size in MB of a folder's files with one of the suffixes; contents are not read, empty files passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s)
    return files.where(wanted).select(name.alias("name"), F.round(F.col("length") / (1024 * 1024), 1).alias("size_mb"))


def safe_name(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a file name has a media suffix and leads out of no folder."""
    suffix = F.lit(False)
    for s in suffixes:
        suffix = suffix | F.lower(name).endswith(s)
    return suffix & ~name.contains("/") & ~name.contains("\\") & ~name.contains("..")


def images(spark: SparkSession, folder: str, glob: str = "*.jpg") -> DataFrame:
    """Files of a folder as frames: their number in order of names, path, and a data URI of their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", data_uri("image/jpeg", F.col("content")).alias("uri"))


def labelled_name(name: Column) -> tuple[Column, Column]:
    """The id at the start of a file name, as four digits, and whether it ends in -F (any case); null where it has none."""
    pid = F.regexp_extract(name, r"^(\d+)-", 1)
    return F.when(pid != "", F.lpad(pid, 4, "0")), F.upper(name).rlike(r"-F\.[A-Z]+$")


def manifest_hash(df: DataFrame) -> Column:
    """A hash of a row that does not depend on the order of its columns."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON document a row."""
    df.write.mode("overwrite").json(path)
