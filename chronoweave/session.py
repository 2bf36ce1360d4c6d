"""Session helpers: local sessions, and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "8", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir where set, else a temporary one of a local session.

    A cluster without that setting is refused, because executors do not see each other's temporary folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("CHRONOWEAVE_TMP"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: computed once, lineage cut, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Overwrite a table that written() made with no rows, once nothing reads it any more, to give its space back."""
    (path,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()} or {None}
    if path:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


#: Seconds that release() waits for Python's references and for what follows the JVM's collection.
MOMENTS = 0.1, 0.3


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: its cleaner acts when their plans are collected as garbage.

    Python's references, the cleaner and the executors' files go one after the other and not at once, so each gets a moment.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(MOMENTS[0])
        spark.sparkContext._jvm.System.gc()
        time.sleep(MOMENTS[1])


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send `rows` rows at a time to Python, where the session has Spark's default of 10,000: texts can be long, and a
    worker and the JVM beside it hold whole batches."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def few_bytes(spark: SparkSession, size: str = "4m") -> None:
    """Send about `size` at a time to Python, a longer row alone, where the session does not say how much: Spark's default is
    64 MB, of which the JVM holds several copies outside its heap for each task."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
