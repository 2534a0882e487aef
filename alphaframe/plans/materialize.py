"""Write what several later steps read, or what a loop keeps extending, as Parquet."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``, else the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir")


LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BEFORE: list[str] = []  # the setting that each write in progress found
_LOCK = threading.Lock()


@contextmanager
def letting_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends; writes of several threads may overlap."""
    with _LOCK:
        _BEFORE.append(_BEFORE[0] if _BEFORE else spark.conf.get(LET_GO))
        spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _BEFORE.pop()
            if not _BEFORE:
                spark.conf.set(LET_GO, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from there.

    Losing executors costs nothing that was written; readers prune columns, push filters down and
    know the true size, so small stages are broadcast by Spark's own rule. The plan behind it is not run again,
    so its shuffle files are let go at once instead of when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with letting_go(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def together(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of stages of one schema as one scan, however many there are."""
    folders = [p.inputFiles()[0].rsplit("/", 1)[0] for p in parts]
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*folders)


def discard(*tables: DataFrame) -> None:
    """Delete stages that nothing reads any more."""
    for t in tables:
        spark, files = t.sparkSession, t.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
