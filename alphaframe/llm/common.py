"""Helpers of the training-data operators: stored intermediate tables and column checks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse, which is shared too.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{named or spark.conf.get('spark.sql.warehouse.dir')}/llm-{uuid.uuid4().hex}"


LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with its own schema.

    What was written survives any executor; the plan that made it is not run again, so its shuffle
    files are let go at once instead of when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark), spark.conf.get(LET_GO)
    spark.conf.set(LET_GO, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(LET_GO, before)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``stored``, for rows dealt by ``by`` to as many tasks as ``buckets``: later joins by it move the other side alone.

    The table's name is let go at once; the files are let go by ``discard`` like those of others.
    """
    spark = df.sparkSession
    folder, name, before = shared_folder(spark), f"llm_{uuid.uuid4().hex}", spark.conf.get(LET_GO)
    spark.conf.set(LET_GO, "true")
    try:
        df.write.format("parquet").bucketBy(buckets, by).option("path", folder).saveAsTable(name)
    finally:
        spark.conf.set(LET_GO, before)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        spark, files = t.sparkSession, t.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names, so that others cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(alias) for alias, c in columns.items()])


STEPS = 32  # bins per doubling of a count


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """The largest counts as a table (key, n), at most ``most``, largest first, then by key.

    Counts are binned by size; the bins that fit whole are taken, so no task sorts or gathers more
    than the result. Keys of the first bin that does not fit are left out.
    """
    key = counts.columns[0]
    binned = counts.withColumn("_bin", F.floor(F.log2("n") * STEPS).cast("int"))
    sizes = sorted(((r["_bin"], r["k"]) for r in binned.groupBy("_bin").agg(F.count("*").alias("k")).collect()), reverse=True)  # 64 * STEPS at most
    edge, total = None, 0
    for b, k in sizes:
        total += k
        if total > most:
            break
        edge = b
    rows = binned.where(F.col("_bin") >= edge) if edge is not None else binned.limit(0)
    return rows.select(key, "n").toArrow().sort_by([("n", "descending"), (key, "ascending")])
