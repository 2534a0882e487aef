"""Run registry: newest rows, versions, active jobs, latest run per strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """Newest ``n`` rows by id: a distributed top-k, not a full sort."""
    return df.orderBy(F.col(id_col).desc()).limit(n)


def next_version(df: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    return df.groupBy(name).agg((F.max(version) + F.lit(1)).alias("next_version"))


def active_jobs(df: DataFrame, kind: str = "kind", status: str = "status", id_col: str = "id") -> DataFrame:
    """Per kind: jobs, jobs still queued or running, and the newest of those."""
    live = F.col(status).isin("QUEUED", "RUNNING")
    return df.groupBy(kind).agg(
        F.count("*").alias("jobs"), F.count_if(live).alias("active"),
        F.max(F.when(live, F.col(id_col))).alias("active_id"),
    )


def strategy_version(name):
    """V7.1 before the single digits, else the first 18 characters of the name."""
    digit = F.regexp_extract(name, r"(?i)v([5-9])", 1)
    return (
        F.when(name.rlike(r"(?i)v7\.1"), "V7.1")
        .when(digit != "", F.concat(F.lit("V"), digit)).otherwise(F.substring(name, 1, 18))
    )


def latest_run_per_strategy(runs: DataFrame, strategy: str = "strategy", id_col: str = "id") -> DataFrame:
    """Newest run of each version. Aggregated map side: a version with most of the runs is no
    heavier than the others."""
    rest = [c for c in runs.columns if c != id_col]
    keyed = runs.withColumn("version", strategy_version(F.col(strategy)))
    return keyed.groupBy("version").agg(
        F.max(id_col).alias(id_col), F.max_by(F.struct(*rest), id_col).alias("_r")
    ).select("version", id_col, "_r.*")
