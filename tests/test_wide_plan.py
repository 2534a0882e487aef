"""Wide cross-sections: the plan is chosen by what a session really holds, and rows are made once."""

import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from alphaframe.operators import ranks as K
from alphaframe.operators import research as R
from alphaframe.operators.technical import forward_return
from alphaframe.plans import materialize
from alphaframe.plans.catalog import inputs as I


@pytest.fixture()
def small_split(monkeypatch):
    monkeypatch.setattr(K, "SPLIT_AT", 50)
    monkeypatch.setattr(K, "RANGE_ROWS", 20)


def test_widest_session(spark, tmp_path, monkeypatch):
    """Symbols bound a session, and its transactions do where there are many symbols that trade seldom."""
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    days = [date(2020, 1, 1)] * 7 + [date(2020, 1, 2)] * 3 + [None] * 2
    rows = [(d, 0.0 if i == 0 else 1.0) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert I.widest_session(spark, str(tmp_path)) == 40
    monkeypatch.setattr(K, "SPLIT_AT", 30)
    assert I.widest_session(spark, str(tmp_path)) == 6
    spark.createDataFrame([], "l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    spark.range(40).write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert I.widest_session(spark, f"{tmp_path}/none") == 0


def test_rows_are_made_once(spark, small_split):
    """What makes the rows is in no plan that reads them once a column."""
    made = spark.range(600).select(
        (F.col("id") % 3).alias("date"), F.col("id").cast("string").alias("symbol"), (1 + F.rand(1)).alias("close"), *[F.rand(k).alias(c) for k, c in enumerate("xyz")])
    wide = dict(universe=200)
    ranked = K.pct_rank(made, list("xyz"), **wide)
    moved = forward_return(made, 1, **wide)
    for df in (
        ranked, moved, K.quantile_bins(made, "x", **wide), R.daily_rank_ic(ranked, "x_rank", "y", **wide), R.quintile_spread(ranked, "x_rank", "y", **wide),
        R.factor_summary(ranked, ["x_rank", "z_rank"], "y", **wide), R.feature_ic_wide(ranked, spark.range(3).selectExpr("id date", "id idx").localCheckpoint(), ["x_rank"], "y", **wide),
    ):
        assert "Range (" not in df._jdf.queryExecution().executedPlan().toString()
    plain = K.pct_rank(made, list("xyz"))
    cols = ("date", "symbol", "x_rank", "y_rank", "z_rank")
    assert sorted(map(tuple, ranked.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))


def test_a_stage_lets_its_shuffles_go(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(materialize.LET_GO)
    kept = materialize.cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert kept.count() == 5 and spark.conf.get(materialize.LET_GO) == setting
