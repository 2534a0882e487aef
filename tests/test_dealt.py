"""Chains of windows on many rows get more tasks, not larger ones, and give the same rows."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from alphaframe.functions import frames
from alphaframe.operators import research as R
from alphaframe.operators.fundamentals import facts_wide, pit_fundamentals
from alphaframe.operators.technical import forward_return
from alphaframe.sources.bars import resample_bars


def bars(spark):
    rng = random.Random(3)
    rows = [(date(2020, 1, 1) + timedelta(d), f"s{i}", rng.uniform(1, 9), rng.choice([None, rng.random()])) for d in range(60) for i in range(20)]
    return spark.createDataFrame(rows + rows[:3], "date date, symbol string, close double, x double")


def rows(df):
    return sorted(([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()), key=repr)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_PER_TASK", 50)
    df, least = bars(spark), spark.sparkContext.defaultParallelism
    n = df.count()
    tasks = -(-n // 50)
    assert tasks > least
    cut = forward_return(df, 5, rows_bound=n)
    assert cut.rdd.getNumPartitions() == tasks
    assert forward_return(df, 5, rows_bound=4 * n).rdd.getNumPartitions() == -(-4 * n // 50)
    assert rows(cut.select("date", "symbol", "future_5d").where("symbol <> 's0'")) == rows(
        forward_return(df, 5).select("date", "symbol", "future_5d").where("symbol <> 's0'"))
    # few rows, or an unknown number of them, are left to Spark
    assert frames.dealt(df, ["date"], None) is df and frames.dealt(df, ["date"], 50) is df
    monkeypatch.setattr(frames, "MOST_TASKS", 30)
    assert frames.dealt(df, ["date"], 10 ** 9).rdd.getNumPartitions() == 30


def test_features_and_filings(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_PER_TASK", 50)
    df = bars(spark).withColumnRenamed("close", "y")
    n = df.count()
    cal = df.select("date").distinct().selectExpr("date", "0 as idx")
    for f in (lambda **k: R.factor_summary(df, ["x"], "y", **k), lambda **k: R.feature_ic_wide(df, cal, ["x"], "y", **k)):
        assert rows(f(rows_bound=n)) == rows(f())
    facts = spark.createDataFrame(
        [(f"s{i}", date(2020, 1, 5), date(2019, 12, 31), m, float(i)) for i in range(20) for m in ("assets", "equity", "net_income")],
        "symbol string, available_at date, period_end date, metric string, value double")
    pit = lambda **k: pit_fundamentals(df.select("date", "symbol"), facts, 2, 1.0, 1.0, **k)
    got = pit(rows_bound=n)
    assert got.rdd.getNumPartitions() == -(-n // 50) and rows(got) == rows(pit())


def test_bars_of_many_transactions(spark, monkeypatch):
    """Transactions are dealt by bar before they are grouped: no task's table grows with the split it reads."""
    monkeypatch.setattr("alphaframe.sources.bars.ROWS_PER_HASH", 40)
    rng = random.Random(5)
    trades = [(date(2020, 1, 1) + timedelta(rng.randrange(30)), rng.choice([None, *(f"s{i}" for i in range(20))]), rng.uniform(1, 9), rng.choice([None, 1.0, 2.0]), k)
              for k in range(900)]
    df = spark.createDataFrame(trades, "d date, s string, p double, q double, k long")
    cols = dict(date=F.col("d"), symbol=F.col("s"), price=F.col("p"), qty=F.col("q"), tie=F.col("k"))
    cut = resample_bars(df, **cols, rows_bound=len(trades))
    assert cut.rdd.getNumPartitions() == -(-len(trades) // 40)
    assert rows(cut) == rows(resample_bars(df, **cols))


def test_filings_of_one_group_each(spark):
    """What a pivot gives: latest known period of each metric, a row also where none is known."""
    facts = spark.createDataFrame([
        ("a", date(2020, 5, 1), date(2020, 3, 31), "assets", 2.0), ("a", date(2020, 5, 1), date(2019, 3, 31), "assets", 9.0),
        ("a", date(2020, 5, 1), date(2020, 3, 31), "equity", None), ("a", date(2020, 5, 1), date(2019, 3, 31), "equity", 3.0),
        ("b", date(2020, 5, 1), date(2020, 3, 31), "other", 1.0), ("c", date(2020, 5, 1), None, "assets", 1.0),
        (None, None, date(2020, 3, 31), "assets", 4.0), ("d", date(2020, 5, 1), date(2020, 3, 31), None, 4.0),
    ], "symbol string, available_at date, period_end date, metric string, value double")
    names = ["assets", "equity"]
    latest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period_end")))
    wide = facts_wide(facts, names)
    assert rows(wide) == rows(facts.groupBy("symbol", "available_at").pivot("metric", names).agg(latest))
    # Both sides of one shuffle, where the pivot had two shuffles or two more aggregations.
    assert facts_wide(facts, names)._jdf.queryExecution().executedPlan().toString().count("Aggregate(") == 2
