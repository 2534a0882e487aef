"""The plans chosen for wide groups and hot keys give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from alphaframe.operators import fundamentals as FU
from alphaframe.operators import ranks as K
from alphaframe.operators import research as R
from alphaframe.operators import technical as T
from alphaframe.operators.asof import asof_join
from alphaframe.operators.technical import forward_return


@pytest.fixture(autouse=True)
def small_split(monkeypatch):
    monkeypatch.setattr(K, "SPLIT_AT", 50)
    monkeypatch.setattr(K, "RANGE_ROWS", 20)


@pytest.fixture(scope="module")
def cross(spark):
    """Ties, nulls, and one value shared by a third of the rows of a date."""
    rng = random.Random(5)
    rows = []
    for d in (1, 2, 3):
        for i in range(200):
            x = None if rng.random() < 0.1 else 0.5 if rng.random() < 0.33 else round(rng.gauss(0, 1), 1)
            rows.append((d, f"s{i:03d}", x, rng.gauss(0, 1) if rng.random() < 0.9 else None))
    return spark.createDataFrame(rows, "date int, symbol string, x double, y double").cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_pct_rank(cross):
    plain = K.pct_rank(cross, ["x", "y"], invert=["y_rank"])
    wide = K.pct_rank(cross, ["x", "y"], invert=["y_rank"], universe=200)
    assert rows(plain, "date", "symbol", "x_rank", "y_rank") == rows(wide, "date", "symbol", "x_rank", "y_rank")
    assert "Window" in wide._jdf.queryExecution().executedPlan().toString()


def test_pct_rank_matches_pandas(cross):
    pdf = cross.toPandas()
    pdf["want"] = pdf.groupby("date")["x"].transform(lambda s: s.rank(pct=True).clip(0.001, 0.999))
    got = K.pct_rank(cross, ["x"]).toPandas().merge(pdf[["date", "symbol", "want"]], on=["date", "symbol"])
    both = got.dropna(subset=["want"])
    assert (both["x_rank"] - both["want"]).abs().max() < 1e-12
    assert got.loc[got["want"].isna(), "x_rank"].isna().all()


def test_bins_and_top_bottom(cross):
    a, b = K.quantile_bins(cross, "x"), K.quantile_bins(cross, "x", universe=200)
    assert rows(a, "date", "symbol", "bin") == rows(b, "date", "symbol", "bin")
    cols = ("date", "symbol", "rank", "candidates", "side")
    for top, bottom in ((5, 3), (5, 0), (150, 100)):
        a, b = K.top_bottom_k(cross, "x", top, bottom, 1), K.top_bottom_k(cross, "x", top, bottom, 1, universe=200)
        assert rows(a, *cols) == rows(b, *cols)


def test_ic_and_summary(cross):
    a, b = R.daily_rank_ic(cross, "x", "y"), R.daily_rank_ic(cross, "x", "y", universe=200)
    assert rows(a, "date", F.round("ic", 9), "n") == rows(b, "date", F.round("ic", 9), "n")
    want = cross.toPandas().dropna().groupby("date").apply(
        lambda g: g["x"].rank().corr(g["y"].rank()), include_groups=False)
    got = {r["date"]: r["ic"] for r in a.collect()}
    assert all(abs(got[d] - v) < 1e-9 for d, v in want.items())
    cols = ("feature", F.round("mean_rank_ic", 9), F.round("top_bottom_future_20d", 9), "observations")
    assert rows(R.factor_summary(cross, ["x"], "y"), *cols) == rows(R.factor_summary(cross, ["x"], "y", universe=200), *cols)


def test_medians_wide(cross):
    """Only the ranges that hold the middle are looked into; ties, gaps and even counts included."""
    for value in ("x", "y"):
        a, b = K.medians(cross, value, ["date"], "m"), K.medians(cross, value, ["date"], "m", universe=200)
        assert rows(a, "date", F.round("m", 12)) == rows(b, "date", F.round("m", 12))
    one = cross.where("date = 1 AND symbol < 's003'").withColumn("z", F.lit(None).cast("double"))
    assert K.medians(one, "z", ["date"], "m", universe=200).count() == 0
    ctx = cross.withColumnsRenamed({"x": "vol_20d", "y": "ret_20d"}).withColumn("trend_200", F.col("ret_20d"))
    cols = ("date", F.round("market_vol_20", 12), F.round("market_ret_20", 9))
    assert rows(T.market_context(ctx), *cols) == rows(T.market_context(ctx, universe=200), *cols)
    raw = cross.withColumnsRenamed({"x": "fundamental_raw", "y": "earnings_raw"})
    cols = ("date", "symbol", F.round("fundamental_raw", 12), "earnings_raw")
    assert rows(FU.fill_fundamentals(raw), *cols) == rows(FU.fill_fundamentals(raw, universe=200), *cols)


def test_row_numbers_and_filters_wide(cross):
    df = cross.withColumn("ok", F.col("y") > 0)
    cols = ("date", "symbol", "selected_rank", "selected")
    assert rows(K.first_rank_filter(df, "x", "ok", 8), *cols) == rows(K.first_rank_filter(df, "x", "ok", 8, universe=200), *cols)
    assert rows(K.row_numbers(df, F.col("x"), ["date"], "symbol", "n"), "date", "symbol", "n") == rows(
        K.row_numbers(df, F.col("x"), ["date"], "symbol", "n", 200), "date", "symbol", "n")


def test_expanding_median(spark):
    """Equal to the median of a growing window, without sorting the past again."""
    import numpy as np

    rng = random.Random(3)
    values = [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "date int, v double").repartition(4)
    got = {r["date"]: r["m"] for r in T.expanding_median(df, "v", "m", 20).collect()}
    for i in range(300):
        past = [v for v in values[:i] if v is not None]
        assert (got[i] is None) == (len(past) < 20)
        assert got[i] is None or abs(got[i] - np.median(past)) < 1e-12


def test_forward_return_wide(cross):
    bars = cross.select("date", "symbol", (F.abs("y") + 1).alias("close"))
    a, b = forward_return(bars, 1), forward_return(bars, 1, universe=200)
    cols = ("date", "symbol", F.round("future_relative_1d", 9))
    assert rows(a, *cols) == rows(b, *cols)


@pytest.mark.parametrize("per_column", [True, False])
def test_asof_chunks(spark, per_column):
    """A hot key resolved in slices equals the one-task form and brute force."""
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}"
    facts = {(key(), rng.randrange(4000)): (rng.random() if rng.random() < 0.8 else None, rng.random()) for _ in range(300)}
    left = [(i, key(), rng.randrange(4000)) for i in range(400)]
    stamp = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c) * 60))
    r = stamp(spark.createDataFrame([(k, t, a, b) for (k, t), (a, b) in facts.items()], "k string, t long, a double, b double"), "t")
    p = stamp(spark.createDataFrame(left, "i long, k string, ts long"), "ts")
    want = []
    for i, k, ts in left:
        past = sorted((t, v) for (kk, t), v in facts.items() if kk == k and t <= ts)
        if per_column:
            known = [v[0] for _, v in past if v[0] is not None]
            want.append((i, known[-1] if known else None, past[-1][1][1] if past else None))
        else:
            want.append((i, *(past[-1][1] if past else (None, None))))
    for chunk in (None, "hour", "day"):
        got = asof_join(p, r, ["k"], "ts", "t", ["a", "b"], chunk=chunk, per_column=per_column)
        assert sorted(map(tuple, got.select("i", "a", "b").collect())) == sorted(want)
