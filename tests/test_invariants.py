"""Invariants of the operators on small hand-made tables, and brute-force twins where SQL has none."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaframe.operators import calendar as C
from alphaframe.operators import fundamentals as FU
from alphaframe.operators import meta as ME
from alphaframe.operators import metrics as M
from alphaframe.operators import models as MO
from alphaframe.operators import portfolio as P
from alphaframe.operators import risk as K
from alphaframe.operators import technical as T
from alphaframe.plans.materialize import cut
from alphaframe.plans.overlay import risk_overlay
from alphaframe.plans.strategy import evaluate, scenario
from alphaframe.plans.walk_forward import WalkForward, walk_forward_oos
from alphaframe.sources import bars as B
from alphaframe.sources import filings as FI
from alphaframe.sources import store as ST

DAY0 = dt.date(2020, 1, 1)
day = lambda i: DAY0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def walk(spark):
    """Six symbols, 330 sessions of a random walk."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(6):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 330)))
        rows += [(day(i), f"S{s}", float(c * 1.001), float(c), 1e6) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "date date, symbol string, open double, close double, volume double").cache()


def as_dict(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_targets_and_features_do_not_look_ahead(walk):
    full = T.forward_return(T.technical(walk))
    last = full.where(F.col("date") > day(309)).agg(F.count("future_20d")).first()[0]
    assert last == 0
    early = T.technical(walk.where(F.col("date") <= day(280)))
    cols = ["ret_20d", "ret_252d", "vol_60d", "trend_200", "median_dollar_volume_60"]
    keep = ["date", "symbol", *[F.round(c, 10).alias(c) for c in cols]]
    a = full.where(F.col("date") <= day(280)).select(*keep)
    assert a.exceptAll(early.select(*keep)).count() == 0


def test_rolling_columns_match_pandas(walk):
    pdf = walk.toPandas().sort_values(["symbol", "date"])
    g = pdf.groupby("symbol")["close"]
    pdf["v"] = g.pct_change().groupby(pdf["symbol"]).rolling(20).std().reset_index(level=0, drop=True) * np.sqrt(252)
    pdf["t"] = pdf["close"] / g.rolling(200).mean().reset_index(level=0, drop=True) - 1
    got = T.technical(walk).select("date", "symbol", "vol_20d", "trend_200").toPandas().merge(pdf, on=["date", "symbol"])
    for a, b in (("vol_20d", "v"), ("trend_200", "t")):
        assert (got[a].isna() == got[b].isna()).all() and (got[a] - got[b]).abs().max() < 1e-9


def test_market_scale_ignores_the_future(walk):
    a = as_dict(T.market_risk_scale(walk), ["date"], "scale")
    bumped = walk.withColumn("close", F.when(F.col("date") > day(200), F.col("close") * (1 + F.rand(1))).otherwise(F.col("close")))
    b = as_dict(T.market_risk_scale(bumped), ["date"], "scale")
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a if k[0] <= day(200))


def test_execution_target_value(spark):
    df = spark.createDataFrame([(day(i), "A", 100.0 + i) for i in range(20)], "date date, symbol string, open double")
    got = T.execution_target(df).orderBy("date").first()["future_open_return"]
    assert abs(got - (111 / 101 - 1)) < 1e-12


@pytest.mark.parametrize("span", [1, 2, 5, 20, 60, 500])
def test_ewma_is_exact_and_one_sided(spark, span):
    rows = [(day(i), "A", None if i % 11 == 3 else float(i % 7)) for i in range(400)]
    schema = "date date, symbol string, x double"
    a = as_dict(T.ewma_score(spark.createDataFrame(rows, schema), "x", span), ["date"], "x_smooth")
    want = pd.Series([r[2] for r in rows]).dropna().ewm(span=span, adjust=False).mean()
    assert max(abs(a[(day(i),)] - w) for i, w in want.items()) < 1e-9
    assert all(a[(day(i),)] is None for i in range(3, 400, 11))
    rows[-1] = (*rows[-1][:2], 999.0)
    b = as_dict(T.ewma_score(spark.createDataFrame(rows, schema), "x", span), ["date"], "x_smooth")
    assert all(a[k] == b[k] for k in a if k != (day(399),))


def test_facts_take_the_latest_period(spark):
    from alphaframe.operators.fundamentals import facts_wide

    rows = [("A", "revenue", 100.0, day(0), day(200)), ("A", "revenue", 60.0, day(90), day(200)), ("A", "revenue", None, day(180), day(200))]
    got = facts_wide(spark.createDataFrame(rows, "symbol string, metric string, value double, period_end date, available_at date"))
    assert [r.revenue for r in got.collect()] == [60.0]


def test_entry_follows_signal_and_costs_hurt(walk):
    cal = C.sessions(walk)
    s = C.align_execution_dates(cal, 5).collect()
    assert all(r["signal_date"] < r["entry_date"] <= r["exit_date"] for r in s)
    scored = walk.withColumn("score", F.col("close"))
    rows = [scenario("base", "long_only", long_count=3, min_names=1), scenario("costly", "long_only", long_count=3, min_names=1, cost_bps=50.0)]
    ev = evaluate(scored, walk, "score", rows, cal)
    m = {r["scenario"]: r for r in ev.metrics.collect()}
    assert m["costly"]["total_return"] < m["base"]["total_return"]
    assert ev.held.where("weight <= 0").count() == 0
    # Journal identity: the last equity is the compounded net return, and every session is there.
    daily = ev.daily.where("scenario = 'base'").orderBy("date").collect()
    last = ev.ledger.where("scenario = 'base'").agg(F.max_by("equity", "rebalance_id")).first()[0]
    assert abs(daily[-1]["equity_usd"] - 100_000 * last) < 1e-6
    assert len(daily) == (daily[-1]["date"] - daily[0]["date"]).days + 1


def test_drawdown_and_order_split(spark):
    curve = spark.createDataFrame([(day(0), 100e3), (day(1), 90e3), (day(2), 100e3)], "date date, equity_usd double")
    dd = M.running_drawdown(curve, 100e3)
    assert abs(dd.agg(F.min("drawdown")).first()[0] + 0.10) < 1e-12
    t = spark.createDataFrame([("A", -2.0, 3.0), ("B", 2.0, -1.0), ("C", 1.0, 4.0)], "symbol string, prior_weight double, target_weight double")
    got = {(r["symbol"], r["action"]): r["qty"] for r in P.split_orders(t).collect()}
    assert got == {("A", "COVER"): 2, ("A", "BUY"): 3, ("B", "SELL"): 2, ("B", "SHORT"): 1, ("C", "BUY"): 3}


def test_cash_left_and_cap(spark):
    sel = spark.createDataFrame([("s", 1, f"N{i}", "LONG", 0.5) for i in range(4)], "scenario string, rebalance_id int, symbol string, side string, scale double")
    loose = P.target_weights(sel, scale="scale", normalize=False).agg(F.sum("weight")).first()[0]
    assert abs(loose - 0.5) < 1e-12
    assert P.target_weights(sel, cap=0.10).agg(F.max("weight")).first()[0] == 0.10


def test_fundamental_gate(spark):
    cols = "symbol string, revenue double, net_income double, assets double, equity double, operating_cf double"
    df = spark.createDataFrame([
        ("ok", 100e6, 1.0, 500e6, 100e6, 1.0), ("bounded", 100e6, -1.0, 500e6, -200e6, None),
        ("deep", 100e6, -1.0, 500e6, -300e6, None), ("small", 1e6, 1.0, 2e6, 1e6, 1.0),
    ], cols)
    got = as_dict(FU.pit_fundamental_gate(df, 4, 50e6, 100e6), ["symbol"], "solid_fundamental_eligible")
    assert got == {("ok",): True, ("bounded",): True, ("deep",): False, ("small",): False}


def test_company_facts_priority(spark):
    row = lambda v, **k: {"end": "2020-03-31", "val": v, "form": "10-Q", "filed": "2020-05-01", **k}
    tags = {
        "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [row(1.0, form="8-K")]}},
        "Revenues": {"units": {"EUR": [row(7.0)], "USD": [row(2.0), row(3.0, filed="")]}},
        "SalesRevenueNet": {"units": {"USD": [row(9.0)]}},
        "NetIncomeLoss": {"units": {"EUR": [row(5.0)]}},
    }
    df = spark.createDataFrame([("A", json.dumps({"facts": {"us-gaap": tags}}))], "symbol string, payload string")
    assert {(r["metric"], r["value"]) for r in FI.flatten_company_facts(df).collect()} == {("revenue", 2.0), ("net_income", 5.0)}


def test_asset_words(spark):
    rows = [("AAA", "Plain Co", "NYSE", True, True), ("BBB", "Big Fund", "NYSE", True, True), ("CCC", "iShares Core", "NYSE", True, True),
            ("D$D", "Odd", "NYSE", True, True), ("EEE", "Otc Co", "OTC", True, True), ("FFF", "No Frac", "NYSE", True, False)]
    df = spark.createDataFrame(rows, "symbol string, name string, exchange string, tradable boolean, fractionable boolean")
    assert [r[0] for r in B.filter_assets(df).collect()] == ["AAA"]


def test_strict_json_nested(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"k": float("-inf")})], "a double, xs array<double>, m map<string,double>")
    assert json.loads(ST.strict_json(df).first()["json"]) == {"a": None, "xs": [1.0, None], "m": {"k": None}}


def test_keyed_result_and_store(spark, tmp_path):
    calls = []
    build = lambda: (calls.append(1), spark.range(3))[1]
    a, hit_a = ST.keyed_result(build, spark, "ns", {"v": 1}, str(tmp_path))
    b, hit_b = ST.keyed_result(build, spark, "ns", {"v": 1}, str(tmp_path))
    _, hit_c = ST.keyed_result(build, spark, "ns", {"v": 2}, str(tmp_path))
    assert (hit_a, hit_b, hit_c, len(calls)) == (False, True, False, 2) and a.count() == b.count() == 3
    assert ST.panel_status(spark, str(tmp_path / "none")).first()["reason"] == "missing"
    df = spark.createDataFrame([(day(0), "A", True)], "date date, symbol string, solid_eligible boolean")
    ST.write_panel(df, str(tmp_path / "p"), mode="x")
    assert ST.panel_status(spark, str(tmp_path / "p")).first()["reason"] == "mode_mismatch"


def greedy(cands, corr, cap, mx, mn):
    chosen, rejected = [], []
    for s in cands:
        if len(chosen) >= mx:
            break
        m = max((corr[frozenset((s, o))] for o, _ in chosen if frozenset((s, o)) in corr), default=0.0)
        (chosen if m <= cap else rejected).append((s, m))
    for s, m in sorted(rejected, key=lambda x: x[1]):
        if len(chosen) >= mn:
            break
        chosen.append((s, m))
    return chosen[:mx]


@pytest.mark.parametrize("block", [4, 64])
@pytest.mark.parametrize("cap,mx,mn", [(0.3, 6, 4), (-0.9, 6, 5), (0.9, 3, 2)])
def test_diversified_select_brute_force(spark, cap, mx, mn, block):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 2))
    r = base[:, rng.integers(0, 2, 14)] * 0.8 + rng.normal(size=(60, 14)) * 0.6
    rets = pd.DataFrame(r, columns=[f"s{i:02d}" for i in range(14)])
    long = [(day(i), c, float(rets.loc[i, c])) for i in range(60) for c in rets if (i + int(c[1:])) % 5]
    rdf = spark.createDataFrame(long, "date date, symbol string, ret double")
    cands = [(day(d), c, float(rng.random())) for d in (40, 59) for c in rets]
    cdf = spark.createDataFrame(cands, "decision date, symbol string, score double")
    cal = C.sessions(rdf)
    got = K.diversified_select(cdf, rdf, cal, cap, mx, mn, cut, lookback=30, min_obs=10, block=block).collect()
    wide = pd.DataFrame(long, columns=["d", "s", "r"]).pivot(index="d", columns="s", values="r")
    for d in (40, 59):
        cc = wide.loc[:day(d)].tail(30).corr(min_periods=10)
        corr = {frozenset((a, b)): cc.loc[a, b] for a in cc for b in cc if a != b and not np.isnan(cc.loc[a, b])}
        order = [c for _, c, _ in sorted((x for x in cands if x[0] == day(d)), key=lambda x: -x[2])]
        want = greedy(order, corr, cap, mx, mn)
        mine = [(r["symbol"], r["max_corr"]) for r in sorted(got, key=lambda r: r["pick"]) if r["decision"] == day(d)]
        assert [s for s, _ in mine] == [s for s, _ in want]
        assert np.allclose([m for _, m in mine], [m for _, m in want], atol=1e-9)


def test_sizing_floors(spark):
    df = spark.createDataFrame([(p, 0.5) for p in (0.49, 0.50, 0.52, 0.70)], "prob double, threshold double")
    low = [r["size"] for r in K.prob_sizing(df, "floor", 0.1).collect()]
    high = [r["size"] for r in K.prob_sizing(df, "floor", 0.4).collect()]
    assert low[0] == high[0] == 0 and all(h >= x for h, x in zip(high, low, strict=True)) and high[1] == pytest.approx(0.4)


@pytest.fixture(scope="module")
def planted(spark):
    """Twenty names, 420 sessions; the target follows the first feature."""
    rng = np.random.default_rng(1)
    rows = []
    for d in range(420):
        x = rng.random((20, 3))
        y = 0.05 * (x[:, 0] - 0.5) + rng.normal(0, 0.02, 20)
        rows += [(day(d), f"S{i:02d}", *map(float, x[i]), float(y[i]), float(y[i]), True, "NEUTRAL" if d % 3 else "TREND_UP") for i in range(20)]
    schema = ("date date, symbol string, momentum_12_1_rank double, f1 double, f2 double, future_relative_20d double, "
              "future_open_return double, solid_eligible boolean, regime string")
    return spark.createDataFrame(rows, schema).cache()


FEATS = ["momentum_12_1_rank", "f1", "f2"]


@pytest.mark.parametrize("std", [False, True])
def test_ridge_equals_direct_solve(spark, planted, std):
    pdf = planted.toPandas()
    members = spark.createDataFrame([(k, day(d)) for k, stop in ((1, 150), (2, 300)) for d in range(stop)], "fold long, date date")
    fits = MO.ridge_fits(MO.gram_by_date(planted, FEATS, "future_relative_20d"), members, 3, 10.0, std).collect()
    for r in fits:
        part = pdf[pdf["date"] < day(150 if r["fold"] == 1 else 300)]
        x, y = part[FEATS].to_numpy(), part["future_relative_20d"].to_numpy()
        s = x.std(axis=0) if std else np.ones(3)
        z = (x - x.mean(axis=0)) / s
        beta = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean())) / s
        assert np.allclose(r["coef"], beta, atol=1e-10)
        assert abs(r["intercept"] - (y.mean() - beta @ x.mean(axis=0))) < 1e-10


def test_classifier_finds_the_signal(planted):
    df = ME.meta_label(planted)
    m = MO.meta_classifier(df, FEATS)
    assert m["coef"][0] > 5 * max(abs(m["coef"][1]), abs(m["coef"][2]))
    one = MO.meta_classifier(df.where("label = 1"), FEATS)
    assert one["classes"] == 1 and one["coef"] == [0.0] * 3
    p = MO.platt_calibration(MO.probability(df, m, FEATS, "raw_prob"))
    assert p["a"] > 0


def test_walk_forward_is_out_of_sample(spark, planted):
    cfg = WalkForward(min_names=5, refresh=60, models=("ridge", "momentum"), features=FEATS)
    scored, refreshes = walk_forward_oos(planted, cfg)
    rows = scored.join(planted.select("date", "symbol", "future_relative_20d"), ["date", "symbol"]).toPandas()
    assert rows["date"].min() == day(229) and len(rows) == rows[["date", "symbol"]].drop_duplicates().shape[0]
    ic = rows.groupby("date").apply(lambda g: g["raw_score"].corr(g["future_relative_20d"], method="pearson"), include_groups=False)
    assert ic.mean() > 0.2
    # Changing labels after the last training date of a refresh changes nothing scored by it.
    bump = F.when(F.col("date") > day(330), -F.col("future_relative_20d")).otherwise(F.col("future_relative_20d"))
    again, _ = walk_forward_oos(planted.withColumn("future_relative_20d", bump), cfg)
    a = as_dict(scored.where(F.col("date") < day(340)), ["date", "symbol"], "prob")
    b = as_dict(again.where(F.col("date") < day(340)), ["date", "symbol"], "prob")
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert refreshes.count() == 4


def test_walk_forward_net_variant(planted):
    df = planted.withColumn("future_relative_open", F.col("future_relative_20d"))
    cfg = WalkForward(kind="net", validation=126, embargo=12, logistic_c=0.30, fit_share=0.55, min_fit=30,
                      min_names=5, refresh=80, models=("ridge", "momentum"), features=FEATS)
    scored, _ = walk_forward_oos(df, cfg)
    per_day = scored.where("trade_score is not null").groupBy("date").count().agg(F.max("count")).first()[0]
    assert per_day is None or per_day <= 15


def test_overlay_keeps_to_its_limits(spark, walk):
    scored = T.technical(walk).where("vol_20d is not null").select(
        "date", "symbol", F.col("ret_20d").alias("smooth_score"), F.lit(0.8).alias("probability"), "vol_20d", F.lit(1).alias("refresh_id"))
    th = spark.createDataFrame([(1, 0.6)], "refresh_id int, threshold double")
    out = risk_overlay(scored, th, walk, max_names=3, min_names=2).toPandas()
    assert out.groupby("date").size().max() <= 3
    assert out["position_scale"].between(0, 1).all() and out["vol_scale"].between(0.35, 1).all()


def test_stream_ewma_over_batches(spark, tmp_path):
    """Two micro-batches continue one state and equal the batch fold."""
    from alphaframe.streaming.ewma import stream_ewma

    rng = random.Random(2)
    rows = [(f"s{i % 3}", 1_600_000_000 + i, i, rng.random()) for i in range(120)]
    make = lambda r: spark.createDataFrame(r, "symbol string, t long, tie long, score double").select(
        "symbol", F.timestamp_seconds("t").alias("ts"), "tie", "score")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (rows[:70], rows[70:]):
        make(part).coalesce(1).write.mode("append").parquet(src)
        q = (stream_ewma(spark.readStream.schema(make(rows[:1]).schema).parquet(src)).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    got = as_dict(spark.read.parquet(out), ["tie"], "smooth")
    for s in ("s0", "s1", "s2"):
        mine = [r for r in rows if r[0] == s]
        want = pd.Series([r[3] for r in mine]).ewm(span=5, adjust=False).mean()
        assert max(abs(got[(r[2],)] - w) for r, w in zip(mine, want, strict=True)) < 1e-12


def test_order_status_merges_batches(spark):
    from alphaframe.streaming.trades import merge_order_status

    schema = "client_order_id string, ts timestamp, status string, symbol string, side string"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    one = merge_order_status(spark.createDataFrame([("a", t(1), "new", "X", "buy"), ("b", t(2), "new", "Y", "buy")], schema), None)
    two = merge_order_status(spark.createDataFrame([("a", t(3), "filled", "X", "buy"), ("b", t(1), "late", "Y", "buy")], schema), one)
    assert {(r["client_order_id"], r["status"], r["is_terminal"]) for r in two.collect()} == {("a", "filled", True), ("b", "new", False)}
