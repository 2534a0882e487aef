"""Greedy choice on wide decisions, correlations by blocks, retention bands and scenario rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaframe.operators import calendar as C
from alphaframe.operators import correlation as X
from alphaframe.operators import portfolio as P
from alphaframe.operators import risk as K
from alphaframe.plans.overlay import overlay_scenario, overlay_stress_scenarios, risk_overlay, risk_overlays
from alphaframe.plans.strategy import PRESET_SCORES, PRESETS, scenario

day = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def gappy(spark):
    """Returns of 40 names over 80 sessions: two factors, gaps, one constant and one short name."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 2))
    r = base[:, rng.integers(0, 2, 40)] * 0.7 + rng.normal(size=(80, 40)) * 0.7
    r[rng.random(r.shape) < 0.15] = np.nan
    r[:, 3] = 0.01
    r[30:, 5] = np.nan
    wide = pd.DataFrame(r, columns=[f"n{i:02d}" for i in range(40)], index=[day(i) for i in range(80)])
    long = [(d, c, float(v)) for d, row in wide.iterrows() for c, v in row.items() if not np.isnan(v)]
    return wide, spark.createDataFrame(long, "date date, symbol string, ret double").cache()


@pytest.mark.parametrize("block", [1, 7, 512])
def test_pairs_by_blocks(spark, gappy, block):
    wide, rets = gappy
    names = spark.createDataFrame([(day(d), c) for d in (45, 79) for c in [*wide.columns, "unknown"]], "decision date, symbol string")
    got = {(r["decision"], r["a"], r["b"]): (r["corr"], r["n"])
           for r in K.pairwise_corr(names, rets, C.sessions(rets), 30, 12, block).collect()}
    want = {}
    for d in (45, 79):
        part = wide.loc[:day(d)].tail(30)
        corr = part.corr(min_periods=12)
        known = part.notna().astype(int)
        n = known.T @ known
        for i, a in enumerate(wide.columns):
            for b in wide.columns[i + 1:]:
                if n.loc[a, b] >= 12 and not np.isnan(corr.loc[a, b]) and "n03" not in (a, b):
                    want[day(d), a, b] = (corr.loc[a, b], n.loc[a, b])
    assert got.keys() == want.keys()
    assert all(got[k][1] == n and abs(got[k][0] - c) < 1e-9 for k, (c, n) in want.items())


def test_no_row_per_pair_and_session(spark, gappy):
    """Vectors are exploded once per block of names, and nothing is joined by date."""
    wide, rets = gappy
    names = spark.createDataFrame([(day(79), c) for c in wide.columns], "decision date, symbol string")
    plan = K.pairwise_corr(names, rets, C.sessions(rets))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "covar" not in plan


def brute(order, corr, cap, most, least):
    chosen, seen, rejected = [], {}, []
    for s in order:
        if len(chosen) >= most:
            break
        known = [corr[frozenset((s, o))] for o in chosen if frozenset((s, o)) in corr]
        seen[s] = max(known) if known else 0.0
        (chosen if seen[s] <= cap else rejected).append(s)
    for s in sorted(rejected, key=lambda s: seen[s]):
        if len(chosen) >= least:
            break
        chosen.append(s)
    return [(s, seen[s]) for s in chosen[:most]]


def test_many_caps_and_limits_in_one_walk(spark, gappy):
    wide, rets = gappy
    rng = np.random.default_rng(9)
    cands = [(day(d), c, float(rng.random())) for d in (30, 50, 79) for c in wide.columns]
    df = spark.createDataFrame(cands, "decision date, symbol string, score double")
    grid = [dict(scenario=f"{cap}/{most}", corr_cap=cap, max_names=most) for cap in (-0.5, 0.1, 0.4, 0.9) for most in (4, 8, 30)]
    got = K.diversified_scenarios(df, rets, C.sessions(rets), grid, 4, 30, 12).collect()
    for d in (30, 50, 79):
        cc = wide.loc[:day(d)].tail(30).corr(min_periods=12).drop(index="n03", columns="n03")
        corr = {frozenset((a, b)): cc.loc[a, b] for a in cc for b in cc if a != b and not np.isnan(cc.loc[a, b])}
        order = [c for _, c, _ in sorted((x for x in cands if x[0] == day(d)), key=lambda x: -x[2])]
        for g in grid:
            want = brute(order, corr, g["corr_cap"], g["max_names"], 4)
            mine = sorted(((r["pick"], r["symbol"], r["max_corr"]) for r in got if r["decision"] == day(d) and r["scenario"] == g["scenario"]))
            assert [s for _, s, _ in mine] == [s for s, _ in want]
            assert np.allclose([m for *_, m in mine], [m for _, m in want], atol=1e-9)


def test_ten_thousand_candidates(spark):
    """One walk with bounded state, whatever the number of candidates; equal to a plain loop."""
    n, t = 10_000, 40
    cal = spark.range(t).select(F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("idx"))
    names = spark.range(n).select(F.format_string("s%05d", "id").alias("symbol"), F.col("id").alias("k"))
    noise = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(2001)) - 1000) / 1000.0
    rets = names.crossJoin(cal).select("date", "symbol", (noise(F.lit(7), F.pmod("k", F.lit(3)), "idx") + 0.5 * noise("k", "idx")).alias("ret"))
    cands = names.select(F.lit(day(t - 1)).alias("decision"), "symbol", noise(F.lit(1), "k").alias("score"))
    got = [(r["symbol"], r["max_corr"]) for r in K.diversified_select(cands, rets, cal, 0.3, 12, 5, None, t, 20).orderBy("pick").collect()]
    wide = rets.toPandas().pivot(index="date", columns="symbol", values="ret")
    order = cands.orderBy(F.col("score").desc(), "symbol").toPandas()["symbol"].tolist()
    z = ((wide - wide.mean()) / wide.std(ddof=0)).to_numpy() / np.sqrt(t)
    at = {s: i for i, s in enumerate(wide.columns)}
    chosen, most, rejected = [], {}, []
    for s in order:
        if len(chosen) == 12:
            break
        most[s] = max((float(z[:, at[s]] @ z[:, at[o]]) for o in chosen), default=0.0)
        (chosen if most[s] <= 0.3 else rejected).append(s)
    chosen += sorted(rejected, key=lambda s: most[s])[:max(0, 5 - len(chosen))]
    assert [s for s, _ in got] == chosen
    assert np.allclose([m for _, m in got], [most[s] for s in chosen], atol=1e-9)


def test_retention_band(spark):
    """Held names stay until they rank behind count and buffer; the best others fill up; a skipped date changes nothing."""
    rng = np.random.default_rng(2)
    names = [f"s{i:02d}" for i in range(14)]
    scored = [(day(d), s, float(rng.random())) for d in range(60) for s in (names if d % 9 else names[:3])]
    df = spark.createDataFrame(scored, "date date, symbol string, score double")
    rows = [scenario("plain", "base", rebalance_days=3, long_count=4, short_count=3),
            scenario("band", "base", rebalance_days=3, long_count=4, short_count=3, rank_buffer=3),
            scenario("long", "long_only", rebalance_days=4, long_count=5, rank_buffer=2)]
    sched = P.schedules(C.sessions(df), rows)
    got = {}
    for r in P.select_names(df, "score", sched, rows).collect():
        got.setdefault((r["scenario"], r["rebalance_id"], r["side"]), set()).add(r["symbol"])
    want = {}
    for row in rows:
        held = {"LONG": [], "SHORT": []}
        for s in sorted((x for x in sched.collect() if x["scenario"] == row["scenario"]), key=lambda x: x["rebalance_id"]):
            ranked = [x[1] for x in sorted((x for x in scored if x[0] == s["signal_date"]), key=lambda x: -x[2])]
            if len(ranked) < row["min_names"]:
                continue
            for side, n, line in (("LONG", row["long_count"], ranked), ("SHORT", row["short_count"], ranked[::-1])):
                if not n:
                    continue
                stay = [x for x in line[:n + row["rank_buffer"]] if x in held[side]]
                held[side] = (stay + [x for x in line if x not in stay])[:n]
                want[row["scenario"], s["rebalance_id"], side] = set(held[side])
    assert got == want
    assert any(got["band", k, "LONG"] != got["plain", k, "LONG"] for _, k, side in got if side == "LONG" and ("plain", k, "LONG") in got)


def test_overlay_rows_equal_single_runs(spark):
    """A scenario row of the shared plan gives what a run of its own gives."""
    rng = np.random.default_rng(3)
    bars, scored = [], []
    for s in range(9):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 160)))
        bars += [(day(i), f"S{s}", float(c), float(c), 1e6) for i, c in enumerate(close)]
        scored += [(day(i), f"S{s}", float(rng.random()), float(rng.uniform(0.4, 1)), float(rng.uniform(0.1, 0.5)), i // 50, "NEUTRAL") for i in range(160)]
    bars = spark.createDataFrame(bars, "date date, symbol string, open double, close double, volume double")
    scored = spark.createDataFrame(scored, "date date, symbol string, smooth_score double, probability double, vol_20d double, refresh_id int, regime string")
    th = spark.createDataFrame([(0, 0.5), (1, 0.6), (2, 0.55)], "refresh_id int, threshold double")
    rows = overlay_stress_scenarios()
    assert len(rows) >= 15 and len({r["scenario"] for r in rows}) == len(rows)
    out = risk_overlays(scored, th, bars, rows).toPandas()
    assert set(out["scenario"]) == {r["scenario"] for r in rows}
    for r in rows[:11]:
        alone = risk_overlay(scored, th, bars, corr_cap=r["corr_cap"], max_names=r["max_names"], market_floor=r["market_floor"],
                             prob_floor=r["prob_floor"]).toPandas() if r["scenario"] in ("overlay_corr_075", "overlay_max_10") else None
        mine = out[out["scenario"] == r["scenario"]]
        assert mine["position_scale"].between(0, 1).all() and mine.groupby("date").size().max() <= r["max_names"]
        if alone is not None:
            key = ["date", "symbol"]
            both = mine.merge(alone, on=key, suffixes=("", "_x"))
            assert len(both) == len(mine) == len(alone) and np.allclose(both["position_scale"], both["position_scale_x"])
    scale = lambda n: out[out["scenario"] == f"overlay_{n}"].set_index(["date", "symbol"])["position_scale"]
    low, mid, high = scale("floor_minus_10"), scale("balanced"), scale("floor_plus_10")
    assert (low <= mid + 1e-12).all() and (mid <= high + 1e-12).all() and (low < high).any()


def test_every_preset_has_a_score():
    assert set(PRESET_SCORES) == set(PRESETS)
    assert overlay_scenario("x", corr_cap=0.5, max_names=7)["long_count"] == 7


def test_vectors_end_with_the_history(spark, gappy):
    wide, rets = gappy
    names = spark.createDataFrame([(day(79), "n05"), (day(40), "n05"), (day(79), "n00")], "decision date, symbol string")
    got = {(r["decision"], r["symbol"]): r["vec"] for r in X.return_vectors(names, rets, C.sessions(rets), 20).collect()}
    assert got[day(79), "n05"] == [] and len(got[day(40), "n05"]) < 20
    want = [None if np.isnan(v) else v for v in wide["n00"].loc[:day(79)].tail(20)]
    assert got[day(79), "n00"] == want[:len(got[day(79), "n00"])] and all(v is None for v in want[len(got[day(79), "n00"]):])
