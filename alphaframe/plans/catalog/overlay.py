"""Diversified choices, the risk overlay and its stress rows on the weekly panel."""

from pyspark.sql import functions as F

from ...functions import by_symbol, period_return
from ...operators import risk as K
from ...operators import technical as T
from ...operators.calendar import sessions
from ...operators.ranks import pct_rank
from ..materialize import cut
from ..overlay import overlay_stress_scenarios, risk_overlay, risk_overlays
from ..strategy import LONG_ONLY_WEIGHTS, run_presets, stress_matrix
from . import inputs as I
from .base import cte, register, six
from .portfolio import LG, PERF, PRESET_ROWS, SCENARIOS, band_sql, chain, scen_sql

OVERLAYS = overlay_stress_scenarios(long_gross=LG)
# The classifier's probability is stood in for by a mix of symbol and session.
cte("scored_w", """
SELECT p.date, p.symbol, idx, score, 0.5 + 0.45 * ((CAST(p.symbol AS BIGINT) * 37 + idx * 11) % 101) / 101.0 AS probability, idx // 100 AS refresh_id,
  CASE idx % 5 WHEN 0 THEN CASE WHEN CAST(p.symbol AS BIGINT) % 2 = 0 THEN 'RISK_OFF' ELSE 'HIGH_VOL' END WHEN 1 THEN 'HIGH_VOL' WHEN 2 THEN 'TREND_UP' ELSE 'NEUTRAL' END AS regime,
  vol_20d FROM panel_w p JOIN cal_w USING (date) JOIN (
    SELECT date, symbol, CASE WHEN count(ret_1d) OVER w = 20 THEN stddev_samp(ret_1d) OVER w * sqrt(252) END AS vol_20d
    FROM tech_w WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) v ON v.date = p.date AND v.symbol = p.symbol
WHERE score IS NOT NULL""", ["panel_w", "cal_w", "tech_w"])
cte("thresholds", "SELECT refresh_id, floor(quantile_cont(probability, 0.4) * 100) / 100 AS threshold FROM scored_w GROUP BY 1", ["scored_w"])
# Sums over the trailing 63 sessions of each ordered pair.
cte("roll", """
SELECT idx, x, y, n, CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 12) END AS corr
FROM (SELECT idx, x, y, count(p) OVER w AS n, sum(a) OVER w AS sx, sum(b) OVER w AS sy, sum(a * a) OVER w AS sxx, sum(b * b) OVER w AS syy, sum(p) OVER w AS sxy
  FROM (SELECT c.idx, s.symbol AS x, t.symbol AS y, CASE WHEN v.ret_1d IS NOT NULL THEN u.ret_1d END AS a, CASE WHEN u.ret_1d IS NOT NULL THEN v.ret_1d END AS b,
      u.ret_1d * v.ret_1d AS p
    FROM cal_w c, (SELECT DISTINCT symbol FROM tech_w) s JOIN (SELECT DISTINCT symbol FROM tech_w) t ON s.symbol <> t.symbol
    LEFT JOIN tech_w u ON u.date = c.date AND u.symbol = s.symbol LEFT JOIN tech_w v ON v.date = c.date AND v.symbol = t.symbol)
  WINDOW w AS (PARTITION BY x, y ORDER BY idx ROWS 62 PRECEDING)) WHERE n >= 20""", ["cal_w", "tech_w"])


def greedy_sql(cands: str, roll: str, caps, most: int, need: int, min_obs: int) -> str:
    """One candidate a step: it joins unless a chosen name is too close; the least close rejects fill up."""
    rest = "list_sort(rejected)[1:greatest(need - len(chosen), 0)]"
    return f"""
WITH RECURSIVE caps(cap, most, need) AS (VALUES {", ".join(f"({c}::DOUBLE, {most}, {need})" for c in caps)}
), walk(cap, decision, pos, chosen, corr, rejected) AS (
  SELECT cap, decision, 1::BIGINT, [symbol], [0.0::DOUBLE], []::STRUCT(c DOUBLE, p BIGINT, s VARCHAR)[] FROM {cands}, caps WHERE pos = 1
  UNION ALL
  SELECT cap, decision, pos, CASE WHEN m <= cap THEN list_append(chosen, symbol) ELSE chosen END, CASE WHEN m <= cap THEN list_append(corr, m) ELSE corr END,
    CASE WHEN m <= cap THEN rejected ELSE list_append(rejected, {{'c': m, 'p': pos, 's': symbol}}) END
  FROM (SELECT w.cap, w.decision, c.pos, any_value(c.symbol) AS symbol, any_value(w.chosen) AS chosen, any_value(w.corr) AS corr, any_value(w.rejected) AS rejected,
          coalesce(max(r.corr) FILTER (list_contains(w.chosen, r.y)), 0.0) AS m
        FROM walk w JOIN caps k ON k.cap = w.cap JOIN {cands} c ON c.decision = w.decision AND c.pos = w.pos + 1
        LEFT JOIN {roll} r ON r.idx = c.idx AND r.x = c.symbol AND r.n >= {min_obs} WHERE len(w.chosen) < k.most GROUP BY 1, 2, 3)
), last AS (SELECT cap, decision, arg_max(chosen, pos) AS chosen, arg_max(corr, pos) AS corr, arg_max(rejected, pos) AS rejected FROM walk GROUP BY 1, 2
), final AS (
  SELECT cap, decision, list_concat(chosen, list_transform({rest}, lambda r: r.s))[1:most] AS names,
    list_concat(corr, list_transform({rest}, lambda r: r.c))[1:most] AS corrs FROM last JOIN caps USING (cap))
SELECT cap, decision, CAST(unnest(range(len(names))) AS INTEGER) AS pick, unnest(names) AS symbol, unnest(corrs) AS max_corr FROM final"""


cte("cand_w", """SELECT date AS decision, idx, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS pos
FROM scored_w WHERE probability >= 0.6""", ["scored_w"])
cte("cand_o", """SELECT date AS decision, idx, symbol, score, probability, threshold, regime, vol_20d, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS pos
FROM scored_w JOIN thresholds USING (refresh_id)
WHERE probability >= threshold AND (idx % 10 = 0 OR idx = (SELECT max(idx) FROM scored_w))""", ["scored_w", "thresholds"])


def scored_weekly(spark, sf, bars):
    df = T.rolling_vol(I.panel_w(spark, sf, bars), [20]).join(sessions(bars), "date")
    k, s = F.col("idx") % 5, F.col("symbol").cast("bigint")
    regime = F.when(k == 0, F.when(s % 2 == 0, "RISK_OFF").otherwise("HIGH_VOL")).when(k == 1, "HIGH_VOL").when(k == 2, "TREND_UP").otherwise("NEUTRAL")
    prob = 0.5 + 0.45 * ((s * 37 + F.col("idx") * 11) % 101) / 101.0
    return df.where("score is not null").select(
        "date", "symbol", "idx", F.col("score").alias("smooth_score"), prob.alias("probability"), "vol_20d", regime.alias("regime"),
        F.floor(F.col("idx") / 100).alias("refresh_id"))


def thresholds(scored):
    """Per refresh the probability that six of ten rows reach, in whole hundredths."""
    return scored.groupBy("refresh_id").agg((F.floor(F.percentile("probability", F.lit(0.4)) * 100) / 100).alias("threshold"))


@register("diversified_select", "SELECT decision, pick, symbol, max_corr FROM (" + greedy_sql("cand_w", "roll", [0.2], 12, 5, 20) + ")", ["cand_w", "roll"], six("max_corr"))
def _(spark, sf):
    """Candidates of every week thinned to weakly correlated names."""
    bars = cut(I.bars_w(spark, sf))
    df = scored_weekly(spark, sf, bars).where("probability >= 0.6")
    rets = bars.select("date", "symbol", period_return("close", F.lag("close").over(by_symbol())).alias("ret"))
    return K.diversified_select(
        df.select(F.col("date").alias("decision"), "symbol", F.col("smooth_score").alias("score")),
        rets, sessions(bars), 0.2, 12, 5, lookback=63, min_obs=20)


def overlay_sql(rows) -> str:
    """Selected and sized rows of overlay scenarios."""
    text = lambda v: "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"
    values = ", ".join(f"('{s['scenario']}', {s['corr_cap']}::DOUBLE, {s['max_names']}, {s['market_floor']}::DOUBLE, {s['prob_floor']}::DOUBLE, {text(s['shift'])})" for s in rows)
    caps = sorted({s["corr_cap"] for s in rows})
    conf = "least(greatest((probability - threshold) / greatest(0.9 - threshold, 0.1), 0.0), 1.0)"
    ctx = "least(greatest((p - t) / (greatest(0.75, t + 0.1) - t), 0), 1)"
    return f"""
WITH o(scenario, cap, most, mfloor, pfloor, shift) AS (VALUES {values}
), picks AS MATERIALIZED ({greedy_sql("cand_o", "roll", caps, max(s["max_names"] for s in rows), 5, 31)}
), chosen AS (
  SELECT o.scenario, c.decision AS date, c.symbol, c.score, c.threshold, c.probability, c.regime, p.max_corr, shift,
    pfloor + (1 - pfloor) * pow({conf}, 1.25) AS probability_scale, vol_20d,
    CASE WHEN market_vol IS NULL OR market_vol = 0 OR ref IS NULL THEN 1.0 ELSE greatest(mfloor, least(ref / market_vol, 1.0)) END AS market_risk_scale,
    quantile_cont(vol_20d, 0.5) OVER (PARTITION BY o.scenario, c.decision) AS med
  FROM o JOIN picks p ON p.cap = o.cap AND p.pick < o.most JOIN cand_o c ON c.decision = p.decision AND c.symbol = p.symbol JOIN mrs1 m ON m.date = c.decision
), sized AS (
  SELECT *, CASE WHEN med > 0 THEN CASE WHEN vol_20d > 0 THEN least(greatest(sqrt(least(greatest(med / vol_20d, 0.1225), 1)), 0.35), 1) ELSE 1.0 END ELSE 1.0 END AS vol_scale FROM chosen
), floors AS (
  SELECT scenario, date, any_value(shift) AS shift, CASE mode(regime ORDER BY regime) WHEN 'RISK_OFF' THEN 0.25 WHEN 'HIGH_VOL' THEN 0.30 WHEN 'TREND_UP' THEN 0.55 ELSE 0.45 END AS base,
    quantile_cont(threshold, 0.5)::DOUBLE AS t, avg(probability) AS p, quantile_cont(market_risk_scale, 0.5) AS m FROM (SELECT * FROM sized ORDER BY regime) GROUP BY 1, 2
), target AS (
  SELECT scenario, date, least(greatest(fl + (0.95 - fl) * (0.5 * m + 0.5 * {ctx}), fl), 0.95) AS target_gross
  FROM (SELECT *, least(greatest(base + shift, 0.10), 0.80) AS fl FROM floors WHERE shift IS NOT NULL)
), raw1 AS (SELECT s.*, target_gross, probability_scale * vol_scale AS raw0 FROM sized s LEFT JOIN target g USING (scenario, date)
), raw2 AS (SELECT *, least(greatest(CASE WHEN avg(raw0) OVER w <= 1e-9 THEN 1.0 ELSE raw0 END, 0.02), 1) AS raw FROM raw1 WINDOW w AS (PARTITION BY scenario, date)
), moved AS (SELECT *, least(greatest(raw / avg(raw) OVER w * target_gross, 0.02), 1) AS sc FROM raw2 WINDOW w AS (PARTITION BY scenario, date)
), last AS (SELECT *, avg(sc) OVER (PARTITION BY scenario, date) AS ms FROM moved)
SELECT scenario, date, symbol, score AS trade_score, threshold, max_corr, probability_scale, vol_scale, market_risk_scale,
  CASE WHEN shift IS NULL THEN least(greatest(probability_scale * vol_scale * market_risk_scale, 0), 1)
    WHEN ms < target_gross THEN least(greatest(sc * target_gross / ms, 0.02), 1) ELSE sc END AS position_scale FROM last"""


cte("mrs1", """SELECT date, market_vol, CASE WHEN count(market_vol) OVER p >= 60 THEN quantile_cont(market_vol, 0.5) OVER p END AS ref
FROM (SELECT *, CASE WHEN count(market_ret) OVER w = 20 THEN stddev_samp(market_ret) OVER w * sqrt(252) END AS market_vol
      FROM mrs0 WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)) WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ["mrs0"])
OVERLAY_NEEDS = ["cand_o", "roll", "mrs1"]
OVERLAY_OUT = ["probability_scale", "vol_scale", "market_risk_scale", "position_scale"]
_SINGLE = [dict(scenario="one", corr_cap=0.85, max_names=12, market_floor=0.45, prob_floor=0.10, shift=None)]


@register("risk_overlay", "SELECT * EXCLUDE (scenario) FROM (" + overlay_sql(_SINGLE) + ")", OVERLAY_NEEDS, six("trade_score", "max_corr", *OVERLAY_OUT))
def _(spark, sf):
    bars = cut(I.bars_w(spark, sf))
    scored = cut(scored_weekly(spark, sf, bars))
    out = risk_overlay(scored, thresholds(scored), bars, cal=sessions(bars))
    return out.select("date", "symbol", "trade_score", "threshold", "max_corr", *OVERLAY_OUT)


@register("risk_overlays", "SELECT scenario, date, symbol, max_corr, position_scale FROM (" + overlay_sql(OVERLAYS) + ")", OVERLAY_NEEDS, six("max_corr", "position_scale"))
def _(spark, sf):
    """All stress rows of the overlay at once."""
    bars = cut(I.bars_w(spark, sf))
    scored = cut(scored_weekly(spark, sf, bars))
    return risk_overlays(scored, thresholds(scored), bars, OVERLAYS, cal=sessions(bars)).select("scenario", "date", "symbol", "max_corr", "position_scale")


cte("ovl", overlay_sql(OVERLAYS), OVERLAY_NEEDS)
cte("scen_o", scen_sql(OVERLAYS))
cte("rk_o", """SELECT scenario, date, symbol, trade_score AS score, row_number() OVER (PARTITION BY scenario, date ORDER BY trade_score DESC, symbol) AS rank,
  count(*) OVER (PARTITION BY scenario, date) AS candidates, position_scale AS scale FROM ovl""", ["ovl"])
chain("_o", """SELECT r.*, s.* EXCLUDE (scenario), 'LONG' AS side, lg, sg FROM rk_o r JOIN scen_o c ON c.scenario = r.scenario AND candidates >= mn
JOIN sched_o s ON s.scenario = r.scenario AND s.signal_date = r.date""", ["rk_o", "scen", "sched"])


@register("stress_matrix", "SELECT * FROM metrics UNION ALL BY NAME SELECT * FROM metrics_o", ["metrics", "metrics_o"], six(*PERF, "avg_turnover"))
def _(spark, sf):
    """Portfolio scenarios and overlay scenarios as rows of one plan."""
    bars = cut(I.bars_w(spark, sf))
    scored = cut(scored_weekly(spark, sf, bars))
    rows = risk_overlays(scored, thresholds(scored), bars, OVERLAYS, cal=sessions(bars))
    return stress_matrix(I.panel_w(spark, sf, bars), bars, "score", SCENARIOS, universe=I.universe_size(spark, sf), overlay=rows, overlays=OVERLAYS)


# --- all presets -----------------------------------------------------------------------------

PAIR = [row | dict(scenario=name, shift=shift) for row, name, shift in ((OVERLAYS[0], "v7", None), (OVERLAYS[0], "v71", 0.0))]
_P_RANKS = ("ret_20d", "ret_60d", "momentum_12_1", "trend_50", "dollar_volume")
cte("preset_ranks", "SELECT *, " + ", ".join(f"{I.pct_sql(c)} AS {c}_rank" for c in _P_RANKS) + """ FROM (
  SELECT *, ret_60d - ret_20d AS momentum_12_1 FROM (
    SELECT date, symbol, close / lag(close, 20) OVER w - 1 AS ret_20d, close / lag(close, 60) OVER w - 1 AS ret_60d, close * volume AS dollar_volume,
      CASE WHEN count(close) OVER w50 = 50 THEN close / avg(close) OVER w50 - 1 END AS trend_50
    FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY date), w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)))""", ["bars_w"])
_LO = " + ".join(f"{w} * coalesce({'dollar_volume_rank' if c == 'liquidity_rank' else c}, 0.5)" if c in ("momentum_12_1_rank", "ret_60d_rank", "ret_20d_rank", "trend_50_rank", "liquidity_rank")
                 else f"{w} * 0.5" for c, w in LONG_ONLY_WEIGHTS.items())
_C = "least(greatest((probability - 0.6) / greatest(0.9 - 0.6, 0.1), 0.0), 1.0)"
cte("pair", overlay_sql(PAIR), OVERLAY_NEEDS)
cte("rk_p", f"""SELECT *, row_number() OVER (PARTITION BY scenario, date ORDER BY round(score, 12) DESC, symbol) AS rank, count(*) OVER (PARTITION BY scenario, date) AS candidates FROM (
SELECT 'base' AS scenario, date, symbol, 0.5 * ret_20d_rank + 0.5 * momentum_12_1_rank AS score, 1.0::DOUBLE AS scale FROM preset_ranks
UNION ALL SELECT 'momentum', date, symbol, momentum_12_1_rank, 1.0 FROM preset_ranks
UNION ALL SELECT 'adaptive', date, symbol, 0.5 * ret_20d_rank + 0.5 * dollar_volume_rank, 1.0 FROM preset_ranks
UNION ALL SELECT 'long_only', date, symbol, {_LO}, 1.0 FROM preset_ranks
UNION ALL SELECT 'model', date, symbol, ret_60d_rank, 1.0 FROM preset_ranks
UNION ALL SELECT 'v5', date, symbol, score, 0.25 + 0.75 * {_C} FROM scored_w WHERE probability >= 0.6
UNION ALL SELECT 'v6', date, symbol, score, 0.10 + 0.90 * pow({_C}, 1.25) FROM scored_w WHERE probability >= 0.6
UNION ALL SELECT scenario, date, symbol, trade_score, position_scale FROM pair) WHERE score IS NOT NULL""", ["preset_ranks", "scored_w", "pair"])
cte("scen_p", scen_sql(PRESET_ROWS))
chain("_p", band_sql("rk_p", "r.date = signal_date AND r.scenario = scen_p.scenario"), ["rk_p", "sched", "scen"])


def preset_panels(spark, sf, bars):
    """A panel per preset: rank scores, sized scores, and the overlay's picks."""
    df = T.sma_trend(T.returns_n(bars, [20, 60]), [50]).withColumns({
        "momentum_12_1": F.col("ret_60d") - F.col("ret_20d"), "dollar_volume": F.col("close") * F.col("volume")})
    ranked = pct_rank(df, list(_P_RANKS), universe=I.universe_size(spark, sf)).withColumns({
        "liquidity_rank": F.col("dollar_volume_rank"), "trend_200_rank": F.lit(None).cast("double"), "fundamental_raw_rank": F.lit(None).cast("double"),
        "meta_score": F.round(0.5 * F.col("ret_20d_rank") + 0.5 * F.col("momentum_12_1_rank"), 12),
        "adaptive_score": F.round(0.5 * F.col("ret_20d_rank") + 0.5 * F.col("dollar_volume_rank"), 12), "model_score": F.col("ret_60d_rank")})
    ranked = cut(ranked)
    scored = cut(scored_weekly(spark, sf, bars))
    sized = scored.where("probability >= 0.6").withColumns({"trade_score": F.col("smooth_score"), "threshold": F.lit(0.6)})
    pair = risk_overlays(scored, thresholds(scored), bars, PAIR, cal=sessions(bars))
    panels = dict.fromkeys(("base", "momentum", "adaptive", "long_only", "model"), ranked)
    for v in ("v5", "v6"):
        panels[v] = K.prob_sizing(sized, v, prob="probability", out="position_scale")
    for v in ("v7", "v71"):
        panels[v] = pair.where(F.col("scenario") == v).drop("scenario", "threshold")
    return panels


@register("run_presets", "SELECT * FROM perf_p JOIN (SELECT scenario, avg(turnover) AS avg_turnover, count(*) AS rebalance_count FROM net_p GROUP BY 1) USING (scenario)",
          ["perf_p", "net_p"], six(*PERF, "avg_turnover"))
def _(spark, sf):
    """The nine presets, each with its own score, counts, band and sizing, as rows of one plan."""
    bars = cut(I.bars_w(spark, sf))
    rows = {s["scenario"]: {k: s[k] for k in ("warmup_days", "rebalance_days", "long_gross", "short_gross")} for s in PRESET_ROWS}
    return run_presets(preset_panels(spark, sf, bars), bars, I.universe_size(spark, sf), overrides=rows)
