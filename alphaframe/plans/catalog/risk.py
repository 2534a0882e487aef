"""Correlation, diversification, sizing and exposure on the weekly panel."""

from pyspark.sql import functions as F

from ...functions import by_symbol, period_return
from ...operators import portfolio as P
from ...operators import risk as K
from ...operators import technical as T
from ...operators.calendar import sessions
from ...operators.metrics import signal_context
from ...operators.ranks import top_bottom_k

from ..materialize import cut
from . import inputs as I
from .base import cte, register, six
from .portfolio import BASE, LG, SG

cte("pw", "SELECT scenario, signal_date AS decision, symbol, weight FROM wts WHERE scenario = 'base'", ["wts"])
cte("trail", """SELECT decision, c.date FROM (SELECT DISTINCT decision, d.idx AS di FROM pw JOIN cal_w d ON d.date = decision)
JOIN cal_w c ON c.idx BETWEEN di - 62 AND di""", ["pw", "cal_w"])
cte("obs", """SELECT p.decision, p.symbol, weight, t.date, ret_1d AS ret FROM pw p JOIN trail d ON d.decision = p.decision
JOIN tech_w t ON t.date = d.date AND t.symbol = p.symbol WHERE ret_1d IS NOT NULL""", ["pw", "trail", "tech_w"])
cte("pairs", """
SELECT decision, a, b, n, round(cv / (sx * sy), 12) AS corr FROM (
  SELECT x.decision, x.symbol AS a, y.symbol AS b, count(*) AS n, covar_pop(x.ret, y.ret) AS cv,
    stddev_pop(x.ret) AS sx, stddev_pop(y.ret) AS sy
  FROM obs x JOIN obs y ON x.decision = y.decision AND x.date = y.date AND x.symbol < y.symbol GROUP BY 1, 2, 3)
WHERE n >= 20 AND sx * sy > 0""", ["obs"])


def weekly(spark, sf):
    """Stored weekly bars, their returns, and the base portfolio per decision date."""
    bars = cut(I.bars_w(spark, sf))
    sched = P.schedules(sessions(bars), BASE)
    sel = P.select_names(I.panel_w(spark, sf, bars), "score", sched, BASE, I.universe_size(spark, sf))
    w = P.target_weights(sel, LG, SG).select(F.col("signal_date").alias("decision"), "symbol", "weight")
    rets = bars.select("date", "symbol", period_return("close", F.lag("close").over(by_symbol())).alias("ret"))
    return cut(w), rets, sessions(bars)


@register("pairwise_corr", "SELECT * FROM pairs", ["pairs"], six("corr"))
def _(spark, sf):
    return K.pairwise_corr(*weekly(spark, sf))


@register("rolling_portfolio_vol", """
SELECT v.*, avg_pair_corr, max_pair_corr FROM (
  SELECT t.decision, count(*) AS sessions, CASE WHEN count(*) >= 10 THEN stddev_samp(coalesce(r, 0)) * sqrt(252) END AS portfolio_vol
  FROM trail t LEFT JOIN (SELECT decision, date, sum(weight * ret) AS r FROM obs GROUP BY 1, 2) o
    ON o.decision = t.decision AND o.date = t.date GROUP BY 1) v
LEFT JOIN (SELECT decision, avg(corr) AS avg_pair_corr, max(corr) AS max_pair_corr FROM pairs GROUP BY 1) p ON p.decision = v.decision""",
          ["trail", "obs", "pairs"], six("portfolio_vol", "avg_pair_corr", "max_pair_corr"))
def _(spark, sf):
    return K.rolling_portfolio_vol(*weekly(spark, sf))


# The classifier's probability is stood in for by a hash-like mix of symbol and session.
_PROB = "0.5 + 0.45 * ((CAST(r.symbol AS BIGINT) * 37 + idx * 11) % 101) / 101.0"
cte("ov0", f"""SELECT r.date, r.symbol, score, {_PROB} AS probability, 0.6 AS threshold,
  CASE idx % 5 WHEN 0 THEN 'RISK_OFF' WHEN 1 THEN 'HIGH_VOL' WHEN 2 THEN 'TREND_UP' ELSE 'NEUTRAL' END AS regime,
  m.scale AS market_risk_scale, v.vol_20d FROM rk r JOIN cal_w USING (date) JOIN mrs m USING (date)
JOIN (SELECT date, symbol, CASE WHEN count(ret_1d) OVER w = 20 THEN stddev_samp(ret_1d) OVER w * sqrt(252) END AS vol_20d
      FROM tech_w WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) v ON v.date = r.date AND v.symbol = r.symbol
WHERE rank <= 12""", ["rk", "cal_w", "mrs", "tech_w"])
_CONF = "least(greatest((probability - threshold) / greatest(0.9 - threshold, 0.1), 0.0), 1.0)"
cte("ov1", f"""SELECT *, CASE WHEN probability >= threshold THEN 0.2 + 0.8 * pow({_CONF}, 1.25) ELSE 0 END AS probability_scale,
  quantile_cont(vol_20d, 0.5) OVER (PARTITION BY date) AS med FROM ov0""", ["ov0"])
cte("ov", """SELECT *, CASE WHEN med > 0 THEN CASE WHEN vol_20d > 0 THEN least(greatest(sqrt(least(greatest(med / vol_20d, 0.1225), 1)), 0.35), 1) ELSE 1.0 END ELSE 1.0 END
  AS vol_scale FROM ov1""", ["ov1"])


def overlay_rows(spark, sf):
    bars = cut(I.bars_w(spark, sf))
    df = T.rolling_vol(I.panel_w(spark, sf, bars), [20])
    df = top_bottom_k(df, "score", 12, min_names=0).join(sessions(bars), "date")
    df = df.join(T.market_risk_scale(bars).select("date", F.col("scale").alias("market_risk_scale")), "date")
    k = F.col("idx") % 5
    regime = F.when(k == 0, "RISK_OFF").when(k == 1, "HIGH_VOL").when(k == 2, "TREND_UP").otherwise("NEUTRAL")
    prob = 0.5 + 0.45 * ((F.col("symbol").cast("bigint") * 37 + F.col("idx") * 11) % 101) / 101.0
    df = df.withColumns({"probability": prob, "threshold": F.lit(0.6), "regime": regime})
    df = K.prob_sizing(df, "floor", 0.20, prob="probability", out="probability_scale")
    return K.vol_scaling(df)


@register("vol_scaling", """SELECT date, symbol, probability_scale, vol_scale,
  least(greatest(probability_scale * vol_scale * market_risk_scale, 0), 1) AS position_scale FROM ov""", ["ov"],
          six("probability_scale", "vol_scale", "position_scale"))
def _(spark, sf):
    return overlay_rows(spark, sf).select("date", "symbol", "probability_scale", "vol_scale", "position_scale")


@register("prob_sizing", f"""SELECT date, symbol, probability,
  CASE WHEN probability >= threshold THEN 0.25 + 0.75 * {_CONF} ELSE 0 END AS v5,
  CASE WHEN probability >= threshold THEN 0.10 + 0.90 * pow({_CONF}, 1.25) ELSE 0 END AS v6,
  CASE WHEN probability >= threshold THEN 0.3 + 0.7 * pow({_CONF}, 1.25) ELSE 0 END AS floored FROM ov0""", ["ov0"],
          six("probability", "v5", "v6", "floored"))
def _(spark, sf):
    df = overlay_rows(spark, sf)
    df = K.prob_sizing(K.prob_sizing(df, "v5", prob="probability", out="v5"), "v6", prob="probability", out="v6")
    df = K.prob_sizing(df, "floor", 0.3, prob="probability", out="floored")
    return df.select("date", "symbol", "probability", "v5", "v6", "floored")


cte("bx0", """SELECT *, least(greatest(fl + (0.95 - fl) * (0.5 * m + 0.5 * least(greatest((p - t) / (greatest(0.75, t + 0.1) - t), 0), 1)), fl), 0.95) AS target_gross
FROM (SELECT date, CASE any_value(regime) WHEN 'RISK_OFF' THEN 0.25 WHEN 'HIGH_VOL' THEN 0.30 WHEN 'TREND_UP' THEN 0.55 ELSE 0.45 END + 0.1 AS fl,
  quantile_cont(threshold, 0.5)::DOUBLE AS t, avg(probability) AS p, quantile_cont(market_risk_scale, 0.5) AS m FROM ov GROUP BY date)""", ["ov"])
cte("bx1", """SELECT date, symbol, target_gross, least(greatest(CASE WHEN avg(raw) OVER (PARTITION BY date) <= 1e-9 THEN 1.0 ELSE raw END, 0.02), 1) AS raw
FROM (SELECT o.date, symbol, target_gross, probability_scale * vol_scale AS raw FROM ov o JOIN bx0 b ON o.date = b.date)""", ["ov", "bx0"])
cte("bx2", "SELECT *, least(greatest(raw / avg(raw) OVER (PARTITION BY date) * target_gross, 0.02), 1) AS sc FROM bx1", ["bx1"])
cte("bx", """SELECT date, symbol, target_gross, CASE WHEN ms < target_gross THEN least(greatest(sc * target_gross / ms, 0.02), 1) ELSE sc END AS balanced_scale
FROM (SELECT *, avg(sc) OVER (PARTITION BY date) AS ms FROM bx2)""", ["bx2"])


@register("balanced_exposure", "SELECT * FROM bx", ["bx"], six("target_gross", "balanced_scale"))
def _(spark, sf):
    return K.balanced_exposure(overlay_rows(spark, sf), 0.1).select("date", "symbol", "target_gross", "balanced_scale")


@register("overlay_summary", """
SELECT avg(n) AS mean_selected_names, avg(s) AS mean_position_scale, avg(g) AS mean_target_gross, count(*) AS decision_dates,
  arg_max(n, date) AS latest_names, arg_max(g, date) AS latest_target_gross
FROM (SELECT date, count(*) AS n, avg(balanced_scale) AS s, max(target_gross) AS g FROM bx GROUP BY date)""", ["bx"],
          six("mean_selected_names", "mean_position_scale", "mean_target_gross", "latest_target_gross"))
def _(spark, sf):
    return K.overlay_summary(K.balanced_exposure(overlay_rows(spark, sf), 0.1))


@register("signal_context", """SELECT date, avg(probability) AS avg_meta_probability, 0.6::DOUBLE AS meta_threshold, any_value(regime) AS regime,
  avg(score) AS avg_signal_score FROM ov GROUP BY date""", ["ov"], six("avg_meta_probability", "meta_threshold", "avg_signal_score"))
def _(spark, sf):
    return signal_context(overlay_rows(spark, sf), "probability", "threshold", "regime", "score")
