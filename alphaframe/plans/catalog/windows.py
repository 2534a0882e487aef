"""Per-symbol and per-date features."""

from pyspark.sql import functions as F

from ...operators import technical as T
from ...operators.ranks import first_rank_filter, pct_rank, quantile_bins, row_numbers
from . import inputs as I
from .base import cte, register, six

RETS = ["ret_1d", "ret_5d", "ret_20d", "ret_60d", "ret_120d", "ret_252d"]


@register("resample_bars", "SELECT * FROM bars", ["bars"], six("open", "high", "low", "close", "vwap"))
def _(spark, sf):
    return I.bars(spark, sf)


@register("returns_n", f"SELECT date, symbol, {', '.join(RETS)} FROM tech", ["tech"], six(*RETS))
def _(spark, sf):
    return T.returns_n(I.bars(spark, sf), [1, 5, 20, 60, 120, 252]).select("date", "symbol", *RETS)


@register("momentum_12_1", "SELECT date, symbol, momentum_12_1 FROM tech", ["tech"], six("momentum_12_1"))
def _(spark, sf):
    return T.momentum_12_1(T.returns_n(I.bars(spark, sf), [20, 252])).select("date", "symbol", "momentum_12_1")


@register("rolling_vol", "SELECT date, symbol, vol_20d, vol_60d FROM tech", ["tech"], six("vol_20d", "vol_60d"))
def _(spark, sf):
    df = T.rolling_vol(T.returns_n(I.bars(spark, sf), [1]), [20, 60])
    return df.select("date", "symbol", "vol_20d", "vol_60d")


@register("sma_trend", "SELECT date, symbol, trend_50, trend_200 FROM tech", ["tech"], six("trend_50", "trend_200"))
def _(spark, sf):
    return T.sma_trend(I.bars(spark, sf), [50, 200]).select("date", "symbol", "trend_50", "trend_200")


@register("rolling_median_dv", "SELECT date, symbol, median_dollar_volume_60 FROM tech", ["tech"],
          six("median_dollar_volume_60"))
def _(spark, sf):
    df = I.bars(spark, sf).withColumn("dollar_volume", F.col("close") * F.col("volume"))
    return T.rolling_median_dv(df).select("date", "symbol", "median_dollar_volume_60")


@register("sessions_to_date", "SELECT date, symbol, history_sessions_to_date FROM tech", ["tech"])
def _(spark, sf):
    return T.sessions_to_date(I.bars(spark, sf)).select("date", "symbol", "history_sessions_to_date")


@register("pct_rank", f"""SELECT date, symbol, {I.pct_sql('ret_20d')} AS ret_20d_rank,
  1 - {I.pct_sql('vol_20d')} AS low_vol_rank FROM tech""", ["tech"], six("ret_20d_rank", "low_vol_rank"))
def _(spark, sf):
    df = T.rolling_vol(T.returns_n(I.bars(spark, sf), [1, 20]), [20])
    df = pct_rank(df, {"ret_20d": "ret_20d_rank", "vol_20d": "low_vol_rank"}, invert=["low_vol_rank"],
                  universe=I.widest_session(spark, sf))
    return df.select("date", "symbol", "ret_20d_rank", "low_vol_rank")


@register("forward_return", "SELECT date, symbol, future_20d, future_relative_20d FROM tech", ["tech"],
          six("future_20d", "future_relative_20d"))
def _(spark, sf):
    return T.forward_return(I.bars(spark, sf), universe=I.widest_session(spark, sf)).select("date", "symbol", "future_20d", "future_relative_20d")


@register("execution_target", """
SELECT date, symbol, f AS future_open_return, f - avg(f) OVER (PARTITION BY date) AS future_relative_open
FROM (SELECT date, symbol, lead(open, 11) OVER w / lead(open, 1) OVER w - 1 AS f
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))""", ["bars"],
          six("future_open_return", "future_relative_open"))
def _(spark, sf):
    df = T.execution_target(I.bars(spark, sf), universe=I.widest_session(spark, sf))
    return df.select("date", "symbol", "future_open_return", "future_relative_open")


# --- date-level context -------------------------------------------------------------------

cte("ctx0", """
SELECT date, avg(ret_20d) AS market_ret_20, quantile_cont(vol_20d, 0.5) AS market_vol_20,
  stddev_samp(ret_20d) AS market_dispersion_20,
  avg(CASE WHEN ret_20d > 0 THEN 1.0 ELSE 0.0 END) AS market_breadth_20,
  avg(CASE WHEN trend_200 > 0 THEN 1.0 ELSE 0.0 END) AS market_trend_breadth
FROM tech GROUP BY date""", ["tech"])
cte("ctx", f"""
SELECT *, CASE WHEN market_ret_20 < {I.RISK_OFF} THEN 'RISK_OFF'
  WHEN market_vol_20 > vol_reference * 1.25 THEN 'HIGH_VOL'
  WHEN market_ret_20 > {I.TREND_UP} THEN 'TREND_UP' ELSE 'NEUTRAL' END AS regime
FROM (SELECT *, CASE WHEN count(market_vol_20) OVER w >= 60 THEN quantile_cont(market_vol_20, 0.5) OVER w END
    AS vol_reference FROM ctx0
  WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", ["ctx0"])
CTX = ["market_ret_20", "market_vol_20", "market_dispersion_20", "market_breadth_20", "market_trend_breadth"]


def tech_df(spark, sf):
    return T.technical(I.bars(spark, sf))


def context(spark, sf):
    df = T.rolling_vol(T.returns_n(I.bars(spark, sf), [1, 20]), [20])
    ctx = T.vol_reference(T.market_context(T.sma_trend(df, [200]), I.widest_session(spark, sf)))
    return T.classify_regime(ctx, I.RISK_OFF, I.TREND_UP)


@register("market_context", f"SELECT date, {', '.join(CTX)} FROM ctx", ["ctx"], six(*CTX))
def _(spark, sf):
    return context(spark, sf).select("date", *CTX)


@register("vol_reference", "SELECT date, vol_reference FROM ctx", ["ctx"], six("vol_reference"))
def _(spark, sf):
    return context(spark, sf).select("date", "vol_reference")


@register("classify_regime", "SELECT date, regime FROM ctx", ["ctx"])
def _(spark, sf):
    return context(spark, sf).select("date", "regime")


@register("attach_context", "SELECT t.date, symbol, regime, market_ret_20 FROM tech t LEFT JOIN ctx c ON t.date = c.date",
          ["ctx"], six("market_ret_20"))
def _(spark, sf):
    ctx = context(spark, sf).select("date", "regime", "market_ret_20")
    return I.bars(spark, sf).select("date", "symbol").join(ctx, "date", "left")


cte("mrs0", """
SELECT date, avg(ret_1d) AS market_ret FROM tech_w GROUP BY date""", ["tech_w"])
cte("mrs", """
SELECT date, market_ret, market_vol, CASE WHEN ref / nullif(market_vol, 0) IS NULL THEN 1.0
  ELSE least(greatest(ref / market_vol, 0.45), 1.0) END AS scale
FROM (SELECT *, CASE WHEN count(market_vol) OVER p >= 60 THEN quantile_cont(market_vol, 0.5) OVER p END AS ref
  FROM (SELECT *, CASE WHEN count(market_ret) OVER w = 20 THEN stddev_samp(market_ret) OVER w * sqrt(252) END AS market_vol
        FROM mrs0 WINDOW w AS (ORDER BY date ROWS 19 PRECEDING))
  WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", ["mrs0"])


@register("market_risk_scale", "SELECT * FROM mrs", ["mrs"], six("market_ret", "market_vol", "scale"))
def _(spark, sf):
    return T.market_risk_scale(I.bars_w(spark, sf))


SPANS = (5, 20, 60)


@register("ewma_score", f"""
SELECT b.date, b.symbol, score, {", ".join(f"s{k} AS smooth_{k}" for k in SPANS)} FROM panel_w b LEFT JOIN (
  WITH RECURSIVE known AS (
    SELECT symbol, date, score AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel_w WHERE score IS NOT NULL
  ), e AS (
    SELECT symbol, date, i, {", ".join(f"x AS s{k}" for k in SPANS)} FROM known WHERE i = 1
    UNION ALL
    SELECT k.symbol, k.date, k.i, {", ".join(f"x * (2.0 / {k + 1}) + s{k} * (1 - 2.0 / {k + 1})" for k in SPANS)}
    FROM e JOIN known k ON k.symbol = e.symbol AND k.i = e.i + 1
  ) SELECT * FROM e) q
ON b.symbol = q.symbol AND b.date = q.date""", ["panel_w"], six("score", *(f"smooth_{k}" for k in SPANS)))
def _(spark, sf):
    df = I.panel_w(spark, sf).select("date", "symbol", "score")
    for k in SPANS:
        df = T.ewma_score(df, "score", k, out=f"smooth_{k}")
    return df


@register("eps_change", "SELECT date, symbol, earnings_raw FROM pit", ["pit"], six("earnings_raw"))
def _(spark, sf):
    return I.pit(spark, sf).select("date", "symbol", "earnings_raw")


@register("quantile_bins", """
SELECT date, symbol, CAST(greatest(0, coalesce(ceil((r - 1) * 5.0 / nullif(n - 1, 0)) - 1, 0)) AS INT) AS bin
FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY ret_20d, symbol) AS r,
        count(*) OVER (PARTITION BY date) AS n FROM tech WHERE ret_20d IS NOT NULL)""", ["tech"])
def _(spark, sf):
    return quantile_bins(T.returns_n(I.bars(spark, sf), [20]), "ret_20d", universe=I.widest_session(spark, sf)).select("date", "symbol", "bin")


@register("band_membership", """
SELECT date, symbol, rank, coalesce(last_value(CASE WHEN rank <= 20 THEN TRUE WHEN rank > 30 THEN FALSE END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), FALSE) AS held
FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank
      FROM panel_w WHERE score IS NOT NULL)""", ["panel_w"])
def _(spark, sf):
    df = I.panel_w(spark, sf).where("score is not null").select("date", "symbol", "score")
    df = row_numbers(df, F.col("score"), ["date"], "symbol", "rank", I.universe_size(spark, sf)).drop("score")
    return T.band_membership(df, 20, 10)


@register("first_rank_filter", """
SELECT date, symbol, accepted, CASE WHEN accepted THEN rn END AS selected_rank,
  coalesce(accepted AND rn <= 8, FALSE) AS selected
FROM (SELECT date, symbol, accepted, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN accepted THEN score END
        DESC NULLS LAST, symbol) AS rn
      FROM (SELECT date, symbol, score, ret_1d > 0 AS accepted FROM panel_w WHERE score IS NOT NULL AND ret_1d IS NOT NULL))""",
          ["panel_w"])
def _(spark, sf):
    df = I.panel_w(spark, sf).where("score is not null and ret_1d is not null")
    df = df.withColumn("accepted", F.col("ret_1d") > 0)
    return first_rank_filter(df, "score", "accepted", 8, universe=I.universe_size(spark, sf)).select("date", "symbol", "accepted", "selected_rank", "selected")
