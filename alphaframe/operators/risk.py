"""Correlation, diversification, volatility scaling and exposure overlays.

Inputs keyed by ``decision`` are the names chosen or proposed on a decision date.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, finite, ratio
from .calendar import trailing_sessions
from .correlation import BLOCK, block_pairs, greedy_picks
from .technical import ANNUAL


def trailing_returns(names: DataFrame, rets: DataFrame, cal: DataFrame, lookback: int) -> DataFrame:
    """(decision, symbol, date, ret): known returns of the named symbols over their trailing sessions."""
    days = trailing_sessions(names, cal, lookback)
    wanted = names.select("decision", "symbol").distinct().join(days, "decision")
    known = rets.where(F.col("ret").isNotNull()).select("date", "symbol", "ret")
    return wanted.join(known, ["date", "symbol"])


def pairwise_corr(
    names: DataFrame, rets: DataFrame, cal: DataFrame, lookback: int = 63, min_obs: int = 20, block: int = BLOCK,
) -> DataFrame:
    """(decision, a, b, corr, n) with a < b over the sessions both have a return, by products of blocks of names."""
    return block_pairs(names, rets, cal, lookback, min_obs, block)


def rolling_portfolio_vol(
    weights: DataFrame, rets: DataFrame, cal: DataFrame, lookback: int = 63, need: int = 10, min_obs: int = 20,
) -> DataFrame:
    """Per decision: deviation of the weighted return over the trailing sessions (a missing
    return counts 0), and mean and largest pair correlation of the held names."""
    held = trailing_returns(weights, rets, cal, lookback).join(
        weights.select("decision", "symbol", "weight"), ["decision", "symbol"])
    daily = held.groupBy("decision", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("_r"))
    all_days = trailing_sessions(weights, cal, lookback).join(daily, ["decision", "date"], "left")
    vol = all_days.groupBy("decision").agg(
        F.count("*").alias("sessions"),
        F.when(F.count("*") >= F.lit(need), F.stddev_samp(F.coalesce("_r", F.lit(0.0))) * F.lit(ANNUAL))
        .alias("portfolio_vol"),
    )
    pairs = pairwise_corr(weights, rets, cal, lookback, min_obs).groupBy("decision").agg(
        F.avg("corr").alias("avg_pair_corr"), F.max("corr").alias("max_pair_corr"))
    return vol.join(pairs, "decision", "left")


def diversified_select(
    cands: DataFrame, rets: DataFrame, cal: DataFrame, cap: float, max_names: int, min_names: int,
    cut: Callable[[DataFrame], DataFrame] | None = None, lookback: int = 63, min_obs: int = 31, block: int = BLOCK,
) -> DataFrame:
    """Greedy choice per decision in score order: a name joins unless its largest correlation
    with the names already chosen exceeds ``cap`` (no common history counts 0).

    A decision that ends below ``min_names`` is filled up with its least correlated rejects. One pass
    over the candidates, whatever their number; see ``greedy_picks``.
    """
    picks = greedy_picks(cands, rets, cal, [cap], max_names, min_names, lookback, min_obs, block, cut)
    return picks.select("decision", "pick", "symbol", "max_corr")


def diversified_scenarios(
    cands: DataFrame, rets: DataFrame, cal: DataFrame, scenarios: Sequence[Mapping], min_names: int, lookback: int = 63, min_obs: int = 31,
) -> DataFrame:
    """``diversified_select`` for many (scenario, corr_cap, max_names) at once.

    The choice under a lower limit is the start of that under a higher one, so only different caps are walked.
    """
    caps = sorted({float(s["corr_cap"]) for s in scenarios})
    picks = greedy_picks(cands, rets, cal, caps, max(int(s["max_names"]) for s in scenarios), min_names, lookback, min_obs)
    wanted = F.array(*[F.struct(F.lit(s["scenario"]).alias("scenario"), F.lit(float(s["corr_cap"])).alias("of"), F.lit(int(s["max_names"])).alias("most"))
                       for s in scenarios])
    rows = picks.withColumn("_s", F.explode(wanted)).where((F.col("_s.of") == F.col("cap")) & (F.col("pick") < F.col("_s.most")))
    return rows.select("_s.scenario", "decision", "pick", "symbol", "max_corr")


# --- sizing --------------------------------------------------------------------------------


def _keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def prob_sizing(df: DataFrame, variant: str = "v5", floor: float | Column = 0.10, prob: str = "prob", threshold: str = "threshold", out: str = "size") -> DataFrame:
    """Size from calibrated probability: 0 below the threshold, rising with confidence above.

    v5: .25 + .75 c; v6: .10 + .90 c^1.25; floor: f + (1 - f) c^1.25.
    """
    p, t = F.col(prob), F.col(threshold)
    conf = clip((p - t) / F.greatest(F.lit(0.90) - t, F.lit(0.10)), 0.0, 1.0)
    if variant == "v5":
        size = F.lit(0.25) + F.lit(0.75) * conf
    else:
        f = clip(F.lit(0.10) if variant == "v6" else floor if isinstance(floor, Column) else F.lit(float(floor)), 0.0, 0.95)
        size = f + (F.lit(1.0) - f) * F.pow(conf, F.lit(1.25))
    return df.withColumn(out, F.when(p >= t, size).otherwise(F.lit(0.0)))


def vol_scaling(sel: DataFrame, by: str | Sequence[str] = "date", vol: str = "vol_20d") -> DataFrame:
    """Root of (median / own) volatility, between .35 and 1, times probability and market scale."""
    v = finite(vol)
    median = F.percentile(v, F.lit(0.5)).over(Window.partitionBy(*_keys(by)))
    own = F.when(v > 0, v)
    root = F.coalesce(F.sqrt(clip(ratio("_median", own), 0.1225, 1.0)), F.lit(1.0))
    scale = F.when(F.col("_median") > 0, clip(root, 0.35, 1.0)).otherwise(F.lit(1.0))
    return sel.withColumn("_median", median).withColumn("vol_scale", scale).withColumn(
        "position_scale",
        clip(F.col("probability_scale") * F.col("vol_scale") * F.col("market_risk_scale"), 0.0, 1.0),
    ).drop("_median")


# Fixed values of the exposure target.
REGIME_FLOORS = {"TREND_UP": 0.55, "NEUTRAL": 0.45, "HIGH_VOL": 0.30, "RISK_OFF": 0.25}
CONFIDENCE_CEILING, MAX_TARGET_GROSS = 0.75, 0.95
MARKET_WEIGHT, CONFIDENCE_WEIGHT = 0.50, 0.50


def balanced_exposure(
    df: DataFrame, shift: float | Column = 0.0, by: str | Sequence[str] = "date", floors: Mapping[str, float] = REGIME_FLOORS,
) -> DataFrame:
    """Position scales moved so that their mean meets a gross target of regime, market and confidence.

    Takes the selected rows of a date: probability, threshold, regime, market_risk_scale,
    probability_scale, vol_scale. Windows by date hold the selected names only.
    """
    by = _keys(by)
    w = Window.partitionBy(*by)
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    table = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))])
    ctx = df.groupBy(*by).agg(
        F.first(shift).alias("_shift"),
        F.coalesce(F.mode("regime", True), F.lit("NEUTRAL")).alias("_regime"),
        F.coalesce(F.percentile("threshold", F.lit(0.5)), F.lit(0.60)).alias("_t"),
        F.avg("probability").alias("_p"),
        F.coalesce(F.percentile("market_risk_scale", F.lit(0.5)), F.lit(1.0)).alias("_m"),
    )
    base = F.coalesce(F.try_element_at(table, F.col("_regime")), F.lit(floors["NEUTRAL"]))
    ceiling = F.greatest(F.lit(CONFIDENCE_CEILING), F.col("_t") + F.lit(0.10))
    conf = clip((F.coalesce("_p", "_t") - F.col("_t")) / (ceiling - F.col("_t")), 0.0, 1.0)
    quality = F.lit(MARKET_WEIGHT) * F.col("_m") + F.lit(CONFIDENCE_WEIGHT) * conf
    target = F.col("_floor") + (F.lit(MAX_TARGET_GROSS) - F.col("_floor")) * quality
    ctx = ctx.withColumn("_floor", clip(base + F.col("_shift"), 0.10, 0.80)).withColumn(
        "target_gross", F.greatest(F.col("_floor"), F.least(F.lit(MAX_TARGET_GROSS), target))
    ).select(*by, "target_gross")

    raw = F.coalesce("probability_scale", F.lit(0.0)) * F.coalesce("vol_scale", F.lit(1.0))
    out = df.join(ctx, by).withColumn("_raw", raw)
    out = out.withColumn("_raw", F.when(F.avg("_raw").over(w) <= F.lit(1e-9), F.lit(1.0)).otherwise(F.col("_raw")))
    out = out.withColumn("_raw", clip("_raw", 0.02, 1.0))
    mean = F.greatest(F.avg("_raw").over(w), F.lit(1e-9))
    out = out.withColumn("_scale", clip(F.col("_raw") / mean * F.col("target_gross"), 0.02, 1.0))
    out = out.withColumn("_mean", F.avg("_scale").over(w))
    again = clip(F.col("_scale") * F.col("target_gross") / F.col("_mean"), 0.02, 1.0)
    more = (F.col("_mean") > F.lit(1e-9)) & (F.col("_mean") < F.col("target_gross"))
    return out.withColumn("balanced_scale", F.when(more, again).otherwise(F.col("_scale"))).drop("_raw", "_scale", "_mean")


def overlay_summary(df: DataFrame, by: str = "date") -> DataFrame:
    """Means over decision dates of names, scale and target, and the newest date's values."""
    daily = df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("balanced_scale").alias("s"), F.max("target_gross").alias("g"))
    return daily.agg(
        F.avg("n").alias("mean_selected_names"), F.avg("s").alias("mean_position_scale"),
        F.avg("g").alias("mean_target_gross"), F.count("*").alias("decision_dates"),
        F.max_by("n", by).alias("latest_names"), F.max_by("g", by).alias("latest_target_gross"),
    )
