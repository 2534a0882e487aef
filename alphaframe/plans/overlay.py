"""Risk overlay on scored rows: diversification, then probability, volatility and market scaling.

The rows of a stress matrix differ in a cap, a limit or a floor. They are scenario rows of one plan: candidates
are found and walked once, picks carry a scenario, and the scales take their floors from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by_symbol, clip, period_return
from ..operators.calendar import sessions
from ..operators.portfolio import per_scenario
from ..operators.risk import balanced_exposure, diversified_scenarios, prob_sizing, vol_scaling
from ..operators.technical import market_vol_ratio
from .materialize import cut
from .strategy import COMMISSION_PLUS_SLIPPAGE_BPS, scenario

DEFAULT_THRESHOLD = 0.60
# Fixed values of the overlay: cap on correlation, limit of names, floors of the market and probability scales.
OVERLAY = dict(corr_cap=0.82, max_names=12, market_floor=0.45, prob_floor=0.10)


def overlay_scenario(name: str, shift: float | None = None, preset: str | None = None, **override) -> dict:
    """A portfolio scenario with the overlay's fields; with ``shift`` exposure is balanced towards a target moved by it."""
    own = {k: override.pop(k, v) for k, v in OVERLAY.items()}
    row = scenario(name, preset or ("v7" if shift is None else "v71"), **{"long_count": own["max_names"], **override})
    return row | own | {"shift": shift}


def overlay_stress_scenarios(**override) -> list[dict]:
    """Stress rows of the overlay (floors, caps, limits, costs) and of balanced exposure (floors, costs)."""
    c = COMMISSION_PLUS_SLIPPAGE_BPS
    rows = [
        ("base", {}), ("prob_floor_020", {"prob_floor": 0.20}), ("prob_floor_030", {"prob_floor": 0.30}), ("prob_floor_040", {"prob_floor": 0.40}),
        ("risk_floor_035", {"market_floor": 0.35}), ("risk_floor_055", {"market_floor": 0.55}), ("risk_floor_065", {"market_floor": 0.65}),
        ("corr_075", {"corr_cap": 0.75}), ("corr_090", {"corr_cap": 0.90}), ("max_10", {"max_names": 10}), ("max_15", {"max_names": 15}),
        ("cost_x2", {"cost_bps": 2 * c}), ("cost_x3", {"cost_bps": 3 * c}),
        ("balanced", {"shift": 0.0}), ("floor_minus_10", {"shift": -0.10}), ("floor_plus_10", {"shift": 0.10}),
        ("balanced_cost_x2", {"shift": 0.0, "cost_bps": 2 * c}), ("balanced_cost_x3", {"shift": 0.0, "cost_bps": 3 * c}),
    ]
    return [overlay_scenario(f"overlay_{n}", **override | o) for n, o in rows]


def risk_overlays(
    scored: DataFrame, thresholds: DataFrame, bars: DataFrame, scenarios: Sequence[Mapping], every: int = 10, min_names: int = 5,
    lookback: int = 63, cal: DataFrame | None = None,
) -> DataFrame:
    """Selected names of every scenario and decision date with their scales.

    ``scored``: date, symbol, smooth_score, probability, vol_20d, refresh_id (and regime where a scenario
    balances exposure); ``thresholds``: refresh_id, threshold. Decision dates are every ``every``-th session of ``cal`` (the scored dates by
    default; give the portfolio's calendar where rebalances have to meet them) and the last scored one.
    """
    cal = sessions(scored) if cal is None else cal
    last = F.max("idx").over(Window.partitionBy())
    decide = cal.join(scored.select("date").distinct(), "date", "left_semi").withColumn("_last", last).where(
        (F.col("idx") % F.lit(every) == 0) | (F.col("idx") == F.col("_last"))).select("date")
    rows = scored.join(decide, "date", "left_semi").join(thresholds, "refresh_id", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))
    cands = cut(rows.where((F.col("probability") >= F.col("threshold")) & F.col("smooth_score").isNotNull()))
    rets = bars.select("date", "symbol", period_return("close", F.lag("close").over(by_symbol())).alias("ret"))
    picks = diversified_scenarios(
        cands.select(F.col("date").alias("decision"), "symbol", F.col("smooth_score").alias("score")),
        rets, cal, scenarios, min_names, lookback, max(20, lookback // 2))
    market = market_vol_ratio(bars).select("date", "calm")
    chosen = cands.join(
        picks.select("scenario", F.col("decision").alias("date"), "symbol", "max_corr"), ["date", "symbol"]
    ).join(market, "date", "left")
    # A floor per scenario: the scale lies between it and 1.
    scale = F.greatest(per_scenario(scenarios, "market_floor"), clip("calm", 0.0, 1.0))
    chosen = chosen.withColumn("market_risk_scale", F.when(F.col("calm").isNull(), F.lit(1.0)).otherwise(scale)).drop("calm")
    sized = prob_sizing(chosen, "floor", per_scenario(scenarios, "prob_floor"), prob="probability", out="probability_scale")
    # Stored: the picks come from one walk, which all scenarios and the balanced rows read.
    out = cut(vol_scaling(sized, ["scenario", "date"]).withColumn("trade_score", F.col("smooth_score")))
    moved = [s for s in scenarios if s.get("shift") is not None]
    if not moved:
        return out
    names = [s["scenario"] for s in moved]
    balanced = balanced_exposure(out.where(F.col("scenario").isin(names)), per_scenario(moved, "shift"), ["scenario", "date"])
    balanced = balanced.withColumn("position_scale", F.col("balanced_scale")).select(*out.columns)
    return out.where(~F.col("scenario").isin(names)).unionByName(balanced)


def risk_overlay(
    scored: DataFrame, thresholds: DataFrame, bars: DataFrame, every: int = 10, corr_cap: float = 0.85,
    max_names: int = 12, min_names: int = 5, market_floor: float = 0.45, prob_floor: float = 0.10,
    lookback: int = 63, cal: DataFrame | None = None,
) -> DataFrame:
    """One row of ``risk_overlays``, without its scenario."""
    row = overlay_scenario("overlay", corr_cap=corr_cap, max_names=max_names, market_floor=market_floor, prob_floor=prob_floor)
    return risk_overlays(scored, thresholds, bars, [row], every, min_names, lookback, cal).drop("scenario")


def overlay_selection(rows: DataFrame, schedule: DataFrame, scenarios: Sequence[Mapping]) -> DataFrame:
    """``risk_overlays`` output as a selection of longs for ``evaluate_selection``."""
    day = Window.partitionBy("scenario", "signal_date")
    fields = {f: per_scenario(scenarios, f) for f in ("long_gross", "short_gross", "cap")}
    ranked = rows.withColumnRenamed("date", "signal_date").withColumns({
        "rank": F.row_number().over(day.orderBy(F.col("trade_score").desc(), F.col("symbol").asc())),
        "candidates": F.count("*").over(day), "side": F.lit("LONG"), **fields})
    return ranked.where(F.col("candidates") >= per_scenario(scenarios, "min_names")).join(schedule, ["scenario", "signal_date"])
