"""Portfolio evaluation of a scored panel, for one preset or many scenarios in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators.calendar import sessions
from ..operators.research import linear_score
from .materialize import cut

# Portfolio parameters of the strategy presets. Names with scale use that column
# for position sizes; ``cost_bps`` is commission plus slippage.
PRESETS: dict[str, dict] = {
    "base": dict(rebalance_days=5, long_count=20, short_count=20, long_gross=1.0, short_gross=1.0),
    "momentum": dict(rebalance_days=5, long_count=20, short_count=20, long_gross=1.0, short_gross=1.0),
    "adaptive": dict(rebalance_days=5, long_count=20, short_count=20, long_gross=1.0, short_gross=1.0),
    "long_only": dict(rebalance_days=10, long_count=15, short_count=0, long_gross=1.0, short_gross=0.0, rank_buffer=5),
    "model": dict(rebalance_days=5, long_count=20, short_count=20, long_gross=1.0, short_gross=1.0),
    "v5": dict(rebalance_days=10, long_count=15, short_count=0, long_gross=1.0, short_gross=0.0, min_names=5, rank_buffer=5),
    "v6": dict(rebalance_days=10, long_count=15, short_count=0, long_gross=1.0, short_gross=0.0, min_names=3, rank_buffer=5),
    "v7": dict(rebalance_days=10, long_count=12, short_count=0, long_gross=1.0, short_gross=0.0, min_names=3, cap=0.10, rank_buffer=3),
    "v71": dict(rebalance_days=10, long_count=12, short_count=0, long_gross=1.0, short_gross=0.0, min_names=3, cap=0.10, rank_buffer=3),
}
LONG_ONLY_WEIGHTS = {
    "momentum_12_1_rank": 0.30, "ret_60d_rank": 0.15, "ret_20d_rank": 0.05, "trend_50_rank": 0.10,
    "trend_200_rank": 0.15, "fundamental_raw_rank": 0.20, "liquidity_rank": 0.05,
}
# What each preset ranks by (a column, or weights of rank columns whose gaps count 0.5), and the
# column that scales its positions.
PRESET_SCORES: dict[str, str | dict[str, float]] = {
    "base": "meta_score", "momentum": "momentum_12_1_rank", "adaptive": "adaptive_score", "long_only": LONG_ONLY_WEIGHTS,
    "model": "model_score", "v5": "trade_score", "v6": "trade_score", "v7": "trade_score", "v71": "trade_score",
}
PRESET_SCALES = dict.fromkeys(("v5", "v6", "v7", "v71"), "position_scale")
COMMISSION_PLUS_SLIPPAGE_BPS = 11.0
INITIAL_CAPITAL = 100_000.0


def scenario(name: str, preset: str = "base", **override) -> dict:
    """A complete scenario row: preset fields, then overrides."""
    row = {
        "scenario": name, "warmup_days": 0, "cost_bps": COMMISSION_PLUS_SLIPPAGE_BPS, "min_names": None,
        "cap": 1e9, "rank_buffer": 0, **PRESETS[preset], **override,
    }
    if row["min_names"] is None:
        row["min_names"] = row["long_count"] + row["short_count"]
    row["cap"], row["cost_bps"] = float(row["cap"]), float(row["cost_bps"])
    row["long_gross"], row["short_gross"] = float(row["long_gross"]), float(row["short_gross"])
    return row


def stress_scenarios(preset: str = "base") -> list[dict]:
    """Base, doubled and tripled costs, rebalance cadence, counts, gross exposure."""
    p, c = PRESETS[preset], COMMISSION_PLUS_SLIPPAGE_BPS
    both = lambda n: {"long_count": n, "short_count": n if p["short_count"] else 0}
    gross = lambda g: (
        {"long_gross": g / 2, "short_gross": g / 2} if p["short_count"] else {"long_gross": g})
    rows = [
        ("base", {}), ("costs_x2", {"cost_bps": 2 * c}), ("costs_x3", {"cost_bps": 3 * c}),
        ("weekly", {"rebalance_days": 5}), ("biweekly", {"rebalance_days": 10}), ("monthly", {"rebalance_days": 21}),
        ("tb10", both(10)), ("tb20", both(20)), ("tb30", both(30)),
        ("gross_1", gross(1.0)), ("gross_15", gross(1.5)),
    ]
    return [scenario(n, preset, **o) for n, o in rows]


@dataclass(frozen=True)
class Evaluation:
    """Tables of one evaluation, all keyed by scenario."""

    schedule: DataFrame
    held: DataFrame
    trades: DataFrame
    ledger: DataFrame
    marks: DataFrame
    daily: DataFrame
    metrics: DataFrame


def evaluate(
    scored: DataFrame, bars: DataFrame, score: str, scenarios: Sequence[Mapping], cal: DataFrame | None = None,
    scale: str | None = None, normalize: bool = True, initial: float = INITIAL_CAPITAL, universe: int | None = None,
) -> Evaluation:
    """Selection, weights, prices, costs, daily account and figures as one lazy plan.

    After the top-k cut every table has (names held) x (rebalances) x (scenarios) rows; the
    bars are read for prices at entry and exit and for the daily marks only.
    """
    cal = sessions(bars) if cal is None else cal
    schedule = P.schedules(cal, scenarios)
    sel = P.select_names(scored, score, schedule, scenarios, universe)
    return evaluate_selection(sel, schedule, bars, scenarios, cal, scale, normalize, initial)


def evaluate_selection(
    sel: DataFrame, schedule: DataFrame, bars: DataFrame, scenarios: Sequence[Mapping], cal: DataFrame,
    scale: str | None = None, normalize: bool = True, initial: float = INITIAL_CAPITAL,
) -> Evaluation:
    """``evaluate`` from the selected names on; they may come from several selections in one table."""
    weights = P.target_weights(sel, F.col("long_gross"), F.col("short_gross"), scale, normalize)
    cap = F.col("cap")
    weights = weights.withColumn("weight", F.greatest(-cap, F.least(cap, F.col("weight"))))
    keep = [*P.KEY, "symbol", "side", "rank", "weight", "signal_date", "entry_date", "exit_date"]
    # Small (names held), and the start of every table below: resolved once.
    held = cut(P.period_returns(weights.select(*keep), bars))
    trades = P.turnover_trades(held)
    costs = P.turnover_costs(held, P.per_scenario(scenarios, "cost_bps"))
    ledger = P.net_returns(held, costs)
    marks = P.daily_mark(held, ledger, schedule, bars, cal, initial)
    daily = M.running_drawdown(P.complete_calendar(marks, cal), initial, ["scenario"])
    return Evaluation(schedule, held, trades, ledger, marks, daily, figures(daily, ledger, initial))


def figures(daily: DataFrame, ledger: DataFrame, initial: float = INITIAL_CAPITAL) -> DataFrame:
    turns = ledger.groupBy("scenario").agg(
        F.avg("turnover").alias("avg_turnover"), F.count("*").alias("rebalance_count"))
    return M.period_performance(daily, ["scenario"], initial).join(turns, "scenario")


def with_score(scored: DataFrame, preset: str) -> tuple[DataFrame, str]:
    """The panel with the column that the preset ranks by."""
    by = PRESET_SCORES[preset]
    if isinstance(by, str):
        return scored, by
    # Rounded, so that equal sums of ranks tie whatever the order of additions.
    return linear_score(scored, by, "_s", 0.5).withColumn("_preset_score", F.round("_s", 12)).drop("_s"), "_preset_score"


def beside_benchmark(ev: Evaluation, bars: DataFrame) -> DataFrame:
    """Figures of an evaluation's scenario beside equal weights over its own dates."""
    ev = replace(ev, daily=cut(ev.daily))
    ev = replace(ev, metrics=figures(ev.daily, ev.ledger))
    first = ev.daily.agg(F.min("date")).scalar()
    last = ev.daily.agg(F.max("date")).scalar()
    bench = M.equal_weight_benchmark(bars, first).where(F.col("date") <= last)
    return M.excess_vs_benchmark(ev.metrics, M.period_performance(bench, initial=INITIAL_CAPITAL))


def run_strategy(
    scored: DataFrame, bars: DataFrame, preset: str, score: str | None = None, scale: str | None = None, universe: int | None = None, **override,
) -> DataFrame:
    """Figures of one preset, beside the equal-weight benchmark over the same dates; by default with the preset's own score and scale."""
    rows = [scenario(preset, preset, **override)]
    if score is None:
        scored, score = with_score(scored, preset)
        scale = PRESET_SCALES.get(preset) if scale is None else scale
    ev = evaluate(scored, bars, score, rows, scale=scale, normalize=preset not in PRESET_SCALES, universe=universe)
    return beside_benchmark(ev, bars)


def run_presets(
    panels: Mapping[str, DataFrame], bars: DataFrame, universe: int | None = None, overrides: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Figures of several presets as rows of one plan: each selects from its own panel by its own score and scale,
    and prices, costs and accounts are computed for all together. ``overrides`` changes fields of single presets."""
    cal, rows, sels = sessions(bars), [], []
    for preset, panel in panels.items():
        row = scenario(preset, preset, **(overrides or {}).get(preset, {}))
        scored, score = with_score(panel, preset)
        schedule = P.schedules(cal, [row])
        scale = PRESET_SCALES.get(preset)
        sel = P.select_names(scored, score, schedule, [row], universe)
        sels.append(sel.select(
            *P.KEY, "symbol", "side", "rank", "signal_date", "entry_date", "exit_date", "long_gross", "short_gross", "cap",
            (F.lit(1.0) if scale is None else F.col(scale)).alias("_scale")))
        rows.append(row)
    both = reduce(DataFrame.unionByName, sels)
    return evaluate_selection(both, P.schedules(cal, rows), bars, rows, cal, "_scale", normalize=False).metrics


def stress_matrix(
    scored: DataFrame, bars: DataFrame, score: str, scenarios: Sequence[Mapping] | None = None,
    scale: str | None = None, normalize: bool = True, universe: int | None = None,
    overlay: DataFrame | None = None, overlays: Sequence[Mapping] = (),
) -> DataFrame:
    """Figures per scenario; scenarios are rows of the plan, not separate plans.

    ``overlay`` adds rows that select and size through the risk overlay: its output for the ``overlays`` scenarios.
    """
    scenarios = scenarios or stress_scenarios()
    if overlay is None:
        return evaluate(scored, bars, score, scenarios, scale=scale, normalize=normalize, universe=universe).metrics
    from .overlay import overlay_selection

    cal, everything = sessions(bars), [*scenarios, *overlays]
    schedule = cut(P.schedules(cal, everything))
    columns = [*P.KEY, "symbol", "side", "rank", "signal_date", "entry_date", "exit_date", "long_gross", "short_gross", "cap"]
    plain = P.select_names(scored, score, schedule, scenarios, universe).select(
        *columns, (F.lit(1.0) if scale is None else F.col(scale)).alias("_scale"))
    sized = overlay_selection(overlay, schedule, overlays).select(*columns, F.col("position_scale").alias("_scale"))
    return evaluate_selection(plain.unionByName(sized), schedule, bars, everything, cal, "_scale", normalize=False).metrics
