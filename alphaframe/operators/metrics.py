"""Performance, attribution and report rows from curves and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by_symbol, period_return, ratio
from ..functions.cols import EPS, TRADING_DAYS


def _ordered(by: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def running_drawdown(ledger: DataFrame, initial: float, by: Sequence[str] = ()) -> DataFrame:
    """Daily P&L, return and drawdown of an account; the peak includes the initial capital."""
    w = _ordered(by, "date")
    prev = F.lag("equity_usd", 1, float(initial)).over(w)
    peak = F.greatest(F.lit(float(initial)), F.max("equity_usd").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ledger.withColumns({
        "daily_pnl_usd": F.col("equity_usd") - prev,
        "daily_return": F.col("equity_usd") / F.greatest(prev, F.lit(EPS)) - F.lit(1.0),
        "drawdown": F.col("equity_usd") / F.greatest(peak, F.lit(EPS)) - F.lit(1.0),
    })


def compound_equity(rets: DataFrame, by: Sequence[str] = ("scenario",), order: str = "rebalance_id", ret: str = "net_return", out: str = "equity") -> DataFrame:
    """Running product of 1 + r; a loss of more than everything turns the sign, as it should."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rets.withColumn(out, F.product(F.lit(1.0) + F.col(ret)).over(w))


def period_performance(curve: DataFrame, by: Sequence[str] = (), initial: float | None = None) -> DataFrame:
    """Return, risk and drawdown figures of daily curves (date, equity_usd, daily_return).

    One window for the running peak, one aggregation per curve.
    """
    w = _ordered(by, "date").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_dd", ratio("equity_usd", F.max("equity_usd").over(w)) - F.lit(1.0))
    first = F.min_by("equity_usd", "date") / F.greatest(
        F.lit(1.0) + F.min_by("daily_return", "date"), F.lit(EPS)
    )
    start = first if initial is None else F.lit(float(initial))
    growth = F.max_by("equity_usd", "date") / F.greatest(start, F.lit(EPS))
    years = F.greatest(
        F.datediff(F.max("date"), F.min("date")) / F.lit(365.25), F.lit(1.0 / 365.25)
    )
    return _figures(rows, by, growth, years, F.col("daily_return"), float(TRADING_DAYS))


def rebalance_performance(curve: DataFrame, periods_per_year: float, by: Sequence[str] = ()) -> DataFrame:
    """The same figures from per-rebalance rows (rebalance_id, equity, net_return)."""
    w = _ordered(by, "rebalance_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_dd", ratio("equity", F.max("equity").over(w)) - F.lit(1.0))
    years = F.greatest(F.count("*") / F.lit(float(periods_per_year)), F.lit(1e-9))
    return _figures(rows, by, F.max_by("equity", "rebalance_id"), years, F.col("net_return"), periods_per_year)


def _figures(rows: DataFrame, by, growth: Column, years: Column, r: Column, per_year: float) -> DataFrame:
    scale = F.lit(per_year ** 0.5)
    loss = F.when(r < 0, r)
    agg = rows.groupBy(*by).agg(
        growth.alias("_growth"), years.alias("elapsed_years"), F.count(r).alias("observations"),
        (F.avg(r) * F.lit(per_year)).alias("_ann"), (F.stddev_samp(r) * scale).alias("volatility"),
        (F.stddev_samp(loss) * scale).alias("_down"), F.min("_dd").alias("max_drawdown"),
    )
    cagr = F.pow("_growth", F.lit(1.0) / F.col("elapsed_years")) - F.lit(1.0)
    return agg.withColumn("cagr", cagr).select(
        *by,
        (F.col("_growth") - F.lit(1.0)).alias("total_return"), "cagr", "volatility",
        ratio("_ann", F.col("volatility") + F.lit(EPS)).alias("sharpe"),
        ratio("_ann", F.col("_down") + F.lit(EPS)).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "max_drawdown", "elapsed_years", "observations",
    )


def position_stats(pos: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Win rate, profit factor and side P&L of closed positions (side, asset_return, net_pnl_usd)."""
    pnl = F.col("net_pnl_usd")
    lost = F.sum(F.when(pnl < 0, pnl))
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, pnl)), F.lit(0.0))
    return pos.groupBy(*by).agg(
        F.count("*").alias("position_periods"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        ratio(F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.abs(lost)).alias("profit_factor"),
        F.avg(F.col("asset_return") * sign).alias("avg_position_period_return"),
        F.max(pnl).alias("best_position_pnl_usd"), F.min(pnl).alias("worst_position_pnl_usd"),
        side("LONG").alias("long_pnl_usd"), side("SHORT").alias("short_pnl_usd"),
    )


def side_attribution(pos: DataFrame, orders: DataFrame) -> DataFrame:
    """Gross P&L and costs per book: BUY/SELL belong to longs, SHORT/COVER to shorts."""
    gross = pos.groupBy(F.col("side").alias("book")).agg(F.sum("gross_pnl_usd").alias("gross_pnl_usd"))
    book = F.when(F.col("action").isin("BUY", "SELL"), "LONG").otherwise("SHORT")
    cost = orders.groupBy(book.alias("book")).agg(F.sum("estimated_cost_usd").alias("costs_usd"))
    return gross.join(cost, "book", "full").select(
        "book", F.coalesce("gross_pnl_usd", F.lit(0.0)).alias("gross_pnl_usd"),
        F.coalesce("costs_usd", F.lit(0.0)).alias("costs_usd"),
        (F.coalesce("gross_pnl_usd", F.lit(0.0)) - F.coalesce("costs_usd", F.lit(0.0))).alias("net_pnl_usd"),
    )


def exposure_summary(weights: DataFrame, by: Sequence[str] = ("rebalance_id",)) -> DataFrame:
    a = F.abs("weight")
    return weights.groupBy(*by).agg(
        F.sum(a).alias("gross_exposure"), F.sum("weight").alias("net_exposure"),
        (F.lit(1.0) - F.sum(a)).alias("cash_pct"), F.max(a).alias("largest_weight"),
        F.count("*").alias("position_count"), F.sort_array(F.collect_set("symbol")).alias("active_symbols"),
    )


def signal_context(
    held: DataFrame, prob: str, threshold: str, regime: str, score: str, by: Sequence[str] = ("date",),
) -> DataFrame:
    """Mean probability, median threshold, most frequent regime (smallest on ties), mean score."""
    return held.groupBy(*by).agg(
        F.avg(prob).alias("avg_meta_probability"),
        F.percentile(threshold, F.lit(0.5)).alias("meta_threshold"),
        F.mode(regime, True).alias("regime"), F.avg(score).alias("avg_signal_score"),
    )


def equal_weight_benchmark(bars: DataFrame, start=None, initial: float = 100_000.0) -> DataFrame:
    """Mean open-to-open return of the universe per date, compounded from ``start``; first day flat."""
    rets = bars.withColumn("_r", period_return("open", F.lag("open").over(by_symbol())))
    daily = rets.groupBy("date").agg(F.avg("_r").alias("_mean"))
    if start is not None:
        daily = daily.where(F.col("date") >= start)
    w = Window.orderBy("date")
    r = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.coalesce("_mean", F.lit(0.0)))
    daily = daily.select("date", r.alias("daily_return"))
    total = F.product(F.lit(1.0) + F.col("daily_return")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("equity_usd", F.lit(float(initial)) * total)


def excess_vs_benchmark(perf: DataFrame, bench: DataFrame) -> DataFrame:
    """Strategy figures beside the one-row benchmark figures."""
    b = {c: bench.select(c).scalar() for c in ("cagr", "sharpe", "max_drawdown")}
    return perf.withColumns({
        "benchmark_cagr": b["cagr"], "benchmark_sharpe": b["sharpe"],
        "benchmark_max_drawdown": b["max_drawdown"],
        "excess_cagr_vs_equal_weight": F.col("cagr") - b["cagr"],
    })


def robustness_summary(metrics: DataFrame, cost_scenarios: Sequence[str], base: str = "base") -> DataFrame:
    """Share of scenarios with positive Sharpe, median, worst, cost stress, verdict, base turnover."""
    positive = F.avg((F.col("sharpe") > 0).cast("double"))
    stressed = F.coalesce(
        F.bool_and(F.when(F.col("scenario").isin(*cost_scenarios), F.col("sharpe") > 0)), F.lit(True)
    )
    return metrics.agg(
        positive.alias("positive_sharpe_ratio"),
        F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"),
        F.min("sharpe").alias("min_sharpe"),
        stressed.alias("cost_stress_pass"),
        ((positive >= F.lit(0.7)) & stressed).alias("passed"),
        F.max(F.when(F.col("scenario") == base, F.col("avg_turnover"))).alias("turnover_base"),
    )


def journal_rows(
    daily: DataFrame, held: DataFrame, orders: DataFrame, schedule: DataFrame, context: DataFrame | None = None, risk: DataFrame | None = None,
) -> DataFrame:
    """The daily account with what a journal shows of the open rebalance: its largest weight, the orders of its entry
    day, and on request the signal context (date, …) and portfolio risk (scenario, decision, …) of its signal date."""
    key = ["scenario", "rebalance_id"]
    largest = held.groupBy(*key).agg(F.max(F.abs("weight")).alias("largest_weight"))
    sent = orders.groupBy(*key).agg(F.count("*").alias("_orders"))
    when = schedule.select(*key, "signal_date", "entry_date")
    rows = daily.join(when, key, "left").join(largest, key, "left").join(sent, key, "left")
    opened = F.col("position_count") > 0
    rows = rows.withColumns({
        "largest_weight": F.when(opened, F.col("largest_weight")),
        "trade_count": F.when(opened & (F.col("date") == F.col("entry_date")), F.coalesce("_orders", F.lit(0))).otherwise(F.lit(0)).cast("long"),
        "_signal": F.when(opened, F.col("signal_date"))}).drop("_orders", "signal_date", "entry_date")
    if context is not None:
        rows = rows.join(context.withColumnRenamed("date", "_signal"), "_signal", "left")
    if risk is not None:
        rows = rows.join(risk.withColumnRenamed("decision", "_signal"), ["scenario", "_signal"], "left")
    return rows.drop("_signal")


AVERAGED = ("gross_exposure", "cash_pct", "avg_meta_probability", "meta_threshold", "avg_pair_corr", "portfolio_vol")
LARGEST = ("largest_weight", "max_pair_corr")


def journal_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The total row of a daily journal: sums, compounded return, last equity and balance, worst drawdown, means of the
    known values of levels, and largest values; columns the journal does not have are left out."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    last = [F.max_by(c, "date").alias(c) for c in ("equity_usd", "balance_usd") if c in df.columns]
    return df.groupBy(*by).agg(
        F.sum(zero("daily_pnl_usd")).alias("daily_pnl_usd"),
        (F.product(F.lit(1.0) + zero("daily_return")) - F.lit(1.0)).alias("daily_return"),
        *last,
        F.min(zero("drawdown")).alias("drawdown"),
        F.sum(zero("turnover")).alias("turnover"),
        F.sum(F.coalesce("trade_count", F.lit(0))).alias("trade_count"),
        F.sum(zero("cost_usd")).alias("cost_usd"),
        *[F.avg(c).alias(c) for c in AVERAGED if c in df.columns],
        *[F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in LARGEST if c in df.columns],
    )


def sweep_best(metrics: DataFrame, n: int = 1) -> DataFrame:
    return metrics.orderBy(F.col("sharpe").desc_nulls_last(), "scenario").limit(n)


def compare_runs(ledger: DataFrame, run_ids: Sequence, value: str = "equity_usd", run: str = "run_id") -> DataFrame:
    """Up to a handful of runs side by side on the union of their dates."""
    return (
        ledger.where(F.col(run).isin(*run_ids)).groupBy("date")
        .pivot(run, list(run_ids)).agg(F.first(value, ignorenulls=True))
        .select("date", *[F.col(str(r)).alias(f"eq_{r}") for r in run_ids])
    )


def paper_vs_model(snaps: DataFrame, curve: DataFrame, tie: str | None = None) -> DataFrame:
    """Realised return between the first and last snapshot against the model's over those dates."""
    day = F.to_date("created_at")
    at = F.struct("created_at", tie) if tie else F.col("created_at")
    paper = snaps.agg(
        F.min_by("equity", at).alias("_e0"), F.max_by("equity", at).alias("_e1"),
        F.count("*").alias("snapshots"), F.min(day).alias("_from"), F.max(day).alias("_to"),
    )
    first, last = snaps.agg(F.min(day)).scalar(), snaps.agg(F.max(day)).scalar()
    model = curve.where((F.col("date") >= first) & (F.col("date") <= last)).agg(
        F.when(F.count("*") >= 2, period_return(F.max_by("equity", "date"), F.min_by("equity", "date")))
    ).scalar()
    return paper.select(
        "snapshots", F.when(F.col("snapshots") >= 2, period_return("_e1", "_e0")).alias("paper_return"),
        model.alias("model_return"),
    ).withColumn("return_gap", F.col("paper_return") - F.col("model_return"))


def symbol_search(df: DataFrame, q: str, col: str = "active_symbols") -> DataFrame:
    """Journal rows with an active symbol containing ``q``, ignoring case."""
    return df.where(F.exists(col, lambda s: F.contains(F.upper(s), F.lit(q.strip().upper()))))


def sort_journal(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Order by any column, missing values last, ties by date."""
    c = F.col(key)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "date")
