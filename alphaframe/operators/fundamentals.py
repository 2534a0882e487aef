"""Point-in-time fundamentals from long filing facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import by_date, finite, mean_known, ratio, true_or_false
from ..sources.filings import METRICS
from .asof import asof_join
from .ranks import medians
from .technical import eps_change

CORE = ("revenue", "net_income", "assets", "equity", "operating_cf")


def facts_wide(facts: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per (symbol, available_at) with a column per metric of a fixed list.

    A filing also repeats earlier periods; the value of the latest period with one counts. One group per filing
    holds all metrics, where a pivot would keep one for each of them first.
    """
    known = F.col("value").isNotNull()
    return facts.groupBy("symbol", "available_at").agg(*[
        F.max_by("value", F.when(known & (F.col("metric") == m), F.col("period_end"))).alias(m) for m in metrics
    ])


def point_in_time(rows: DataFrame, facts: DataFrame, metrics: Sequence[str] = METRICS, rows_bound: int | None = None) -> DataFrame:
    """(date, symbol) rows with the last value of every metric published up to the date.

    Facts are pivoted first, so all metrics are carried forward in one pass over the rows
    rather than one as-of join each. A (symbol) partition holds its sessions and filings only.
    """
    return asof_join(
        rows, facts_wide(facts, metrics), ["symbol"], "date", "available_at", metrics, per_column=True, rows_bound=rows_bound,
    )


def core_count(cols: Sequence[str] = CORE) -> Column:
    return reduce(add, [F.col(c).isNotNull().cast("int") for c in cols])


def pit_fundamental_gate(df: DataFrame, k: int, min_revenue: float, min_assets: float) -> DataFrame:
    """Core coverage, positive assets, bounded negative equity, activity, and size."""
    assets, equity = F.col("assets"), F.col("equity")
    revenue, income = F.col("revenue"), F.col("net_income")
    active = true_or_false(revenue > 0) | income.isNotNull()
    large = true_or_false(revenue >= F.lit(float(min_revenue))) | true_or_false(
        assets >= F.lit(float(min_assets))
    )
    gate = (
        (F.col("sec_core_metrics") >= F.lit(k)) & (assets > 0) & equity.isNotNull()
        & (equity > F.lit(-0.5) * assets) & active & large
    )
    return df.withColumn("sec_core_metrics", core_count()).withColumn(
        "solid_fundamental_eligible", true_or_false(gate)
    )


def fundamental_ratios(df: DataFrame) -> DataFrame:
    """Profitability, margin and leverage ratios and their mean; roe needs positive equity."""
    out = df.withColumn("fcf", F.col("operating_cf") - F.coalesce("capex", F.lit(0.0))).withColumns({
        "roe": ratio("net_income", F.when(F.col("equity") > 0, F.col("equity"))),
        "roa": ratio("net_income", "assets"),
        "gross_margin": ratio("gross_profit", "revenue"),
        "operating_margin": ratio("operating_income", "revenue"),
        "fcf_margin": ratio("fcf", "revenue"),
        "debt_assets": ratio("debt", "assets"),
    })
    return out.withColumn("fundamental_raw", mean_known(
        "roe", "roa", "gross_margin", "operating_margin", "fcf_margin", -F.col("debt_assets")
    ))


def pit_fundamentals(
    rows: DataFrame, facts: DataFrame, k: int, min_revenue: float, min_assets: float, rows_bound: int | None = None,
) -> DataFrame:
    """The rows with their point-in-time ratios, gate, and earnings change.

    Everything is partitioned by symbol, so technical windows on the same rows need no further
    shuffle. ``rows_bound`` is an upper bound of the rows.
    """
    pit = fundamental_ratios(pit_fundamental_gate(point_in_time(rows, facts, rows_bound=rows_bound), k, min_revenue, min_assets))
    return eps_change(pit).withColumn("earnings_raw", finite("earnings_raw"))


def attach_fundamentals(panel: DataFrame, pit: DataFrame, universe: int | None = None) -> DataFrame:
    """Left join on (date, symbol); a missing composite takes the date's median, then 0."""
    cols = ["fundamental_raw", "earnings_raw", "solid_fundamental_eligible", "sec_core_metrics"]
    joined = panel.join(pit.select("date", "symbol", *cols), ["date", "symbol"], "left")
    return fill_fundamentals(joined, universe=universe)


def fill_fundamentals(df: DataFrame, one_task_per_date: bool = False, universe: int | None = None) -> DataFrame:
    """Missing composite to the date's median, then 0; missing earnings to 0.

    ``one_task_per_date`` takes the median in a window, which shares the shuffle of the date
    ranks that follow; the default aggregates map side and joins the medians back, range by range on dates
    wider than a task should hold.
    """
    if one_task_per_date:
        df = df.withColumn("_median", F.percentile("fundamental_raw", F.lit(0.5)).over(by_date()))
    else:
        df = df.join(medians(df, "fundamental_raw", ["date"], "_median", universe), "date", "left")
    return df.withColumns({
        "fundamental_raw": F.coalesce("fundamental_raw", "_median", F.lit(0.0)),
        "earnings_raw": F.coalesce("earnings_raw", F.lit(0.0)),
    }).drop("_median")


def operating_quality(facts: DataFrame, k: int, min_revenue: float, min_assets: float) -> DataFrame:
    """Per symbol flags on the latest known value of each core metric."""
    last = F.max_by("value", F.struct("available_at", "period_end"))
    latest = (
        facts.where(F.col("value").isNotNull()).groupBy("symbol", "metric").agg(last.alias("value"))
        .groupBy("symbol").pivot("metric", list(CORE)).agg(F.max("value"))
    )
    gt = lambda c, x: true_or_false(F.col(c) > F.lit(float(x)))
    ge = lambda c, x: true_or_false(F.col(c) >= F.lit(float(x)))
    return latest.select(
        "symbol",
        core_count().alias("sec_core_metrics"),
        true_or_false((F.col("assets") > 0) & (F.col("equity") > F.lit(-0.5) * F.col("assets")))
        .alias("sec_balance_ok"),
        (gt("revenue", 0) | F.col("net_income").isNotNull()).alias("sec_activity_ok"),
        (gt("net_income", 0) | gt("operating_cf", 0)).alias("sec_earning_power"),
        (ge("revenue", min_revenue) | ge("assets", min_assets)).alias("sec_size_ok"),
    ).withColumn(
        "sec_operating_company",
        (F.col("sec_core_metrics") >= F.lit(k)) & F.col("sec_balance_ok")
        & F.col("sec_activity_ok") & F.col("sec_size_ok"),
    )
