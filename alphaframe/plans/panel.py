"""The feature panel: bars + fundamentals + news to ranks, score and forward target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fundamentals import fill_fundamentals, pit_fundamentals
from ..operators.ranks import pct_rank, too_wide
from ..operators.research import linear_score
from ..operators.technical import forward_return, solid_eligible, technical
from ..sources.news import pit_news_mask

RANKED = {
    "momentum_12_1": "momentum_12_1_rank", "ret_60d": "ret_60d_rank", "ret_20d": "ret_20d_rank",
    "trend_50": "trend_50_rank", "trend_200": "trend_200_rank",
    "fundamental_raw": "fundamental_raw_rank", "earnings_raw": "earnings_raw_rank",
    "news_raw": "news_raw_rank", "vol_20d": "low_vol_rank", "dollar_volume": "liquidity_rank",
}

# Weights of the composite score.
META_WEIGHTS = {
    "momentum_12_1_rank": 0.25, "ret_60d_rank": 0.10, "trend_200_rank": 0.10,
    "fundamental_raw_rank": 0.20, "earnings_raw_rank": 0.15, "news_raw_rank": 0.05,
    "low_vol_rank": 0.10, "liquidity_rank": 0.05,
}


@dataclass(frozen=True)
class Eligibility:
    """Trading floors and caps. Prices, volumes and volatility levels depend on the market."""

    min_price: float = 5.0
    min_sessions: int = 252
    min_dollar_volume: float = 5_000_000.0
    max_vol: float = 0.90


@dataclass(frozen=True)
class FundamentalGate:
    """Coverage and size floors of the filing gate."""

    core_metrics: int = 4
    min_revenue: float = 50_000_000.0
    min_assets: float = 100_000_000.0


FILING_COLUMNS = ("fundamental_raw", "earnings_raw", "solid_fundamental_eligible", "sec_core_metrics")


def feature_panel(
    bars: DataFrame, facts: DataFrame, news: DataFrame, sectors: DataFrame, limits: Eligibility,
    gate: FundamentalGate, horizon: int = 20, universe: int | None = None, complete: bool = True,
    last_date: Column | None = None, rows_bound: int | None = None,
) -> DataFrame:
    """One row per (date, symbol) with a complete score.

    Two shuffles after the bars: by symbol, serving the as-of filings, the technical windows and
    the target; and by date, serving the target's mean, the filing medians and all ranks. Rows
    without a score are dropped last, because the date mean of the target covers all of them.
    ``rows_bound``, an upper bound of the bars, sets the number of tasks of both.
    """
    rows = bars.select("date", "symbol", "open", "close", "volume")
    pit = pit_fundamentals(rows, facts, gate.core_metrics, gate.min_revenue, gate.min_assets, rows_bound)
    df = technical(pit.select(*rows.columns, *FILING_COLUMNS))
    df = solid_eligible(df, limits.min_price, limits.min_sessions, limits.min_dollar_volume, limits.max_vol)
    df = pit_news_mask(df, news, last=last_date).join(sectors, "symbol", "left")
    df = forward_return(df, horizon, universe=universe, rows_bound=rows_bound)
    df = fill_fundamentals(df, one_task_per_date=not too_wide(universe))
    df = pct_rank(df, RANKED, invert=["low_vol_rank"], universe=universe)
    df = linear_score(df, META_WEIGHTS, "meta_score")
    return df.where(F.col("meta_score").isNotNull()) if complete else df
