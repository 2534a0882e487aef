"""Choosing the tradable universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by_symbol, period_return
from .ranks import pct_rank
from .technical import ANNUAL


def liquidity_stats(bars: DataFrame, n: int = 60) -> DataFrame:
    """Per symbol: history length, last price, and dollar volume and volatility of the last n bars."""
    back = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    rows = bars.select("symbol", "date", "close", (F.col("close") * F.col("volume")).alias("_dv")).withColumns(
        {"_ret": period_return("close", F.lag("close").over(by_symbol())), "_back": F.row_number().over(back)}
    )
    recent = F.col("_back") <= F.lit(n)
    r, dv = F.when(recent, F.col("_ret")), F.when(recent, F.col("_dv"))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("history_sessions"),
        F.max_by("close", "date").alias("last_price"),
        F.coalesce(F.percentile(dv, F.lit(0.5)), F.lit(0.0)).alias(f"median_dollar_volume_{n}"),
        F.when(F.count_if(recent) > 20, F.stddev_samp(r) * F.lit(ANNUAL)).alias(f"volatility_{n}"),
    )


def universe_gate(
    stats: DataFrame, min_sessions: int, min_price: float, min_dollar_volume: float, max_vol: float,
) -> DataFrame:
    """History, price, liquidity and volatility floors; an unknown volatility counts as 99."""
    return stats.where(
        (F.col("history_sessions") >= F.lit(min_sessions))
        & (F.col("last_price") >= F.lit(float(min_price)))
        & (F.col("median_dollar_volume_60") >= F.lit(float(min_dollar_volume)))
        & (F.coalesce("volatility_60", F.lit(99.0)) <= F.lit(float(max_vol)))
    )


def quality_score(stats: DataFrame, universe: int | None = None) -> DataFrame:
    """Half liquidity, then current liquidity, length of history and calm, as rank shares."""
    ranks = {
        "median_dollar_volume_60": "liq_rank", "current_dollar_volume": "current_liq_rank",
        "history_sessions": "history_rank", "volatility_60": "stability_rank",
    }
    one = stats.withColumn("_all", F.lit(1))
    ranked = pct_rank(one, ranks, by=["_all"], invert=["stability_rank"], universe=universe, bounded=False)
    return ranked.drop("_all").withColumn(
        "quality_score",
        F.lit(0.50) * F.col("liq_rank") + F.lit(0.20) * F.col("current_liq_rank")
        + F.lit(0.15) * F.col("history_rank") + F.lit(0.15) * F.col("stability_rank"),
    )


def universe_top_n(stats: DataFrame, n: int, universe: int | None = None) -> DataFrame:
    """Best ``n`` names. The rank is one global cross-section: pass ``universe`` when it is large."""
    return quality_score(stats, universe).orderBy(
        F.col("quality_score").desc_nulls_last(), F.col("median_dollar_volume_60").desc(), "symbol"
    ).limit(n)


FUNNEL_COLUMNS = ("quality_score", "median_dollar_volume_60", "history_sessions", "volatility_60")


def universe_funnel(stages: DataFrame, ranked: DataFrame | None = None, filters: dict | None = None, top: int = 50) -> DataFrame:
    """One row of counts from a table of per-symbol stage flags, on request with the thresholds applied and the symbols of the
    ``top`` names of ``ranked`` in order."""
    flags = ("prefiltered", "qualified", "selected")
    out = stages.agg(
        F.count("*").alias("candidate_count"),
        *[F.count_if(F.col(c)).alias(f"{c}_count") for c in flags],
    ).withColumns({k: F.lit(v) for k, v in (filters or {}).items()})
    if ranked is None:
        return out
    names = funnel_top(ranked, top).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"])).scalar()
    return out.withColumn("top_symbols", names)


def funnel_top(ranked: DataFrame, top: int = 50, universe: int | None = None) -> DataFrame:
    """(place, symbol, score and statistics) of the best ``top`` names; the cut runs before the numbering."""
    best = universe_top_n(ranked, top, universe)
    order = Window.orderBy(F.col("quality_score").desc_nulls_last(), F.col("median_dollar_volume_60").desc(), "symbol")
    return best.select(F.row_number().over(order).alias("place"), "symbol", *FUNNEL_COLUMNS)
