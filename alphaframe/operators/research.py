"""Factor research: rank correlation with the forward target, bins, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corr_of, dealt, ratio
from ..functions.cols import EPS
from ..plans.materialize import cut
from .calendar import latest_cross_section
from .ranks import _ranges, _window_rank, bin_of, quantile_bins, too_wide, value_ranks

FEATURES = (
    "momentum_12_1_rank", "ret_60d_rank", "ret_20d_rank", "trend_50_rank", "trend_200_rank",
    "fundamental_raw_rank", "earnings_raw_rank", "news_raw_rank", "low_vol_rank", "liquidity_rank",
)
MODEL_FEATURES = tuple(f for f in FEATURES if f != "news_raw_rank")
TARGET = "future_relative_20d"


def rank_ic(
    df: DataFrame, score: str, target: str, by: Sequence[str], universe: int | None = None, stored: bool = False,
) -> DataFrame:
    """Spearman correlation per group over complete pairs; groups without a value are null.

    Groups too wide for a task are read several times, so the pairs are stored unless ``df`` reads a ``stored`` table.
    """
    pairs = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(
        *by, F.col(score).alias("_x"), F.col(target).alias("_y")
    )
    if too_wide(universe):
        if not stored:
            pairs = cut(pairs)
        tables = {c: value_ranks(pairs, c, by, _ranges(universe)) for c in ("_x", "_y")}
        for c, table in tables.items():
            pairs = pairs.join(table.select(*by, c, F.col("avg_rank").alias(f"{c}r")), [*by, c])
    else:
        pairs = pairs.withColumns({f"{c}r": _window_rank(c, by)[0] for c in ("_x", "_y")})
    return pairs.groupBy(*by).agg(corr_of("_xr", "_yr").alias("ic"), F.count("*").alias("n"))


def daily_rank_ic(df: DataFrame, score: str, target: str = TARGET, universe: int | None = None) -> DataFrame:
    return rank_ic(df, score, target, ["date"], universe).where(F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, information ratio and share of positive days."""
    return ic.groupBy(*by).agg(
        F.avg("ic").alias("mean_rank_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        ratio(F.avg("ic"), F.stddev_samp("ic") + F.lit(EPS)).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_ratio"),
        F.count("ic").alias("days"),
    )


def monthly_ic(ic: DataFrame, months: int = 36) -> DataFrame:
    return (
        ic.groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("ic").alias("ic"))
        .orderBy(F.col("month").desc()).limit(months)
    )


def recent_ic(ic: DataFrame, days: int = 60) -> DataFrame:
    return ic.orderBy(F.col("date").desc()).limit(days).select("date", "ic")


def quintile_spread(df: DataFrame, feature: str, target: str = TARGET, k: int = 5, universe: int | None = None) -> DataFrame:
    """(date, spread): mean target of the top bin minus the bottom bin, dates with all bins only."""
    pairs = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).select("date", "symbol", feature, target)
    return bin_spread(quantile_bins(pairs, feature, k, universe=universe), target, ["date"], k)


def bin_spread(binned: DataFrame, target: str, by: Sequence[str], k: int = 5) -> DataFrame:
    in_bin = lambda b: F.avg(F.when(F.col("bin") == F.lit(b), F.col(target)))
    return (
        binned.groupBy(*by)
        .agg((in_bin(k - 1) - in_bin(0)).alias("spread"), F.countDistinct("bin").alias("_bins"))
        .where(F.col("_bins") >= F.lit(k)).drop("_bins")
    )


def factor_summary(
    df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, universe: int | None = None, rows_bound: int | None = None,
) -> DataFrame:
    """IC summary, mean bin spread and counts of every feature from one long pass.

    Unpivoting makes (feature, date) the unit of work: ten times more, ten times smaller
    groups than ranking each feature inside a date, behind a single shuffle. ``rows_bound``, an upper bound
    of the rows of ``df``, sets its number of tasks.
    """
    rows = df.select("date", "symbol", F.col(target).alias("target"), *features)
    long = (cut(rows) if too_wide(universe) else rows).unpivot(
        ["date", "symbol", "target"], list(features), "feature", "value"
    ).where(F.col("value").isNotNull() & F.col("target").isNotNull())
    by = ["feature", "date"]
    if too_wide(universe):
        ic = rank_ic(long, "value", "target", by, universe, stored=True)
        spread = bin_spread(quantile_bins(long, "value", 5, by, universe=universe), "target", by)
        daily = ic.join(spread, by, "left")
    else:
        w = Window.partitionBy(*by).orderBy("value", "symbol")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = dealt(long, by, rows_bound).withColumns({
            "bin": bin_of(F.row_number().over(w), F.count("*").over(whole), 5),
            "_x": _window_rank("value", by)[0], "_y": _window_rank("target", by)[0],
        })
        in_bin = lambda b: F.avg(F.when(F.col("bin") == F.lit(b), F.col("target")))
        daily = ranked.groupBy(*by).agg(
            corr_of("_x", "_y").alias("ic"), F.count("*").alias("n"),
            F.when(F.countDistinct("bin") >= 5, in_bin(4) - in_bin(0)).alias("spread"),
        )
    return daily.groupBy("feature").agg(
        F.avg("ic").alias("mean_rank_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        ratio(F.avg("ic"), F.stddev_samp("ic") + F.lit(EPS)).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_ratio"),
        F.avg("spread").alias("top_bottom_future_20d"),
        F.sum("n").alias("observations"),
        F.count("*").alias("dates"),
    )


def factor_report(df: DataFrame, feature: str, target: str = TARGET, universe: int | None = None, rows_bound: int | None = None) -> DataFrame:
    return factor_summary(df, [feature], target, universe, rows_bound)


def factor_corr(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(f1, f2, corr) on the last date: every pair is one aggregate of a single scan, no self join."""
    snap = latest_cross_section(df)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = snap.agg(*[F.round(corr_of(a, b), 3).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[
        F.struct(F.lit(x).alias("f1"), F.lit(y).alias("f2"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs for x, y in ({(a, b), (b, a)})
    ])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def feature_top(summary: DataFrame, n: int = 6) -> DataFrame:
    return summary.orderBy(F.col("mean_rank_ic").desc_nulls_last(), "feature").limit(n)


# --- adaptive factor weights ---------------------------------------------------------------

# Weights used until factors have shown a positive past correlation.
FALLBACK_WEIGHTS = {
    "momentum_12_1_rank": 0.35, "trend_200_rank": 0.20, "fundamental_raw_rank": 0.20,
    "news_raw_rank": 0.15, "liquidity_rank": 0.10,
}


def feature_ic_wide(df: DataFrame, cal: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, universe: int | None = None, rows_bound: int | None = None) -> DataFrame:
    """One row per session with the IC of every feature (null where undefined).

    With ``rows_bound``, an upper bound of the rows of ``df``, the dates of the features are dealt to tasks of bounded size.
    """
    rows = df.select("date", F.col(target).alias("target"), *features)
    long = (cut(rows) if too_wide(universe) else rows).unpivot(
        ["date", "target"], list(features), "feature", "value"
    )
    long = long if too_wide(universe) else dealt(long, ["feature", "date"], rows_bound)
    ic = rank_ic(long, "value", "target", ["feature", "date"], universe, stored=True)
    wide = ic.groupBy("date").pivot("feature", list(features)).agg(F.max("ic"))
    return cal.join(wide, "date", "left")


def adaptive_weights(
    ic_wide: DataFrame, lookback: int = 252, embargo: int = 20, cap: float = 0.35,
    features: Sequence[str] = FEATURES, start_after: int = 40,
) -> DataFrame:
    """Per session a weight per feature from its past mean IC and hit rate, capped and normalised.

    The window ends ``embargo`` sessions back and holds ``lookback`` sessions. Dates without any
    IC are left out of the hit rate; a null IC on a counted date is a miss.
    """
    w = Window.orderBy("idx").rowsBetween(-(lookback + embargo), -(embargo + 1))
    counted = F.coalesce(*features).isNotNull()

    def raw(f: str):
        hit = F.avg(F.when(counted, F.coalesce(F.col(f) > 0, F.lit(False)).cast("double"))).over(w)
        trust = F.greatest(F.coalesce(hit, F.lit(0.0)) - F.lit(0.5), F.lit(0.0)) * F.lit(2.0)
        return F.greatest(F.coalesce(F.avg(f).over(w), F.lit(0.0)), F.lit(0.0)) * (
            F.lit(0.5) + F.lit(0.5) * trust
        )

    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    over = lambda x: x > F.lit(cap + EPS)

    def spread(ws, _):
        """Cut the weights over the cap and give the excess to the rest in proportion."""
        excess = F.aggregate(ws, F.lit(0.0), lambda s, x: s + F.when(over(x), x - F.lit(cap)).otherwise(0.0))
        rest = F.aggregate(ws, F.lit(0.0), lambda s, x: s + F.when(over(x), 0.0).otherwise(x))
        more = F.when(rest > F.lit(EPS), excess / F.greatest(rest, F.lit(EPS))).otherwise(0.0)
        return F.transform(ws, lambda x: F.when(over(x), F.lit(cap)).otherwise(x + x * more))

    fallback = F.array(*[F.lit(float(FALLBACK_WEIGHTS.get(f, 0.0))) for f in features])
    out = ic_wide.select("date", "idx", F.array(*[raw(f) for f in features]).alias("_raw"))
    usable = (F.col("idx") - F.lit(embargo) > F.lit(start_after)) & (sums("_raw") > F.lit(EPS))
    share = F.transform("_raw", lambda x: x / sums("_raw"))
    capped = F.aggregate(F.sequence(F.lit(1), F.lit(8)), share, spread)
    out = out.withColumn("_w", F.when(usable, capped).otherwise(fallback))
    total = sums("_w")
    return out.select(
        "date", "idx", *[(F.col("_w")[i] / total).alias(f) for i, f in enumerate(features)]
    )


def adaptive_score(panel: DataFrame, weights: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Weighted rank sum with the weights of the row's date; a missing rank counts 0.5."""
    w = weights.select("date", *[F.col(f).alias(f"_w_{f}") for f in features])
    joined = panel.join(w, "date")
    terms = [F.coalesce(f, F.lit(0.5)) * F.col(f"_w_{f}") for f in features]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return joined.withColumn("adaptive_score", total).drop(*[f"_w_{f}" for f in features])


def linear_score(df: DataFrame, weights: dict[str, float], out: str, fill: float | None = None) -> DataFrame:
    """Weighted sum of ranks: null-propagating, or with missing ranks read as ``fill``."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(float(w)) * (F.col(c) if fill is None else F.coalesce(c, F.lit(float(fill))))
    return df.withColumn(out, total)


def pct_rank_columns(df: DataFrame, cols: Sequence[str], universe: int | None = None) -> DataFrame:
    """Shorthand for percentile ranks of several columns by date, named ``{col}_rank``."""
    from .ranks import pct_rank

    return pct_rank(df, list(cols), universe=universe)
