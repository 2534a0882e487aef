"""Blending, labelling, calibration search and reports of the meta layer (table arithmetic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, ratio, true_or_false
from ..functions.cols import EPS
from .calendar import latest_cross_section
from .ranks import row_numbers
from .research import rank_ic
from .risk import prob_sizing
from .technical import REGIMES

MIN_REGIME_DATES = 20
THRESHOLDS_V5 = (0.50, 0.55, 0.60, 0.65)
THRESHOLDS_V6 = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
COUNTS_V6 = (8, 10, 12, 15)
ROUND_TRIP_BPS = 22.0


def momentum_base(df: DataFrame, out: str = "pred_momentum") -> DataFrame:
    return df.withColumn(out, F.coalesce("momentum_12_1_rank", F.lit(0.5)) - F.lit(0.5))


def model_ic(df: DataFrame, models: Sequence[str], target: str, by: Sequence[str] = ("fold", "date"), universe: int | None = None) -> DataFrame:
    """(by…, model, ic): daily rank correlation of every model column in one long pass."""
    long = df.select(*by, F.col(target).alias("_target"), *models).unpivot(
        [*by, "_target"], list(models), "model", "_score")
    return rank_ic(long, "_score", "_target", [*by, "model"], universe).select(*by, "model", "ic")


def _quality():
    mean = F.coalesce(F.avg("ic"), F.lit(0.0))
    hit = F.coalesce(F.avg((F.col("ic") > 0).cast("double")), F.lit(0.0))
    return F.greatest(mean, F.lit(0.0)) * F.greatest(hit, F.lit(0.35))


def _normalised(q: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    total, n = F.sum("_q").over(w), F.count("*").over(w)
    return q.withColumn(
        "weight", F.when(total > F.lit(EPS), ratio("_q", total)).otherwise(F.lit(1.0) / n)).drop("_q")


def ic_blend_weights(ic: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Share of max(mean IC, 0) x max(hit rate, .35) per model; equal when nothing is positive."""
    return _normalised(ic.groupBy(*by, "model").agg(_quality().alias("_q")), by)


def regime_router(ic: DataFrame, dates: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """(by…, regime, model, weight): own weights with 20 dates in the regime, else the global ones.

    ``ic``: by…, date, model, ic; ``dates``: by…, date, regime, one row per validation date.
    """
    glob = ic_blend_weights(ic, by).withColumnRenamed("weight", "_global")
    counts = dates.groupBy(*by, "regime").agg(F.count("*").alias("_n"))
    own = ic_blend_weights(ic.join(dates, [*by, "date"]), [*by, "regime"])
    regimes = F.explode(F.array(*[F.lit(r) for r in REGIMES])).alias("regime")
    keys = [*by, "regime"]
    return (
        glob.select("*", regimes).join(own, [*keys, "model"], "left").join(counts, keys, "left")
        .select(*keys, "model", F.when(F.col("_n") >= MIN_REGIME_DATES, F.coalesce("weight", "_global"))
                .otherwise(F.col("_global")).alias("weight"))
    )


def blend_score(df: DataFrame, router: DataFrame, models: Sequence[str], out: str = "raw_score", by: Sequence[str] = ("fold",)) -> DataFrame:
    """Sum of model ranks times the weights of the row's fold and regime.

    The router is pivoted to one row per (fold, regime) first: the rows are joined once and
    never multiplied by the number of models.
    """
    keys = [*by, "regime"]
    wide = router.groupBy(*keys).pivot("model", list(models)).agg(F.first("weight"))
    wide = wide.select(*keys, *[F.col(m).alias(f"_w_{m}") for m in models])
    total = F.lit(0.0)
    for m in models:
        total = total + F.col(m) * F.col(f"_w_{m}")
    return df.join(wide, keys, "left").withColumn(out, total).drop(*[f"_w_{m}" for m in models])


def meta_label(df: DataFrame, kind: str = "relative", round_trip_bps: float = ROUND_TRIP_BPS) -> DataFrame:
    """1 if the trade was worth it: beats the cross-section, or makes money after costs."""
    win = (
        F.col("future_relative_20d") > 0 if kind == "relative"
        else F.col("future_open_return") > F.lit(round_trip_bps / 10_000.0)
    )
    return df.withColumn("label", true_or_false(win).cast("int"))


def meta_features(df: DataFrame, cols: Sequence[str], regime: str = "regime") -> DataFrame:
    """Missing inputs read as 0.5 and one indicator per regime."""
    filled = {c: F.coalesce(c, F.lit(0.5)) for c in cols}
    hot = {f"regime_{r.lower()}": (F.col(regime) == F.lit(r)).cast("double") for r in REGIMES}
    return df.withColumns({**filled, **hot})


def threshold_search(
    cal: DataFrame, grid: Sequence[float] = THRESHOLDS_V5, by: Sequence[str] = ("fold",),
    prob: str = "prob", target: str = "future_relative_20d", min_rate: float = 0.15, default: float = 0.55,
) -> DataFrame:
    """Per fold the threshold with the best mean relative return x sqrt(n).

    Objectives are compared to ten digits, so that equal ones tie and the first threshold wins.
    All thresholds are conditional aggregates of one pass; rows are not repeated per threshold.
    """
    ok = lambda t: F.col(prob) >= F.lit(float(t))
    aggs = []
    for i, t in enumerate(grid):
        aggs += [F.count_if(ok(t)).alias(f"n{i}"), F.avg(F.when(ok(t), F.col(target))).alias(f"m{i}")]
    wide = cal.groupBy(*by).agg(F.count("*").alias("_rows"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("accepted"), F.col(f"m{i}").alias("mean_target"))
        for i, t in enumerate(grid)
    ])
    long = wide.select(*by, "_rows", F.explode(rows).alias("r")).select(*by, "_rows", "r.*")
    long = long.withColumn("acceptance_rate", ratio("accepted", "_rows")).withColumn(
        "objective",
        F.when(F.col("acceptance_rate") >= F.lit(min_rate), F.round(F.col("mean_target") * F.sqrt(F.greatest(F.col("accepted"), F.lit(1))), 10)),
    )
    best = Window.partitionBy(*by).orderBy(F.col("objective").desc_nulls_last(), "threshold")
    any_ok = F.max("objective").over(Window.partitionBy(*by)).isNotNull()
    chosen = F.when(any_ok, F.row_number().over(best) == 1).otherwise(F.col("threshold") == F.lit(default))
    return long.withColumn("selected", chosen).drop("_rows")


def portfolio_grid_search(
    cal: DataFrame, thresholds: Sequence[float] = THRESHOLDS_V6, counts: Sequence[int] = COUNTS_V6,
    hold: int = 10, by: Sequence[str] = ("fold",), prob: str = "prob", score: str = "smooth_score",
    ret: str = "future_open_return", round_trip_bps: float = ROUND_TRIP_BPS,
) -> DataFrame:
    """Threshold x count grid on every ``hold``-th date: mean over deviation of the sized net
    return, less a share of the worst period. One row per grid point, the best flagged.

    Rows are repeated per threshold only on the evaluation dates, and cut to the largest count
    before they are repeated per count.
    """
    fold = Window.partitionBy(*by).orderBy("date")
    dates = cal.select(*by, "date").distinct().withColumn("_i", F.row_number().over(fold) - F.lit(1))
    rows = cal.join(dates.where(F.col("_i") % F.lit(hold) == 0).select(*by, "date"), [*by, "date"])
    names = rows.groupBy(*by).agg(F.count("*").alias("_names"))
    per_t = rows.where(F.col(prob) >= F.lit(float(min(thresholds)))).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    ).where(F.col(prob) >= F.col("threshold"))
    order = Window.partitionBy(*by, "threshold", "date").orderBy(F.col(score).desc(), F.col("symbol").asc())
    cut = per_t.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(counts))
    cut = prob_sizing(cut, "v6", prob=prob).withColumn(
        "long_count", F.explode(F.array(*[F.lit(int(c)) for c in counts]))
    ).where(F.col("_rank") <= F.col("long_count"))
    period = cut.groupBy(*by, "threshold", "long_count", "date").agg(
        F.count("*").alias("_n"),
        F.avg(F.col("size") * (F.col(ret) - F.lit(round_trip_bps / 10_000.0))).alias("_r"),
    ).where(F.col("_n") >= 3)
    stats = period.groupBy(*by, "threshold", "long_count").agg(
        F.count("*").alias("periods"), F.sum("_n").alias("_acc"), F.avg("_r").alias("mean_net"),
        F.stddev_samp("_r").alias("vol"), F.min("_r").alias("worst"),
    )
    grid = names
    for name, values in (("threshold", [float(t) for t in thresholds]), ("long_count", list(counts))):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = grid.join(stats, [*by, "threshold", "long_count"], "left").withColumns({
        "periods": F.coalesce("periods", F.lit(0)),
        "acceptance_rate": F.coalesce(ratio("_acc", "_names"), F.lit(0.0)),
    })
    objective = ratio("mean_net", F.col("vol") + F.lit(EPS)) - F.lit(0.15) * F.abs(F.least("worst", F.lit(0.0)))
    out = out.withColumn("objective", F.when(F.col("periods") >= 4, F.round(objective, 10)))
    best = Window.partitionBy(*by).orderBy(F.col("objective").desc_nulls_last(), "threshold", "long_count")
    any_ok = F.max("objective").over(Window.partitionBy(*by)).isNotNull()
    middle = (F.col("threshold") == F.lit(float(thresholds[len(thresholds) // 2]))) & (
        F.col("long_count") == F.lit(int(counts[len(counts) // 2])))
    return out.withColumn("selected", F.when(any_ok, F.row_number().over(best) == 1).otherwise(middle)).select(
        *by, "threshold", "long_count", "periods", "acceptance_rate", "objective", "selected")


def latest_signals(scored: DataFrame, prob: str = "prob", trade: str = "trade_score", universe: int | None = None, last: Column | None = None) -> DataFrame:
    """Last scored date, ranked by trade score with rejected names last. Counts are summed map side; ranks are
    taken range by range where ``universe`` says that the date may be too wide for a task."""
    snap = latest_cross_section(scored, prob, last)
    counts = snap.groupBy("date").agg(F.count(trade).alias("accepted_count"))
    ranked = row_numbers(snap, F.col(trade), ["date"], "symbol", "rank", universe)
    return ranked.join(counts, "date").withColumn("accepted", F.col(trade).isNotNull())


def refresh_report(scored: DataFrame, score: str, target: str, trade: str, by: str = "refresh_id", universe: int | None = None) -> DataFrame:
    """Per refresh and over all (null id): mean IC, IR, hit rate, days, acceptance rate."""
    ic = rank_ic(scored, score, target, [by, "date"], universe)
    accept = scored.groupBy(by).agg(F.count("*").alias("_n"), F.count(trade).alias("_a"))
    daily = lambda rows, key: rows.groupBy(*key).agg(
        F.avg("ic").alias("rank_ic"),
        F.when(F.count("ic") > 1, ratio(F.avg("ic"), F.stddev_samp("ic") + F.lit(EPS))).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_ratio"), F.count("ic").alias("days"))
    per = daily(ic, [by]).join(accept.withColumn("acceptance_rate", ratio("_a", "_n")).drop("_a", "_n"), by, "full")
    total = daily(ic, []).withColumn("acceptance_rate", accept.agg(ratio(F.sum("_a"), F.sum("_n"))).scalar())
    return per.unionByName(total.withColumn(by, F.lit(None).cast(dict(scored.dtypes)[by])))


def logit(p) -> Column:
    q = clip(p, 1e-5, 1.0 - 1e-5)
    return F.log(q / (F.lit(1.0) - q))
