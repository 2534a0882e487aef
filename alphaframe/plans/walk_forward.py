"""Continuous walk-forward scoring: refit on past labels only, score until the next refresh,
smooth, and decide trade or skip with a calibrated meta layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import meta as ME
from ..operators import models as MO
from ..operators.calendar import fold_range_join, sessions
from ..operators.folds import continuous_folds, valid_dates_semi
from ..operators.ranks import first_rank_filter, pct_rank
from ..operators.research import MODEL_FEATURES
from ..operators.risk import prob_sizing
from ..operators.technical import REGIMES, ewma_score
from .materialize import cut, discard, together


@dataclass(frozen=True)
class WalkForward:
    """Lengths in sessions. ``kind`` relative: label and target against the cross-section, sized
    with a 25 % floor; net: label and target of the next-open holding period after costs."""

    kind: str = "relative"
    min_train: int = 126
    validation: int = 63
    embargo: int = 20
    refresh: int = 20
    span: int = 5
    min_names: int = 20
    models: Sequence[str] = ("ridge", "gbt", "ensemble", "momentum")
    features: Sequence[str] = MODEL_FEATURES
    boosting: dict = field(default_factory=dict)
    logistic_c: float = 0.35
    fit_share: float = 0.65
    min_fit: int = 20
    universe: int | None = None

    @property
    def target(self) -> str:
        return "future_relative_20d" if self.kind == "relative" else "future_relative_open"


# Date-level features of the trade filter of the next-open variant.
CONTEXT = ("market_ret_20", "market_vol_20", "market_dispersion_20", "market_breadth_20", "market_trend_breadth")
# Fixed values of the next-open variant: ten-session holding period, twelve-session embargo.
NET = dict(kind="net", validation=126, embargo=12, logistic_c=0.30, fit_share=0.55, min_fit=30)


def walk_forward_oos(panel: DataFrame, cfg: WalkForward) -> tuple[DataFrame, DataFrame]:
    """(scored, refreshes): one out-of-sample row per eligible (date, symbol) after start-up.

    ``panel``: date, symbol, features, target, regime, solid_eligible. Linear models of all
    refreshes come from one pass over the labels; each tree model is one distributed fit per
    refresh. The driver holds coefficients only.
    """
    target, feats = cfg.target, list(cfg.features)
    labels = [target] + (["future_open_return"] if cfg.kind == "net" else [])
    # The net variant also learns from the state of the market, where the panel has it.
    context = [c for c in CONTEXT if c in panel.columns] if cfg.kind == "net" else []
    rows = cut(panel.select("date", "symbol", "regime", "solid_eligible", *feats, *labels, *context))
    cal = sessions(rows)
    live_names = valid_dates_semi(rows, cfg.min_names)
    labelled = cut(live_names.na.drop(subset=[*feats, *labels]))
    folds = cut(continuous_folds(cal, cfg.min_train, cfg.validation, cfg.embargo, cfg.refresh))
    members = cut(fold_range_join(cal, folds).unionByName(_live_members(cal, folds)))
    usable = _usable_folds(labelled, members, cfg)
    dates = lambda role: members.where(F.col("role") == role).join(
        usable.select("fold"), "fold", "left_semi").select("fold", "date")

    val = labelled.join(dates("validation"), "date")
    test = live_names.na.drop(subset=feats)
    count = test.groupBy("date").agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.min_names)
    # Dates whose fold had too few labels keep the models of the last usable refresh.
    test = test.join(count.select("date"), "date", "left_semi").join(_carry_folds(members, usable), "date")

    val, test = _base_predictions(labelled, val, test, dates, usable, cal, folds, cfg)
    ranks = {f"pred_{m}": f"rank_{m}" for m in cfg.models}
    names = list(ranks.values())
    val = cut(pct_rank(val, ranks, by=["fold", "date"], universe=cfg.universe))
    test = cut(pct_rank(test, ranks, universe=cfg.universe))

    val_dates = val.select("fold", "date", "regime").distinct()
    router = cut(ME.regime_router(ME.model_ic(val, names, target, universe=cfg.universe), val_dates))
    val = ewma_score(ME.blend_score(val, router, names), "raw_score", cfg.span, "smooth_score", by=["fold", "symbol"])
    test = ewma_score(ME.blend_score(test, router, names), "raw_score", cfg.span, "smooth_score")

    inputs = [*names, "raw_score", "smooth_score", *feats, *context]
    cols = [*inputs, *[f"regime_{r.lower()}" for r in REGIMES]]
    val = cut(ME.meta_label(ME.meta_features(fit_or_calibrate(val, cfg), inputs), cfg.kind))
    layer, cal_rows = _meta_layer(val, cols, cfg)
    chosen = _thresholds(cal_rows, cfg)
    meta = layer.join(chosen, "fold")
    scored = _decide(ME.meta_features(test, inputs), meta, cols, cfg)
    refreshes = usable.join(router.groupBy("fold").agg(F.count("*").alias("router_rows")), "fold").join(meta.drop("coef"), "fold")
    return scored, refreshes


def _live_members(cal: DataFrame, folds: DataFrame) -> DataFrame:
    span = folds.select("fold", F.explode(F.sequence(F.lit(0), F.col("live_stop") - F.lit(1))).alias("idx"))
    return span.join(cal, "idx").select("fold", F.lit("live").alias("role"), "date")


def _usable_folds(labelled: DataFrame, members: DataFrame, cfg: WalkForward) -> DataFrame:
    """Folds with enough labelled training and validation dates."""
    have = labelled.select("date").distinct()
    n = lambda role: F.count_if(F.col("role") == role)
    counts = members.join(have, "date").groupBy("fold").agg(
        n("train").alias("train_dates"), n("validation").alias("validation_dates"), n("live").alias("live_dates"))
    return cut(counts.where(
        (F.col("train_dates") >= cfg.min_train) & (F.col("live_dates") > 0)
        & (F.col("validation_dates") >= max(20, cfg.validation // 2))))


def _carry_folds(members: DataFrame, usable: DataFrame) -> DataFrame:
    """(date, fold): the last usable refresh at or before each test date (calendar sized)."""
    t = members.where("role = 'test'").select("date", "fold").join(
        usable.select("fold", F.col("fold").alias("_ok")), "fold", "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("fold", F.last("_ok", ignorenulls=True).over(w)).drop("_ok")
    return t.where(F.col("fold").isNotNull())


def _base_predictions(labelled, val, test, dates, usable, cal, folds, cfg: WalkForward):
    feats, target = list(cfg.features), cfg.target
    if "momentum" in cfg.models:
        val, test = ME.momentum_base(val), ME.momentum_base(test)
    if "ridge" in cfg.models:
        gram = cut(MO.gram_by_date(labelled, feats, target))
        wanted = folds.join(usable.select("fold"), "fold", "left_semi")
        fits = [MO.ridge_prefix_fits(gram, cal, wanted, len(feats), standardize=True, stop=s) for s in ("train_stop", "live_stop")]
        val = MO.linear_predict(val, fits[0], feats, "pred_ridge")
        test = MO.linear_predict(test, fits[1], feats, "pred_ridge")
    trees = [m for m in ("gbt", "ensemble") if m in cfg.models]
    if not trees:
        return val, test
    val, test = cut(val), cut(test)
    needed = labelled.select("date", "symbol", target, *feats)
    # Training dates are all up to one: a fit reads its part of the stored rows, which are not written again for each.
    each = dates("train").withColumn("role", F.lit("train")).unionByName(dates("live").withColumn("role", F.lit("live")))
    ends = each.groupBy("role", "fold").agg(F.max("date").alias("end")).collect()
    known = needed.groupBy("date").count().collect()  # one row a session
    tasks = sorted(((r["role"] != "train", r["fold"], r["end"], sum(x["count"] for x in known if x["date"] <= r["end"])) for r in ends))

    def one(task: tuple) -> DataFrame:
        live, k, end, rows = task
        fit = needed.where(F.col("date") <= F.lit(end))
        out = (test if live else val).where(F.col("fold") == k)
        if "gbt" in trees:
            out, _ = MO.gbt_fit_predict(fit, out, feats, target, "pred_gbt", rows=rows, **cfg.boosting)
        if "ensemble" in trees:
            out, _ = MO.reweighted_ensemble(fit, out, feats, target, "pred_ensemble", cut, drop=discard, rows=rows, **cfg.boosting)
        return cut(out)

    done = MO.at_once(one, tasks, max(t[3] for t in tasks), most=2 * MO.FITS_AT_ONCE)
    half = len(done) // 2
    return together(done[:half]), together(done[half:])


def fit_or_calibrate(val: DataFrame, cfg: WalkForward) -> DataFrame:
    """Flag the early validation dates for fitting and, after an embargo, the late ones for
    calibration; with fewer than ten late dates the embargo is given up."""
    w = Window.partitionBy("fold")
    d = val.select("fold", "date").distinct().withColumns({
        "_i": F.row_number().over(w.orderBy("date")) - F.lit(1), "_n": F.count("*").over(w)})
    split = F.greatest(F.lit(cfg.min_fit), F.floor(F.col("_n") * F.lit(cfg.fit_share)))
    start = F.least(F.col("_n"), split + F.lit(cfg.embargo))
    start = F.when(F.col("_n") - start < 10, split).otherwise(start)
    d = d.withColumns({"_fit": F.col("_i") < split, "_cal": F.col("_i") >= start})
    d = d.withColumn("_cal", F.col("_cal") | (F.col("_fit") & (F.max(F.col("_cal").cast("int")).over(w) == 0)))
    return val.join(d.select("fold", "date", "_fit", "_cal"), ["fold", "date"])


def _meta_layer(val: DataFrame, cols: Sequence[str], cfg: WalkForward) -> tuple[DataFrame, DataFrame]:
    """Coefficients of the trade filter per refresh, and calibration rows with their probability; all refreshes are fitted together."""
    fits = MO.meta_classifiers(val.where("_fit"), cols, c=cfg.logistic_c, cut=cut)
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
    late = cut(MO.linear_predict(val.where("_cal"), fits, cols, "_z").withColumn("raw_prob", raw))
    platt = MO.platt_calibrations(late, cut=cut)
    layer = fits.join(platt.select("fold", F.col("a").alias("platt_a"), F.col("b").alias("platt_b")), "fold", "left")
    z = F.col("platt_a") * ME.logit("raw_prob") + F.col("platt_b")
    prob = F.when(F.col("platt_a").isNull(), F.col("raw_prob")).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    cal_rows = late.join(layer.select("fold", "platt_a", "platt_b"), "fold").withColumn("prob", prob).drop("_z", "platt_a", "platt_b")
    return layer, cut(cal_rows)


def _thresholds(cal_rows: DataFrame, cfg: WalkForward) -> DataFrame:
    if cfg.kind == "relative":
        best = ME.threshold_search(cal_rows).where("selected")
        return best.select(F.col("fold").cast("long").alias("fold"), "threshold", F.lit(1 << 30).alias("long_count"))
    best = ME.portfolio_grid_search(cal_rows).where("selected")
    return best.select(F.col("fold").cast("long").alias("fold"), "threshold", "long_count")


def _decide(test: DataFrame, meta: DataFrame, cols: Sequence[str], cfg: WalkForward) -> DataFrame:
    out = MO.linear_predict(test.withColumn("fold", F.col("fold").cast("long")), meta, cols, "_z")
    out = out.join(meta.select("fold", "platt_a", "platt_b", "threshold", "long_count"), "fold")
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
    z = F.col("platt_a") * ME.logit(raw) + F.col("platt_b")
    out = out.withColumn("prob", F.when(F.col("platt_a").isNull(), raw).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
    out = prob_sizing(out, "v5" if cfg.kind == "relative" else "v6").withColumn("_ok", F.col("prob") >= F.col("threshold"))
    # The count kept per date comes with the refresh, so the flag is taken on the rank.
    out = first_rank_filter(out, "smooth_score", "_ok", 1 << 30, universe=cfg.universe)
    keep = F.col("_ok") & (F.col("selected_rank") <= F.col("long_count"))
    return out.select(
        "date", "symbol", "regime", F.col("fold").alias("refresh_id"), "raw_score", "smooth_score", "prob", "threshold",
        F.when(keep, F.col("size")).otherwise(0.0).alias("position_scale"),
        F.when(keep, F.col("smooth_score")).alias("trade_score"))
