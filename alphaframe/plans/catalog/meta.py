"""Folds, models and the meta layer."""

from pyspark.sql import functions as F

from ...operators import folds as FO
from ...operators import meta as ME
from ...operators import metrics as M
from ...operators import models as MO
from ...operators import portfolio as P
from ...operators.calendar import fold_range_join, sessions
from ...operators.quality import coverage_report, data_quality, validation_gate
from ...operators.research import MODEL_FEATURES
from ...operators.technical import execution_target
from ...sources.store import panel_metadata
from ..materialize import cut, discard
from ..walk_forward import WalkForward, fit_or_calibrate, walk_forward_oos
from . import inputs as I
from .base import cte, register, six
from .portfolio import BASE, SCENARIOS, bench, ev
from .research import ic_sql
from .windows import context

_SIMPLE = """
SELECT CAST(row_number() OVER (ORDER BY s) AS INT) AS fold, s - 20 AS train_stop, s AS test_start, least(s + t, n) AS test_stop
FROM (SELECT n, t, unnest(range(st, n, t)) AS s FROM (SELECT n,
  CASE WHEN n < 630 THEN greatest(252, CAST(floor(n * 0.55) AS BIGINT)) ELSE 504 END AS st,
  CASE WHEN n < 630 THEN greatest(63, CAST(floor(n * 0.15) AS BIGINT)) ELSE 126 END AS t FROM (SELECT count(*) AS n FROM {cal})))
WHERE s - 20 >= 126 AND least(s + t, n) - s >= 20"""
cte("simple_d", _SIMPLE.format(cal="cal"), ["cal"])
cte("simple_w", _SIMPLE.format(cal="cal_w"), ["cal_w"])
cte("cont_d", """
SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS fold, i - 103 AS train_stop, i - 83 AS val_start, i - 20 AS val_stop, i AS test_start,
  least(i + 20, n) AS test_stop FROM (SELECT n, unnest(range(229, n, 20)) AS i FROM (SELECT count(*) AS n FROM cal))""", ["cal"])


@register("fold_plan", """
SELECT 'simple' AS kind, fold, CAST(train_stop AS INT) AS train_stop, NULL::INT AS val_start, NULL::INT AS val_stop,
  CAST(test_start AS INT) AS test_start, CAST(test_stop AS INT) AS test_stop FROM simple_d
UNION ALL SELECT 'continuous', fold, train_stop, val_start, val_stop, test_start, test_stop FROM cont_d""", ["simple_d", "cont_d"])
def _(spark, sf):
    cal = I.cal(spark, sf)
    s = FO.simple_folds(cal).withColumn("kind", F.lit("simple"))
    return s.unionByName(FO.continuous_folds(cal).drop("live_stop").withColumn("kind", F.lit("continuous")))


@register("fold_range_join", """
SELECT fold, 'train' AS role, date FROM simple_w JOIN cal_w ON idx < train_stop
UNION ALL SELECT fold, 'test', date FROM simple_w JOIN cal_w ON idx >= test_start AND idx < test_stop""", ["simple_w", "cal_w"])
def _(spark, sf):
    cal = I.cal_w(spark, sf)
    return fold_range_join(cal, FO.simple_folds(cal))


@register("valid_dates_semi", """
SELECT date, symbol FROM panel_w WHERE ret_1d > 0 AND date IN (
  SELECT date FROM panel_w WHERE ret_1d > 0 GROUP BY date HAVING count(DISTINCT symbol) >= 30)""", ["panel_w"])
def _(spark, sf):
    df = I.panel_w(spark, sf).withColumn("up", F.coalesce(F.col("ret_1d") > 0, F.lit(False)))
    return FO.valid_dates_semi(df, 30, "up").select("date", "symbol")


@register("attach_oos_scores", """SELECT date, symbol, score, CASE WHEN score > 0.5 THEN 1 - score END AS score_oos
FROM panel_w""", ["panel_w"], six("score", "score_oos"))
def _(spark, sf):
    p = I.panel_w(spark, sf).select("date", "symbol", "score")
    return FO.attach_oos_scores(p, p.where("score > 0.5").withColumn("score", 1 - F.col("score")))


@register("momentum_base", "SELECT date, symbol, coalesce(momentum_12_1_rank, 0.5) - 0.5 AS pred_momentum FROM panel", ["panel"], six("pred_momentum"))
def _(spark, sf):
    return ME.momentum_base(I.panel(spark, sf)).select("date", "symbol", "pred_momentum")


# --- blending --------------------------------------------------------------------------------

MODELS = ("ret_60d_rank", "trend_200_rank", "low_vol_rank", "momentum_12_1_rank")
cte("mf", f"""SELECT p.date, symbol, idx // 250 AS fold, regime, future_relative_20d, {', '.join(MODELS)}
FROM panel p JOIN cal_p c ON c.date = p.date JOIN ctx x ON x.date = p.date""", ["panel", "cal_p", "ctx"])
cte("mlong", f"SELECT * FROM mf UNPIVOT (score FOR model IN ({', '.join(MODELS)}))", ["mf"])
cte("mic", ic_sql("score", "future_relative_20d", "mlong", "fold, date, model"), ["mlong"])
_W = """SELECT {k}, model, CASE WHEN sum(q) OVER (PARTITION BY {k}) > 1e-12 THEN q / sum(q) OVER (PARTITION BY {k})
  ELSE 1.0 / count(*) OVER (PARTITION BY {k}) END AS weight
FROM (SELECT {k}, model, greatest(coalesce(avg(ic), 0), 0) * greatest(coalesce(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 0), 0.35) AS q
  FROM {s} GROUP BY {k}, model)"""
cte("bw", _W.format(k="fold", s="mic"), ["mic"])
cte("mdates", "SELECT DISTINCT fold, date, regime FROM mf", ["mf"])
cte("micr", "SELECT m.*, regime FROM mic m JOIN mdates d ON d.fold = m.fold AND d.date = m.date", ["mic", "mdates"])
cte("bwr", _W.format(k="fold, regime", s="micr"), ["micr"])
cte("router", """
SELECT g.fold, r.regime, g.model, CASE WHEN coalesce(n, 0) >= 20 THEN coalesce(o.weight, g.weight) ELSE g.weight END AS weight
FROM bw g CROSS JOIN (VALUES ('TREND_UP'), ('NEUTRAL'), ('HIGH_VOL'), ('RISK_OFF')) r(regime)
LEFT JOIN bwr o ON o.fold = g.fold AND o.regime = r.regime AND o.model = g.model
LEFT JOIN (SELECT fold, regime, count(*) AS n FROM mdates GROUP BY 1, 2) c ON c.fold = g.fold AND c.regime = r.regime""", ["bw", "bwr", "mdates"])


def blend_frame(spark, sf):
    p = cut(I.panel(spark, sf).select("date", "symbol", "future_relative_20d", *MODELS))
    ctx = context(spark, sf).select("date", "regime")
    return cut(p.join(sessions(p), "date").join(ctx, "date").withColumn("fold", F.floor(F.col("idx") / 250)))


@register("ic_blend_weights", "SELECT * FROM bw", ["bw"], six("weight"))
def _(spark, sf):
    return ME.ic_blend_weights(ME.model_ic(blend_frame(spark, sf), MODELS, "future_relative_20d"))


def routed(spark, sf):
    f = blend_frame(spark, sf)
    return f, ME.regime_router(ME.model_ic(f, MODELS, "future_relative_20d"), f.select("fold", "date", "regime").distinct())


@register("regime_router", "SELECT * FROM router", ["router"], six("weight"))
def _(spark, sf):
    return routed(spark, sf)[1]


@register("blend_score", """SELECT l.date, l.symbol, sum(score * weight) AS raw_score FROM mlong l
JOIN router r ON r.fold = l.fold AND r.regime = l.regime AND r.model = l.model GROUP BY 1, 2""", ["mlong", "router"], six("raw_score"))
def _(spark, sf):
    f, router = routed(spark, sf)
    return ME.blend_score(f.na.drop(subset=list(MODELS)), router, MODELS).select("date", "symbol", "raw_score")


# --- calibration frame on the weekly panel ---------------------------------------------------

cte("cf", """SELECT p.date, p.symbol, idx // 100 AS fold, idx, p.score AS smooth_score, future_relative_20d,
  lead(open, 11) OVER w / lead(open, 1) OVER w - 1 AS future_open_return,
  0.3 + 0.6 * ((CAST(p.symbol AS BIGINT) * 37 + idx * 11) % 101) / 101.0 AS prob
FROM panel_w p JOIN cal_w c ON c.date = p.date WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date)""", ["panel_w", "cal_w"])


def cal_frame(spark, sf):
    df = execution_target(I.panel_w(spark, sf), universe=I.universe_size(spark, sf)).join(I.cal_w(spark, sf), "date")
    prob = 0.3 + 0.6 * ((F.col("symbol").cast("bigint") * 37 + F.col("idx") * 11) % 101) / 101.0
    return cut(df.select(
        "date", "symbol", F.floor(F.col("idx") / 100).alias("fold"), "idx", F.col("score").alias("smooth_score"),
        "future_relative_20d", "future_open_return", prob.alias("prob")))


@register("meta_label", """SELECT date, symbol, CAST(coalesce(future_relative_20d > 0, FALSE) AS INT) AS relative_label,
  CAST(coalesce(future_open_return > 0.0022, FALSE) AS INT) AS net_label FROM cf""", ["cf"])
def _(spark, sf):
    df = ME.meta_label(cal_frame(spark, sf)).withColumnRenamed("label", "relative_label")
    return ME.meta_label(df, "net").select("date", "symbol", "relative_label", F.col("label").alias("net_label"))


cte("ts", """SELECT *, CASE WHEN acceptance_rate >= 0.15 THEN round(mean_target * sqrt(greatest(accepted, 1)), 10) END AS objective FROM (
 SELECT fold, t AS threshold, count(*) FILTER (prob >= t) AS accepted, avg(future_relative_20d) FILTER (prob >= t) AS mean_target,
   count(*) FILTER (prob >= t) / count(*) AS acceptance_rate
 FROM cf, (VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65)) g(t) WHERE future_relative_20d IS NOT NULL GROUP BY fold, t)""", ["cf"])


@register("threshold_search", """SELECT fold, threshold, accepted, mean_target, acceptance_rate, objective,
  CASE WHEN max(objective) OVER (PARTITION BY fold) IS NOT NULL
    THEN row_number() OVER (PARTITION BY fold ORDER BY objective DESC NULLS LAST, threshold) = 1 ELSE threshold = 0.55 END AS selected FROM ts""",
          ["ts"], six("mean_target", "acceptance_rate", "objective"))
def _(spark, sf):
    return ME.threshold_search(cal_frame(spark, sf).where("future_relative_20d is not null"))


cte("pg0", """SELECT c.* FROM cf c JOIN (SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY date) - 1 AS i FROM
  (SELECT DISTINCT fold, date FROM cf WHERE smooth_score IS NOT NULL AND future_open_return IS NOT NULL)) d
ON d.fold = c.fold AND d.date = c.date WHERE i % 10 = 0 AND smooth_score IS NOT NULL AND future_open_return IS NOT NULL""", ["cf"])
cte("pg1", """SELECT *, 0.1 + 0.9 * pow(least(greatest((prob - t) / greatest(0.9 - t, 0.1), 0), 1), 1.25) AS size,
  row_number() OVER (PARTITION BY fold, t, date ORDER BY smooth_score DESC, symbol) AS rk
FROM pg0, (VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65), (0.7), (0.75)) g(t) WHERE prob >= t""", ["pg0"])
cte("pg2", """SELECT fold, t, k, date, count(*) AS n, avg(size * (future_open_return - 0.0022)) AS r
FROM pg1, (VALUES (8), (10), (12), (15)) c(k) WHERE rk <= k GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""", ["pg1"])
cte("pg", """
SELECT g.fold, g.t AS threshold, g.k AS long_count, coalesce(periods, 0) AS periods, coalesce(acc / names, 0) AS acceptance_rate,
  CASE WHEN periods >= 4 THEN round(m / (v + 1e-12) - 0.15 * abs(least(w, 0)), 10) END AS objective
FROM (SELECT fold, t, k, names FROM (SELECT fold, count(*) AS names FROM pg0 GROUP BY 1), (VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65), (0.7), (0.75)) a(t),
  (VALUES (8), (10), (12), (15)) b(k)) g
LEFT JOIN (SELECT fold, t, k, count(*) AS periods, sum(n) AS acc, avg(r) AS m, stddev_samp(r) AS v, min(r) AS w FROM pg2 GROUP BY 1, 2, 3) s
ON s.fold = g.fold AND s.t = g.t AND s.k = g.k""", ["pg0", "pg2"])


@register("portfolio_grid_search", """SELECT *, CASE WHEN max(objective) OVER (PARTITION BY fold) IS NOT NULL
  THEN row_number() OVER (PARTITION BY fold ORDER BY objective DESC NULLS LAST, threshold, long_count) = 1
  ELSE threshold = 0.65 AND long_count = 12 END AS selected FROM pg""", ["pg"], six("acceptance_rate", "objective"))
def _(spark, sf):
    return ME.portfolio_grid_search(cal_frame(spark, sf).where("smooth_score is not null and future_open_return is not null"))


cte("sc", "SELECT *, CASE WHEN prob >= 0.6 THEN smooth_score END AS trade_score FROM cf WHERE smooth_score IS NOT NULL", ["cf"])


def scored(spark, sf):
    df = cal_frame(spark, sf).where("smooth_score is not null")
    return df.withColumn("trade_score", F.when(F.col("prob") >= 0.6, F.col("smooth_score")))


@register("latest_signals", """SELECT date, symbol, prob, row_number() OVER (ORDER BY trade_score DESC NULLS LAST, symbol) AS rank,
  trade_score IS NOT NULL AS accepted, count(trade_score) OVER () AS accepted_count FROM sc WHERE date = (SELECT max(date) FROM sc)""",
          ["sc"], six("prob"))
def _(spark, sf):
    return ME.latest_signals(scored(spark, sf), universe=I.universe_size(spark, sf)).select("date", "symbol", "prob", "rank", "accepted", "accepted_count")


cte("sic", ic_sql("smooth_score", "future_relative_20d", "sc", "fold, date"), ["sc"])
_R = "avg(ic) AS rank_ic, CASE WHEN count(ic) > 1 THEN avg(ic) / (stddev_samp(ic) + 1e-12) END AS ic_ir, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive_ic_ratio, count(ic) AS days"


@register("refresh_report", f"""
SELECT refresh_id, rank_ic, ic_ir, positive_ic_ratio, days, acceptance_rate FROM (SELECT fold, {_R} FROM sic GROUP BY fold) a
FULL JOIN (SELECT fold AS refresh_id, count(trade_score) / count(*) AS acceptance_rate FROM sc GROUP BY fold) b ON a.fold = b.refresh_id
UNION ALL SELECT NULL, *, (SELECT count(trade_score) / count(*) FROM sc) FROM (SELECT {_R} FROM sic)""", ["sc", "sic"],
          six("rank_ic", "ic_ir", "positive_ic_ratio", "acceptance_rate"))
def _(spark, sf):
    df = scored(spark, sf).withColumnRenamed("fold", "refresh_id")
    return ME.refresh_report(df, "smooth_score", "future_relative_20d", "trade_score", universe=I.universe_size(spark, sf))


@register("coverage_report", """
SELECT count(*) AS sessions, count(*) FILTER (idx >= 140) AS expected_sessions, (SELECT count(DISTINCT date) FROM sc) AS scored_sessions,
  (SELECT count(DISTINCT date) FROM sc) / count(*) AS coverage_ratio,
  (SELECT count(DISTINCT date) FROM sc) / count(*) FILTER (idx >= 140) AS post_startup_coverage_ratio FROM cal_w""", ["sc", "cal_w"],
          six("coverage_ratio", "post_startup_coverage_ratio"))
def _(spark, sf):
    return coverage_report(scored(spark, sf), I.cal_w(spark, sf), 140)


_SHOWN = "CASE WHEN abs(value) > 1e6 THEN sign(value) * ln(abs(value)) ELSE value END"
cte("gate_inputs", """
SELECT (SELECT (max(status) = 'PASS')::INT FROM quality) AS quality, (SELECT (count(*) > 0)::INT FROM panel) AS provenance,
  (SELECT bool_and(entry_idx = signal_idx + 1)::INT FROM sched WHERE scenario = 'base') AS timing,
  (SELECT (count(DISTINCT date) = count(DISTINCT (fold, date)))::INT FROM sc) AS strict,
  (SELECT (count(*) FILTER (news_raw <> 0 AND date < (SELECT max(date) FROM bars)) = 0)::INT FROM panel) AS news,
  (SELECT count(DISTINCT date) FROM sc) / (SELECT count(*) FILTER (idx >= 140) FROM cal_w) AS coverage,
  (SELECT quantile_cont(k, 0.5) FROM (SELECT count(DISTINCT symbol) AS k FROM panel WHERE solid_eligible GROUP BY date)) AS breadth,
  m.sharpe, m.cagr, (SELECT avg(ic) FROM sic) AS ic, (SELECT avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) FROM sic) AS ic_days,
  (SELECT avg((f > 0)::INT) FROM (SELECT avg(ic) AS f FROM sic GROUP BY fold)) AS folds, m.max_drawdown,
  (SELECT p.cagr - b.cagr FROM perf p, bench_perf b WHERE p.scenario = 'base') AS excess, m.avg_turnover,
  (SELECT count(trade_score) / count(*) FROM sc) AS acceptance, r.med, r.low, r.stress::INT AS stress
FROM metrics m, (SELECT quantile_cont(sharpe, 0.5) AS med, min(sharpe) AS low,
    coalesce(bool_and(sharpe > 0) FILTER (scenario IN ('cost_x2', 'cost_x3')), TRUE) AS stress FROM metrics) r
WHERE m.scenario = 'base'""", ["quality", "panel", "sched", "sc", "bars", "cal_w", "sic", "perf", "bench_perf", "metrics"])


@register("validation_gate", f"""
WITH c AS (
  SELECT u.*, CASE WHEN name = 'beats_equal_weight_cagr' THEN value > threshold
    WHEN name = 'turnover_under_35pct' THEN value <= threshold
    WHEN name = 'meta_filter_not_degenerate' THEN value BETWEEN 0.10 AND threshold ELSE value >= threshold END AS good
  FROM gate_inputs g, LATERAL (VALUES ('data_quality', 'core', g.quality::DOUBLE, 1.0::DOUBLE), ('dataset_provenance', 'core', g.provenance, 1.0),
    ('execution_timing', 'core', g.timing, 1.0), ('strict_continuous_oos', 'core', g.strict, 1.0),
    ('historical_news_no_leakage', 'core', g.news, 1.0), ('post_startup_coverage_at_least_95pct', 'core', g.coverage, 0.95),
    ('eligible_universe_breadth', 'core', g.breadth, 25.0), ('sharpe_at_least_0_75', 'quality', g.sharpe, 0.75),
    ('cagr_at_least_5pct', 'quality', g.cagr, 0.05), ('oos_rank_ic_at_least_0_02', 'quality', g.ic, 0.02),
    ('positive_oos_ic_days', 'quality', g.ic_days, 0.55), ('positive_oos_folds', 'quality', g.folds, 0.60),
    ('max_drawdown_better_than_minus_25pct', 'quality', g.max_drawdown, -0.25),
    ('beats_equal_weight_cagr', 'quality', nullif(g.excess, 0), 0.0), ('turnover_under_35pct', 'quality', nullif(g.avg_turnover, 0), 0.35),
    ('meta_filter_not_degenerate', 'quality', g.acceptance, 0.80), ('robustness_median_sharpe', 'quality', g.med, 0.50),
    ('robustness_worst_case_positive', 'quality', g.low, 0.0), ('cost_stress_x2_x3', 'quality', g.stress, 1.0)) u(name, part, value, threshold)
), v AS (SELECT *, coalesce(good, FALSE) AS ok FROM c)
SELECT name, part, {_SHOWN} AS value, threshold, ok, bool_and(ok) OVER () AS passed,
  CASE WHEN bool_and(ok) OVER () THEN 'PAPER_READY' WHEN bool_and(ok OR part <> 'core') OVER ()
    AND count(*) FILTER (part = 'quality' AND ok) OVER () >= 8 THEN 'CANDIDATE' ELSE 'RESEARCH_ONLY' END AS tier FROM v""",
          ["gate_inputs"], six("value"))
def _(spark, sf):
    """The gate over the reports of one run; each report is one row or one per refresh."""
    e = ev(spark, sf, SCENARIOS)
    metrics, daily = cut(e.metrics), cut(e.daily.where("scenario = 'base'"))
    panel = cut(I.panel(spark, sf, complete=False).select("date", "symbol", "meta_score", "fundamental_raw", "solid_eligible", "news_raw"))
    full = panel.where("meta_score is not null")
    sc = cut(scored(spark, sf))
    quality = data_quality(panel).first()
    meta = panel_metadata(full.select("date", "symbol", "solid_eligible")).first()
    timing = P.schedules(I.cal_w(spark, sf), BASE).agg(F.every(F.col("entry_idx") == F.col("signal_idx") + 1)).first()[0]
    strict = sc.agg(F.countDistinct("date") == F.countDistinct("fold", "date")).first()[0]
    leaked = full.where((F.col("news_raw") != 0) & (F.col("date") < I.last_session(spark, sf))).isEmpty()
    cover = coverage_report(sc, I.cal_w(spark, sf), 140).first()
    refresh = ME.refresh_report(sc.withColumnRenamed("fold", "refresh_id"), "smooth_score", "future_relative_20d", "trade_score").collect()
    whole = next(r for r in refresh if r["refresh_id"] is None)
    folds = [r["rank_ic"] for r in refresh if r["refresh_id"] is not None and r["rank_ic"] is not None]
    robust = M.robustness_summary(metrics, ["cost_x2", "cost_x3"]).first()
    perf = M.period_performance(daily, ["scenario"], 100_000.0)
    excess = M.excess_vs_benchmark(perf, M.period_performance(bench(spark, sf, daily), initial=100_000.0)).first()
    values = {
        "data_quality_pass": quality["status"] == "PASS", "has_fingerprint": bool(meta["fingerprint"]), "next_open_execution": timing,
        "strict_oos": strict, "news_neutral": leaked, "post_startup_coverage_ratio": cover["post_startup_coverage_ratio"],
        "solid_eligible_symbols_median": meta["solid_eligible_symbols_median"], "oos_mean_rank_ic": whole["rank_ic"],
        "positive_oos_ic_ratio": whole["positive_ic_ratio"], "positive_fold_ratio": sum(x > 0 for x in folds) / len(folds) if folds else None,
        "excess_cagr_vs_equal_weight": excess["excess_cagr_vs_equal_weight"], "acceptance_rate": whole["acceptance_rate"],
        "robust_median_sharpe": robust["median_sharpe"], "robust_min_sharpe": robust["min_sharpe"], "cost_stress_pass": robust["cost_stress_pass"],
    }
    one = metrics.where("scenario = 'base'").select("sharpe", "cagr", "max_drawdown", "avg_turnover").withColumns(
        {k: F.lit(v) if isinstance(v, bool) else F.lit(v).cast("double") for k, v in values.items()})
    size = F.abs("value")
    return validation_gate(one).withColumn("value", F.when(size > 1e6, F.signum("value") * F.log(size)).otherwise(F.col("value")))


# --- models ----------------------------------------------------------------------------------


def model_panel(spark, sf, *extra):
    return cut(I.panel(spark, sf).select("date", "symbol", "future_relative_20d", *MODEL_FEATURES, *extra))


FEATS = list(MODEL_FEATURES)
K = len(FEATS)


def ridge_sql(folds: str, alpha: float = 10.0) -> str:
    """fold, intercept and coefficients by elimination of the normal equations, one pivot a step."""
    x = [f"{f}::DOUBLE" for f in FEATS]
    row = lambda i: "[" + ", ".join(
        f"n * covar_pop_{min(i, j)}_{max(i, j)}" + (f" + {alpha}" if i == j else "") for j in range(K)) + f", n * covar_y_{i}]"
    covs = ", ".join(f"covar_pop({x[i]}, {x[j]}) AS covar_pop_{i}_{j}" for i in range(K) for j in range(i, K))
    ys = ", ".join(f"covar_pop({x[i]}, future_relative_20d) AS covar_y_{i}" for i in range(K))
    return f"""
WITH RECURSIVE sums AS MATERIALIZED (
  SELECT fold, count(*) AS n, avg(future_relative_20d) AS my, [{", ".join(f"avg({c})" for c in x)}] AS mx, {covs}, {ys}
  FROM ({folds}) GROUP BY fold
), gone(fold, p, m) AS (
  SELECT fold, 1, [{", ".join(row(i) for i in range(K))}] FROM sums
  UNION ALL
  SELECT fold, p + 1, list_transform(range(1, {K + 1}), lambda r: CASE WHEN r = p THEN top
    ELSE list_transform(range(1, {K + 2}), lambda c: m[r][c] - m[r][p] * top[c]) END)
  FROM (SELECT *, list_transform(m[p], lambda v: v / m[p][p]) AS top FROM gone WHERE p <= {K})
), fit AS (SELECT fold, list_transform(m, lambda r: r[{K + 1}]) AS coef FROM gone WHERE p = {K + 1})
SELECT f.fold, coef, my - list_sum(list_transform(range(1, {K + 1}), lambda i: coef[i] * mx[i])) AS intercept FROM fit f JOIN sums USING (fold)"""


_DOT = " + ".join(f"{f} * coef[{i + 1}]" for i, f in enumerate(FEATS))
cte("mp", f"SELECT date, symbol, future_relative_20d, {', '.join(FEATS)} FROM panel WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATS)}", ["panel"])
cte("cal_m", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM mp)", ["mp"])
cte("simple_m", _SIMPLE.format(cal="cal_m"), ["cal_m"])
cte("ridge_w", ridge_sql("SELECT f.fold, p.* FROM simple_m f JOIN cal_m c ON c.idx < f.train_stop JOIN mp p ON p.date = c.date WHERE future_relative_20d IS NOT NULL"),
    ["simple_m", "cal_m", "mp"])
cte("ridge_1", ridge_sql("SELECT 1 AS fold, * FROM mp WHERE future_relative_20d IS NOT NULL"), ["mp"])


@register("ridge_expanding", f"""SELECT f.fold, p.date, symbol, intercept + {_DOT} AS model_score
FROM simple_m f JOIN ridge_w USING (fold) JOIN cal_m c ON c.idx >= f.test_start AND c.idx < f.test_stop JOIN mp p ON p.date = c.date""",
          ["simple_m", "ridge_w", "cal_m", "mp"], six("model_score"))
def _(spark, sf):
    p = model_panel(spark, sf).na.drop(subset=FEATS)
    cal = cut(sessions(p))
    return MO.ridge_expanding(p, cal, cut(FO.simple_folds(cal)), FEATS, "future_relative_20d").select("fold", "date", "symbol", "model_score")


@register("latest_prediction", f"""SELECT date, symbol, intercept + {_DOT} AS prediction FROM mp, ridge_1 WHERE date = (SELECT max(date) FROM mp)
ORDER BY prediction DESC, symbol LIMIT 20""", ["mp", "ridge_1"], six("prediction"))
def _(spark, sf):
    return MO.latest_prediction(model_panel(spark, sf), FEATS, "future_relative_20d")


@register("model_importances", f"""SELECT fold, feature, importance, row_number() OVER (PARTITION BY fold ORDER BY abs(importance) DESC, feature) AS place
FROM (SELECT fold, unnest({FEATS!r}) AS feature, unnest(coef) AS importance FROM ridge_w)""", ["ridge_w"], six("importance"))
def _(spark, sf):
    """Coefficients of the ridge of every fold, largest first."""
    p = model_panel(spark, sf).na.drop(subset=FEATS)
    cal = cut(sessions(p))
    fits = MO.ridge_prefix_fits(MO.gram_by_date(p, FEATS, "future_relative_20d"), cal, FO.simple_folds(cal), K)
    return MO.importances(fits, FEATS)


@register("gbt_walk_forward")
def _(spark, sf):
    """Every fold is one distributed fit."""
    p = model_panel(spark, sf).na.drop(subset=[*MODEL_FEATURES])
    cal = cut(sessions(p))
    folds = cut(FO.simple_folds(cal))
    ks = [r["fold"] for r in folds.select("fold").collect()]
    out = MO.gbt_walk_forward(p, cut(fold_range_join(cal, folds)), MODEL_FEATURES, "future_relative_20d", ks)
    return out.select("fold", "date", "symbol", "model_score")


@register("reweighted_ensemble")
def _(spark, sf):
    p = model_panel(spark, sf).na.drop(subset=[*MODEL_FEATURES])
    cal = cut(sessions(p))
    at = cal.agg(F.floor(F.count("*") * 0.8)).scalar()
    p = p.join(cal, "date")
    train, test = p.where(F.col("idx") < at - 20), p.where(F.col("idx") >= at)
    out, _ = MO.reweighted_ensemble(cut(train), cut(test), MODEL_FEATURES, "future_relative_20d", "pred", cut, drop=discard)
    return out.select("date", "symbol", "pred")


def labelled_cal(spark, sf):
    """Labelled rows with the early dates flagged for fitting and, past the embargo, the late ones for calibration."""
    df = cal_frame(spark, sf).where("smooth_score is not null and future_relative_20d is not null")
    return cut(fit_or_calibrate(ME.meta_label(df).withColumn("fold", F.lit(0)), WalkForward()))


_WF = WalkForward()
cte("lab", f"""SELECT l.*, i < split AS fit, i >= CASE WHEN n - least(n, split + {_WF.embargo}) < 10 THEN split ELSE least(n, split + {_WF.embargo}) END AS late
FROM (SELECT date, symbol, smooth_score AS x1, prob AS x2, CAST(future_relative_20d > 0 AS INT) AS label FROM cf WHERE smooth_score IS NOT NULL AND future_relative_20d IS NOT NULL) l
JOIN (SELECT date, i, n, greatest({_WF.min_fit}, CAST(floor(n * {_WF.fit_share}) AS BIGINT)) AS split FROM (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM cf WHERE smooth_score IS NOT NULL AND future_relative_20d IS NOT NULL))) d
USING (date)""", ["cf"])
# Newton steps on standardised features with balanced classes; three unknowns by Cramer's rule.
cte("newton", """
WITH RECURSIVE base AS MATERIALIZED (
  SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, count(*) AS n, sum(label) AS k FROM lab WHERE fit
), z AS MATERIALIZED (
  SELECT label AS y, (x1 - m1) / s1 AS u, (x2 - m2) / s2 AS v, CASE label WHEN 1 THEN n / (2.0 * k) ELSE n / (2.0 * (n - k)) END AS w FROM lab, base WHERE fit
), step(i, b0, b1, b2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det, b1 + (a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det,
    b2 + (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM (
    SELECT i, b0, b1, b2, sum(w * (y - p)) AS g0, sum(w * (y - p) * u) - b1 / 0.35 AS g1, sum(w * (y - p) * v) - b2 / 0.35 AS g2, sum(w * p * (1 - p)) AS a,
      sum(w * p * (1 - p) * u) AS b, sum(w * p * (1 - p) * v) AS c, sum(w * p * (1 - p) * u * u) + 1 / 0.35 AS d, sum(w * p * (1 - p) * u * v) AS e,
      sum(w * p * (1 - p) * v * v) + 1 / 0.35 AS f
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p FROM step, z WHERE i < 12) GROUP BY i, b0, b1, b2)))
SELECT b0 - b1 * m1 / s1 - b2 * m2 / s2 AS c0, b1 / s1 AS c1, b2 / s2 AS c2 FROM step, base WHERE i = 12""", ["lab"])
cte("filtered", "SELECT date, symbol, label, late, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2))) AS raw FROM lab, newton", ["lab", "newton"])
cte("platt", """
WITH RECURSIVE z AS MATERIALIZED (
  SELECT label AS y, ln(least(greatest(raw, 1e-5), 1 - 1e-5) / (1 - least(greatest(raw, 1e-5), 1 - 1e-5))) AS u FROM filtered WHERE late
), step(i, b, a) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, b + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), a + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01)
  FROM (SELECT i, b, a, sum(y - p) AS g0, sum((y - p) * u) - a AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * u) AS h01, sum(p * (1 - p) * u * u) + 1 AS h11
    FROM (SELECT *, 1 / (1 + exp(-(b + a * u))) AS p FROM step, z WHERE i < 12) GROUP BY i, b, a))
SELECT a, b FROM step WHERE i = 12""", ["filtered"])


@register("meta_classifier", "SELECT date, symbol, label, raw AS p FROM filtered", ["filtered"], {"p": 4})
def _(spark, sf):
    df = labelled_cal(spark, sf)
    m = MO.meta_classifiers(df.where("_fit"), ["smooth_score", "prob"], cut=cut)
    out = MO.linear_predict(df, m, ["smooth_score", "prob"], "_z")
    return out.select("date", "symbol", "label", (1 / (1 + F.exp(-F.col("_z")))).alias("p"))


@register("platt_calibration", """SELECT date, symbol, label, 1 / (1 + exp(-(b + a * ln(least(greatest(raw, 1e-5), 1 - 1e-5) / (1 - least(greatest(raw, 1e-5), 1 - 1e-5)))))) AS p
FROM filtered, platt""", ["filtered", "platt"], {"p": 4})
def _(spark, sf):
    """A filter fitted on the early dates, calibrated on the late ones."""
    df = labelled_cal(spark, sf)
    m = MO.meta_classifier(df.where("_fit"), ["smooth_score", "prob"])
    raw = cut(MO.probability(df, m, ["smooth_score", "prob"], "raw_prob"))
    p = MO.platt_calibration(raw.where("_cal"))
    return MO.calibrated(raw, p, "raw_prob", "p").select("date", "symbol", "label", "p")


@register("walk_forward_oos")
def _(spark, sf):
    """All four models at their own size, on eligible rows, refitted every 20 sessions. The fixture has few names a day."""
    p = I.panel(spark, sf).join(context(spark, sf).select("date", "regime"), "date")
    return walk_forward_oos(p, WalkForward(min_names=3, universe=I.widest_session(spark, sf)))[0]
