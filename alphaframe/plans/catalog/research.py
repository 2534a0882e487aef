"""Factor research, rankings, and panel reports."""

from pyspark.sql import functions as F

from ...operators import research as R
from ...operators.quality import data_quality
from ...operators.ranks import explain_symbol, ranking_report
from ...operators.technical import forward_return, returns_n
from ...sources.store import panel_metadata
from ..materialize import cut
from . import inputs as I
from .base import cte, register, six

SUMMARY = ("mean_rank_ic", "ic_std", "ic_ir", "positive_ic_ratio")


def ic_sql(score: str, target: str, source: str, by: str = "date") -> str:
    """Spearman per group from average ranks of complete pairs."""
    avg = lambda c: (
        f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    )
    return f"""SELECT {by}, n, round(CASE WHEN sx * sy > 0 THEN cv / (sx * sy) END, 12) + 0.0 AS ic FROM (
  SELECT {by}, count(*) AS n, covar_pop(x, y) AS cv, stddev_pop(x) AS sx, stddev_pop(y) AS sy
  FROM (SELECT {by}, {avg(score)} AS x, {avg(target)} AS y FROM {source}
        WHERE {score} IS NOT NULL AND {target} IS NOT NULL) GROUP BY {by})"""


def ic_agg_sql(source: str, by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {key}avg(ic) AS mean_rank_ic, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) + 1e-12) AS ic_ir,
  avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive_ic_ratio, count(ic) AS days FROM {source} {group}"""


cte("ic_mom", ic_sql("momentum_12_1_rank", "future_relative_20d", "panel"), ["panel"])

cte("flag0", f"""SELECT *, 0.5 * {I.pct_sql('ret_20d')} + 0.5 * {I.pct_sql('ret_60d')} AS flag_score FROM tech""", ["tech"])
cte("flag_ic", ic_sql("flag_score", "future_relative_20d", "flag0"), ["flag0"])


@register("flagship", ic_agg_sql("flag_ic"), ["flag_ic"], six(*SUMMARY))
def _(spark, sf):
    """Transactions to bars, two momentum ranks, a linear score, and its rank IC summary."""
    n = I.widest_session(spark, sf)
    df = forward_return(returns_n(I.bars(spark, sf), [20, 60]), universe=n)
    df = R.pct_rank_columns(df, ["ret_20d", "ret_60d"], n)
    df = R.linear_score(df, {"ret_20d_rank": 0.5, "ret_60d_rank": 0.5}, "flag_score")
    return R.ic_summary(R.daily_rank_ic(df, "flag_score", universe=n))


@register("daily_rank_ic", "SELECT * FROM ic_mom WHERE ic IS NOT NULL", ["ic_mom"], six("ic"))
def _(spark, sf):
    return R.daily_rank_ic(I.panel(spark, sf), "momentum_12_1_rank", universe=I.widest_session(spark, sf))


@register("ic_summary", ic_agg_sql("ic_mom"), ["ic_mom"], six(*SUMMARY))
def _(spark, sf):
    return R.ic_summary(R.daily_rank_ic(I.panel(spark, sf), "momentum_12_1_rank", universe=I.widest_session(spark, sf)))


@register("monthly_ic", """SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(ic) AS ic FROM ic_mom
WHERE ic IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 36""", ["ic_mom"], six("ic"))
def _(spark, sf):
    return R.monthly_ic(R.daily_rank_ic(I.panel(spark, sf), "momentum_12_1_rank", universe=I.widest_session(spark, sf)))


@register("recent_ic", "SELECT date, ic FROM ic_mom WHERE ic IS NOT NULL ORDER BY date DESC LIMIT 60", ["ic_mom"], six("ic"))
def _(spark, sf):
    return R.recent_ic(R.daily_rank_ic(I.panel(spark, sf), "momentum_12_1_rank", universe=I.widest_session(spark, sf)))


def spread_sql(source: str, value: str, by: str = "date") -> str:
    return f"""
SELECT {by}, avg(t) FILTER (bin = 4) - avg(t) FILTER (bin = 0) AS spread FROM (
  SELECT {by}, t, greatest(0, coalesce(ceil((r - 1) * 5.0 / nullif(n - 1, 0)) - 1, 0)) AS bin FROM (
    SELECT {by}, future_relative_20d AS t, row_number() OVER (PARTITION BY {by} ORDER BY {value}, symbol) AS r,
      count(*) OVER (PARTITION BY {by}) AS n
    FROM {source} WHERE {value} IS NOT NULL AND future_relative_20d IS NOT NULL))
GROUP BY {by} HAVING count(DISTINCT bin) >= 5"""


@register("quintile_spread", spread_sql("panel", "momentum_12_1_rank"), ["panel"], six("spread"))
def _(spark, sf):
    return R.quintile_spread(I.panel(spark, sf), "momentum_12_1_rank", universe=I.widest_session(spark, sf))


cte("long_f", f"""SELECT date, symbol, future_relative_20d, feature, value FROM panel
UNPIVOT (value FOR feature IN ({', '.join(R.FEATURES)}))""", ["panel"])
cte("ic_f", ic_sql("value", "future_relative_20d", "long_f", "feature, date"), ["long_f"])
cte("spread_f", spread_sql("long_f", "value", "feature, date"), ["long_f"])
cte("summary_f", """
SELECT i.feature, avg(ic) AS mean_rank_ic, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) + 1e-12) AS ic_ir,
  avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive_ic_ratio,
  avg(spread) AS top_bottom_future_20d, CAST(sum(n) AS BIGINT) AS observations, count(*) AS dates
FROM ic_f i LEFT JOIN spread_f s ON i.feature = s.feature AND i.date = s.date GROUP BY i.feature""", ["ic_f", "spread_f"])


@register("factor_summary", "SELECT * FROM summary_f", ["summary_f"], six(*SUMMARY, "top_bottom_future_20d"))
def _(spark, sf):
    return R.factor_summary(I.panel(spark, sf), universe=I.widest_session(spark, sf), rows_bound=I.most_bars(spark, sf))


@register("factor_report", "SELECT * FROM summary_f WHERE feature = 'ret_60d_rank'", ["summary_f"], six(*SUMMARY, "top_bottom_future_20d"))
def _(spark, sf):
    return R.factor_report(I.panel(spark, sf), "ret_60d_rank", universe=I.widest_session(spark, sf), rows_bound=I.most_bars(spark, sf))


@register("feature_top", "SELECT feature, mean_rank_ic FROM summary_f ORDER BY mean_rank_ic DESC NULLS LAST, feature LIMIT 6",
          ["summary_f"], six("mean_rank_ic"))
def _(spark, sf):
    return R.feature_top(R.factor_summary(I.panel(spark, sf), universe=I.widest_session(spark, sf), rows_bound=I.most_bars(spark, sf))).select("feature", "mean_rank_ic")


@register("factor_corr", """
SELECT a.feature AS f1, b.feature AS f2,
  round(CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) > 0
    THEN covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END, 3) + 0.0 AS corr
FROM (SELECT * FROM long_f WHERE date = (SELECT max(date) FROM panel)) a
JOIN (SELECT * FROM long_f WHERE date = (SELECT max(date) FROM panel)) b ON a.symbol = b.symbol GROUP BY 1, 2""", ["long_f", "panel"])
def _(spark, sf):
    return R.factor_corr(stored(spark, sf))


cte("icw", f"SELECT c.date, idx, {', '.join(f'{f}' for f in R.FEATURES)} FROM cal_p c LEFT JOIN (PIVOT (SELECT feature, date, ic FROM ic_f) ON feature IN ({', '.join(repr(f) for f in R.FEATURES)}) USING max(ic) GROUP BY date) p ON c.date = p.date",
    ["ic_f", "cal_p"])
cte("cal_p", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel)", ["panel"])

_hit = lambda f: (
    f"avg(CASE WHEN coalesce({', '.join(R.FEATURES)}) IS NOT NULL THEN CASE WHEN {f} > 0 THEN 1.0 ELSE 0.0 END END) OVER w"
)
_raws = ", ".join(
    f"greatest(coalesce(avg({f}) OVER w, 0), 0) * (0.5 + 0.5 * greatest(coalesce({_hit(f)}, 0) - 0.5, 0) * 2)"
    for f in R.FEATURES
)
_fall = ", ".join(str(R.FALLBACK_WEIGHTS.get(f, 0.0)) for f in R.FEATURES)
_step = lambda x: (
    f"list_transform({x}, lambda v: CASE WHEN v > 0.35 + 1e-12 THEN 0.35 ELSE v + v * coalesce("
    f"list_sum(list_transform({x}, lambda u: CASE WHEN u > 0.35 + 1e-12 THEN u - 0.35 ELSE 0 END))"
    f" / CASE WHEN list_sum(list_transform({x}, lambda u: CASE WHEN u > 0.35 + 1e-12 THEN 0 ELSE u END)) > 1e-12"
    f" THEN list_sum(list_transform({x}, lambda u: CASE WHEN u > 0.35 + 1e-12 THEN 0 ELSE u END)) END, 0) END)"
)
cte("aw0", f"""SELECT date, idx, CASE WHEN idx - 20 > 40 AND list_sum(rw) > 1e-12
  THEN list_transform(rw, lambda v: v / list_sum(rw)) ELSE [{_fall}]::DOUBLE[] END AS w,
  idx - 20 > 40 AND list_sum(rw) > 1e-12 AS usable
FROM (SELECT date, idx, [{_raws}]::DOUBLE[] AS rw FROM icw
  WINDOW w AS (ORDER BY idx ROWS BETWEEN 272 PRECEDING AND 21 PRECEDING))""", ["icw"])
for _i in range(1, 9):
    cte(f"aw{_i}", f"SELECT date, idx, usable, CASE WHEN usable THEN {_step('w')} ELSE w END AS w FROM aw{_i - 1}", [f"aw{_i - 1}"])
cte("aw", "SELECT date, idx, " + ", ".join(
    f"w[{i + 1}] / list_sum(w) AS {f}" for i, f in enumerate(R.FEATURES)) + " FROM aw8", ["aw8"])


def stored(spark, sf, *more):
    """The panel columns that several steps of a query read, computed once."""
    return cut(I.panel(spark, sf).select("date", "symbol", "future_relative_20d", *R.FEATURES, *more))


def weights(spark, sf, panel):
    from ...operators.calendar import sessions

    return R.adaptive_weights(R.feature_ic_wide(panel, sessions(panel), universe=I.widest_session(spark, sf), rows_bound=I.most_bars(spark, sf)))


@register("adaptive_weights", "SELECT * FROM aw", ["aw"], six(*R.FEATURES))
def _(spark, sf):
    return weights(spark, sf, stored(spark, sf))


@register("adaptive_score", "SELECT p.date, p.symbol, " + " + ".join(
    f"coalesce(p.{f}, 0.5) * w.{f}" for f in R.FEATURES) + " AS adaptive_score FROM panel p JOIN aw w ON p.date = w.date",
    ["panel", "aw"], six("adaptive_score"))
def _(spark, sf):
    p = stored(spark, sf)
    return R.adaptive_score(p, weights(spark, sf, p)).select("date", "symbol", "adaptive_score")


# --- rankings and reports --------------------------------------------------------------------


cte("r", """SELECT *, row_number() OVER (ORDER BY meta_score DESC, symbol) AS rn, count(*) OVER () AS n
FROM panel WHERE date = (SELECT max(date) FROM panel)""", ["panel"])


@register("ranking_report", """
SELECT 'TOP' AS part, rn AS rank, date, symbol, meta_score AS score FROM r WHERE rn <= 30
UNION ALL SELECT 'BOTTOM', rn, date, symbol, meta_score FROM r WHERE rn > n - 30""", ["r"], six("score"))
def _(spark, sf):
    p = cut(I.panel(spark, sf).select("date", "symbol", "meta_score"))
    return ranking_report(p, "meta_score", 30, 30)


cte("me", """SELECT date, symbol, meta_score AS score, rn, n, feature, value FROM
  (SELECT * FROM r WHERE symbol = (SELECT min(symbol) FROM r)) UNPIVOT (value FOR feature IN (%s))""" % ", ".join(R.FEATURES), ["r"])


@register("explain_symbol", """
SELECT date, symbol, score, feature AS factor, value, rn AS rank, n AS universe_size,
  row_number() OVER (ORDER BY value DESC, feature) <= 3 AS strongest,
  row_number() OVER (ORDER BY value, feature) <= 3 AS weakest FROM me""", ["me"], six("score", "value"))
def _(spark, sf):
    from ...operators.calendar import latest_cross_section

    p = cut(latest_cross_section(stored(spark, sf, "meta_score")))
    return explain_symbol(p, p.agg(F.min("symbol")).scalar(), "meta_score", list(R.FEATURES))


@register("panel_metadata", """
SELECT a.*, b.*, 'batch' AS mode, '7' AS schema, 16 AS fingerprint_length FROM
 (SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS "from", max(date) AS "to",
    count(*) FILTER (solid_eligible) AS solid_eligible_rows FROM panel) a,
 (SELECT arg_max(k, date) AS solid_eligible_symbols_latest, quantile_cont(k, 0.5) AS solid_eligible_symbols_median,
    quantile_cont(k, 0.1) AS solid_eligible_symbols_p10, min(date) AS solid_eligible_from
  FROM (SELECT date, count(DISTINCT symbol) AS k FROM panel WHERE solid_eligible GROUP BY date)) b""", ["panel"],
    six("solid_eligible_symbols_median", "solid_eligible_symbols_p10"))
def _(spark, sf):
    p = cut(I.panel(spark, sf).select("date", "symbol", "solid_eligible"))
    meta = panel_metadata(p)
    # The digest covers the JSON of the row; the twin can only tell that it is there.
    return meta.withColumn("fingerprint_length", F.length("fingerprint")).drop("fingerprint")


cte("quality", """
SELECT name, severity, coalesce(ok, FALSE) AS ok, value,
  CASE WHEN bool_or(severity = 'critical' AND NOT coalesce(ok, FALSE)) OVER () THEN 'BLOCK' ELSE 'PASS' END AS status FROM (
    SELECT 'market_data_present' AS name, 'critical' AS severity, (SELECT count(*) FROM ranked)::DOUBLE AS value, (SELECT count(*) FROM ranked) > 0 AS ok
    UNION ALL SELECT 'universe_size', 'critical', count(DISTINCT symbol), count(DISTINCT symbol) >= 20 FROM last_ranked
    UNION ALL SELECT 'latest_features', 'critical', count(*), count(*) > 0 FROM last_ranked
    UNION ALL SELECT 'finite_scores', 'critical', avg((momentum_12_1_rank IS NOT NULL)::INT), avg((momentum_12_1_rank IS NOT NULL)::INT) > 0.98 FROM last_ranked
    UNION ALL SELECT 'fundamentals_coverage', 'warning', avg((fundamental_raw <> 0)::INT), avg((fundamental_raw <> 0)::INT) > 0.5 FROM last_ranked)""",
    ["ranked", "last_ranked"])
cte("last_ranked", "SELECT * FROM ranked WHERE date = (SELECT max(date) FROM ranked)", ["ranked"])


@register("data_quality", "SELECT name, severity, ok, value, status FROM quality", ["quality"], six("value"))
def _(spark, sf):
    p = I.panel(spark, sf, complete=False).select("date", "symbol", "meta_score", "fundamental_raw")
    return data_quality(cut(p)).select("name", "severity", "ok", "value", "status")
