"""Sources, filters, predicates and point-in-time joins."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import finite
from ...operators import fundamentals as FU
from ...operators.asof import asof_join
from ...operators.calendar import latest_cross_section, period_filter
from ...operators.portfolio import dedup_keep_last

from ...operators.research import FEATURES, linear_score
from ...operators.technical import solid_eligible
from ...operators.universe import funnel_top, liquidity_stats, quality_score, universe_funnel, universe_gate, universe_top_n
from ...sources import bars as B
from ...sources import filings as FI
from ...sources.news import pit_news_mask, score_news
from ...sources.store import fingerprint, strict_json
from ..materialize import cut, shared_folder
from ..panel import META_WEIGHTS
from . import inputs as I
from .base import cte, register, six
from .windows import tech_df


@register("scan_bars", """
SELECT date, symbol, p AS open, q AS volume FROM (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS symbol, l_extendedprice / l_quantity AS p,
    l_quantity AS q, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_quantity > 0) WHERE rn = 1""",
          round_to=six("open"))
def _(spark, sf):
    li = I.table(spark, sf, "lineitem").where("l_quantity > 0")
    rows = li.select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("open"), F.col("l_quantity").alias("volume"),
        B.ordered_key(l_orderkey=15, l_linenumber=2, l_partkey=12).alias("at"))
    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return B.scan_bars(spark, path, ["at"]).select("date", "symbol", "open", "volume")


@register("flatten_bars_json", """
SELECT date, symbol, open, high, low, close, volume, CASE WHEN idx % 2 = 0 THEN vwap ELSE close END AS vwap
FROM bars_w JOIN cal_w USING (date)""", ["bars_w", "cal_w"], six("open", "high", "low", "close", "vwap"))
def _(spark, sf):
    """Bars packed into one payload per session (vw missing on odd sessions) and flattened again."""
    df = I.bars_w(spark, sf).join(I.cal_w(spark, sf), "date")
    bar = F.struct(
        F.concat(F.col("date").cast("string"), F.lit("T05:00:00Z")).alias("t"), F.col("open").alias("o"),
        F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.col("volume").alias("v"), F.when(F.col("idx") % 2 == 0, F.col("vwap")).alias("vw"),
    )
    # One payload per (session, symbol): a session's symbols never meet in one row.
    one = F.create_map(F.col("symbol"), F.array(bar))
    return B.flatten_bars_json(df.select(F.to_json(F.struct(one.alias("bars"))).alias("payload")))


@register("flatten_snapshots", """
SELECT symbol, price, volume, price * volume AS dollar_volume FROM (
  SELECT symbol, close AS price, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars_w)
  WHERE rn = CASE WHEN CAST(symbol AS INT) % 3 = 0 THEN 2 ELSE 1 END)
WHERE price >= 1000 AND volume > 0""", ["bars_w"], six("price", "dollar_volume"))
def _(spark, sf):
    """Last and previous bar per symbol as snapshot payloads; every third symbol lacks today's."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    b = I.bars_w(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    bar = F.struct(F.col("close").alias("c"), F.col("volume").alias("v"))
    today = (F.col("rn") == 1) & (F.col("symbol").cast("int") % 3 != 0)
    snap = b.groupBy("symbol").agg(
        F.max(F.when(today, bar)).alias("dailyBar"), F.max(F.when(F.col("rn") == 2, bar)).alias("prevDailyBar")
    )
    body = F.create_map(F.col("symbol"), F.struct("dailyBar", "prevDailyBar"))
    return B.flatten_snapshots(snap.select(F.to_json(body).alias("payload")), 1000.0)


@register("filter_assets", r"""
SELECT DISTINCT upper(symbol) AS symbol FROM assets
WHERE length(symbol) <= 10 AND regexp_matches(upper(symbol), '^[A-Z0-9.\-]+$')
  AND exchange IN ('NASDAQ', 'NYSE', 'ARCA', 'AMEX') AND tradable AND fractionable
  AND NOT regexp_matches(' ' || upper(name), ' ETF| ETN| FUND| WARRANT| RIGHTS| UNIT|PROSHARES|ISHARES')""", ["assets"])
def _(spark, sf):
    return B.filter_assets(I.assets(spark, sf))


@register("flatten_company_facts", """
SELECT symbol, CASE metric WHEN 'operating_cf' THEN 'operating_cf' ELSE metric END AS metric, value, period_end, available_at
FROM facts WHERE NOT (metric = 'revenue' AND CAST(symbol AS INT) % 4 = 1)
UNION ALL SELECT symbol, metric, value * 2, period_end, available_at
FROM facts WHERE metric = 'revenue' AND CAST(symbol AS INT) % 4 = 1""", ["facts"], {"value": 2})
def _(spark, sf):
    """Facts nested into filing documents and flattened. One symbol in four also has a
    preferred revenue tag with doubled values, which has to win over the plain one."""
    tag = {m: FI.CONCEPTS[m][0] for m in I.METRICS} | {"revenue": "Revenues"}
    names = F.create_map(*[F.lit(x) for kv in tag.items() for x in kv])
    f = I.filings(spark, sf)
    doubled = f.where("metric = 'revenue' and cast(symbol as int) % 4 = 1").select(
        "symbol", F.lit(FI.CONCEPTS["revenue"][0]).alias("tag"), "period_end", "available_at",
        (F.col("value") * 2).alias("value"),
    )
    tagged = f.select("symbol", names[F.col("metric")].alias("tag"), "period_end", "available_at", "value")
    row = F.struct(
        F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.lit("10-Q").alias("form"),
        F.col("available_at").cast("string").alias("filed"),
    )
    # A symbol has one row per tag and quarter: bounded by the calendar.
    docs = (
        tagged.unionByName(doubled).groupBy("symbol", "tag").agg(F.collect_list(row).alias("rows"))
        .groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(
            "tag", F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units")).alias("u")))).alias("us-gaap"))
    )
    docs = docs.select("symbol", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("payload"))
    out = FI.flatten_company_facts(docs)
    return out.select("symbol", "metric", "value", "period_end", "available_at")


@register("dedup_facts", """
SELECT symbol, metric, available_at, period_end, value FROM (
  SELECT symbol, metric, date_trunc('year', available_at)::DATE AS available_at, period_end, value,
    row_number() OVER (PARTITION BY symbol, metric, date_trunc('year', available_at) ORDER BY period_end DESC) AS rn
  FROM facts) WHERE rn = 1""", ["facts"], {"value": 2})
def _(spark, sf):
    f = I.filings(spark, sf).withColumn("available_at", F.trunc("available_at", "year"))
    return FI.dedup_facts(f)


cte("ids", """SELECT 'S' || s_suppkey AS ticker, s_suppkey AS entity_id, s_name AS title
FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'S' || s_suppkey || '-B', s_suppkey + 1000000, s_name || ' B' FROM supplier WHERE s_suppkey % 3 = 0""")
cte("asked", """SELECT 'S' || s_suppkey AS symbol FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.B' FROM supplier WHERE s_suppkey % 2 = 0""")


def ids(spark, sf):
    s = I.table(spark, sf, "supplier")
    base = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    return s.where("s_suppkey % 5 <> 0").select(
        base.alias("ticker"), F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("title")
    ).unionByName(s.where("s_suppkey % 3 = 0").select(
        F.concat(base, F.lit("-B")).alias("ticker"), (F.col("s_suppkey") + 1_000_000).alias("entity_id"),
        F.concat("s_name", F.lit(" B")).alias("title"),
    ))


def asked(spark, sf):
    s = I.table(spark, sf, "supplier")
    base = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    return s.select(base.alias("symbol")).unionByName(
        s.where("s_suppkey % 2 = 0").select(F.concat(base, F.lit(".B")).alias("symbol"))
    )


@register("resolve_entity_ids", """
SELECT symbol, lpad(CAST(coalesce(a.entity_id, b.entity_id) AS VARCHAR), 10, '0') AS entity_id,
  coalesce(a.title, b.title) AS title, coalesce(a.entity_id, b.entity_id) IS NOT NULL AS matched
FROM asked LEFT JOIN ids a ON a.ticker = replace(symbol, '.', '-') LEFT JOIN ids b ON b.ticker = symbol""", ["asked", "ids"])
def _(spark, sf):
    return FI.resolve_entity_ids(asked(spark, sf), ids(spark, sf))


@register("filing_coverage", """
SELECT count(*) AS symbols_asked, count(*) FILTER (n > 0) AS symbols_with_facts, CAST(coalesce(sum(n), 0) AS BIGINT) AS facts,
  (SELECT count(*) FROM asked LEFT JOIN ids a ON a.ticker = replace(symbol, '.', '-')
   LEFT JOIN ids b ON b.ticker = symbol WHERE a.entity_id IS NULL AND b.entity_id IS NULL) AS unmatched
FROM asked LEFT JOIN (SELECT 'S' || symbol AS symbol, count(*) AS n FROM facts GROUP BY 1) USING (symbol)""",
          ["asked", "ids", "facts"])
def _(spark, sf):
    f = I.filings(spark, sf).withColumn("symbol", F.concat(F.lit("S"), "symbol"))
    return FI.filing_coverage(asked(spark, sf), f, ids(spark, sf))


@register("score_news", "SELECT * FROM news", ["news"], six("news_score"))
def _(spark, sf):
    return score_news(I.news_items(spark, sf), F.col("age_days"), I.POS, I.NEG)


@register("pit_news_mask", """
SELECT date, b.symbol, CASE WHEN date = (SELECT max(date) FROM bars) THEN coalesce(news_score, 0) ELSE 0.0 END AS news_raw
FROM bars b LEFT JOIN news n ON b.symbol = n.symbol""", ["bars", "news"], six("news_raw"))
def _(spark, sf):
    return pit_news_mask(I.bars(spark, sf).select("date", "symbol"), I.news(spark, sf), last=I.last_session(spark, sf))


@register("fingerprint", """
SELECT substr(sha256('{"from":"' || min(l_shipdate)::DATE || '","rows":' || count(*) || ',"symbols":' || count(DISTINCT l_suppkey)
  || ',"to":"' || max(l_shipdate)::DATE || '"}'), 1, 16) AS fingerprint FROM lineitem""")
def _(spark, sf):
    facts = I.table(spark, sf, "lineitem").agg(
        F.count("*").alias("rows"), F.countDistinct("l_suppkey").alias("symbols"),
        F.min(F.col("l_shipdate").cast("date")).alias("from"), F.max(F.col("l_shipdate").cast("date")).alias("to"),
    )
    return fingerprint(facts, ["rows", "symbols", "from", "to"])


@register("strict_json", """
SELECT c_custkey, '{"k":' || c_custkey || ',"a":' || CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) || '.0' ELSE 'null' END
  || ',"xs":[' || CASE WHEN c_custkey % 3 = 2 THEN 'null' ELSE '1.0' END || ',2.5]}' AS json FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    bad = F.when(k % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    a = F.when(k % 3 == 0, k.cast("double")).otherwise(bad)
    xs = F.array(F.when(k % 3 == 2, F.lit(float("inf"))).otherwise(F.lit(1.0)), F.lit(2.5))
    df = I.table(spark, sf, "customer").select("c_custkey", F.struct(k.alias("k"), a.alias("a"), xs.alias("xs")).alias("doc"))
    return strict_json(df, keep=["c_custkey"], unwrap="doc")


# --- predicates -----------------------------------------------------------------------------


@register("pit_fundamental_gate", "SELECT date, symbol, sec_core_metrics, solid_fundamental_eligible FROM pit", ["pit"])
def _(spark, sf):
    rows = I.bars(spark, sf).select("date", "symbol")
    pit = FU.point_in_time(rows, I.filings(spark, sf))
    df = FU.pit_fundamental_gate(pit, I.CORE_K, I.MIN_REVENUE, I.MIN_ASSETS)
    return df.select("date", "symbol", "sec_core_metrics", "solid_fundamental_eligible")


RATIOS = ("roe", "roa", "gross_margin", "fcf_margin", "fundamental_raw")


@register("fundamental_ratios", f"SELECT date, symbol, {', '.join(RATIOS)} FROM pit", ["pit"], six(*RATIOS))
def _(spark, sf):
    rows = I.bars(spark, sf).select("date", "symbol")
    df = FU.fundamental_ratios(FU.point_in_time(rows, I.filings(spark, sf)))
    return df.select("date", "symbol", *RATIOS)


@register("operating_quality", f"""
SELECT symbol, (revenue IS NOT NULL)::INT + (net_income IS NOT NULL)::INT + (assets IS NOT NULL)::INT
    + (equity IS NOT NULL)::INT + (operating_cf IS NOT NULL)::INT AS sec_core_metrics,
  assets > 0 AND equity > -0.5 * assets AS sec_balance_ok, revenue > 0 OR net_income IS NOT NULL AS sec_activity_ok,
  net_income > 0 OR operating_cf > 0 AS sec_earning_power,
  revenue >= {I.MIN_REVENUE} OR assets >= {I.MIN_ASSETS} AS sec_size_ok,
  assets > 0 AND equity > -0.5 * assets AND (revenue > 0 OR net_income IS NOT NULL)
    AND (revenue >= {I.MIN_REVENUE} OR assets >= {I.MIN_ASSETS}) AS sec_operating_company
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY available_at DESC) AS rn FROM facts_w) WHERE rn = 1""", ["facts_w"])
def _(spark, sf):
    return FU.operating_quality(I.filings(spark, sf), 5, I.MIN_REVENUE, I.MIN_ASSETS)


@register("solid_eligible", "SELECT date, symbol, solid_eligible FROM joined", ["joined"])
def _(spark, sf):
    pit = I.pit(spark, sf).select("date", "symbol", "solid_fundamental_eligible")
    df = tech_df(spark, sf).join(pit, ["date", "symbol"], "left")
    lim = I.LIMITS
    return solid_eligible(df, lim.min_price, lim.min_sessions, lim.min_dollar_volume, lim.max_vol).select(
        "date", "symbol", "solid_eligible")


STATS = ("last_price", "median_dollar_volume_60", "volatility_60")
cte("stats", """
SELECT symbol, count(*) AS history_sessions, arg_max(close, date) AS last_price,
  coalesce(quantile_cont(dv, 0.5) FILTER (back <= 60), 0) AS median_dollar_volume_60,
  CASE WHEN count(*) FILTER (back <= 60) > 20 THEN stddev_samp(ret_1d) FILTER (back <= 60) * sqrt(252) END AS volatility_60
FROM (SELECT symbol, date, close, dollar_volume AS dv, ret_1d,
        row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM tech0) GROUP BY symbol""", ["tech0"])


@register("liquidity_stats", "SELECT * FROM stats", ["stats"], six(*STATS))
def _(spark, sf):
    return liquidity_stats(I.bars(spark, sf))


GATE = dict(min_sessions=500, min_price=100.0, min_dollar_volume=50_000.0, max_vol=300.0)
cte("gated", """SELECT * FROM stats WHERE history_sessions >= 500 AND last_price >= 100
AND median_dollar_volume_60 >= 50000 AND coalesce(volatility_60, 99) <= 300""", ["stats"])


@register("universe_gate", "SELECT * FROM gated", ["gated"], six(*STATS))
def _(spark, sf):
    return universe_gate(liquidity_stats(I.bars(spark, sf)), **GATE)


cte("current", "SELECT symbol, arg_max(dollar_volume, date) AS current_dollar_volume FROM tech0 GROUP BY symbol", ["tech0"])
_raw_pct = lambda c: (
    f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    f" / count({c}) OVER () END"
)
cte("quality", f"""
SELECT *, 0.50 * liq_rank + 0.20 * current_liq_rank + 0.15 * history_rank + 0.15 * stability_rank AS quality_score
FROM (SELECT *, {_raw_pct('median_dollar_volume_60')} AS liq_rank, {_raw_pct('current_dollar_volume')} AS current_liq_rank,
  {_raw_pct('history_sessions')} AS history_rank, 1 - {_raw_pct('volatility_60')} AS stability_rank
  FROM gated JOIN current USING (symbol))""", ["gated", "current"])


def gated_stats(spark, sf, bars=None):
    b = I.bars(spark, sf) if bars is None else bars
    cur = b.groupBy("symbol").agg(
        F.max_by(F.col("close") * F.col("volume"), F.col("date")).alias("current_dollar_volume"))
    return universe_gate(liquidity_stats(b), **GATE).join(cur, "symbol")


@register("universe_top_n", """SELECT symbol, quality_score, median_dollar_volume_60, history_sessions, volatility_60
FROM quality ORDER BY quality_score DESC NULLS LAST, median_dollar_volume_60 DESC, symbol LIMIT 25""", ["quality"],
          six("quality_score", "median_dollar_volume_60", "volatility_60"))
def _(spark, sf):
    top = universe_top_n(gated_stats(spark, sf), 25, I.universe_size(spark, sf))
    return top.select("symbol", "quality_score", "median_dollar_volume_60", "history_sessions", "volatility_60")


_BEST = "ORDER BY quality_score DESC NULLS LAST, median_dollar_volume_60 DESC, symbol LIMIT 50"


@register("universe_funnel", f"""
SELECT count(*) AS candidate_count, count(*) FILTER (s.history_sessions >= 500) AS prefiltered_count,
  count(*) FILTER (g.symbol IS NOT NULL) AS qualified_count,
  count(*) FILTER (g.symbol IS NOT NULL AND coalesce(quality_score, 0) >= 0.5) AS selected_count,
  {GATE['min_sessions']} AS min_sessions, {GATE['min_price']}::DOUBLE AS min_price, {GATE['min_dollar_volume']}::DOUBLE AS min_dollar_volume, {GATE['max_vol']}::DOUBLE AS max_vol,
  (SELECT list(symbol) FROM (SELECT symbol FROM quality {_BEST})) AS top_symbols
FROM stats s LEFT JOIN quality g ON s.symbol = g.symbol""", ["stats", "quality"])
def _(spark, sf):
    bars = cut(I.bars(spark, sf))
    gated = cut(gated_stats(spark, sf, bars))
    q = quality_score(gated, I.universe_size(spark, sf)).select(
        "symbol", F.lit(True).alias("qualified"), (F.coalesce("quality_score", F.lit(0.0)) >= 0.5).alias("selected"))
    stages = liquidity_stats(bars).select("symbol", (F.col("history_sessions") >= 500).alias("prefiltered"))
    return universe_funnel(stages.join(q, "symbol", "left").na.fill(False, ["qualified", "selected"]), gated, GATE)


@register("universe_funnel_top", f"""SELECT CAST(row_number() OVER () AS INTEGER) AS place, * FROM (
  SELECT symbol, quality_score, median_dollar_volume_60, history_sessions, volatility_60 FROM quality {_BEST})""", ["quality"],
          six("quality_score", "median_dollar_volume_60", "volatility_60"))
def _(spark, sf):
    """The best names of the funnel with their score and statistics."""
    return funnel_top(gated_stats(spark, sf), 50, I.universe_size(spark, sf))


# --- projections on the panel ---------------------------------------------------------------


@register("linear_score", "SELECT date, symbol, meta_score FROM panel", ["panel"], six("meta_score"))
def _(spark, sf):
    return linear_score(I.panel(spark, sf).drop("meta_score"), META_WEIGHTS, "meta_score").select("date", "symbol", "meta_score")


@register("drop_incomplete", "SELECT date, symbol, vol_60d, trend_200 FROM tech WHERE vol_60d IS NOT NULL AND trend_200 IS NOT NULL",
          ["tech"], six("vol_60d", "trend_200"))
def _(spark, sf):
    df = tech_df(spark, sf).select("date", "symbol", finite("vol_60d").alias("vol_60d"), finite("trend_200").alias("trend_200"))
    return df.na.drop(subset=["vol_60d", "trend_200"])


@register("latest_cross_section", """SELECT date, symbol, score FROM panel_w
WHERE date = (SELECT max(date) FROM panel_w WHERE score IS NOT NULL) AND score IS NOT NULL""", ["panel_w"], six("score"))
def _(spark, sf):
    panel = cut(I.panel_w(spark, sf).select("date", "symbol", "score"))
    return latest_cross_section(panel, "score")


@register("period_filter", "SELECT date, symbol, close FROM bars WHERE date >= (SELECT max(date) FROM bars) - 90", ["bars"], six("close"))
def _(spark, sf):
    return period_filter(I.bars(spark, sf), 90, I.last_session(spark, sf)).select("date", "symbol", "close")


# --- point-in-time joins ---------------------------------------------------------------------

cte("ev_facts", """
SELECT user_id, ts, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type
FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id, ts""")


@register("asof_join", """
SELECT p.event_id, p.user_id, f.value AS last_value, f.event_type AS last_type
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('purchase', 'signup')) p
ASOF LEFT JOIN ev_facts f ON p.user_id = f.user_id AND p.ts >= f.ts""", ["ev_facts"], six("last_value"))
def _(spark, sf):
    """A user may own a large share of the events, so each user is resolved in hourly slices."""
    ev = I.table(spark, sf, "events")
    fact = F.col("event_type").isin("purchase", "signup")
    facts = dedup_keep_last(
        ev.where(fact).select("user_id", "ts", "event_id", F.col("value").alias("last_value"),
                              F.col("event_type").alias("last_type")), ["user_id", "ts"], ["event_id"])
    probes = ev.where(~fact).select("event_id", "user_id", "ts")
    out = asof_join(probes, facts, ["user_id"], "ts", "ts", ["last_value", "last_type"], chunk="hour")
    return out.select("event_id", "user_id", "last_value", "last_type")


@register("attach_fundamentals", "SELECT date, symbol, fundamental_raw, earnings_raw FROM joined", ["joined"],
          six("fundamental_raw", "earnings_raw"))
def _(spark, sf):
    out = FU.attach_fundamentals(I.bars(spark, sf).select("date", "symbol"), I.pit(spark, sf), I.universe_size(spark, sf))
    return out.select("date", "symbol", "fundamental_raw", "earnings_raw")


PANEL_COLS = (*FEATURES, "meta_score", "future_relative_20d")


@register("feature_panel", f"SELECT date, symbol, sector, solid_eligible, {', '.join(PANEL_COLS)} FROM panel", ["panel"], six(*PANEL_COLS))
def _(spark, sf):
    return I.panel(spark, sf).select("date", "symbol", "sector", "solid_eligible", *PANEL_COLS)
