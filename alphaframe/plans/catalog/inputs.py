"""Engine tables derived from the given tables, and the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import dealt
from ...functions.frames import ROWS_PER_HASH
from ...operators.calendar import sessions
from ...operators.fundamentals import pit_fundamentals
from ...operators.ranks import pct_rank, too_wide
from ...operators.technical import forward_return, returns_n
from ...sources.bars import ordered_key, resample_bars
from ...sources.news import score_news
from ..panel import META_WEIGHTS, Eligibility, FundamentalGate, feature_panel
from .base import cte

POS, NEG = ("the", "and", "is"), ("of", "for", "on")
LIMITS = Eligibility(min_price=1.0, min_sessions=252, min_dollar_volume=54_000.0, max_vol=180.0)
CORE_K, MIN_REVENUE, MIN_ASSETS = 5, 800_000.0, 5_000_000.0
RISK_OFF, TREND_UP = 1.5, 4.5
METRICS = ("revenue", "net_income", "gross_profit", "operating_cf", "assets", "equity", "eps")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def universe_size(spark: SparkSession, sf_dir: str) -> int:
    """Upper bound of a cross-section: the row count of the supplier table (footers only)."""
    return table(spark, sf_dir, "supplier").count()


def widest_session(spark: SparkSession, sf_dir: str) -> int:
    """Upper bound of a daily cross-section: symbols, or where a task should not sort as many, the most transactions of a day if less."""
    symbols = universe_size(spark, sf_dir)
    if not too_wide(symbols):
        return symbols
    days = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0).groupBy(F.col("l_shipdate").cast("date")).count()
    return min(symbols, days.agg(F.max("count")).first()[0] or 0)


def most_bars(spark: SparkSession, sf_dir: str) -> int:
    """Upper bound of the number of bars: the row count of the transactions (footers only)."""
    return table(spark, sf_dir, "lineitem").count()


def bars(spark: SparkSession, sf_dir: str, unit: str | None = None) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return resample_bars(
        table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0),
        date=day if unit is None else F.trunc(day, unit),
        price=F.col("l_extendedprice") / F.col("l_quantity"), qty=F.col("l_quantity"),
        symbol=F.col("l_suppkey").cast("string"), tie=ordered_key(l_orderkey=15, l_linenumber=2, l_partkey=12),
        rows_bound=most_bars(spark, sf_dir) if unit is None else None,
    )


def bars_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "week")


_BARS = """
SELECT {d} AS date, CAST(l_suppkey AS VARCHAR) AS symbol,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
  sum(l_quantity) AS volume,
  sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity) AS vwap
FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2"""
cte("bars", _BARS.format(d="CAST(l_shipdate AS DATE)"))
cte("bars_w", _BARS.format(d="CAST(date_trunc('week', l_shipdate) AS DATE)"))
cte("cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)", ["bars"])
cte("cal_w", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars_w)", ["bars_w"])


def cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session calendar straight from the ship dates: one column is read, no bars are built."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    return sessions(li.select(F.col("l_shipdate").cast("date").alias("date")))


def cal_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    return sessions(li.select(F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date")))


def last_session(spark: SparkSession, sf_dir: str):
    """Last trading date as a scalar, from two columns of the transactions."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    return li.agg(F.max("l_shipdate").cast("date")).scalar()


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sector"))
    sup = table(spark, sf_dir, "supplier")
    return sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("symbol"), "sector"
    )


cte("sectors", """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, n_name AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long quarterly facts per supplier, published 45 days after the quarter.

    As in real filings, each also repeats the year before, here with a larger value.
    """
    from pyspark.sql import Window

    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    q = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q"))
        .agg(
            F.sum(ext * (1 - disc)).alias("revenue"), F.sum(ext * tax).alias("_tax"),
            F.sum(ext * (disc + tax)).alias("_dt"), F.sum("l_quantity").alias("_qty"),
        )
    )
    acct = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    w = Window.partitionBy("l_suppkey").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    q = dealt(q, ["l_suppkey"], most_bars(spark, sf_dir), ROWS_PER_HASH).join(acct, "l_suppkey").withColumns({
        "net_income": F.col("revenue") - F.col("_dt") * 5,
        "gross_profit": F.col("revenue") - F.col("_tax"),
        "operating_cf": F.col("revenue") * F.lit(0.8),
        "assets": F.lit(1_000_000.0) + F.col("s_acctbal") + F.sum("revenue").over(w),
    }).withColumn("equity", F.col("assets") * F.lit(0.4) + F.col("net_income")).withColumn(
        "eps", F.col("net_income") / F.col("_qty"))
    end = F.last_day(F.add_months("q", 2))
    now = q.select(
        F.col("l_suppkey").cast("string").alias("symbol"), end.alias("period_end"),
        F.date_add(end, 45).alias("available_at"), *METRICS,
    ).unpivot(["symbol", "period_end", "available_at"], list(METRICS), "metric", "value")
    period = F.explode(F.array(
        F.struct("period_end", "value"),
        F.struct(F.add_months("period_end", -12).alias("period_end"), (F.abs("value") * 2 + 1).alias("value")),
    ))
    return now.select("symbol", "available_at", "metric", period.alias("p")).select(
        "symbol", "p.period_end", "available_at", "metric", "p.value")


cte("fq", """
SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q,
  sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * l_tax) AS tx,
  sum(l_extendedprice * (l_discount + l_tax)) AS dt, sum(l_quantity) AS qty
FROM lineitem GROUP BY 1, 2""")
cte("facts_w", """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, last_day(q + INTERVAL 2 MONTH) AS period_end,
  CAST(last_day(q + INTERVAL 2 MONTH) + INTERVAL 45 DAY AS DATE) AS available_at,
  revenue, revenue - dt * 5 AS net_income, revenue - tx AS gross_profit, revenue * 0.8 AS operating_cf,
  assets, assets * 0.4 + (revenue - dt * 5) AS equity, (revenue - dt * 5) / qty AS eps
FROM (SELECT *, 1000000.0 + s_acctbal
        + sum(revenue) OVER (PARTITION BY l_suppkey ORDER BY q ROWS UNBOUNDED PRECEDING) AS assets
      FROM fq JOIN supplier ON s_suppkey = l_suppkey)""", ["fq"])
cte("facts_now", """SELECT symbol, period_end, available_at, metric, value FROM facts_w
UNPIVOT (value FOR metric IN (revenue, net_income, gross_profit, operating_cf, assets, equity, eps))""", ["facts_w"])
cte("facts", """SELECT symbol, period_end, available_at, metric, value FROM facts_now
UNION ALL SELECT symbol, CAST(period_end - INTERVAL 12 MONTH AS DATE), available_at, metric, abs(value) * 2 + 1 FROM facts_now""", ["facts_now"])


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "documents").select(
        F.col("text").alias("headline"), F.lit("").alias("summary"),
        F.array((F.col("doc_id") % n).cast("string")).alias("symbols"),
        (F.col("doc_id") % 30).cast("int").alias("age_days"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_news(news_items(spark, sf_dir), F.col("age_days"), POS, NEG)


cte("news", r"""
SELECT symbol, avg((np - nn) / greatest(1, np + nn) * exp(-age / 7.0)) AS news_score FROM (
  SELECT CAST(doc_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS symbol, doc_id % 30 AS age,
    len(list_intersect(['the', 'and', 'is'], ws)) AS np, len(list_intersect(['of', 'for', 'on'], ws)) AS nn
  FROM (SELECT doc_id, regexp_split_to_array(translate(lower(text), ',.', '  '), '\s+') AS ws FROM documents))
GROUP BY symbol""")


def pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).select("date", "symbol")
    return pit_fundamentals(rows, filings(spark, sf_dir), CORE_K, MIN_REVENUE, MIN_ASSETS)


cte("asof_facts", """
SELECT b.date, b.symbol, f.revenue, f.net_income, f.gross_profit, f.operating_cf, f.assets, f.equity, f.eps
FROM (SELECT date, symbol FROM bars) b
ASOF LEFT JOIN facts_w f ON b.symbol = f.symbol AND b.date >= f.available_at""", ["bars", "facts_w"])
cte("pit", f"""
SELECT *,
  (coalesce(roe, 0) + coalesce(roa, 0) + coalesce(gross_margin, 0) + coalesce(fcf_margin, 0)) / nullif(
    (roe IS NOT NULL)::INT + (roa IS NOT NULL)::INT + (gross_margin IS NOT NULL)::INT
    + (fcf_margin IS NOT NULL)::INT, 0) AS fundamental_raw,
  eps / nullif(lag(eps) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS earnings_raw,
  coalesce(sec_core_metrics >= {CORE_K} AND assets > 0 AND equity IS NOT NULL AND equity > -0.5 * assets
    AND (coalesce(revenue > 0, FALSE) OR net_income IS NOT NULL)
    AND (coalesce(revenue >= {MIN_REVENUE}, FALSE) OR coalesce(assets >= {MIN_ASSETS}, FALSE)), FALSE)
    AS solid_fundamental_eligible
FROM (SELECT *, net_income / CASE WHEN equity > 0 THEN equity END AS roe, net_income / nullif(assets, 0) AS roa,
  gross_profit / nullif(revenue, 0) AS gross_margin, operating_cf AS fcf,
  operating_cf / nullif(revenue, 0) AS fcf_margin,
  (revenue IS NOT NULL)::INT + (net_income IS NOT NULL)::INT + (assets IS NOT NULL)::INT
  + (equity IS NOT NULL)::INT + (operating_cf IS NOT NULL)::INT AS sec_core_metrics FROM asof_facts)""", ["asof_facts"])

cte("tech0", """
SELECT date, symbol, open, close, volume, close * volume AS dollar_volume,
  close / lag(close, 1) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d,
  close / lag(close, 20) OVER w - 1 AS ret_20d, close / lag(close, 60) OVER w - 1 AS ret_60d,
  close / lag(close, 120) OVER w - 1 AS ret_120d, close / lag(close, 252) OVER w - 1 AS ret_252d,
  lead(close, 20) OVER w / close - 1 AS future_20d,
  row_number() OVER w AS history_sessions_to_date
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""", ["bars"])
cte("tech", """
SELECT *, ret_252d - ret_20d AS momentum_12_1,
  CASE WHEN count(ret_1d) OVER w20 = 20 THEN stddev_samp(ret_1d) OVER w20 * sqrt(252) END AS vol_20d,
  CASE WHEN count(ret_1d) OVER w60 = 60 THEN stddev_samp(ret_1d) OVER w60 * sqrt(252) END AS vol_60d,
  CASE WHEN count(close) OVER w50 = 50 THEN close / avg(close) OVER w50 - 1 END AS trend_50,
  CASE WHEN count(close) OVER w200 = 200 THEN close / avg(close) OVER w200 - 1 END AS trend_200,
  CASE WHEN count(dollar_volume) OVER w60 >= 40 THEN quantile_cont(dollar_volume, 0.5) OVER w60 END
    AS median_dollar_volume_60,
  future_20d - avg(future_20d) OVER (PARTITION BY date) AS future_relative_20d
FROM tech0 WINDOW
  w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING),
  w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING),
  w60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING),
  w200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)""", ["tech0"])


def pct_sql(col: str, by: str = "date") -> str:
    return (
        f"CASE WHEN {col} IS NOT NULL THEN least(greatest((rank() OVER (PARTITION BY {by} ORDER BY {col})"
        f" + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0)"
        f" / count({col}) OVER (PARTITION BY {by}), 0.001), 0.999) END"
    )


cte("joined", f"""
SELECT t.*, sector,
  coalesce(fundamental_raw, quantile_cont(fundamental_raw, 0.5) OVER (PARTITION BY t.date), 0) AS fundamental_raw,
  coalesce(earnings_raw, 0) AS earnings_raw, sec_core_metrics, solid_fundamental_eligible,
  coalesce(solid_fundamental_eligible AND close >= {LIMITS.min_price}
    AND history_sessions_to_date >= {LIMITS.min_sessions}
    AND median_dollar_volume_60 >= {LIMITS.min_dollar_volume} AND vol_60d <= {LIMITS.max_vol}, FALSE) AS solid_eligible,
  CASE WHEN t.date = (SELECT max(date) FROM tech) THEN coalesce(news_score, 0) ELSE 0 END AS news_raw
FROM tech t LEFT JOIN pit p ON t.date = p.date AND t.symbol = p.symbol
LEFT JOIN news n ON t.symbol = n.symbol LEFT JOIN sectors s ON t.symbol = s.symbol""",
    ["tech", "pit", "news", "sectors"])
_RANKS = ", ".join(
    f"{pct_sql(c)} AS {c}_rank" for c in (
        "momentum_12_1", "ret_60d", "ret_20d", "trend_50", "trend_200", "fundamental_raw",
        "earnings_raw", "news_raw")
)
cte("ranked", f"""SELECT *, {_RANKS}, 1 - {pct_sql('vol_20d')} AS low_vol_rank,
  {pct_sql('dollar_volume')} AS liquidity_rank FROM joined""", ["joined"])
cte("panel", "SELECT * FROM (SELECT *, " + " + ".join(f"{w} * {c}" for c, w in META_WEIGHTS.items())
    + " AS meta_score FROM ranked) WHERE meta_score IS NOT NULL", ["ranked"])


def panel(spark: SparkSession, sf_dir: str, complete: bool = True) -> DataFrame:
    return feature_panel(
        bars(spark, sf_dir), filings(spark, sf_dir), news(spark, sf_dir), sectors(spark, sf_dir), LIMITS,
        FundamentalGate(CORE_K, MIN_REVENUE, MIN_ASSETS), universe=widest_session(spark, sf_dir), complete=complete,
        last_date=last_session(spark, sf_dir), rows_bound=most_bars(spark, sf_dir),
    )


def panel_w(spark: SparkSession, sf_dir: str, weekly: DataFrame | None = None) -> DataFrame:
    """Weekly panel for portfolio work: 20-week return rank as the score."""
    df = returns_n(bars_w(spark, sf_dir) if weekly is None else weekly, [1, 20])
    return pct_rank(forward_return(df, 20), {"ret_20d": "score"}, universe=universe_size(spark, sf_dir))


cte("tech_w", """
SELECT date, symbol, open, close, volume, close / lag(close, 1) OVER w - 1 AS ret_1d,
  close / lag(close, 20) OVER w - 1 AS ret_20d, lead(close, 20) OVER w / close - 1 AS future_20d
FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY date)""", ["bars_w"])
cte("panel_w", f"""SELECT *, {pct_sql('ret_20d')} AS score,
  future_20d - avg(future_20d) OVER (PARTITION BY date) AS future_relative_20d FROM tech_w""", ["tech_w"])


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.when(k % 13 == 0, F.concat(F.lit("s$"), k.cast("string")))
        .otherwise(F.concat(F.lit("S"), k.cast("string"))).alias("symbol"),
        F.when(k % 10 == 3, F.concat("s_name", F.lit(" ETF"))).otherwise(F.col("s_name")).alias("name"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("NASDAQ", "NYSE", "ARCA", "AMEX", "OTC")]), (k % 5 + 1).cast("int")
        ).alias("exchange"),
        (k % 7 != 0).alias("tradable"), (k % 11 != 0).alias("fractionable"),
    )


cte("assets", """
SELECT CASE WHEN s_suppkey % 13 = 0 THEN 's$' || s_suppkey ELSE 'S' || s_suppkey END AS symbol,
  CASE WHEN s_suppkey % 10 = 3 THEN s_name || ' ETF' ELSE s_name END AS name,
  ['NASDAQ', 'NYSE', 'ARCA', 'AMEX', 'OTC'][s_suppkey % 5 + 1] AS exchange,
  s_suppkey % 7 <> 0 AS tradable, s_suppkey % 11 <> 0 AS fractionable FROM supplier""")
