"""Run registry, state log, stored results, set operations."""

import uuid

from pyspark.sql import functions as F

from ...operators import registry as RG
from ...sources import store as ST
from ..materialize import shared_folder
from . import inputs as I
from .base import cte, register, six


@register("latest_state", """SELECT o_custkey AS key, arg_max(o_orderstatus || ':' || o_orderkey, row(o_orderdate, o_orderkey)) AS value,
  max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    log = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.concat_ws(":", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("value"))
    return ST.latest_state(log, "key", "at", "value").withColumn("updated_at", F.col("updated_at.o_orderdate"))


@register("parse_run_payload", """SELECT o_orderkey AS id, o_orderpriority AS strategy,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) ELSE o_totalprice END AS cagr, CAST(o_orderkey % 7 AS DOUBLE) AS sharpe,
  NULL::DOUBLE AS sortino FROM orders""", (), {"cagr": 4, "sharpe": 4})
def _(spark, sf):
    k = F.col("o_orderkey")
    metrics = F.struct(
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("cagr"), (k % 7).cast("double").alias("sharpe"))
    runs = I.table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("strategy"), F.col("o_custkey").alias("cagr"), k.alias("sharpe"),
        F.to_json(F.struct(metrics.alias("metrics"))).alias("payload"))
    return ST.parse_run_payload(runs, {"cagr": "cagr", "sharpe": "sharpe", "sortino": None})


cte("jobs", """SELECT o_orderkey AS id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status,
  'model ' || (o_custkey % 7) AS name, CAST(o_orderkey % 50 AS INT) AS version FROM orders""")


def jobs(spark, sf):
    st = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING")
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), st.alias("status"),
        F.concat(F.lit("model "), (F.col("o_custkey") % 7).cast("string")).alias("name"),
        (F.col("o_orderkey") % 50).cast("int").alias("version"))


@register("registry_rollups", """SELECT kind, count(*) AS jobs, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) AS active,
  max(id) FILTER (status IN ('QUEUED', 'RUNNING')) AS active_id FROM jobs GROUP BY kind""", ["jobs"])
def _(spark, sf):
    return RG.active_jobs(jobs(spark, sf))


@register("newest_runs", "SELECT id, kind, status FROM jobs ORDER BY id DESC LIMIT 60", ["jobs"])
def _(spark, sf):
    return RG.newest(jobs(spark, sf), 60).select("id", "kind", "status")


@register("next_version", "SELECT name, max(version) + 1 AS next_version FROM jobs GROUP BY name", ["jobs"])
def _(spark, sf):
    return RG.next_version(jobs(spark, sf))


@register("latest_run_per_strategy", """SELECT version, id, strategy FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY id DESC) AS rn FROM (
  SELECT o_orderkey AS id, strategy, CASE WHEN strategy ILIKE '%v7.1%' THEN 'V7.1' WHEN regexp_matches(strategy, '(?i)v[5-9]')
    THEN 'V' || regexp_extract(strategy, '(?i)v([5-9])', 1) ELSE substr(strategy, 1, 18) END AS version
  FROM (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'Blend v5 OOS' WHEN 1 THEN 'Blend V6' WHEN 2 THEN 'Blend v7 base'
    WHEN 3 THEN 'Blend V7.1 Balanced' ELSE 'Momentum 12-1 baseline' END AS strategy FROM orders))) WHERE rn = 1""")
def _(spark, sf):
    names = ["Blend v5 OOS", "Blend V6", "Blend v7 base", "Blend V7.1 Balanced", "Momentum 12-1 baseline"]
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return RG.latest_run_per_strategy(I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), pick.alias("strategy")))


# --- set operations ---------------------------------------------------------------------------


@register("union_parts", """SELECT o_orderkey AS id, o_totalprice AS amount, NULL AS status FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1""", (), {"amount": 4})
def _(spark, sf):
    o = I.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    a = o.where("id % 2 = 0").select("id", F.col("o_totalprice").alias("amount"))
    b = o.where("id % 2 = 1").select("id", F.col("o_orderstatus").alias("status"))
    return a.unionByName(b, allowMissingColumns=True)


@register("union_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem")
def _(spark, sf):
    a = I.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    b = I.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return a.distinct().union(b.distinct()).distinct()


@register("common_symbols", """
WITH s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem)
SELECT symbol FROM s WHERE m = (SELECT min(m) FROM s) INTERSECT SELECT symbol FROM s WHERE m = (SELECT max(m) FROM s)""")
def _(spark, sf):
    """Symbols that trade in the month of the first entry and in that of the last exit."""
    day = F.trunc(F.col("l_shipdate").cast("date"), "month")
    s = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), day.alias("m"))
    first, last = s.agg(F.min("m")).scalar(), s.agg(F.max("m")).scalar()
    return s.where(F.col("m") == first).select("symbol").intersect(s.where(F.col("m") == last).select("symbol"))


# --- stores -----------------------------------------------------------------------------------


@register("write_panel", "SELECT date, symbol, close, score, ret_1d > 0 AS solid_eligible FROM panel_w", ["panel_w"], six("close", "score"))
def _(spark, sf):
    """Written by year with its metadata row, then read back."""
    where = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    df = I.panel_w(spark, sf).select("date", "symbol", "close", "score", (F.col("ret_1d") > 0).alias("solid_eligible"))
    ST.write_panel(df, where)
    return ST.read_panel(spark, where)


@register("read_panel", "SELECT date, symbol, close FROM bars_w WHERE year(date) = 1998", ["bars_w"], six("close"))
def _(spark, sf):
    """Reading one year back touches that year's directory only."""
    where = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    df = I.bars_w(spark, sf).select("date", "symbol", "close", F.lit(True).alias("solid_eligible"))
    ST.write_panel(df, where)
    return ST.read_panel(spark, where, years=[1998]).select("date", "symbol", "close")


@register("panel_status", "SELECT TRUE AS ready, 'ready' AS reason, (SELECT count(*) FROM bars_w) AS stored_rows", ["bars_w"])
def _(spark, sf):
    where = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    df = I.bars_w(spark, sf).select("date", "symbol", "close", (F.col("close") > 0).alias("solid_eligible"))
    ST.write_panel(df, where)
    return ST.panel_status(spark, where).withColumn("stored_rows", ST.read_panel(spark, where).agg(F.count("*")).scalar())


@register("keyed_result", "SELECT symbol, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY symbol", ["bars"], six("volume"))
def _(spark, sf):
    """Stored under a content key; the second call reads the first one's table."""
    where = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    build = lambda: I.bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    bars = I.bars(spark, sf)
    # Of the content, whatever its order: the number of rows and the sum of their hashes.
    content = bars.agg(F.count("*"), F.sum(F.xxhash64(*bars.columns).cast("decimal(38,0)"))).first()
    facts = {"fingerprint": [str(x) for x in content], "version": 1, "config": {"unit": "day"}}
    ST.keyed_result(build, spark, "volume", facts, where)
    return ST.keyed_result(build, spark, "volume", facts, where)[0]
