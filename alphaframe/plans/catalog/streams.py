"""Streaming twins: the events table read as a file stream and drained once."""

import uuid

from pyspark.sql import functions as F

from ...streaming import trades as ST
from ...streaming.ewma import stream_ewma
from ..materialize import shared_folder
from . import inputs as I
from .base import cte, register, six

cte("msgs", """
SELECT event_id, ts, CAST(user_id AS VARCHAR) AS client_order_id, CAST(user_id % 10 AS VARCHAR) AS symbol,
  CASE event_type WHEN 'purchase' THEN 'fill' WHEN 'click' THEN 'partial_fill' ELSE event_type END AS event,
  round(value, 2) AS qty, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type <> 'error'""")


def messages(spark, sf):
    """The events as trade-update messages; errors go to another stream. Every third message
    leaves quantity and price to the order's filled values."""
    ev = spark.readStream.schema(I.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    event = F.when(F.col("event_type") == "purchase", "fill").when(F.col("event_type") == "click", "partial_fill").otherwise(F.col("event_type"))
    qty, price = F.round("value", 2), F.get_json_object("props", "$.k").cast("double")
    given = F.col("event_id") % 3 != 0
    # Purchases fill the order, sign-ups end it for the day every other time; the rest leave the status to the event.
    status = F.when(F.col("event_type") == "purchase", "Filled").when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "canceled")
    order = F.struct(
        F.col("user_id").cast("string").alias("client_order_id"), F.col("event_id").cast("string").alias("id"),
        (F.col("user_id") % 10).cast("string").alias("symbol"), F.lit("buy").alias("side"), status.alias("status"),
        qty.alias("filled_qty"), price.alias("filled_avg_price"))
    data = F.struct(event.alias("event"), F.when(given, qty).alias("qty"), F.when(given, price).alias("price"), order.alias("order"))
    stream = F.when(F.col("event_type") == "error", "listening").otherwise("trade_updates")
    return ev.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_json(F.struct(stream.alias("stream"), data.alias("data"))).alias("payload"))


def drain(sdf, spark):
    """Run a stream over what is there, into files, and read them."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = sdf.writeStream.format("parquet").option("path", f"{where}/data").option(
        "checkpointLocation", f"{where}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{where}/data")


@register("stream_trade_updates", "SELECT CAST(event_id AS VARCHAR) AS broker_order_id, client_order_id, symbol, event, qty, k AS price FROM msgs", ["msgs"], six("qty", "price"))
def _(spark, sf):
    out = drain(ST.stream_trade_updates(messages(spark, sf)), spark)
    return out.select("broker_order_id", "client_order_id", "symbol", "event", "qty", "price")


@register("stream_fills", """SELECT DISTINCT client_order_id, event, qty, k AS price, abs(qty * k) AS notional FROM msgs
WHERE event IN ('fill', 'partial_fill')""", ["msgs"], six("qty", "price", "notional"))
def _(spark, sf):
    updates = ST.stream_trade_updates(messages(spark, sf))
    # Everything sent twice: the repeats have to go.
    out = drain(ST.stream_fills(updates.union(updates), "60 days"), spark)
    return out.select("client_order_id", "event", "qty", "price", "notional")


cte("statuses", """SELECT client_order_id, ts, CASE WHEN event = 'fill' THEN 'Filled' WHEN event = 'signup' AND event_id % 2 = 0 THEN 'canceled' ELSE event END AS status FROM msgs""", ["msgs"])


@register("stream_order_status", """SELECT client_order_id, status, lower(status) IN ('filled', 'canceled', 'expired', 'rejected', 'done_for_day') AS is_terminal
FROM (SELECT client_order_id, arg_max(status, row(ts, status)) AS status FROM statuses GROUP BY 1)""", ["statuses"])
def _(spark, sf):
    where = f"{shared_folder(spark)}/status-{uuid.uuid4().hex}"
    ST.stream_order_status(ST.stream_trade_updates(messages(spark, sf)), f"{where}/data", f"{where}/ckpt").awaitTermination()
    return ST.read_order_status(spark, f"{where}/data").select("client_order_id", "status", "is_terminal")


@register("stream_ewma", """
SELECT CAST(user_id AS VARCHAR) AS symbol, unnest(ids) AS tie, unnest(list_transform(range(1, len(xs) + 1), lambda i:
  list_reduce(xs[1:i], lambda s, x: x / 3.0 + s * (1 - 1 / 3.0)))) AS smooth
FROM (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(value ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id)""",
          (), six("smooth"))
def _(spark, sf):
    ev = spark.readStream.schema(I.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    rows = ev.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                     F.col("event_id").alias("tie"), F.col("value").alias("score"))
    return drain(stream_ewma(rows), spark).select("symbol", "tie", "smooth")

