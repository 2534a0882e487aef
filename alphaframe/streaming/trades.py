"""Trade updates as a stream: parsed messages, de-duplicated fills, latest order status."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

ORDER_FIELDS = (
    "client_order_id string, id string, symbol string, side string, status string, "
    "filled_qty double, filled_avg_price double"
)
MESSAGE = f"struct<stream: string, data: struct<event: string, qty: double, price: double, order: struct<{ORDER_FIELDS.replace(' ', ': ').replace(',:', ',')}>>>"
FILL_EVENTS = ("fill", "partial_fill")
# Order states after which nothing changes any more.
TERMINAL = ("filled", "canceled", "expired", "rejected", "done_for_day")


def stream_trade_updates(sdf: DataFrame, payload: str = "payload", ts: str = "ts") -> DataFrame:
    """Messages of the trade_updates stream as flat rows; works on a batch as well.

    Quantity and price fall back to the order's filled quantity and average price.
    """
    msg = sdf.select(F.col(ts).alias("ts"), F.from_json(payload, MESSAGE).alias("m"))
    d, o = "m.data", "m.data.order"
    rows = msg.where(F.col("m.stream") == "trade_updates")
    return rows.select(
        "ts", F.coalesce(f"{d}.event", F.lit("")).alias("event"), F.col(f"{o}.client_order_id"),
        F.col(f"{o}.id").alias("broker_order_id"), F.col(f"{o}.symbol"), F.col(f"{o}.side"),
        F.coalesce(f"{o}.status", f"{d}.event").alias("status"),
        F.coalesce(F.nullif(F.col(f"{d}.qty"), F.lit(0.0)), f"{o}.filled_qty", F.lit(0.0)).alias("qty"),
        F.coalesce(F.nullif(F.col(f"{d}.price"), F.lit(0.0)), f"{o}.filled_avg_price", F.lit(0.0)).alias("price"),
    )


def stream_fills(updates: DataFrame, delay: str = "1 day") -> DataFrame:
    """Fills with notional; repeats of (order, event, quantity, price) within ``delay`` dropped.

    The watermark bounds the state; a repeat later than it would pass.
    """
    fills = updates.where(F.col("event").isin(*FILL_EVENTS)).withColumn(
        "notional", F.abs(F.col("qty") * F.col("price")))
    keys = ["client_order_id", "event", "qty", "price"]
    if updates.isStreaming:
        return fills.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return fills.dropDuplicates(keys)


def merge_order_status(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Last status per order of a micro-batch merged with what is stored."""
    rows = batch.where(F.col("client_order_id").isNotNull()).select("client_order_id", "ts", "status", "symbol", "side")
    if stored is not None:
        rows = rows.unionByName(stored.drop("is_terminal"))
    latest = rows.groupBy("client_order_id").agg(F.max_by(F.struct("ts", "status", "symbol", "side"), F.struct("ts", "status")).alias("s"))
    return latest.select("client_order_id", "s.*").withColumn("is_terminal", F.lower("status").isin(*TERMINAL))


class LatestStatus(StatefulProcessor):
    """Per order the newest (time in microseconds, status) seen; a newer one is handed out as a change and replaces it.

    After a terminal state a timer runs on event time; when the watermark reaches it the order is forgotten, so the
    state holds the open orders and those closed a while ago. An order without a terminal state is forgotten after
    ``idle`` without an update.
    """

    def __init__(self, keep_ms: int, idle_ms: int) -> None:
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rank = lambda at, status: (at, status is not None, status or "")
        best = None
        for r in rows:  # one row is held, however many an order has
            if best is None or rank(r["at"], r["status"]) > rank(best["at"], best["status"]):
                best = r
        if self.newest.exists() and rank(best["at"], best["status"]) <= rank(*self.newest.get()):
            return
        self.newest.update((best["at"], best["status"]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        done = (best["status"] or "").lower() in TERMINAL
        self.handle.registerTimer(best["at"] // 1000 + (self.keep_ms if done else self.idle_ms))
        yield Row(client_order_id=key[0], at=best["at"], status=best["status"], symbol=best["symbol"], side=best["side"], is_terminal=done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


CHANGED = "client_order_id string, at long, status string, symbol string, side string, is_terminal boolean"
CHANGES = "client_order_id string, ts timestamp, status string, symbol string, side string, is_terminal boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that typed state needs."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def order_changes(updates: DataFrame, delay: str = "1 day", keep_days: float = 7, idle_days: float = 90) -> DataFrame:
    """Changes of order status as a stream: a row whenever an order's newest status is replaced by a newer one.

    Updates without an order id or time are left out, as are those older than the watermark. A closed order is forgotten
    ``keep_days`` after its last update, any order after ``idle_days``. Start it inside ``keyed_state``.
    """
    rows = updates.where("client_order_id IS NOT NULL AND ts IS NOT NULL").select(
        "client_order_id", "ts", F.unix_micros("ts").alias("at"), "status", "symbol", "side")
    changed = rows.withWatermark("ts", delay).groupBy("client_order_id").transformWithState(
        LatestStatus(int(keep_days * DAY_MS), int(idle_days * DAY_MS)), CHANGED, "append", "EventTime")
    return changed.select("client_order_id", F.timestamp_micros("at").alias("ts"), "status", "symbol", "side", "is_terminal")


def stream_order_status(updates: DataFrame, path: str, checkpoint: str, **limits):
    """Append every change of an order's status under ``path``; no batch writes an order that did not change."""
    with keyed_state(updates.sparkSession):
        return order_changes(updates, **limits).writeStream.format("parquet").option("path", path).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_order_status(spark: SparkSession, path: str) -> DataFrame | None:
    """The last change of every order, by one aggregation; None if there is none yet."""
    try:
        changes = spark.read.schema(CHANGES).parquet(path)
    except AnalysisException:
        return None
    return merge_order_status(changes, None)
