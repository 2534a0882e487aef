"""Order changes with typed state: restarts, late and repeated updates, closed orders that are forgotten."""

import datetime as dt

from pyspark.sql import functions as F

from alphaframe.streaming import trades as ST

SCHEMA = "client_order_id string, ts timestamp, status string, symbol string, side string"
at = lambda d, m=0: dt.datetime(2024, 1, d, 0, m)


def feed(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def drain(spark, tmp_path, **limits):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    updates = spark.readStream.schema(SCHEMA).parquet(src)
    ST.stream_order_status(updates, out, ck, **limits).awaitTermination()
    return out


def test_changes_across_restarts(spark, tmp_path):
    """Each run goes on from the state of the one before; only newer states are written."""
    src = str(tmp_path / "src")
    feed(spark, src, [("a", at(1), "new", "X", "buy"), ("b", at(1), "new", "Y", "sell"), (None, at(1), "new", "Z", "buy"), ("n", None, "new", "Z", "buy")])
    out = drain(spark, tmp_path)
    feed(spark, src, [("a", at(1, 5), "partial_fill", "X", "buy"), ("b", at(1), "new", "Y", "sell"), ("a", at(1, 3), "older", "X", "buy")])
    drain(spark, tmp_path)
    feed(spark, src, [("a", at(1, 9), "Filled", "X", "buy"), ("b", at(1), "a_lesser_status_at_the_same_time", "Y", "sell")])
    drain(spark, tmp_path)
    changes = spark.read.schema(ST.CHANGES).parquet(out)
    assert sorted((r["client_order_id"], r["status"]) for r in changes.collect()) == [("a", "Filled"), ("a", "new"), ("a", "partial_fill"), ("b", "new")]
    last = {r["client_order_id"]: (r["status"], r["is_terminal"]) for r in ST.read_order_status(spark, out).collect()}
    assert last == {"a": ("Filled", True), "b": ("new", False)}


def test_nothing_is_rewritten(spark, tmp_path):
    """A run without news writes no order again, however many there are."""
    src = str(tmp_path / "src")
    feed(spark, src, [(f"o{i}", at(1), "new", "X", "buy") for i in range(500)])
    out = drain(spark, tmp_path)
    n = spark.read.schema(ST.CHANGES).parquet(out).count()
    feed(spark, src, [("o7", at(1, 1), "filled", "X", "buy")])
    drain(spark, tmp_path)
    assert spark.read.schema(ST.CHANGES).parquet(out).count() == n + 1 == 501


def test_closed_orders_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    """Once the watermark is past a closed order's time, its state is gone: the same key starts anew."""
    src = str(tmp_path / "src")
    limits = dict(delay="1 hour", keep_days=1, idle_days=20)
    feed(spark, src, [("a", at(1), "filled", "X", "buy"), ("b", at(1), "new", "Y", "buy")])
    out = drain(spark, tmp_path, **limits)
    feed(spark, src, [("c", at(10), "new", "Z", "buy")])  # moves the watermark on
    drain(spark, tmp_path, **limits)
    feed(spark, src, [("late", at(2), "new", "Z", "buy"), ("a", at(10, 1), "reopened", "X", "buy"), ("b", at(10, 1), "filled", "Y", "buy")])
    drain(spark, tmp_path, **limits)
    rows = sorted((r["client_order_id"], r["status"]) for r in spark.read.schema(ST.CHANGES).parquet(out).collect())
    assert rows == [("a", "filled"), ("a", "reopened"), ("b", "filled"), ("b", "new"), ("c", "new")]


def test_order_updates_from_messages(spark):
    """Status falls back to the event, and names are compared without case."""
    rows = [("{\"stream\":\"trade_updates\",\"data\":{\"event\":\"canceled\",\"order\":{\"client_order_id\":\"a\"}}}", at(1)),
            ("{\"stream\":\"trade_updates\",\"data\":{\"event\":\"fill\",\"order\":{\"client_order_id\":\"b\",\"status\":\"FILLED\"}}}", at(1)),
            ("not json", at(1)), (None, at(1))]
    updates = ST.stream_trade_updates(spark.createDataFrame(rows, "payload string, ts timestamp"))
    got = {r["client_order_id"]: r["is_terminal"] for r in ST.merge_order_status(updates.where(F.col("client_order_id").isNotNull()), None).collect()}
    assert got == {"a": True, "b": True}


EWMA = "symbol string, ts timestamp, tie long, score double"


def smooth_feed(spark, src, rows):
    spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 0, 0, t), i, float(v)) for i, t, v in rows], EWMA).coalesce(1).write.mode("append").parquet(src)


def smooth_drain(spark, tmp_path, delay):
    from alphaframe.streaming.ewma import stream_ewma

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = spark.readStream.schema(EWMA).parquet(src)
    stream_ewma(rows, 3, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return {r["tie"]: r["smooth"] for r in spark.read.parquet(out).collect()}


def test_rows_out_of_order_wait_for_the_watermark_and_late_ones_go(spark, tmp_path):
    """Rows of a later batch that lie between earlier ones are smoothed in their place; what the watermark passed stays as it was."""
    src = str(tmp_path / "src")
    smooth_feed(spark, src, [(1, 0, 1), (2, 10, 2), (3, 30, 8)])
    first = smooth_drain(spark, tmp_path, "15 seconds")
    assert first == {1: 1.0, 2: 1.5}  # 30 waits: the watermark is at 15
    smooth_feed(spark, src, [(4, 20, 4), (5, 5, 100), (6, 50, 0)])  # 20 comes before 30; 5 is too late
    got = smooth_drain(spark, tmp_path, "15 seconds")
    assert got == {1: 1.0, 2: 1.5, 4: 2.75, 3: 5.375}
    smooth_feed(spark, src, [(7, 59, 1)])
    smooth_drain(spark, tmp_path, "15 seconds")
    assert set(got) == {1, 2, 3, 4}


def test_many_rows_of_one_symbol_wait_packed(spark, tmp_path):
    """A symbol's rows wait at 24 bytes each and leave in chunks, in order."""
    from alphaframe.streaming.ewma import CHUNK, ROW, smoothed

    n = 3 * CHUNK + 17
    assert ROW.itemsize == 24
    src = str(tmp_path / "src")
    spark.range(n).select(F.lit("s").alias("symbol"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") * 7919) % n * 1_000_000).alias("ts"),
                          F.col("id").alias("tie"), ((F.col("id") * 31) % 101).cast("double").alias("score")).coalesce(1).write.parquet(src)
    got = smooth_drain(spark, tmp_path, "0 seconds")
    order = sorted(range(n), key=lambda i: (i * 7919 % n, i))
    want = smoothed([float(i * 31 % 101) for i in order], 0.5, None)
    assert len(got) == n and max(abs(got[i] - w) for i, w in zip(order, want)) < 1e-9
