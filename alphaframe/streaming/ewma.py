"""Stateful one-sided smoothing per symbol, never touching what was emitted before."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .trades import ROCKSDB, STORE

BLOCK = 64


def smoothed(x: np.ndarray, alpha: float, previous: float | None) -> np.ndarray:
    """s = alpha*x + (1-alpha)*previous, a block at a time by a running sum of scaled inputs."""
    x = np.asarray(x, float)
    if alpha >= 1.0 or not len(x):
        return x
    out, rest = np.empty(len(x)), 1.0 - alpha
    up = rest ** np.arange(BLOCK)
    last = x[0] if previous is None else previous
    for at in range(0, len(x), BLOCK):
        part = x[at:at + BLOCK]
        k = up[:len(part)]
        out[at:at + BLOCK] = k * (np.cumsum(alpha * part / k) + rest * last)
        last = out[min(at + BLOCK, len(x)) - 1]
    return out


ROW = np.dtype([("at", "<i8"), ("tie", "<i8"), ("score", "<f8")])
CHUNK = 4096


class Smoothing(StatefulProcessor):
    """Per symbol the last smoothed value, and the rows the watermark has not passed yet.

    Rows wait packed, 24 bytes each, in chunks of a list state; a timer at the earliest of them hands out what
    the watermark has passed, in order of (ts, tie), a chunk at a time.
    """

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double")
        self.waiting = handle.getListState("waiting", "chunk binary")

    def _wake(self, earliest_us: int) -> None:
        for t in list(self.handle.listTimers()):
            if t <= earliest_us // 1000 - 1:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(earliest_us // 1000 - 1)  # timers fire once the watermark is beyond them

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None
        while part := list(islice(rows, CHUNK)):
            packed = np.array([(r["at"], r["tie"], np.nan if r["score"] is None else r["score"]) for r in part], ROW)
            self.waiting.appendValue((packed.tobytes(),))
            low = int(packed["at"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = np.concatenate([np.frombuffer(bytes(c[0]), ROW) for c in self.waiting.get()] or [np.empty(0, ROW)])
        ready = held["at"] // 1000 <= passed
        rest, now = held[~ready], held[ready]
        self.waiting.clear()
        for at in range(0, len(rest), CHUNK):
            self.waiting.appendValue((rest[at:at + CHUNK].tobytes(),))
        if len(rest):
            self._wake(int(rest["at"].min()))
        now = now[np.lexsort((now["tie"], now["at"]))]
        for at in range(0, len(now), CHUNK):
            part = now[at:at + CHUNK]
            out = smoothed(part["score"], self.alpha, self.last.get()[0] if self.last.exists() else None)
            self.last.update((float(out[-1]),))
            for r, s in zip(part, out):
                yield Row(symbol=key[0], at=int(r["at"]), tie=int(r["tie"]), score=float(r["score"]), smooth=float(s))

    def close(self) -> None:
        pass


def stream_ewma(sdf: DataFrame, span: int = 5, delay: str = "0 seconds") -> DataFrame:
    """(symbol, ts, tie, score) with the running smoothed score, in the order of event time.

    A row is handed out once the watermark, ``delay`` behind the newest time seen, has passed it, so rows that come out of
    order within that delay are smoothed in order; later ones are dropped. The state of a symbol is one number
    and the rows still waiting. Rows without symbol, time or score are left out. Sets the session's state store to the one
    that typed state needs.
    """
    sdf.sparkSession.conf.set(STORE, ROCKSDB)
    rows = sdf.where("symbol IS NOT NULL AND ts IS NOT NULL AND score IS NOT NULL").select(
        "symbol", "ts", F.unix_micros("ts").alias("at"), "tie", F.col("score").cast("double").alias("score"))
    out = rows.withWatermark("ts", delay).groupBy("symbol").transformWithState(
        Smoothing(2.0 / (span + 1.0)), "symbol string, at long, tie long, score double, smooth double", "append", "EventTime")
    return out.select("symbol", F.timestamp_micros("at").alias("ts"), "tie", "score", "smooth")
