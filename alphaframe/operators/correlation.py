"""Correlations of trailing returns by matrix products over blocks of names.

A name's returns over the sessions before a decision are one array, cut from the array of its whole
history, so a history moves once per name and never once per session. Gaps are handled by masks:
sums over the sessions that two names share are products of values, squares and masks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def histories(rets: DataFrame, cal: DataFrame) -> DataFrame:
    """(symbol, history): the returns of a symbol by session, null where unknown, up to its last known one."""
    known = rets.where(F.col("ret").isNotNull()).select("date", "symbol", "ret").join(cal.select("date", "idx"), "date")
    lists = known.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("idx", "ret"))).alias("e"))
    gap = lambda x, k: F.when(k == 0, x["idx"]).otherwise(x["idx"] - F.get("e", k - 1)["idx"] - F.lit(1))
    dense = F.flatten(F.transform("e", lambda x, k: F.concat(
        F.array_repeat(F.lit(None).cast("double"), gap(x, k).cast("int")), F.array(x["ret"]))))
    return lists.select("symbol", dense.alias("history"))


def return_vectors(names: DataFrame, rets: DataFrame, cal: DataFrame, lookback: int) -> DataFrame:
    """``names`` (decision, symbol, …) with ``vec``: up to ``lookback`` returns, the same sessions for all names of a
    decision; shorter or empty where a symbol has none later on."""
    at = cal.select(F.col("date").alias("decision"), F.col("idx").alias("_at"))
    low = F.greatest(F.lit(0), F.col("_at") - F.lit(lookback - 1))
    vec = F.when(F.size("history") > low, F.slice("history", (low + 1).cast("int"), (F.col("_at") - low + 1).cast("int")))
    rows = names.join(at, "decision").join(histories(rets, cal), "symbol", "left")
    return rows.withColumn("vec", F.coalesce(vec, F.array().cast("array<double>"))).drop("_at", "history")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; NaN where a return is unknown."""
    lens = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lens), width), np.nan)
    out[np.arange(width) < lens[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class Masked:
    """Returns of some names, ready for products: values with 0 in gaps, squares and masks."""

    def __init__(self, x: np.ndarray) -> None:
        known = ~np.isnan(x)
        count = known.sum(axis=1)
        mean = np.where(known, x, 0.0).sum(axis=1) / np.maximum(count, 1)
        # Shifted by each name's own mean, which changes no correlation but keeps the sums small.
        self.values = np.where(known, x - mean[:, None], 0.0)
        self.squares, self.mask = self.values ** 2, known.astype(float)

    def rows(self, at) -> Masked:
        part = object.__new__(Masked)
        part.values, part.squares, part.mask = self.values[at], self.squares[at], self.mask[at]
        return part

    @staticmethod
    def joined(parts: Sequence[Masked]) -> Masked:
        whole = object.__new__(Masked)
        for field in ("values", "squares", "mask"):
            setattr(whole, field, np.concatenate([getattr(p, field) for p in parts]))
        return whole


def correlations(x: Masked, y: Masked, min_obs: int) -> tuple[np.ndarray, np.ndarray]:
    """(correlation, sessions in common) of each name of ``x`` with each of ``y``; NaN below ``min_obs`` or on a constant side.

    Rounded to 12 digits, so that sign tests and caps do not depend on the order of sums.
    """
    n = x.mask @ y.mask.T
    sx, sy = x.values @ y.mask.T, x.mask @ y.values.T
    sxx, syy = x.squares @ y.mask.T, x.mask @ y.squares.T
    vx, vy = n * sxx - sx ** 2, n * syy - sy ** 2
    fine = (n >= max(min_obs, 1)) & (vx > 1e-13 * n * sxx) & (vy > 1e-13 * n * syy)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = (n * (x.values @ y.values.T) - sx * sy) / np.sqrt(vx * vy)
    return np.where(fine, np.round(corr, 12), np.nan), n


def block_pairs(names: DataFrame, rets: DataFrame, cal: DataFrame, lookback: int, min_obs: int, block: int = BLOCK) -> DataFrame:
    """(decision, a, b, corr, n) with a < b: names are dealt into blocks, and each pair of blocks is one product.

    A name's vector moves once per block of its decision; no row per pair and session exists.
    """
    vectors = return_vectors(names.select("decision", "symbol").distinct(), rets, cal, lookback).where(F.size("vec") > 0)
    blocks = names.select("decision", "symbol").distinct().groupBy("decision").agg(
        F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("symbol"), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j")))
    dealt = vectors.join(blocks, "decision").withColumn("_own", own).select("decision", "symbol", "vec", "_own", F.explode(pairs).alias("_p"))
    kind = names.schema["decision"].dataType.simpleString()

    def product(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("symbol", "ascending")]))
        x = Masked(matrix(table.column("vec").combine_chunks(), lookback))
        own, i, j = (table.column(c).to_numpy() for c in ("_own", "i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        corr, n = correlations(x.rows(left), x.rows(right), min_obs)
        r, c = np.nonzero(~np.isnan(corr))
        if i[0] == j[0]:
            once = left[r] < right[c]
            r, c = r[once], c[once]
        a, b = np.minimum(left[r], right[c]), np.maximum(left[r], right[c])  # rows lie by symbol
        return pa.table({
            "decision": table.column("decision").take(pa.array(a)), "a": table.column("symbol").take(pa.array(a)),
            "b": table.column("symbol").take(pa.array(b)), "corr": corr[r, c], "n": n[r, c].astype(np.int64)})

    flat = dealt.select("decision", "symbol", "vec", "_own", "_p.i", "_p.j")
    return flat.groupBy("decision", "i", "j").applyInArrow(product, f"decision {kind}, a string, b string, corr double, n long")


class Choice:
    """The greedy choice of one decision under one cap, carried from batch to batch."""

    def __init__(self, cap: float, max_names: int, min_names: int, min_obs: int) -> None:
        self.cap, self.max_names, self.min_names, self.min_obs = cap, max_names, min_names, min_obs
        self.taken: list[Masked] = []
        self.chosen: list[tuple[str, float]] = []
        self.rejected: list[tuple[float, int, str]] = []

    def full(self) -> bool:
        return len(self.chosen) >= self.max_names

    def add(self, x: Masked, symbols: list[str], first: int) -> None:
        """Candidates in order. The largest correlation with the chosen names runs along; a new choice
        is correlated with the candidates after it only."""
        if self.full():
            return
        most = np.full(len(symbols), np.nan)
        if self.taken:
            most = np.fmax.reduce(correlations(x, Masked.joined(self.taken), self.min_obs)[0], axis=1)
        at, left = 0, []
        while not self.full():
            seen = np.where(np.isnan(most), 0.0, most)
            ok = np.flatnonzero(seen[at:] <= self.cap)
            stop = at + int(ok[0]) if len(ok) else len(symbols)
            left += range(at, stop)
            if stop == len(symbols):
                break
            self.chosen.append((symbols[stop], float(seen[stop])))
            self.taken.append(x.rows([stop]))
            at = stop + 1
            if at < len(symbols):
                most[at:] = np.fmax(most[at:], correlations(x.rows(slice(at, None)), self.taken[-1], self.min_obs)[0][:, 0])
        seen = np.where(np.isnan(most), 0.0, most)
        self.rejected = sorted([*self.rejected, *((float(seen[k]), first + k, symbols[k]) for k in left)])[:self.min_names]

    def picks(self) -> list[tuple[str, float]]:
        short = max(0, self.min_names - len(self.chosen))
        return (self.chosen + [(s, m) for m, _, s in self.rejected[:short]])[:self.max_names]


def greedy_picks(
    cands: DataFrame, rets: DataFrame, cal: DataFrame, caps: Sequence[float], max_names: int, min_names: int,
    lookback: int, min_obs: int, block: int = BLOCK, cut=None,
) -> DataFrame:
    """(cap, decision, pick, symbol, max_corr) for every cap at once over one stream of candidates.

    Candidates (decision, symbol, score) are dealt by decision and sorted by score, and each task walks
    through its decisions. What it carries is bounded by the caps, ``max_names`` and ``min_names``, whatever the number of
    candidates: the chosen names' returns and the least correlated rejects. ``block`` candidates are compared at once; ``cut`` stores the vectors first.
    """
    rows = return_vectors(cands.select("decision", "symbol", "score"), rets, cal, lookback)
    if cut is not None:
        rows = cut(rows)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("decision", "symbol")]
    limits = [float(c) for c in caps]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, choices, place = None, [], 0

        def done() -> pa.RecordBatch:
            rows = [(cap, key, k, s, m) for cap, c in zip(limits, choices, strict=True) for k, (s, m) in enumerate(c.picks())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.float64()), pa.array(cols[1], key_type), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], names=["cap", "decision", "pick", "symbol", "max_corr"])

        for batch in batches:
            key_type = batch.schema.field("decision").type
            days, symbols = batch.column("decision").to_pylist(), batch.column("symbol").to_pylist()
            start = 0
            while start < len(days):
                stop = start + 1
                while stop < len(days) and stop - start < block and days[stop] == days[start]:
                    stop += 1
                if days[start] != key or not choices:
                    if choices:
                        yield done()
                    key, place = days[start], 0
                    choices = [Choice(c, max_names, min_names, min_obs) for c in limits]
                if not all(c.full() for c in choices):
                    x = Masked(matrix(batch.column("vec").slice(start, stop - start), lookback))
                    for c in choices:
                        c.add(x, symbols[start:stop], place)
                place, start = place + stop - start, stop
        if choices:
            yield done()

    ordered = rows.repartition("decision").sortWithinPartitions("decision", F.col("score").desc(), F.col("symbol").asc())
    return ordered.select("decision", "symbol", "vec").mapInArrow(
        walk, f"cap double, decision {kinds[0]}, pick int, symbol {kinds[1]}, max_corr double")
