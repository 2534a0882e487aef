"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree halves the vectors at the median of a random projection, again and again; vectors near a cut
go to both sides. The cuts are fitted on a bounded sample, every vector is sent down every tree, and
vectors of one label that meet in a leaf are compared. A pair that meets in several leaves counts in
the first; of the links only a spanning star leaves a leaf. A leaf with very many vectors is
compared block by block, so its size bounds neither a task nor what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored
from .components import components

TREES = 8
SAMPLE = 32_768
LEAF = 256
BLOCK = 1024
SPILL = 0.15  # in standard deviations of the projection
LEAST_FIT = 32
DEEPEST = 48


@dataclass
class Tree:
    """One direction per level; per fitted node its children and, per level, the cut that holds below it."""

    directions: np.ndarray  # dimension x depth
    cuts: np.ndarray  # node x depth
    widths: np.ndarray  # depth
    children: np.ndarray  # node x 2; a node that is not fitted further is its own child

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf codes; a row that spills has several."""
        shown = unit @ self.directions
        row, node, code = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        for level in range(self.directions.shape[1]):
            gap = shown[row, level] - self.cuts[node, level]
            right, both = gap > 0, np.abs(gap) <= self.widths[level]
            again = np.flatnonzero(both)
            row, node, code = np.concatenate([row, row[again]]), np.concatenate([node, node[again]]), np.concatenate([code, code[again]])
            right = np.concatenate([right, ~right[again]]).astype(np.int64)
            node, code = self.children[node, right], code * 2 + right
        return row, code


def grow(sample: np.ndarray, dimension: int, depth: int, seed: int, spill: float = SPILL) -> Tree:
    """Fit a tree on unit vectors; below nodes with few of them their own medians hold for all levels."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(dimension, depth))
    directions /= np.linalg.norm(directions, axis=0)
    shown = sample @ directions
    cuts, children, work = [], [], [(np.arange(len(sample)), 0)]
    at = 0
    while at < len(work):
        rows, level = work[at]
        cuts.append(np.median(shown[rows], axis=0) if len(rows) else np.zeros(depth))
        pair = [at, at]
        if level < depth and len(rows) >= 2 * LEAST_FIT:
            right = shown[rows, level] > cuts[-1][level]
            if right.any() and not right.all():
                pair = [len(work), len(work) + 1]
                work += [(rows[~right], level + 1), (rows[right], level + 1)]
        children.append(pair)
        at += 1
    widths = spill * (shown.std(axis=0) if len(sample) else np.ones(depth))
    return Tree(directions, np.array(cuts), widths, np.array(children, np.int64))


def usable(v: list | None) -> bool:
    """Whether all components are finite and one is not zero."""
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v))


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.array(column.to_pylist(), np.float64)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def compare(unit: np.ndarray, codes: list[np.ndarray], here: int, least: float, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of ``rows`` x ``cols`` at or above ``least``, and whether this leaf is their first."""
    hit = unit[rows] @ unit[cols].T >= least
    i, j = np.nonzero(hit)
    i, j = rows[i], cols[j]
    use = i < j if len(rows) == len(cols) and (rows == cols).all() else i != j
    i, j = i[use], j[use]
    width = max(map(len, codes))
    padded = np.full((len(codes), width), -1, np.int64)
    for k, c in enumerate(codes):
        padded[k, :len(c)] = c
    earlier = np.where(padded < here, padded, -1)
    owned = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        a, b = earlier[i[at:at + (1 << 14)]], padded[j[at:at + (1 << 14)]]
        owned[at:at + (1 << 14)] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))
    return i, j, owned


def star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component under the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.98, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label link at cosine ``least`` or more, in double precision; links found are exact,
    those of vectors that never share a leaf are missed. A vector that is null, empty, zero or has a null
    or non-finite component, one without label, and one without id link with nothing; vectors of
    different lengths never link. Rows that repeat an id are one vector, of their smallest embedding and
    label, and give a row each. An empty table gives an empty result; further columns are ignored.
    ``trees``, ``leaf`` and ``sample`` (the most vectors the cuts are fitted on) trade time for recall.
    """
    rows = only(vectors, vec_id=id_col, embedding=vector_col, label=label_col).withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    one = stored(fine.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("v")).select("vec_id", "v.*"))
    sizes = one.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("n")).groupBy("dim").agg(
        F.max("n").alias("most"), F.sum("n").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    forest: dict[int, list[Tree]] = {}
    for s in sizes:  # further lengths are not split, which keeps their pairs
        depth = min(DEEPEST, max(0, int(np.ceil(np.log2(s["most"] / leaf)))))
        near = one.where(F.size("embedding") == s["dim"]).where(
            F.xxhash64("vec_id", F.lit(17)).cast("double") / F.lit(2.0 ** 64) + 0.5 <= F.lit(min(1.0, 0.9 * sample / s["n"])))
        flat = near.limit(sample).toArrow().column("embedding") if depth else []
        unit = unit_rows(flat) if len(flat) else np.empty((0, s["dim"]))
        forest[s["dim"]] = [grow(unit, s["dim"], depth, 1000 + t) for t in range(trees if depth else 1)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding").to_pylist()
            for dim in {len(v) for v in values}:
                of = np.array([k for k, v in enumerate(values) if len(v) == dim])
                unit = unit_rows(batch.column("embedding").take(pa.array(of)))
                found: list[list[int]] = [[] for _ in of]
                for t, tree in enumerate(forest.get(dim, [grow(np.empty((0, dim)), dim, 0, 0)])):
                    for r, code in zip(*tree.leaves(unit), strict=True):
                        found[r].append(t << 48 | int(code))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(of)) for c in ("vec_id", "embedding", "label")), pa.array(map(sorted, found), pa.list_(pa.int64()))],
                    names=["vec_id", "embedding", "label", "codes"])

    label = one.schema["label"].dataType.simpleString()
    key = one.schema["vec_id"].dataType.simpleString()
    sent = stored(one.mapInArrow(send, f"vec_id {key}, embedding array<double>, label {label}, codes array<long>"))
    met = sent.withColumn("code", F.explode("codes")).withColumn("dim", F.size("embedding"))
    large = stored(met.groupBy("label", "dim", "code").agg(F.count("*").alias("n")).where(F.col("n") > block)
                   .select("label", "dim", "code", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = met.join(large, ["label", "dim", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "b", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.select("vec_id", "embedding", "label", "codes", "code", "dim", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def meet(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        unit = unit_rows(group.column("embedding"))[by]
        codes = [np.array(c, np.int64) for c in group.column("codes").to_pylist()]
        codes = [codes[k] for k in by]
        b, x, y = group.column("b").to_numpy()[by], group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        i, j, owned = compare(unit, codes, group.column("code")[0].as_py(), least, left, right)
        n = np.bincount(i[owned], minlength=len(ids)) + np.bincount(j[owned], minlength=len(ids))
        root = star(len(ids), i, j)
        take = np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
        return pa.table({"vec_id": ids[take], "n": n[take], "to": ids[root[take]]})

    found = stored(tasks.groupBy("label", "dim", "code", "x", "y").applyInArrow(meet, f"vec_id {key}, n long, to {key}"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    linked = components(found.select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    facts = stored(counts.join(linked, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", "component"))
    whole = F.coalesce("component", "vec_id")
    return rows.join(facts, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"),
        F.coalesce(F.col("vec_id") == whole, F.lit(False)).alias("kept"))
