"""Removal of long repeated byte strings by a sampled suffix array.

A string of ``length`` bytes is known by its anchor, the place in it whose ``gram`` bytes have the least
hash; equal strings have equal anchors at equal places. So only the suffixes at anchors that occur
twice are sorted. All windows with one anchor form a region. Regions that are equal as a whole are repeated as a
whole; of the different ones around equal anchors, the text to the right and the reversed text to the
left are put in suffix order by deep-shallow sorting. The common prefixes of neighbours in both
orders tell how far each region agrees with any other, without forming pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, stored
from .shingles import VALUE, mixed, powers
from .suffix_sort import deep_shallow, neighbours

LENGTH = 200
GRAM = 32
CHUNK = 1 << 22
SLICE = 256
GROUP_MOST = 4096


def sums_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[:-1], out=sums[1:])
    return sums, down


def hashed(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte range, from its bytes and length."""
    return mixed((sums[end] - sums[start]) * down[start] + mixed((end - start).astype(np.uint64)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, by running minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def regions(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows (hash of the anchor, hash of the region, start, windows, anchor place from the start)."""
    found = []
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[at:at + CHUNK + length - 1]
        if len(part) < length:
            continue
        sums, down = sums_of(part)
        n = len(part) - gram + 1
        grams = mixed((sums[gram:] - sums[:n]) * down[:n])
        packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        place = (sliding_min(packed, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.concatenate([start[1:], [len(place)]])
        anchor = place[start]
        found.append(np.stack([
            grams[anchor].view(np.int64), hashed(sums, down, start, end + length - 1).view(np.int64), start + at, end - start, anchor - start], axis=1))
    return np.concatenate(found) if found else np.empty((0, 5), np.int64)


def data_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def anchors(docs: DataFrame) -> DataFrame:
    """key, mark, h: one row per region of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [regions(data_of(t))[:, 0] for t in part.column("text").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(of), part.column("mark").take(of), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]))],
                    names=["key", "mark", "h"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "mark", "text").mapInArrow(run, f"key {kind}, mark long, h long")


def suspects(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, mark, text and the regions around wanted anchors of each text that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["h", "r", "start", "windows", "left"]
        kind = pa.struct([(f, pa.int64()) for f in fields])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                kept = []
                for text, hs in zip(part.column("text").to_pylist(), part.column("hs"), strict=True):
                    rows = regions(data_of(text))
                    rows = rows[np.isin(rows[:, 0], hs.values.to_numpy())]
                    kept.append(rows)
                flat = np.concatenate([*kept, np.empty((0, 5), np.int64)])
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in kept])]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(5)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("mark"), part.column("text"), pa.ListArray.from_arrays(pa.array(offsets), items)],
                    names=["key", "mark", "text", "regions"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.join(wanted, ["key", "mark"]).select("key", "mark", "text", "hs").mapInArrow(
        run, f"key {kind}, mark long, text string, regions array<struct<h:long,r:long,start:long,windows:long,left:long>>")


def agreement(left: list[bytes], right: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each region, the stretches (bytes left of its anchor, bytes right) that another one repeats.

    ``right`` starts at the anchor, ``left`` is what comes before it, reversed. A set of neighbours in
    the order of ``right`` shares a prefix; within it, the left neighbours tell the longest common left
    side of each. All such sets come from one pass with a stack.
    """
    n = len(right)
    by_right, by_left = deep_shallow(right), deep_shallow(left)
    shared_right, shared_left = neighbours(right, by_right), neighbours(left, by_left)
    rank = [0] * n
    for place, k in enumerate(by_left):
        rank[k] = place
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def settle(first: int, last: int, depth: int) -> None:
        ranks = sorted(rank[k] for k in by_right[first:last + 1])
        before = 0
        for x, place in enumerate(ranks):
            after = min(shared_left[place + 1:ranks[x + 1] + 1]) if x + 1 < len(ranks) else 0
            best = max(before, after)
            if best + depth >= length:
                out[by_left[place]].append((best, depth))
            before = after

    stack: list[tuple[int, int]] = []  # first place, shared prefix
    for place in range(1, n + 1):
        depth, first = shared_right[place] if place < n else 0, place - 1
        while stack and stack[-1][1] > depth:
            first, deep = stack.pop()
            settle(first, place - 1, deep)
        if depth and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))
    return out


def partly_repeated(samples: DataFrame, length: int) -> DataFrame:
    """h, r, from, to (bytes from the region's start) of what other regions of the same anchor repeat."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        h = table.column("h").to_numpy()
        r, left, body = table.column("r").to_pylist(), table.column("left").to_pylist(), table.column("body").to_pylist()
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), [len(h)]]).tolist()
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                found = agreement([body[k][:left[k]][::-1] for k in range(a, b)], [body[k][left[k]:] for k in range(a, b)], length)
                rows += [(int(h[a]), r[a + k], left[a + k] - x, left[a + k] + y) for k, spans in enumerate(found) for x, y in spans]
        columns = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "r", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # sorted: where the last anchor begins
                rest = table.slice(cut)
                if cut:
                    yield judged(table.slice(0, cut))
        if rest is not None:
            yield judged(rest)

    dealt = samples.select("h", "r", "left", "body").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "h long, r long, `from` long, `to` long")


def bodies(texts: DataFrame, samples: DataFrame, length: int) -> DataFrame:
    """Add the bytes of each sampled region, read from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = (text or "").encode()
                rows += [(w["h"], w["r"], w["left"], data[w["start"]:w["start"] + w["windows"] + length - 1]) for w in wanted]
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "r", "left", "body"])

    by_text = samples.groupBy("key", "mark").agg(F.collect_list(F.struct("h", "r", "start", "windows", "left")).alias("wanted"))
    return texts.select("key", "mark", "text").join(by_text, ["key", "mark"]).select("text", "wanted").mapInArrow(
        run, "h long, r long, left long, body binary")


def counted_windows(samples: DataFrame, length: int) -> DataFrame:
    """The same answer as ``partly_repeated`` for anchors with very many regions: windows are counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column("body")[k].as_py(), np.uint8)
                sums, down = sums_of(data)
                start = np.arange(len(data) - length + 1)
                w = hashed(sums, down, start, start + length).view(np.int64)
                one = np.full(len(w), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one + batch.column("h")[k].as_py()), pa.array(one + batch.column("r")[k].as_py()), pa.array(start), pa.array(w)],
                    names=["h", "r", "at", "w"])

    windows = stored(samples.select("h", "r", "body").mapInArrow(run, "h long, r long, at long, w long"))
    again = stored(windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w"))
    return windows.join(again, ["h", "w"]).select("h", "r", F.col("at").alias("from"), (F.col("at") + length).alias("to"))


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_most: int = GROUP_MOST,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (from, to: the maximal runs of bytes that go), kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in this or another
    text; overlaps count, matches end with their text, and all strings are judged on the input. A null
    text counts as empty; texts shorter than ``length`` keep all. Rows that repeat are occurrences of
    their own, also with equal or null ids. An empty table gives an empty result; further columns are
    ignored. ``kept_sha256`` has the digest of the bytes that stay; ``without`` cuts them out.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    # Equal ids with equal texts have equal answers; these two columns tell all other rows apart.
    key: list[Column] = [F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("key"), F.xxhash64("text").alias("mark")]
    texts = rows.select(*key, "text")
    found = stored(anchors(texts))
    twice = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    wanted = found.join(twice, "h").groupBy("key", "mark").agg(F.collect_set("h").alias("hs"))
    work = stored(suspects(texts, wanted))
    places = work.select("key", "mark", F.explode("regions").alias("g")).select("key", "mark", "g.*")
    kinds = places.groupBy("h", "r").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "mark", "start", "windows", "left")).alias("one"))
    kinds = stored(kinds.select("h", "r", "n", "one.*"))
    several = stored(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    # Around these anchors regions differ, so each kind of region is read once and compared.
    sampled = stored(bodies(work, kinds.join(several.select("h"), "h").drop("n"), length))
    usual, many = several.where(F.col("kinds") <= group_most).select("h"), several.where(F.col("kinds") > group_most).select("h")
    part = partly_repeated(sampled.join(usual, "h"), length).union(counted_windows(sampled.join(many, "h"), length))
    whole = kinds.where("n > 1").select("h", "r", F.lit(0).cast("long").alias("from"), (F.col("windows") + length - 1).alias("to"))
    hits = stored(whole.union(part.join(kinds.where("n = 1").select("h", "r"), ["h", "r"])))
    spans = places.select("key", "mark", "h", "r", "start").join(hits, ["h", "r"]).groupBy("key", "mark").agg(
        F.collect_set(F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                merged, digests = [], []
                for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    merged.append(merge_spans((s["from"], s["to"]) for s in spans))
                    digests.append(hashlib.sha256(without((text or "").encode(), merged[-1])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("mark"), pa.array([[{"from": a, "to": b} for a, b in m] for m in merged], span), pa.array(digests)],
                    names=["key", "mark", "spans", "digest"])

    removed = stored(work.select("key", "mark", "text").join(spans, ["key", "mark"]).mapInArrow(
        cut, "key string, mark long, spans array<struct<from:long,to:long>>, digest string").distinct())
    text = F.coalesce("text", F.lit(""))
    whole_texts = rows.select("doc_id", *key, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("full"))
    return whole_texts.join(removed, ["key", "mark"], "left").select(
        "doc_id", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<from:long,to:long>>")).alias("spans"),
        F.coalesce("digest", "full").alias("kept_sha256"))


def merge_spans(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))
