"""Best-fit packing of token pieces, planned over counts of lengths.

The pieces of a corpus have at most ``capacity`` different lengths, so their counts are a bounded
table whatever the corpus. Best fit, longest first, runs over those counts: sequences that are
filled alike form one range, and a step fills a whole range at once. Each piece then finds its
place by its rank among the pieces of its length; a length that many pieces share is ranked in
parts of about ``PART`` pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_codec import byte_codec
from .common import only, stored

PART = 500
SLICE = 256


def token_pieces(
    docs: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit, binary).

    A document is its ids and then ``end_id``; a null text counts as empty. Only documents longer
    than ``capacity`` are cut, into pieces of ``capacity`` tokens of which the first may be shorter.
    Rows that repeat, and null ids, give pieces of their own; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = byte_codec(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, piece, start, length, ids = [], [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    whole = codec.encode(text or "") + end
                    n, a, j = len(whole) // 4, 0, 0
                    while a < n:
                        b = a + ((n - a) % capacity or capacity) if j == 0 else a + capacity
                        row.append(k), piece.append(j), start.append(a), length.append(b - a)
                        ids.append(whole[4 * a:4 * b])
                        a, j = b, j + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    kept = only(docs, doc_id=id_col, text=text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: length, rank_from, pieces, each, sequence, offset.

    Pieces of rank ``rank_from + q`` of a length (q < pieces) go to sequence ``sequence + q // each``
    at ``offset + (q % each) * length``. The tightest open range is always filled first; one
    sequence of it takes as many equal pieces as fit, which is what best fit does one by one.
    """
    spare: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges of sequences
    rooms: list[int] = []  # the rooms in use, sorted
    rows, made = [], 0

    def keep(room: int, first: int, last: int) -> None:
        if first < last and room:
            if not spare[room]:
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            spare[room].append((first, last))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = int(np.searchsorted(rooms, length))
            if at < len(rooms):
                room = rooms[at]
                first, last = spare[room].pop()
                if not spare[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, made
                last = made = first + -(-left // (capacity // length))
            each = room // length
            take = min(left, (last - first) * each)
            full, rest = divmod(take, each)
            rows.append((length, rank, take, each, first, capacity - room))
            keep(room - each * length, first, first + full)
            if rest:
                keep(room - rest * length, first + full, first + full + 1)
            keep(room, first + full + bool(rest), last)
            left, rank = left - take, rank + take
    return pd.DataFrame(rows, columns=["length", "rank_from", "pieces", "each", "sequence", "offset"]).astype("int64")


def best_fit_pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to each piece; all other columns are carried along.

    ``pieces`` needs doc_id, piece and length (1 to ``capacity``). Which of the pieces of one length
    gets which place follows a hash, then (doc_id, piece); it does not change how many sequences there are.
    Equal rows get different places. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_plan(hist, capacity)
    parts = [-(-hist.get(n, 0) // PART) or 1 for n in range(capacity + 1)]
    shares = spark.createDataFrame(pd.DataFrame({"length": np.arange(capacity + 1), "n_parts": parts}))
    dealt = pieces.join(F.broadcast(shares), "length").withColumn(  # `capacity` + 1 rows
        "_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("n_parts"))).drop("n_parts")
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = stored(sizes.select("length", "_part", (
        F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before")))
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_part")
    )
    # One sorted number per planned step; the plan is bounded by the number of lengths.
    plan = plan.sort_values(["length", "rank_from"], ignore_index=True)
    step = (plan["length"].to_numpy() << 44) + plan["rank_from"].to_numpy()
    each, first, base, at = (plan[c].to_numpy() for c in ("each", "sequence", "offset", "rank_from"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            k = np.searchsorted(step, (length << 44) + rank, side="right") - 1
            q = rank - at[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(first[k] + q // each[k]), pa.array(base[k] + q % each[k] * length)],
                names=[*names, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "_rank"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.withColumn("length", F.col("length").cast("long")).withColumn("_rank", F.col("_rank").cast("long")).mapInArrow(
        place, f"{fields}, sequence_id long, offset long")
