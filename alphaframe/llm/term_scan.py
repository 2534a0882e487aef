"""Ranked lexical search by scanning documents with an automaton of all item terms.

No index of the documents is built. The distinct terms of the items, each between boundary guards, make
one Aho-Corasick automaton. Every task reads its documents as bytes in which all that is not part of a
term has become the guard, so a hit is a whole term, and a document's hits are its term frequencies.
A first scan sums what weights need (documents, terms, documents per term); a second one scores:
the automaton's outputs lead to the items that hold the term, and each task keeps the best documents per
item. Both scans give rows that grow with terms or items, not with documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as the automaton reads them: lower case, and a space for all that parts terms.
GUARDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MOST_TERMS = 1 << 16
SLICE = 256  # documents scored at once
CELLS = 1 << 22  # of one block of scores


@dataclass(frozen=True)
class Part:
    """Items that one automaton serves: terms, and per term the items that hold it (CSR), how often they do."""

    items: pa.Array
    terms: list[str]
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            built.add_word(f" {t.encode().decode('latin-1')} ", k)
        if self.terms:
            built.make_automaton()
        return built


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times. An item without an id or without a term has no row."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.where("item_id IS NOT NULL").select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def parts_of(wanted: DataFrame, most: int) -> list[Part]:
    """The items in parts of at most ``most`` (item, term) rows each, unless a single item has more.

    Parts are doubled in number until that holds, so what is broadcast at once is bounded by ``most`` terms
    or one item's text, whatever the number of items.
    """
    n = max(1, -(-wanted.count() // most))
    while True:
        dealt = wanted.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"), F.min("item_id").alias("a"), F.max("item_id").alias("b"))
        if sizes.where((F.col("rows") > most) & (F.col("a") != F.col("b"))).isEmpty():
            break
        n *= 2
    out = []
    for k in sorted(r["part"] for r in sizes.select("part").collect()):
        rows = dealt.where(F.col("part") == k).select("item_id", "term", "times").toArrow().sort_by([("term", "ascending"), ("item_id", "ascending")])
        term, item = rows.column("term").combine_chunks().dictionary_encode(), rows.column("item_id").combine_chunks().dictionary_encode()
        counts = np.bincount(term.indices.to_numpy(), minlength=len(term.dictionary))
        out.append(Part(item.dictionary, term.dictionary.to_pylist(), np.concatenate([[0], np.cumsum(counts)]),
                        item.indices.to_numpy().astype(np.int64), rows.column("times").to_numpy()))
    return out


def scanned(automaton: ahocorasick.Automaton, terms: int, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Terms of a whole text with repeats, the item terms among them, and how often each occurs."""
    if not text:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64)
    low = text.encode("utf-8", "surrogatepass").translate(GUARDED)
    if not terms:
        return len(low.split()), np.empty(0, np.int64), np.empty(0, np.int64)
    hits = np.fromiter((v for _, v in automaton.iter(f" {low.decode('latin-1')} ")), np.int64)
    found, tf = np.unique(hits, return_counts=True)
    return len(low.split()), found, tf


def totals(part: Part) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: documents with a term (at term -2), all their terms (at -1), and documents per item term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, df, docs_seen, all_terms = part.automaton(), np.zeros(len(part.terms), np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                n, found, _ = scanned(automaton, len(part.terms), text.as_py())
                docs_seen, all_terms = docs_seen + (n > 0), all_terms + n
                df[found] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[docs_seen, all_terms], df[at]]))], names=["term", "n"])

    return run


def weights(docs: DataFrame, part: Part) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the weight of each item term; bounded by the part's terms."""
    counted = docs.select("text").mapInArrow(totals(part), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    known = n.get(-2, 0)
    w = [math.floor(1000 * math.log((2 * known + 2) / (2 * n.get(k, 0) + 1))) for k in range(len(part.terms))]
    return known, n.get(-1, 0), np.array(w, np.int64)


def best_of(item: np.ndarray, score: np.ndarray, top: int, order: np.ndarray) -> np.ndarray:
    """Places of the ``top`` highest scores per item; equal ones by the order of their documents."""
    by = np.lexsort((order, -score, item))
    first = np.concatenate([[True], item[by][1:] != item[by][:-1]])
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    return by[rank < top]


def ranking(part: Part, known: int, length: int, w: np.ndarray, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: the best documents of each item, as item, doc_id and score."""

    def score_block(block: list[tuple[int, np.ndarray, np.ndarray]], many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([b[0] for b in block], np.int64)
        m = 25 + (75 * n * known) // length
        doc = np.repeat(np.arange(len(block)), [len(b[1]) for b in block])
        term, tf = (np.concatenate([b[k] for b in block]) for k in (1, 2))
        gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        lens = part.starts[term + 1] - part.starts[term]
        at = np.repeat(part.starts[term], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        cell = np.repeat(doc, lens) * many + part.item[at]
        # Doubles hold sums of whole numbers below 2 ** 53 exactly; larger ones are summed as integers.
        gained = np.repeat(gain, lens) * part.times[at]
        if gained.sum(dtype=np.float64) < 2.0 ** 52:
            score = np.bincount(cell, gained, len(block) * many).astype(np.int64)
        else:
            score = np.zeros(len(block) * many, np.int64)
            np.add.at(score, cell, gained)
        hit = np.flatnonzero(score)
        return hit // many, hit % many, score[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, many = part.automaton(), len(part.items)
        step = max(1, min(SLICE, CELLS // max(1, many)))
        kept: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids = batch.column("doc_id").slice(at, step)
                block = [scanned(automaton, len(part.terms), x.as_py()) for x in batch.column("text").slice(at, step)]
                if not length or not any(len(b[1]) for b in block):
                    continue
                doc, item, score = score_block(block, many)
                docs = ids.take(pa.array(doc))
                if kept is not None:
                    docs, item, score = pa.concat_arrays([kept[0], docs]), np.concatenate([kept[1], item]), np.concatenate([kept[2], score])
                # Places of ids in ascending order, null last.
                order = np.empty(len(docs), np.int64)
                order[pa.compute.sort_indices(docs).to_numpy()] = np.arange(len(docs))
                best = best_of(item, score, top, order)
                kept = docs.take(pa.array(best)), item[best], score[best]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([part.items.take(pa.array(kept[1])), kept[0], pa.array(kept[2])], names=["item_id", "doc_id", "score"])

    return run


def leading(rows: DataFrame, top: int, *by: Column | str) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", top: int = 10, most_terms: int = MOST_TERMS, salts: int = 64,
) -> DataFrame:
    """One row per item and place: item_id, rank, doc_id, score, best first, equal scores by ascending doc_id.

    A null or empty text has no term, counts nowhere and is never found. Rows that repeat a doc_id are
    documents of their own; a row without id counts, and ranks behind equal scores. Items that share an id
    are one item with all their terms; an item without id or terms has no row, nor has one that no document
    meets with a score above 0. Empty tables give an empty result; further columns are ignored.
    Items beyond ``most_terms`` terms take further automata and scans.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    wanted = stored(item_terms(only(items, item_id=item_col, text=item_text_col)))
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((wanted, "item_id"), (rows, "doc_id"))}
    shape = f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long"
    found = docs.sparkSession.createDataFrame([], shape)
    for part in parts_of(wanted, most_terms):
        known, length, w = weights(rows, part)
        found = found.union(rows.mapInArrow(ranking(part, known, length, w, top), shape))
    # Each task hands on its own best; salts keep the ones of an item from meeting in one task all at once.
    salted = leading(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))), top, "item_id", "salt")
    return leading(salted.select("item_id", "doc_id", "score"), top, "item_id").select("item_id", "rank", "doc_id", "score")
