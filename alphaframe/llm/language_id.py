"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of distinct byte n-grams (one to
three bytes, lower case) they share over the geometric mean of how many each has. Nyström landmarks
turn it into features, one ridge regression per language (one against the rest) is fitted on them,
and since the kernel is linear in the presence of n-grams, a batch of whole texts is scored by one product
of its presence matrix with the landmarks' combined weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, stored

SPACE = (1 << 24) + (1 << 16) + (1 << 8)  # keys of all n-grams of one to three bytes
BATCH = 32
UNKNOWN = "und"
LEAST_TEXTS = 20  # learned texts that a bound of the cover is taken from


def gram_keys(text: str) -> np.ndarray:
    """The n-gram of each place and length as a number below ``SPACE``; repeats included."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    return np.concatenate([b, two + (1 << 8), (two[:-1] << 8) + b[2:] + ((1 << 16) + (1 << 8))])


def distinct_keys(text: str) -> np.ndarray:
    """Sorted distinct keys of a whole text; nothing but the text's own n-grams takes memory."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    ones, twos = np.flatnonzero(np.bincount(b, minlength=1)), np.flatnonzero(np.bincount(two, minlength=1))
    threes = np.unique((two[:-1] << 8) + b[2:])
    return np.concatenate([ones, twos + (1 << 8), threes + ((1 << 16) + (1 << 8))]).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Between two lists of sorted distinct key sets."""
    keys = np.unique(np.concatenate([*b, np.empty(0, np.int32)]))

    def rows(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(keys)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(keys, s)
            at[at == len(keys)] = 0
            out[k, at[keys[at] == s]] = 1
        return out

    return (rows(a) @ rows(b).T) / np.sqrt(np.outer([len(s) for s in a], [len(s) for s in b]))


@dataclass
class Model:
    """Weights of the landmarks' n-grams for each language, and the least share of them in a text of such a language."""

    langs: list[str]
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    least: float = 0.0


def least_cover(sets: list[np.ndarray], labels: list[str], chosen: list[int]) -> float:
    """Half the share of known n-grams that all but one in a hundred learned texts of each language reach.

    Each text is held out for its own share: of a landmark the n-grams count that another landmark has too.
    """
    if len(sets) < LEAST_TEXTS:
        return 0.0
    keys, times = np.unique(np.concatenate([sets[k] for k in chosen]), return_counts=True)
    known, often = keys, keys[times > 1]
    marks, covers = set(chosen), {}
    for k, s in enumerate(sets):
        covers.setdefault(labels[k], []).append(np.isin(s, often if k in marks else known).mean())
    return min((float(np.quantile(c, 0.01)) / 2 for c in covers.values() if len(c) > 1), default=0.0)


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Ridge regression on Nyström features; every k-th text of each language is a landmark."""
    langs = sorted(set(labels))
    if not langs:
        return Model([])
    each = max(1, landmarks // len(langs))
    chosen = [k for g in langs for k in [j for j, x in enumerate(labels) if x == g][:each]]
    marks = [sets[k] for k in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    phi = kernel(sets, marks) @ root
    target = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # Languages count alike, however many texts of each there are.
    share = np.array([1 / labels.count(x) for x in labels])[:, None]
    solved = np.linalg.solve(phi.T @ (share * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (share * target))
    alpha = root @ solved
    keys = np.unique(np.concatenate(marks))
    weights = np.zeros((len(keys), len(langs)))
    for k, s in enumerate(marks):
        weights[np.searchsorted(keys, s)] += alpha[k] / np.sqrt(len(s))
    return Model(langs, keys, weights.astype(np.float32), least_cover(sets, labels, chosen))


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each whole text."""
    return judge(model, texts)[:2]


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score (0 to 1) of each whole text, and whether it has enough known n-grams.

    Its share of them may miss the model's least one by the error of a share of so few.
    """
    langs, scores, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model.langs:
        return langs, scores, fits
    known = [k for k, t in enumerate(texts) if has_letter(t)]
    for at in range(0, len(known), BATCH):
        part = known[at:at + BATCH]
        present = np.zeros((len(part), len(model.keys)), np.float32)
        sizes = np.empty(len(part))
        for row, k in enumerate(part):
            keys = distinct_keys(texts[k])
            sizes[row] = len(keys)
            col = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
            present[row, col[model.keys[col] == keys]] = 1
        value = (present @ model.weights) / np.sqrt(sizes)[:, None]
        best = value.argmax(axis=1)
        for row, k in enumerate(part):
            langs[k] = model.langs[best[row]]
        scores[part] = np.clip((value[np.arange(len(part)), best] + 1) / 2, 0, 1)
        fits[part] = present.sum(axis=1) / sizes + 1 / np.sqrt(sizes) >= model.least
    return langs, scores, fits


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def train_sample(docs: DataFrame, per_lang: int) -> list[tuple[str, np.ndarray]]:
    """At most ``per_lang`` labelled texts of each language, as sorted distinct n-gram keys; equal rows count once."""
    able = docs.where("lang IS NOT NULL AND text IS NOT NULL AND NOT coalesce(held_out, true)").where(
        F.col("text").rlike(r"\p{L}")).withColumn("at", F.xxhash64("doc_id", "text"))
    hashes = stored(able.select("lang", "at").distinct())
    counts = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # Of each language the hashes below a share of their range, about twice as many as are kept.
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, 2 * per_lang / n + 20 / n)))])[F.col("lang")]
    low: dict[str, list[int]] = {g: [] for g in counts}
    for r in hashes.where((F.col("at").cast("double") / F.lit(2.0 ** 64) + 0.5) <= share).collect():
        low[r["lang"]].append(r["at"])
    last = {g: sorted(x)[:per_lang][-1] for g, x in low.items() if x}
    if not last:
        return []
    edge = F.create_map(*[x for g, n in last.items() for x in (F.lit(g), F.lit(n))])[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()  # of the chosen texts only
        for batch in batches:
            new = []
            for k, x in enumerate(zip(batch.column("lang").to_pylist(), batch.column("at").to_pylist())):
                if x not in done:
                    done.add(x)
                    new.append(k)
            part = batch.take(pa.array(new, pa.int32()))
            keys = [distinct_keys(t).astype("<i4").tobytes() if has_letter(t) else None for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("at"), pa.array(keys, pa.binary())], names=["lang", "at", "keys"])

    chosen = able.where(F.col("at") <= edge).select("lang", "at", "text").mapInArrow(run, "lang string, at long, keys binary")
    rows = chosen.where("keys IS NOT NULL").groupBy("lang", "at").agg(F.min("keys").alias("keys")).collect()  # per_lang of each language at most
    return [(r["lang"], np.frombuffer(bytes(r["keys"]), "<i4")) for r in sorted(rows, key=lambda r: (r["lang"], r["at"]))]


def learned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 3, held_out: int = 1, per_lang: int = 256, landmarks: int = 256, ridge: float = 1e-3,
) -> tuple[DataFrame, Model]:
    """The rows under the operator's names with their fold, and the model."""
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    rows = rows.withColumn("held_out", remainder(F.col("doc_id"), folds) == held_out)
    sample = train_sample(rows, per_lang)
    return rows, fit([s for _, s in sample], [g for g, _ in sample], landmarks, ridge)


def identify(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 3, held_out: int = 1, per_lang: int = 256, landmarks: int = 256, ridge: float = 1e-3,
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    The model learns from at most ``per_lang`` texts of each language, whatever their length, taken by a hash of id and text from rows whose ``lang`` is not null and whose crc32(id) mod
    ``folds`` is not ``held_out``; a null id is never learned from and not held out. Every text is
    scored whole. A null text, one without a letter, and every text where no language could be
    learned, is ``und`` with score 0. Equal scores go to the first language by name. Rows that repeat give
    repeated results; further columns are ignored.
    """
    rows, model = learned(docs, id_col, text_col, lang_col, folds, held_out, per_lang, landmarks, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = decide(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(scores)],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    kept = rows.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, *, text_col: str = "text", **training) -> DataFrame:
    """The rows, with all columns, whose text has a letter and is in a learned language; decided on each row by itself.

    A text is in none if the share of its n-grams that the model knows is too small, see ``least_cover``; the score
    tells languages apart and says nothing there. Trained like ``identify``; fewer than ``LEAST_TEXTS`` learned texts give no bound.
    """
    _, model = learned(docs, text_col=text_col, **training)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(judge(model, part.column(place).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
