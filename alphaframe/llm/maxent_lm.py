"""A hashed maximum-entropy language model with class-factored softmax.

The most frequent words form classes of neighbouring frequency, and all other words one more class, which is a
tree: every word, seen or not, falls to a leaf by its hash, about as many leaves as the root of the number of
words. A word's probability is that of its class given the context, times that of the word in its class given the
context, or of the branches to its leaf given the context and of its share of the leaf's counts. Contexts are hashed
features: the word before, the one before that alone (a skip) and both. Every task runs gradient updates
over its own documents from the common weights; the changes of a feature's weights are averaged by how
often each task saw the feature, and the next round starts from there. Counts cover all training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, only, stored
from .language_id import remainder

WIDTH = 32  # classes, words of a class, and branches of a node; the last class is that of all other words
ITEMS = WIDTH * (WIDTH - 1)
KNOWN = 1 << 18
BUCKETS, MOST_BUCKETS = 1 << 13, 1 << 15  # rows of weights for classes, and as many for what is inside; they grow with the different words
MOST_LEVELS = 3
LEARNED = 1 << 22  # tokens a task should learn from, since each hands on weights of all features it saw
FEATURES = 3
BATCH = 1 << 13
SLICE = 256
RATE = 0.1
FEW = 7  # sights of a feature in a batch that are added one after the other
NOTHING = np.float32(-1e4)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, A-Z lower-cased, as bytes, and how many each text has; a null text has none."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(trimmed)
    words, blank = lists.flatten(), pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words.cast(pa.binary()), np.where(blank, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))


@dataclass
class Vocabulary:
    """Bounded: the ``KNOWN`` most frequent training words with their counts, and totals of all of them."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N: training tokens, ends included
    distinct: int  # V: different training tokens, the end included
    ends: int
    rest: np.ndarray | None = None  # by leaf: counts plus one of its words, plus one for a word never seen; None: one leaf
    buckets: int = BUCKETS
    nodes: list[np.ndarray] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.index = {w: k for k, w in enumerate(self.words)}
        self.unknown, self.end, self.start = len(self.words), len(self.words) + 1, len(self.words) + 2
        self.hashed = len(self.words) + 3  # from here on: words that are not shipped, by their hash
        # By token: log10(count + 1), and its place among the classes' words.
        self.log_count = np.concatenate([np.log10(self.counts + 1.0), [0.0, np.log10(self.ends + 1.0), 0.0]])
        self.item = np.full(len(self.words) + 3, -1, np.int64)
        shown = min(len(self.words), ITEMS - 1)
        self.item[:shown] = np.arange(shown)
        self.item[self.end] = ITEMS - 1
        in_classes = self.counts[:shown].sum() + self.ends
        self.rest_total = self.total - int(in_classes)
        self.rest_distinct = max(0, self.distinct - shown - (self.ends > 0))
        items = np.zeros(ITEMS)
        items[:shown], items[-1] = self.counts[:shown], max(self.ends, 1)
        grid = items.reshape(WIDTH - 1, WIDTH)
        with np.errstate(divide="ignore"):
            classes = np.log(np.append(grid.sum(axis=1), self.rest_total + 1.0))
            inside = np.log(grid) - np.log(np.maximum(grid.sum(axis=1, keepdims=True), 1e-9))
        self.class_bias = np.maximum(classes, NOTHING).astype(np.float32)
        self.word_bias = np.maximum(inside, NOTHING).astype(np.float32)
        if self.rest is None:
            self.rest = np.array([self.rest_total + self.rest_distinct + 1.0])
        self.leaf = np.array([zlib.crc32(w) % len(self.rest) for w in self.words] + [0, 0, 0], np.int64)
        self.log_rest = np.log10(self.rest)
        # By level, what the branches of each node hold.
        self.nodes = []
        below = self.rest
        while len(below) > 1:
            grid = below.reshape(-1, WIDTH)
            below = grid.sum(axis=1)
            self.nodes.insert(0, (np.log(grid) - np.log(below)[:, None]).astype(np.float32))

    def shipped(self, ids: np.ndarray) -> np.ndarray:
        """Token numbers with one number for all words that are not shipped."""
        return np.where(ids >= self.hashed, self.unknown, ids)

    def leaves(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= self.hashed, (ids - self.hashed) % len(self.rest), self.leaf[self.shipped(ids)])

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[dict[bytes, int]]]:
        """As ``numbered``, for texts and counts in plain lists."""
        ids, starts, strange = self.numbered(pa.array(texts, pa.string()))
        return ids, starts, [{s["word"]: s["n"] for s in own} for own in strange.to_pylist()]

    def numbered(self, texts: pa.Array, counted: bool = True) -> tuple[np.ndarray, np.ndarray, pa.ListArray | None]:
        """Token numbers with two start marks before each text and an end after it, where texts begin, unknown words if ``counted``."""
        words, sizes = words_of(texts)
        # A word is looked up once, however often the texts have it.
        coded = words.dictionary_encode()
        met, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        own = np.fromiter(map(self.index.get, met, repeat(-1)), np.int64, len(met))
        missing = np.flatnonzero(own < 0)
        own[missing] = [self.hashed + zlib.crc32(met[k]) for k in missing.tolist()]
        starts = np.cumsum(sizes + 3) - sizes - 3
        ids = np.empty(len(words) + 3 * len(sizes), np.int64)
        ids[starts] = ids[starts + 1] = self.start
        ids[starts + 2 + sizes] = self.end
        text = np.repeat(np.arange(len(sizes)), sizes)
        ids[np.arange(len(words)) + 3 * text + 2] = shown = own.take(code)
        if not counted:
            return ids, starts, None
        at = np.flatnonzero(shown >= self.hashed)
        pairs, n = np.unique(text.take(at) * np.int64(len(met) + 1) + code.take(at), return_counts=True)
        text, code = np.divmod(pairs, len(met) + 1)
        strange = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(n)], names=["word", "n"])
        return ids, starts, pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)), strange)


def spread(x: np.ndarray) -> np.ndarray:
    return (((x * np.int64(0x9E3779B97F4A7C1)) ^ (x >> np.int64(7))) * np.int64(0x2545F4914F6CDD1D)) >> np.int64(33)


class Maxent:
    """Weights: by hashed feature of class logits, then by hashed (feature, class) of word logits."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None):
        self.v = vocabulary
        self.weights = np.zeros((2 * vocabulary.buckets, WIDTH), np.float32) if weights is None else weights.copy()
        self.half = len(self.weights) // 2
        self.seen = np.zeros(2 * self.half, np.float32)

    def contexts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens to predict, and their features before hashing."""
        at = np.flatnonzero(ids != self.v.start)
        one, two = ids[at - 1], ids[at - 2]
        return at, np.stack([one * 4 + 1, two * 4 + 2, (one * np.int64(1_000_003) + two) * 4 + 3], axis=1)

    def folded(self, x: np.ndarray) -> np.ndarray:
        """``x`` modulo the rows of one half, which a mask gives where they are a power of two."""
        return x % self.half if self.half & (self.half - 1) else x & (self.half - 1)

    def logits(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.folded(spread(features))
        return rows, self._sum(rows, self.v.class_bias)

    def word_logits(self, features: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.half + self.folded(spread(features * WIDTH + classes[:, None]))
        return rows, self._sum(rows, self.v.word_bias[classes])

    def branches(self, features: np.ndarray, leaves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """From the root of the words outside the classes to their leaves: rows, logits and the branch taken, by level."""
        for level, bias in enumerate(self.v.nodes):
            under = WIDTH ** (len(self.v.nodes) - 1 - level)
            node = leaves // (under * WIDTH)
            rows = self.half + self.folded(spread((features * np.int64(MOST_LEVELS) + level) * np.int64(1_000_003) + node[:, None]))
            yield rows, self._sum(rows, bias[node] if level else bias), leaves // under % WIDTH

    def _sum(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = self.weights.take(rows[:, 0], axis=0)
        more = np.empty_like(z)
        for k in range(1, rows.shape[1]):
            z += self.weights.take(rows[:, k], axis=0, out=more, mode="clip")  # all are in range; clip spares a copy
        z += bias
        return z

    def log_probabilities(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and natural log probabilities: of the word for words of the classes, else of the word's leaf."""
        at, features = self.contexts(ids)
        out = np.empty(len(at))
        for a in range(0, len(at), BATCH):
            f, shown = features[a:a + BATCH], ids[at[a:a + BATCH]]
            item = self.v.item[self.v.shipped(shown)]
            classes = np.where(item < 0, WIDTH - 1, item // WIDTH)
            _, z = self.logits(f)
            p = picked(z, classes)
            inside = np.flatnonzero(item >= 0)
            _, z = self.word_logits(f[inside], classes[inside])
            p[inside] += picked(z, item[inside] % WIDTH)
            others = np.flatnonzero(item < 0)
            for _, z, branch in self.branches(f[others], self.v.leaves(shown[others])):
                p[others] += picked(z, branch)
            out[a:a + BATCH] = p
        return at, out

    def learn(self, ids: np.ndarray) -> None:
        at, features = self.contexts(ids)
        for a in range(0, len(at), BATCH):
            f, shown = features[a:a + BATCH], ids[at[a:a + BATCH]]
            item = self.v.item[self.v.shipped(shown)]
            classes = np.where(item < 0, WIDTH - 1, item // WIDTH)
            rows, z = self.logits(f)
            self._update(rows, slope(z, classes))
            inside = np.flatnonzero(item >= 0)
            if len(inside):
                rows, z = self.word_logits(f[inside], classes[inside])
                self._update(rows, slope(z, item[inside] % WIDTH))
            others = np.flatnonzero(item < 0)
            if len(others):
                for rows, z, branch in self.branches(f[others], self.v.leaves(shown[others])):
                    self._update(rows, slope(z, branch))

    def _update(self, rows: np.ndarray, step: np.ndarray) -> None:
        """Move each feature's weights along its summed slope; features seen often move less per sight."""
        # Numbers of 16 bits are sorted by radix; sums run along columns kept together.
        narrow = rows.astype(np.uint16) if len(self.weights) <= 1 << 16 else rows
        by = np.argsort(narrow, axis=None, kind="stable")
        flat = narrow.ravel().take(by)
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        own, n = flat.take(first).astype(np.int64), np.diff(first, append=len(flat))
        of = by // rows.shape[1]  # whose slope
        total = step.take(of.take(first), axis=0)
        # Most features are seen once or a few times in a batch: their further slopes are added up turn by turn, those seen most often first in line.
        more = np.flatnonzero((n > 1) & (n <= FEW))
        times = n.take(more).astype(np.uint8)
        more = more.take(np.argsort(times, kind="stable")[::-1])
        begin = first.take(more)
        rest = step.take(of.take(begin + 1), axis=0)
        over = len(more) - np.cumsum(np.bincount(times, minlength=FEW + 1))  # by k: features with more than k sights
        for k in range(2, FEW):
            rest[:over[k]] += step.take(of.take(begin[:over[k]] + k), axis=0)
        total[more] += rest
        many = np.flatnonzero(n > FEW)
        if len(many):
            places = of.compress(np.repeat(n > FEW, n))
            begins = np.concatenate([[0], np.cumsum(n.take(many))[:-1]])
            total[many] = np.add.reduceat(np.ascontiguousarray(step.take(places, axis=0).T), begins, axis=1).T
        seen = self.seen.take(own) + n.astype(np.float32)
        self.seen[own] = seen
        total *= np.float32(RATE)
        total /= np.sqrt(seen + 8)[:, None]
        np.subtract(self.weights.take(own, axis=0), total, out=total)
        whole_rows(self.weights)[own] = whole_rows(total)


def whole_rows(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` as one item each, which are set at once."""
    return x.view(f"V{x.shape[1] * x.itemsize}").ravel()


def picked(z: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log probabilities of the branches taken."""
    z = np.ascontiguousarray(z.T)  # one branch after the other: sums and maxima of many rows at once
    z -= z.max(axis=0)
    taken = z[which, np.arange(len(which))]
    np.exp(z, out=z)
    # Added as a sum along a row adds them.
    total = z[:8] + z[8:16]
    for k in range(16, WIDTH, 8):
        total += z[k:k + 8]
    while len(total) > 1:
        total = total[::2] + total[1::2]
    return (taken - np.log(total[0])).astype(np.float64)


def slope(z: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Probabilities less one at the branch taken; ``z`` is used up."""
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z, out=z)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(p)), which] -= 1
    return p


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; counted per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = words_of(batch.column("text"))[0].value_counts()
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, vocabulary: Broadcast, rounds: int) -> np.ndarray:
    """Weights after ``rounds`` rounds, each over its own share of the documents."""
    weights = np.zeros((2 * vocabulary.value.buckets, WIDTH), np.float32)
    fields = [f"d{k}" for k in range(WIDTH)]
    sc = docs.sparkSession.sparkContext
    for r in range(rounds):
        shared = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            model = Maxent(vocabulary.value, shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    model.learn(vocabulary.value.numbered(batch.column("text").slice(at, SLICE), counted=False)[0])
            own = np.flatnonzero(model.seen)
            change = (model.weights[own] - shared.value[own]) * model.seen[own, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(model.seen[own]), *(pa.array(np.ascontiguousarray(change[:, k])) for k in range(WIDTH))],
                names=["feature", "seen", *fields])

        share = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text").coalesce(max(sc.defaultParallelism, vocabulary.value.total // LEARNED))
        moved = share.mapInArrow(run, "feature long, seen float, " + ", ".join(f"{f} float" for f in fields))
        total = moved.groupBy("feature").agg(F.sum("seen").alias("seen"), *(F.sum(f).alias(f) for f in fields)).toArrow()  # a row per feature, 2 * MOST_BUCKETS at most
        own = total.column("feature").to_numpy()
        weights = weights.copy()
        weights[own] += np.stack([total.column(f).to_numpy() for f in fields], axis=1) / total.column("seen").to_numpy()[:, None]
    return weights


def rest_of(counts: DataFrame, words: list[bytes], n: np.ndarray, distinct: int) -> np.ndarray:
    """By leaf of the words outside the classes: counts plus one of its words, plus one. About as many leaves as the root of ``distinct``."""
    levels = 0
    while levels < MOST_LEVELS and WIDTH ** (2 * levels) < distinct:
        levels += 1
    rest = np.zeros(WIDTH ** levels)
    sums = counts.groupBy(F.pmod(F.crc32("word"), F.lit(len(rest))).alias("leaf")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()  # a row per leaf
    rest[sums.column("leaf").to_numpy()] = sums.column("n").to_numpy()
    for w, c in zip(words[:ITEMS - 1], n[:ITEMS - 1]):
        rest[zlib.crc32(w) % len(rest)] -= c + 1
    return rest + 1


def score_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, rounds: int = 2, known: int = KNOWN,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the whole text and its end, ``base_score`` the smoothed unigram
    one. Documents whose crc32(id) mod ``folds`` is ``held_out`` are not learned from; nor is a row without
    id, which is not held out. A null text counts as empty: its end alone is scored. Without training
    documents every probability is 1. Rows that repeat count each and give a row each; an empty table
    gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("held_out", remainder(F.col("doc_id"), folds) == held_out)
    train = rows.where("NOT held_out")
    counts = stored(word_counts(train))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    top = most_frequent(counts, known)
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << (max(1, sums["v"]) - 1).bit_length()))
    vocabulary = Vocabulary(words, n, sums["n"] + ends, sums["v"] + (ends > 0), ends, rest_of(counts, words, n, sums["v"]), buckets)
    shared = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(trained(train, shared, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        model = Maxent(v, weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, starts, strange = v.numbered(part.column("text"))
                places, p = model.log_probabilities(ids)
                shown, log10 = ids[places], np.zeros((2, len(ids)))
                known = v.shipped(shown)
                rest = v.item[known] < 0
                log10[0, places] = v.log_count[known]
                log10[1, places] = p / np.log(10) + np.where(rest, v.log_count[known] - v.log_rest[v.leaves(shown)], 0.0)
                head, score = np.add.reduceat(log10, starts, axis=1)
                size = np.diff(np.append(starts, len(ids))) - 2
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(head), pa.array(score), strange],
                    names=["doc_id", "held_out", "n_tokens", "head", "score", "strange"])

    key = rows.schema["doc_id"].dataType.simpleString()
    part = stored(
        rows.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
        .mapInArrow(run, f"doc_id {key}, held_out boolean, n_tokens long, head double, score double, strange array<struct<word:binary,n:long>>")
        .withColumn("row", F.monotonically_increasing_id()))
    # Words outside the bounded vocabulary meet their counts by a join, once per text and word.
    strange = part.select("row", F.explode("strange").alias("s")).select("row", "s.word", F.col("s.n").alias("times"))
    found = strange.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail"), F.sum("times").alias("tail_known"))
    found = stored(found)
    tail, tail_known = F.coalesce("tail", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    unknown = F.aggregate("strange", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    base = F.col("head") + tail - F.col("n_tokens") * F.lit(float(np.log10(vocabulary.total + vocabulary.distinct + 1)))
    model = F.col("score") + tail
    return part.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - unknown - (0 if ends else 1) + tail_known).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (model if ends else F.lit(0.0)).alias("score"))
