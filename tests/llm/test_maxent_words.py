"""Words are split, looked up and counted by batch, as each text by itself would have it."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from alphaframe.llm.maxent_lm import WIDTH, Vocabulary, picked, word_counts, words_of

SIGNS = ["a", "B", "Ä", "é", "Z", "日", "\x00", "\xa0", "\x1c", "\x1f", "\x85", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r"]


def texts():
    rng = random.Random(1)
    return [None, "", "  ", " \n", "a", " a ", *("".join(rng.choices(SIGNS, k=rng.randrange(30))) for _ in range(500))]


def plain(text):
    return (text or "").encode().lower().split()


def test_words():
    for kind in (pa.string(), pa.large_string()):
        words, sizes = words_of(pa.array(texts(), kind))
        assert words.to_pylist() == [w for t in texts() for w in plain(t)] and sizes.tolist() == [len(plain(t)) for t in texts()]
    words, sizes = words_of(pa.array([None, ""], pa.string()))
    assert words.to_pylist() == [] and sizes.tolist() == [0, 0]


def test_numbers_and_unknown_words():
    all_words = Counter(w for t in texts() for w in plain(t))
    words, counts = zip(*all_words.most_common(40))
    v = Vocabulary(list(words), np.array(counts), sum(all_words.values()), len(all_words), 5)
    ids, starts, strange = v.numbered(pa.array(texts()).slice(1, 300))
    want, begins = [], []
    for t in texts()[1:301]:
        begins.append(len(want))
        want += [v.start, v.start, *(v.index.get(w, v.hashed + zlib.crc32(w)) for w in plain(t)), v.end]
    unknown = [Counter(w for w in plain(t) if w not in v.index) for t in texts()[1:301]]
    assert any(unknown) and ids.tolist() == want and starts.tolist() == begins
    assert [{s["word"]: s["n"] for s in own} for own in strange.to_pylist()] == unknown
    assert [x.tolist() for x in v.tokens([])[:2]] == [[], []] and v.tokens([None])[2] == [{}]


def test_word_counts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    assert {bytes(r["word"]): r["n"] for r in word_counts(df).collect()} == Counter(w for t in texts() for w in plain(t))


def test_sums_along_branches_as_along_rows():
    """Bit by bit what a sum along each row gives."""
    rng = np.random.default_rng(4)
    z, which = rng.normal(size=(300, WIDTH)).astype(np.float32), rng.integers(0, WIDTH, 300)
    low = z - z.max(axis=1, keepdims=True)
    assert np.array_equal(picked(z, which), (low[np.arange(300), which] - np.log(np.exp(low).sum(axis=1))).astype(np.float64))
