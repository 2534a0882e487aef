import math
import re
import zlib
from collections import Counter

import numpy as np

from alphaframe.llm.maxent_lm import ITEMS, WIDTH, Maxent, Vocabulary, score_texts

SCHEMA = "doc_id long, text string, held_out string, word string"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def base(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    c = Counter()
    for i, t, *_ in rows:
        if i is not None and not held[i]:
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t, *_ in rows:
        own = [*tokens(t), None]
        out.append((i, held[i], len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    got = sorted([tuple(r) for r in score_texts(spark.createDataFrame(rows, SCHEMA), **kw).collect()], key=str)
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want))
    return got


def test_all_documents_and_better_than_the_base(spark):
    rows = [(r.doc_id, r.text, "x", "y") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = check(spark, rows, known=3000)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    assert all(g[6] <= 0 for g in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = [b"w%d" % k for k in range(1500)]
    v = Vocabulary(words, np.sort(rng.integers(1, 500, 1500))[::-1].astype(np.int64), 400_000, 1501, 50)
    m = Maxent(v, rng.normal(size=(1 << 14, WIDTH)).astype(np.float32))
    _, f = m.contexts(np.array([v.start, v.start, 5, 1200]))
    _, z = m.logits(f[1:])
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    whole = p[0, -1]
    for c in range(WIDTH - 1):
        _, w = m.word_logits(f[1:], np.array([c]))
        whole += p[0, c] * (np.exp(w - w.max()) / np.exp(w - w.max()).sum()).sum()
    assert abs(whole - 1) < 1e-4 and v.item[v.end] == ITEMS - 1
    # the words outside the classes share their class's probability with one unseen word
    rest = v.counts[ITEMS - 1:]
    assert rest.sum() + v.ends + v.counts[:ITEMS - 1].sum() == v.counts.sum() + v.ends
    assert v.rest_distinct == len(rest)


def test_updates_learn_what_follows():
    v = Vocabulary([b"a", b"b", b"c"], np.array([50, 50, 50], np.int64), 200, 4, 50)
    m = Maxent(v)
    ids, _, _ = v.tokens(["a b c a b c a b c"] * 200)
    before = m.log_probabilities(ids)[1].sum()
    for _ in range(3):
        m.learn(ids)
    assert m.log_probabilities(ids)[1].sum() > before / 3


def test_odd_rows(spark):
    rows = [(1, None, "x", "y"), (1, None, "x", "y"), (None, "A a b", None, "y"), (2, "a b a\tA", "x", None), (3, "", "x", "y"), (4, "zz " * 30_000, "x", "y")]
    check(spark, rows)
    check(spark, [r for r in rows if r[0] is None])
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
