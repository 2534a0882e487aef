"""Words outside the classes of the most frequent ones have a model of their own, too."""

import zlib

import numpy as np

from alphaframe.llm.maxent_lm import ITEMS, WIDTH, Maxent, Vocabulary, score_texts

SCHEMA = "doc_id long, text string"


def vocabulary(leaves, n=3000):
    words, counts = [b"w%d" % k for k in range(n)], np.arange(n, 0, -1).astype(np.int64)
    rest = np.ones(leaves)
    for w, c in zip(words[ITEMS - 1:], counts[ITEMS - 1:]):
        rest[zlib.crc32(w) % leaves] += c + 1
    return Vocabulary(words, counts, int(counts.sum()) + 50, n + 1, 50, rest)


def test_probabilities_of_all_words_sum_to_one():
    v = vocabulary(WIDTH ** 2)
    rng = np.random.default_rng(2)
    m = Maxent(v, rng.normal(size=(1 << 14, WIDTH)).astype(np.float32))
    whole = 0.0
    for w in range(len(v.words) + 1):
        token = v.end if w == len(v.words) else w
        _, p = m.log_probabilities(np.array([v.start, v.start, 7, token]))
        share = (v.counts[w] + 1) / v.rest[v.leaf[w]] if v.item[token] < 0 else 1.0
        whole += np.exp(p[-1]) * share
    for leaf in range(len(v.rest)):
        _, p = m.log_probabilities(np.array([v.start, v.start, 7, v.hashed + leaf]))
        whole += np.exp(p[-1]) / v.rest[leaf]
    assert abs(whole - 1) < 1e-4


def test_rare_words_follow_their_contexts():
    """Both words outside the classes, one of them not even shipped."""
    v = vocabulary(WIDTH ** 2)
    text = " ".join(["w2500 w2700", "w2600 never"] * 300)
    m = Maxent(v)
    ids, _, strange = v.tokens([text])
    assert strange[0] == {b"never": 300}
    for _ in range(20):
        m.learn(ids)

    def p(a, b):
        i, _, _ = v.tokens([f"{a} {b}"])
        return m.log_probabilities(i)[1][1]

    assert p("w2500", "w2700") > p("w2500", "never") + 1 and p("w2600", "never") > p("w2600", "w2700") + 1


def test_gain_over_the_base_where_rare_words_go_in_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 1500, 60))) for i in range(700)]
    got = score_texts(spark.createDataFrame(rows, SCHEMA), known=2000).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score - r.base_score for r in held) > 0
