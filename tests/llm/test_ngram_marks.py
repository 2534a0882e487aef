"""Marks rule out pairs before their sets move, and never one that links."""

import random

import numpy as np

from alphaframe.llm import ngram_join as N
from alphaframe.llm.shingles import shingle_set


def texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(30000)}"
    out = []
    for size in (1, 4, 5, 30, 300, 3000, 9000):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for changed in (1, 2, size // 60, size // 40, size // 20, size // 4):
            w = list(base)
            for _ in range(changed):
                w[rng.randrange(size)] = word()
            out.append(" ".join(w))
        out.append(" ".join(word() for _ in range(size)))
    return [*dict.fromkeys(out)]


def test_marks_lose_no_link(spark):
    sets = [shingle_set(t) for t in texts()]
    names = [N.named(s, len(s)) for s in sets]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    halves = N.half_sets(docs, spark.createDataFrame([(m,) for m in names], "member long"))
    every = [(names[i], names[j]) for i in range(len(sets)) for j in range(i)]
    common = {(names[i], names[j]): (len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])) for i in range(len(sets)) for j in range(i)}
    able = {(r["a"], r["b"]) for r in N.able_by_marks(spark.createDataFrame(every, "a long, b long"), halves, 75).collect()}
    links = {p for p, (c, n) in common.items() if 100 * c >= 75 * (n - c)}
    assert len(links) > 10 and links <= able
    # Few others are left, and those are large sets.
    assert len(able - links) < len(every) // 10


def test_sets_move_for_few_pairs(spark, monkeypatch):
    """Pairs that share a passage but do not link are met by their marks alone."""
    met, real = [], N.met_sets
    monkeypatch.setattr(N, "met_sets", lambda pairs, sets: (met.append(pairs.count()), real(pairs, sets))[1])
    rng = random.Random(2)
    head = [f"h{k}" for k in range(60)]
    rows = [(i, " ".join([*head, *(f"x{rng.randrange(10 ** 6)}" for _ in range(100))])) for i in range(150)]
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot_least=10 ** 6)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i % 1000 for i, _ in rows}
    assert 20 <= sum(met) < 60


def test_marks_of():
    marks, twice = N.marks_of(np.array([0, 5, N.MARKS, 2 * N.MARKS + 1], np.uint64))
    assert marks.dtype == np.int64 and len(marks) * 64 == N.MARKS and twice == 1
    assert sum(int(x).bit_count() for x in marks.view(np.uint64)) == 3
