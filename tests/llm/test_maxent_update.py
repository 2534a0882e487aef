"""Slopes of a feature are added in order whatever their number, and the kernels use up what they are given."""

import time

import numpy as np

from alphaframe.llm.maxent_lm import BATCH, FEW, RATE, WIDTH, Maxent, Vocabulary, picked, slope


def model():
    words, counts = [b"w%d" % k for k in range(50)], np.arange(50, 0, -1).astype(np.int64)
    return Maxent(Vocabulary(words, counts, int(counts.sum()) + 5, 51, 5))


def plain(m, rows, step):
    """One feature after the other."""
    weights, seen = m.weights.astype(np.float64), m.seen.astype(np.float64)
    total = np.zeros_like(weights)
    for r, s in zip(rows, step):
        for f in r:
            total[f] += s
            seen[f] += 1
    own = np.unique(rows)
    weights[own] -= RATE * total[own] / np.sqrt(seen[own] + 8)[:, None]
    return weights, seen


def test_update_of_rare_and_frequent_features():
    rng = np.random.default_rng(7)
    m = model()
    for case in ([1], [FEW], [FEW + 1], [1, 2, FEW - 1, FEW, FEW + 1, 3 * FEW, 200]):
        flat = np.concatenate([np.full(n, 100 + 7 * k + n) for k, n in enumerate(case)])
        flat = rng.permutation(np.concatenate([flat, np.arange(-len(flat) % 3) + 5]))
        rows, step = flat.reshape(-1, 3), rng.normal(size=(len(flat) // 3, WIDTH)).astype(np.float32)
        weights, seen = plain(m, rows, step)
        m._update(rows, step)
        assert np.allclose(m.weights, weights, atol=1e-5) and np.array_equal(m.seen, seen)


def test_update_costs_little_where_most_features_are_seen_once():
    """Against the sums along columns that every feature took before."""
    rng = np.random.default_rng(8)
    m = model()
    rows = rng.integers(0, len(m.weights), (BATCH, 3))
    step = rng.normal(size=(BATCH, WIDTH)).astype(np.float32)

    def before():
        by = np.argsort(rows.astype(np.uint16), axis=None, kind="stable")
        flat = rows.ravel()[by]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        return np.add.reduceat(np.ascontiguousarray(step.take(by // 3, axis=0).T), first, axis=1).T, flat[first]

    def least(f):
        took = []
        for _ in range(15):
            at = time.perf_counter()
            f()
            took.append(time.perf_counter() - at)
        return min(took)

    m._update(rows, step)
    assert least(lambda: m._update(rows, step)) < 1.2 * least(before)


def test_kernels():
    rng = np.random.default_rng(9)
    z = rng.normal(size=(20, WIDTH)).astype(np.float32)
    which = rng.integers(0, WIDTH, 20)
    p = np.exp(z.astype(np.float64))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(picked(z.copy(), which), np.log(p[np.arange(20), which]), atol=1e-5)
    p[np.arange(20), which] -= 1
    assert np.allclose(slope(z.copy(), which), p, atol=1e-5)
