import numpy as np

from alphaframe.llm.vector_forest import near_vectors
from test_components import brute as joined

SCHEMA = "vec_id long, embedding array<float>, label int, codes string"


def brute(rows, least=0.98):
    fine = {}
    for i, v, g, _ in rows:
        if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and any(v):
            fine[i] = (np.array(v, np.float32).astype(float), g)
    ids = sorted(fine)
    links = []
    for g in {x[1] for x in fine.values()}:
        for size in {len(x[0]) for x in fine.values()}:
            own = [i for i in ids if fine[i][1] == g and len(fine[i][0]) == size]
            if own:
                u = np.array([fine[i][0] for i in own])
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                links += [(own[a], own[b]) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)), strict=True)]
    root, n = joined(links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    out = []
    for i, *_ in rows:
        c = None if i is None else root.get(i, i)
        out.append((i, n.get(i, 0), c, i is not None and i == c))
    return sorted(out, key=str), len(links)


def cloud(seed=1, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for size in [1] * 700 + [2] * 40 + [5] * 20 + [150]:
        c, g = rng.normal(size=dim), int(rng.integers(0, 2))
        for _ in range(size):
            rows.append((len(rows), [float(x) for x in np.float32(c + 0.1 * rng.normal(size=dim))], g, "x"))
    return rows


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def test_recall_and_no_false_links(spark):
    rows = cloud()
    want, links = brute(rows)
    found = got(near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=32, block=40))
    by = {r[0]: r for r in found}
    assert len(found) == len(rows) and all(by[w[0]][1] <= w[1] for w in want)  # never a link too many
    assert sum(r[1] for r in found) / 2 >= 0.95 * links > 1000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.5]
    rows = [(1, one, 1, "x"), (2, one, 1, "x"), (3, one, 2, "x"), (4, one, None, "x"), (5, None, 1, "x"), (6, [], 1, "x"), (7, [0.0, 0.0, 0.0], 1, "x"),
            (8, [1.0, nan, 0.5], 1, "x"), (9, [1.0, inf, 0.5], 1, "x"), (10, [1.0, None, 0.5], 1, "x"), (None, one, 1, "x"), (2, one, 1, "y"),
            (11, [2.0, 0.0, 1.0], 1, "x"), (12, [1.0, 0.0], 1, "x")]
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)[0]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
