import random

from alphaframe.llm.components import components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_shapes(spark):
    rng = random.Random(4)
    path = list(range(100, 140))
    rng.shuffle(path)
    links = [*zip(path, path[1:]), *[(5, k) for k in range(6, 30)], (1, 2), (2, 1), (2, 3), (50, 51), (51, 52), (52, 50)]
    links += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(7, 7)], "a long, b long")).collect()}
    assert got == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
