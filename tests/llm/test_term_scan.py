import math
import random
import re
from collections import Counter

from alphaframe.llm.common import stored
from alphaframe.llm.term_scan import item_terms, parts_of, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, score long, term string"
ITEMS = "item_id long, text string, doc_id string, rank int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    found = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in docs]
    big_n, big_l = sum(n > 0 for _, _, n in found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    merged = {}
    for i, t, *_ in items:
        if i is not None:
            merged.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in merged.items():
        scores = []
        for d, c, n in found:
            if not n:
                continue
            m = 25 + (75 * n * big_n) // big_l
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, times in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "clash", 1, "clash") for d in docs], DOCS).repartition(3),
            spark.createDataFrame([(*i, "clash", 1) for i in items], ITEMS))


DOC_ROWS = [
    (1, "The cat sat"), (2, "cat-cat CAT_cat 1cat"), (3, None), (4, ""), (5, " .,! \x7f"), (6, "é cat É Été été"), (7, "x" * 30_000 + " cat"),
    (8, "the " * 5_000), (9, "ſ K K k"), (10, "sat sat the"), (10, "sat sat the"), (None, "sat sat the"), (11, "𝄞cat 𝄞 cat"), (12, "a b cat"),
]
ITEM_ROWS = [(1, "CAT the cat"), (2, "été É"), (2, "sat"), (3, None), (4, "..."), (None, "cat"), (5, "K k s"), (6, "zebra"), (7, "a b 𝄞")]


def test_matches_brute_force_on_odd_rows(spark):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    assert got(search(docs, items)) == brute(DOC_ROWS, ITEM_ROWS)


def test_many_documents_ties_and_parts(spark):
    rng = random.Random(7)
    names = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(names, weights=range(1, 61), k=rng.randint(0, 30)))) for i in range(400)]
    docs += [(1000 + i, docs[17][1]) for i in range(50)]  # copies tie
    items = [(i, " ".join(rng.choices(names, k=12))) for i in range(30)]
    a, b = frames(spark, docs, items)
    wanted = brute(docs, items)
    assert got(search(a, b)) == wanted
    assert got(search(a, b, most_terms=20, salts=2)) == wanted  # many automata
    assert got(search(a, b, top=3)) == [r for r in wanted if r[1] <= 3]


def test_parts_are_bounded(spark):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(50)] + [(99, " ".join(f"z{k}" for k in range(40)))], "item_id long, text string")
    parts = parts_of(stored(item_terms(items)), 10)
    assert all(p.starts[-1] <= 10 or len(p.items) == 1 for p in parts)
    assert sum(len(p.items) for p in parts) == 51


def test_empty_tables(spark):
    docs, items = frames(spark, DOC_ROWS, ITEM_ROWS)
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(docs.where("text IS NULL"), items).count() == 0
