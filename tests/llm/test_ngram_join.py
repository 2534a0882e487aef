import random
import re

import pytest

from alphaframe.llm.ngram_join import near_duplicates
from alphaframe.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, member string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def brute_set(text):
    w = words_of(text)
    return {" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def brute(rows, share=75):
    sets = {i: brute_set(t) for i, t, _ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted([(i, len(brute_set(t)), None if i is None else find(i)) for i, t, _ in rows], key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(vocab, k=20))
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 6, 30, 60, 120]))
        for _ in range(rng.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w) + (" " + line if rng.random() < 0.4 else ""))
    texts += [None, "", " \n", "A b", "a  B", "one two three four", line, line + " x"]
    rng.shuffle(texts)
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return rows + [(3, texts[3], "y"), (None, texts[4], "x")]


@pytest.mark.parametrize(("seed", "hot_most", "hot_least", "salt_rows"), [(1, 1 << 16, 24, 512), (2, 40, 2, 3), (3, 0, 2, 3), (4, 5000, 2, 2)])
def test_matches_brute_force(spark, seed, hot_most, hot_least, salt_rows):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), hot_most=hot_most, hot_least=hot_least, salt_rows=salt_rows)
    assert sorted([tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()], key=str) == brute(rows)


def test_shingle_sets():
    for text in [None, "", "a", "A b c d", "a b c d e", "a b c d e f é", "x " * 50, " \t\x0b  z"]:
        assert len(shingle_set(text)) == len(brute_set(text))
    assert (shingle_set("A b\nc D e") == shingle_set("a B c d E")).all()


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exactly_at_the_threshold(spark):
    """6 of 8 shingles in common is a link, 5 of 9 is not; so close a pair is decided on whole numbers."""
    words = [f"w{k}" for k in range(11)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-2], "y", "z"]), " ".join([f"v{k}" for k in range(11)])]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted([tuple(r) for r in got.collect()]) == brute(rows)
    assert [r[2] for r in brute(rows)][:2] == [0, 0]


def test_large_group_of_near_copies_takes_few_pairs(spark, monkeypatch):
    """Copies with one or two of 120 words changed: pairs compared grow with the group, not with its square."""
    from alphaframe.llm import ngram_join as N

    rng, compared = random.Random(3), []
    real = N.linked

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(N, "linked", counted)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(1200):
        w = list(base)
        for _ in range(1 if i % 3 else 2):
            w[rng.randrange(120)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "x"))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert sum(compared) < 30 * 1200  # all pairs would be 720,000


def test_many_rows_of_one_id(spark):
    """Rows that repeat an id and a text over many batches are one member."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text, "x")] * 3000 + [(9, text + " end", "x"), (11, text + " end here", "x"), (7, "other words altogether stand here now", "x")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(40))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(7, 7), (9, 7), (11, 7)}


def test_sets_are_dealt_once(spark):
    """Whatever is compared in a round, sets stay where they were stored: only pairs, and what the first set adds to them, move."""
    from pyspark.sql import functions as F

    from alphaframe.llm import ngram_join as N

    texts = [" ".join(f"w{k + j}" for k in range(12)) for j in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts, None, ""])], "doc_id long, text string").repartition(3)
    names = [N.named(s, len(s)) for s in map(shingle_set, texts)]
    sets = N.half_sets(docs, spark.createDataFrame([(m,) for m in names[:30]], "member long"))
    assert {r["member"]: r["n"] for r in sets.collect()} == dict.fromkeys(names[:30], 8) and sets.count() == 30
    pairs = spark.createDataFrame([(names[k], names[k + d]) for k in range(20) for d in (1, 3)], "a long, b long")
    met = N.met_sets(pairs, sets)
    assert sorted(r["common"] for r in met.collect()) == [5] * 20 + [7] * 20
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
    # Sets of texts that no one asks for are not kept; an empty table has none.
    assert N.half_sets(docs.where(F.lit(False)), sets.select("member")).count() == 0
