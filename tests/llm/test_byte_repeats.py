import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaframe.llm.byte_repeats import remove_repeats
from alphaframe.llm.queries import op8_suffix_dedup
from alphaframe.llm.suffix_sort import SHALLOW, common, deep_shallow, neighbours

SCHEMA = "doc_id long, text string, mark string"


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(d[k:k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = [False] * len(d)
        end = 0
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                for x in range(max(k, end), k + length):
                    gone[x] = True
                end = k + length
        spans, kept = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, sum(s["to"] - s["from"] for s in r.spans), len(r.spans), r.kept_sha256) for r in df.collect()], key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"abcdefgh", b"x" * SHALLOW, b"y" * 50]), max_size=6).map(b"".join), min_size=1, max_size=12))
def test_deep_shallow(strings):
    order = deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for n, a, b in zip(neighbours(strings, order)[1:], order, order[1:]):
        assert strings[a][:n] == strings[b][:n] and n == common(strings[a], strings[b])


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(60), text(150)
    texts = ["", None, "ab" * 400, "x" * 199, "x" * 200, line[:200], line + line]
    for _ in range(12):
        base = text(rng.choice([20, 80, 300]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                t[rng.randrange(len(t))] = rng.choice("abcé")
            t = "".join(t)
            cut = rng.randrange(len(t))
            texts.append(t[:cut] + rng.choice(["", line, passage, passage[rng.randrange(100):]]) + t[cut:])
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return rows + [(7, texts[7], "x"), (None, texts[8], "y"), (8, texts[9] + "!", "y")]


@pytest.mark.parametrize(("seed", "group_most"), [(1, 4096), (2, 2), (3, 4)])
def test_matches_brute_force(spark, seed, group_most):
    rows = corpus(seed)
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), group_most=group_most)) == brute(rows, 200)


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = sorted([tuple(r) for r in op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()], key=str)
    assert found == brute(rows, 200)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
