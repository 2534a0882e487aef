import re
import zlib

import numpy as np
import public_tokenizers
from test_ngram_join import brute as near_brute
from test_packing import gapless
from test_secret_scan import plain_spans
from tokenizers import Tokenizer

import corpus_pipeline as p
from alphaframe.llm.secret_scan import mask

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    before = by_id(docs)
    one = p.languages(spark, docs, SF).cache()
    after = by_id(one)
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}  # clean documents stay

    two = p.copies(spark, one, SF).cache()
    first = {}
    for i, r in sorted(after.items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text), i)
    assert set(by_id(two)) == set(first.values())

    three = p.near_copies(spark, two, SF).cache()
    rows = [(i, r.text, "x") for i, r in by_id(two).items()]
    assert set(by_id(three)) == {i for i, _, c in near_brute(rows) if i == c}

    four = p.secrets(spark, three, SF).cache()
    assert four.columns == docs.columns
    for i, r in by_id(four).items():
        assert r.text == mask(before[i].text, plain_spans(before[i].text), "[secret]") and r.n_chars == len(r.text)

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = p.sequences(spark, four, SF).collect()
    gapless(last, 2048)
    want = {}
    for i, r in by_id(four).items():
        ids = np.array([*lib.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        at, j = 0, 0
        while at < len(ids):
            b = len(ids) % 2048 or 2048 if j == 0 else at + 2048
            want[i, j] = zlib.crc32(ids[at:b].tobytes())
            at, j = b, j + 1
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in last} == want


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and the hat " * 3, "en", "a", 1), (2, None, "en", "a", None), (None, "le chat et le chapeau " * 3, "fr", "a", 3),
            (3, "le chat et le chapeau " * 3, "fr", None, 3), (1, "the cat sat on the mat and the hat " * 3, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {1, 3}  # the row without id copies 3
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_decisions_take_effect_by_row(spark):
    cat, chat = "the cat sat on the mat and the hat " * 3, "le chat et le chapeau de la maison " * 3
    rows = [(k, f"{w} {t}", g, "a", 1) for k in range(1, 40) for w, t, g in [(f"w{k}x{k * 7}", *(((cat, "en"), (chat, "fr"))[k % 2]))]]
    docs = spark.createDataFrame(
        [*rows, (None, "123 !", "en", "a", 5), (None, None, "en", "a", None), (50, "567 ?", "en", "a", 5), (50, "the hat of the cat", "en", "b", 18)], SCHEMA)
    got = p.languages(spark, docs, SF).collect()
    assert len(got) == len(rows) + 1 and (50, "the hat of the cat") in {(r.doc_id, r.text) for r in got}

    one, two = "one two three four five six seven eight nine ten", "red green blue black white grey pink brown gold silver"
    docs = spark.createDataFrame(
        [(7, one, "en", "a", 1)] * 5 + [(3, two, "en", "a", 1), (5, two, "en", "a", 1), (5, "alone " + one, "en", "a", 1)]
        + [(None, "x y z w v u " + two, "en", "a", 1)] * 4, SCHEMA)
    kept = [(3, two), (5, "alone " + one), (7, one), (None, "x y z w v u " + two)]
    assert sorted(((r.doc_id, r.text) for r in p.copies(spark, docs, SF).collect()), key=str) == sorted(kept, key=str)
    near = "alpha beta gamma delta " * 2 + " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame(
        [(2, near, "en", "a", 1), (4, near + " tail", "en", "a", 1), (4, one, "en", "a", 1), (9, two, "en", "a", 1)] + [(6, two, "en", "a", 1)] * 3
        + [(None, near + " more", "en", "a", 1), (None, near + " other", "en", "b", 1)], SCHEMA)
    got = [(r.doc_id, r.text) for r in p.near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == [(2, near), (4, one), (6, two)]  # rows without id that near-copy one with an id go too
    docs = spark.createDataFrame([(None, near, "en", "a", 1), (None, near + " more", "en", "a", 1)], SCHEMA)
    assert p.near_copies(spark, docs, SF).count() == 1
