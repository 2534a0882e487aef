import random
import zlib

import numpy as np

from alphaframe.llm.language_id import BATCH, decide, fit, gram_keys, identify, judge, kernel, recognised, train_sample
from alphaframe.llm.queries import op6_language_id

SCHEMA = "doc_id long, text string, lang string, held_out string"


def grams(text):
    b = text.lower().encode()
    return {b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_kernel_and_scores_against_brute_force():
    texts = ["the cat and the hat", "le chat et le chapeau", "die katze und der hut", "the dog", "a", "éé", "der hund und"]
    labels = ["en", "fr", "de", "en", "en", "fr", "de"]
    sets = [np.unique(gram_keys(t)) for t in texts]
    k = kernel(sets, sets)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(k[i, j] - len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))) < 1e-6
    model = fit(sets, labels, landmarks=100, ridge=1e-3)
    many = texts * (BATCH // 4)
    langs, scores = decide(model, many)
    # all texts are landmarks: the same ridge regression on the kernel's own feature map
    values, vectors = np.linalg.eigh(k.astype(float))
    phi = vectors[:, values > 1e-6] * np.sqrt(values[values > 1e-6])
    share = np.array([1 / labels.count(x) for x in labels])[:, None]
    target = np.where(np.array(labels)[:, None] == np.array(sorted(set(labels)))[None], 1.0, -1.0)
    value = phi @ np.linalg.solve(phi.T @ (share * phi) + 1e-3 * np.eye(phi.shape[1]), phi.T @ (share * target))
    assert np.allclose(scores[:7], np.clip((value.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)
    assert langs[:7] == labels and langs == labels * (BATCH // 4)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held)
    assert right > 0.9, right


def test_odd_rows(spark):
    rows = [(k, t, g, "x") for k, (t, g) in enumerate([("the cat and hat", "en"), ("le chat et", "fr")] * 6)]
    rows += [(100, None, "en", "x"), (101, "123 !", "en", "x"), (None, "the hat", "fr", None), (102, "", None, None), (103, "the cat " * 9000, None, "x")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en" and got[None][0] == "en"
    none = identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0


STRANGE = ["это совсем другой язык и никто его не знает", "日本語の文章です。これは学習されていません", "ภาษาที่ไม่ได้เรียนรู้", "это"]


def test_unlearned_scripts_do_not_fit_and_short_texts_do(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    short = [" ".join(r.text.split()[3:6]) for r in docs.limit(60).collect() if len(r.text.split()) > 8]
    more = [(10 ** 9 + k, t, None) for k, t in enumerate([*STRANGE, *short])]
    got = {r.doc_id for r in recognised(docs.union(spark.createDataFrame(more, docs.schema))).collect()}
    assert got == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {i for i, *_ in more[len(STRANGE):]}


def test_a_text_of_all_languages_fits():
    rng = random.Random(4)
    shared = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(40)]
    texts = [" ".join(rng.choices(shared, k=30)) for _ in range(10)]
    model = fit([np.unique(gram_keys(t)) for t in texts for _ in range(24)], [f"l{k:02}" for k in range(24)] * 10, 256, 1e-3)
    langs, scores, fits = judge(model, [texts[0], *STRANGE])
    assert scores[0] < 0.25 and list(fits) == [True] + [False] * len(STRANGE)


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(k, "the cat and the hat", "en", "x") for k in range(12)] + [(k, "le chat et le chapeau " * 1200, "fr", "x") for k in range(12, 24)]
    rows.append((99, "le chapeau", None, "x"))
    assert {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}[99] == "fr"


def test_rows_that_repeat_an_id_do_not_fill_the_sample(spark):
    rows = [(1, "the cat and the hat", "en", False)] * 300 + [(1, f"the dog number {k}", "en", False) for k in range(300)] + [(2, "le chat", "fr", False)] * 50
    got = train_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean"), 20)
    assert sum(g == "en" for g, _ in got) == 20 and sum(g == "fr" for g, _ in got) == 1
    assert len({s.tobytes() for g, s in got if g == "en"}) == 20
