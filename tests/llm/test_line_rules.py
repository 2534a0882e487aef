import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaframe.llm.line_rules import BOILERPLATE, MARKS, MENU, SEPARATORS, SYMBOLS, LineRules, clean_lines

SPACE = " \t\n\x0b\x0c\r"
PROSE = "The old mill stood by the river, and its wheel had not turned for many years. "
SCHEMA = "doc_id long, text string, words string, line long, n_words string"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fails(line):
    w = words(line)
    between, symbols = sum(c in SEPARATORS for c in line), sum(c in SYMBOLS for c in line)
    if not w:
        return None
    if re.search(MENU.replace("$", r"\Z"), lower(line)) or (between >= 2 and 4 * between >= len(w)):
        return "navigation"
    if re.search(BOILERPLATE, lower(line)):
        return "boilerplate"
    if 3 * symbols > len(w) or (len(w) >= 8 and not re.search(MARKS, line)):
        return "punctuation"
    return None


def brute(text):
    text = text or ""
    w, lines = words(text), text.split("\n")
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    worded = [x for x in lines if words(x)]
    out = [fails(x) for x in lines]
    clean = "\n".join(x for x, f in zip(lines, out) if f is None)
    chars = sum(map(len, w))
    lost = chars - sum(map(len, words(clean)))
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (clean, len(w), chars, sum(c in SYMBOLS for c in text), len(worded) - len(set(worded)), len(covered), len(worded),
            tuple(out.count(r) for r in ("navigation", "boilerplate", "punctuation")), lost, base, not base and 100 * lost <= 50 * chars)


def got(df):
    return [(r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"],
             tuple(r["removed"]), r["lost_chars"], r["base_failed"], r["kept"]) for r in df.orderBy("doc_id").collect()]


TEXTS = [
    None, "", " \n\t ", "one", PROSE * 2, PROSE * 40, "Home | News | Sport | Contact\n" + PROSE * 3 + "\nAll rights reserved.",
    "a b c d e f g h " * 5, "x" * 50_000, "\n".join([PROSE] * 3), "w%%% x### y*** z$$$ " * 10, "Home\nSearch\n» Back to top «\n" + PROSE * 2,
    " ".join(f"w{i}" for i in range(30)), "ß 𝄞 é. " * 9 + "\n" + "ß 𝄞 é. " * 9, "a\r\nb\r\n" + PROSE * 2, "Licensed under the X.\n" + PROSE * 2,
    " ".join(f"w{i % 997}" for i in range(20_000)) + ".", "中文，没有空格。" * 30,
]


def test_matches_brute_force(spark):
    rows = [(i, t, "clash", i, "clash") for i, t in enumerate(TEXTS)]
    assert got(clean_lines(spark.createDataFrame(rows, SCHEMA))) == [brute(t) for t in TEXTS]


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a", "b", "C.", "|", "»", "home", "\n", "\x0b", "%%", "copyright 2020", "é", "  "]), max_size=60)
                      .map(" ".join), min_size=1, max_size=12))
def test_odd_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(clean_lines(df)) == [brute(t) for t in texts]


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"word{i}," for i in range(32))
    rows = [(1, text), (1, text), (None, text), (None, None)]
    out = clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["kept"]) for r in out) == [
        (False, 32, True), (False, 32, True), (True, 0, False), (True, 32, True)]
    assert clean_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_limits_are_parameters(spark):
    df = spark.createDataFrame([(1, "Home\n" + PROSE)], "doc_id long, text string")
    assert clean_lines(df, rules=LineRules(least_words=5)).first()["kept"]
    assert not clean_lines(df, rules=LineRules(least_words=5, lost_share=1)).first()["kept"]


def test_native_plan(spark):
    df = clean_lines(spark.createDataFrame([(1, PROSE)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("text", ["Subscribe to our newsletter now", "Next page", "a | b | c"])
def test_single_lines_fail(text):
    assert fails(text)
