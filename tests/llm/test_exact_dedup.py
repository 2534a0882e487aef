import hashlib
import re

from alphaframe.llm.exact_dedup import exact_dedup

LONG = ("one two three four five six seven eight nine ten. " * 300)
ROWS = [
    (1, "a  b", "x"), (2, "a\tb", "x"), (3, None, "x"), (4, "", None), (5, " ", "x"), (6, LONG, "x"), (7, LONG, "x"),
    (8, LONG[:-3] + "e. ", "x"), (9, "x" * 20000, "x"), (10, "x" * 20001, "x"), (6, LONG, "x"), (None, "a b", "x"),
    (12, "ß é", "x"), (13, "ß  é", "x"),
]
SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t, _ in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t and j is not None]
        keep = min(ids, default=None)
        out.append((i, keep, sum(u == t for _, u in norm), i is not None and i == keep,
                    hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_matches_brute_force(spark):
    assert got(exact_dedup(spark.createDataFrame(ROWS, SCHEMA))) == brute(ROWS)


def test_clashing_identifiers_are_told_apart(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(exact_dedup(df, least=8, most=64, hash_bits=1)) == brute(ROWS)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
