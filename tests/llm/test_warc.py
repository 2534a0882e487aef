import hashlib
import random

from alphaframe.llm.warc import LoserTree, archive, order, records, url_key

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>ü\r\n\r\nWARC/1.0\r\n</p>" * 20
ROWS = [
    (5, "http://A.example.com/x", BIG, "c"), (3, "http://a.example.com/x", BIG, None), (9, None, BIG, "c"),
    (4, "http://b.org", "short", "c"), (6, "http://b.org", "short", "c"), (7, "http://b.org?q=1\r\nX", None, "c"),
    (8, "", "", "c"), (3, "http://a.example.com/x", BIG, None), (None, "http://c.net/", BIG, "c"), (5, "https://d.net/#t", "y" * 500, "c"),
]


def test_loser_tree():
    rng = random.Random(1)
    for k in range(7):
        runs = [sorted([(rng.choice("abc"), rng.randint(0, 3), rng.randint(0, 9)) for _ in range(rng.randint(0, 6))]) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted([r for run in runs for r in run], key=order)


def test_round_trip_and_revisits(spark):
    got = archive(spark.createDataFrame(ROWS, SCHEMA), per_file=2).collect()
    assert len(got) == len(ROWS)
    want = []
    for page, url, html, _ in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if (h or "") == (html or "") and p is not None]
        back = page is not None and len(body) >= 100 and page > min(same)
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if back else "response", min(same) if back else None))
    assert sorted(want, key=str) == sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str)
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(ROWS)))
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)


def test_small_parts():
    assert url_key("http://A.b.com/P?x") == "com,b,a)/P?x" and url_key("") == ")"
    data = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [(at, bytes(b)) for at, _, b in records(data)] == [(0, b"abc"), (38, b"")]


def test_empty_table(spark):
    assert archive(spark.createDataFrame([], SCHEMA)).count() == 0
