import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alphaframe.llm.byte_codec import ByteCodec
from alphaframe.llm.packing import best_fit_pack, best_fit_plan, token_pieces
from alphaframe.llm.queries import op4_best_fit_packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(FILE)
CODEC = ByteCodec(FILE)


def check(text):
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aehit  \n\t,.'é日 \u001c 07", max_size=50))
def test_random_texts(text):
    check(text)


def test_odd_texts():
    for text in ["", " ", "  ", "a ", " a", "a  b", "a \n b", "it's <|endoftext|> x", "<|endoftext|>", "don't 's", "\n", "x" * 3000]:
        check(text)


def one_by_one(counts, capacity):
    """Best fit of one piece after the other."""
    rooms = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((fit or capacity) - n)
    return sorted(rooms)


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(40):
        cap = rng.choice([10, 37, 64])
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap // 2))}
        fill = {}
        for s in best_fit_plan(counts, cap).itertuples():
            for q in range(s.pieces):
                fill.setdefault(s.sequence + q // s.each, []).append((s.offset + q % s.each * s.length, s.length))
        for spans in fill.values():
            end = 0
            for a, n in sorted(spans):
                assert a == end
                end += n
            assert end <= cap
        assert sorted(cap - sum(n for _, n in v) for v in fill.values()) == one_by_one(counts, cap)


def gapless(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= capacity
    return len(by)


def test_query_over_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    want = {}
    for d in docs:
        ids = np.array([*LIB.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        first, at, j = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            b = first if j == 0 else at + 2048
            want[d.doc_id, j] = (at, b - at, zlib.crc32(ids[at:b].tobytes()))
            at, j = b, j + 1
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used = gapless(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "a b", 2), (3, "word " * 900, 3)], "doc_id long, text string, ids int")
    pieces = token_pieces(df, FILE, capacity=64).withColumn("sequence", F.lit("x"))
    rows = best_fit_pack(pieces, capacity=64).collect()
    assert len(rows) == 3 + -(-len(LIB.encode("word " * 900).ids + [0]) // 64) and {r.sequence for r in rows} == {"x"}
    gapless(rows, 64)
    assert best_fit_pack(token_pieces(df.limit(0), FILE)).count() == 0
