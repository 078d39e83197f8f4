import heapq
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vantage.llm import token_store as ts
from vantage.llm.tokens import Encoder, default_tokenizer


def huffman_cost(counts):
    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=200).filter(any))
def test_code_lengths(counts):
    n = np.array(counts)
    free = ts.code_lengths(n, 20)
    assert int((free * n).sum()) == huffman_cost(counts)
    assert sum(2.0 ** -int(x) for x in free if x) <= 1
    tight = ts.code_lengths(n, 8)
    assert tight.max() <= 8 and sum(2.0 ** -int(x) for x in tight if x) <= 1 and ((tight > 0) == (n > 0)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), min_size=1, max_size=1500), st.integers(1, 64))
def test_bits_round_trip(ids, block):
    ids = np.array(ids)
    lengths = ts.code_lengths(np.bincount(ids, minlength=300) ** 3)
    data, at = ts.pack_bits(ids, lengths, ts.canonical(lengths))
    back = ts.unpack_bits(np.concatenate((data, np.zeros(8, np.uint8))), at[:-1:block], len(ids), ts.decode_table(lengths), block)
    assert back.tolist() == ids.tolist()


def test_encoder_equals_library():
    e, rng = Encoder(default_tokenizer()), random.Random(0)
    alphabet = ["a", "Bc", " ", "  ", "\n", " \n", "é", "'s", "'", "12", "!", ".", "\x1c", "　", "\t", "日", "²", "||", "\n\n", "ʰ", "<|endoftext|>"]
    library = Tokenizer.from_file(default_tokenizer())
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(e(x), e.dtype).tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)
    assert e(None) == e("") == b""


def check_store(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = ts.read_store(spark, ts.write_store(docs)).collect()
    library = Tokenizer.from_file(default_tokenizer())
    want = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((d is not None, d or 0, x) for d, x in want)
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        before += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [d for d, _ in want]


def test_store_edge_cases(spark, monkeypatch):
    rows = [(5, "b c"), (2, None), (9, ""), (None, "x y"), (2, "again"), (5, "b c"), (6, "a <|endoftext|> b"), (-7, "word " * 60_000), (10**12, "é日 ")]
    check_store(spark, rows)
    check_store(spark, [(1, None)])
    check_store(spark, [])


def test_store_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check_store(spark, rows)
