import heapq
import zlib
from collections import Counter

import numpy as np
import pytest

from gridfold.llm import token_files as T

P = pytest.importorskip("public_tokenizers")


def huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def limited_cost(counts, limit):
    """Least total bits over all length vectors, tried one by one (few symbols)."""
    best = None

    def go(k, left, cost):
        nonlocal best
        if k == len(counts):
            best = cost if best is None else min(best, cost)
            return
        for bits in range(1, limit + 1):
            share = 1 << (limit - bits)
            if share <= left:
                go(k + 1, left - share, cost + bits * counts[k])

    go(0, 1 << limit, 0)
    return best


def test_code_lengths_are_the_best():
    rng = np.random.default_rng(5)
    for n in (2, 3, 10, 500):
        counts = rng.zipf(1.3, n).clip(1, 10**9)
        bits = T.code_lengths(counts, 25)
        assert sum(2.0 ** -float(b) for b in bits) == 1
        if bits.max() < 25:
            assert int((bits * counts).sum()) == huffman_cost(counts.tolist())
    for limit in (3, 4):
        counts = np.array([1, 1, 2, 4, 9, 30])
        bits = T.code_lengths(counts, limit)
        assert bits.max() <= limit and int((bits * counts).sum()) == limited_cost(counts.tolist(), limit)
    assert T.code_lengths(np.array([5])).tolist() == [1] and T.code_lengths(np.empty(0, np.int64)).tolist() == []
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(5, np.int64), 2)


def test_blocks_round_trip_and_any_place():
    rng = np.random.default_rng(6)
    for n, symbols in ((1, 1), (63, 3), (64, 2), (1000, 700), (5000, 5000)):
        ids = np.sort(rng.choice(60_000, symbols, replace=False))
        text = rng.choice(ids, n)
        text[:min(n, symbols)] = ids[:min(n, symbols)]
        known, counts = np.unique(text, return_counts=True)
        code = T.Code(known, T.code_lengths(counts))
        # a prefix code, canonical
        words = sorted(format(c, f"0{b}b") for c, b in zip(code.codes.tolist(), code.bits.tolist()))
        assert all(not b.startswith(a) for a, b in zip(words, words[1:]))
        cut = n // 3
        data = T.pack_block(code, [None, 2**60], [cut, n - cut], text)
        block = T.Block(data)
        assert block.doc_ids == [None, 2**60] and block.sizes.tolist() == [cut, n - cut]
        assert (block.ids(code.table(), code.longest) == text).all()
        for a, m in ((0, 1), (n - 1, 5), (n // 2, 70), (n, 1)):
            assert block.ids(code.table(), code.longest, a, m).tolist() == text[a:a + m].tolist()
        with pytest.raises(ValueError, match="damaged"):
            T.Block(data[:20] + bytes([data[20] ^ 1]) + data[21:])


def expected(rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(i, np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]


def test_documents(spark, docs, rows, empty, tmp_path):
    want = expected([(i, t) for i, t, *_ in rows])
    folder = str(tmp_path / "ids")
    encoded = T.encode_ids(docs, P.path("word_bpe_49k.json"), 1, "<u4").selectExpr("*", "monotonically_increasing_id() AS at")
    T.write_ids(T.stage(spark, encoded, "test-ids"), folder, "<u4", block_ids=500, step=16)
    got = T.read_documents(spark, folder, keep_ids=True).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(x.tolist())) for i, x in want)
    got.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at, flat = 0, []
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at, flat = at + r.n_tokens, flat + r.ids
    for first, count in ((0, 10), (at - 3, 10), (at // 2, 1200)):
        parts = sorted(T.read_range(spark, folder, first, count).collect())
        assert [x for p in parts for x in p.ids] == flat[first:first + count]
    assert spark.read.parquet(folder + "/blocks").count() > 5
    assert T.token_file_documents(empty).count() == 0


def test_query(spark):
    from gridfold.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    at, want = 0, []
    for i, x in expected(texts):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    out = QUERIES["op13_token_files"](spark, d).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in out.collect()) == want
