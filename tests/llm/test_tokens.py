import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridfold.llm.bpe import byte_bpe, encode_documents
from gridfold.llm.common import tokenizer_path
from gridfold.llm.packing import best_fit, pack_documents
from gridfold.llm.token_counts import PrefixTable, count_tokens, prefix_counter

P = pytest.importorskip("public_tokenizers")
UNITS = ["a", "b", " ", "\n", "th", "e", "\t", "é", "\xa0", "1", ".", "'s", "  ", "▁", "Z", "世", "\r", "<s>", "<|endoftext|>"]


def odd(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n", " \n ", "x" * 2000, *("".join(rng.choice(UNITS) for _ in range(rng.randint(1, 40))) for _ in range(n))]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_backtracking_gives_the_library_s_ids(tik):
    bpe = byte_bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in odd(3000):
        ids = bpe.encode(t)
        assert ids == ",".join(map(str, tik.encode_ordinary(t))), repr(t)
        assert bpe.decode(ids) == t.encode()


def test_encode_documents(docs, rows, empty, tik):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        ids = tik.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert encode_documents(empty).count() == 0


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_counts_at_every_prefix(pieces):
    counter = prefix_counter(tokenizer_path("piece_bpe_32k.model"))
    for t in odd(400, seed=2):
        if len(t) > 100:
            t = t[:60]
        true = [len(pieces.encode(t[:k])) for k in range(len(t) + 1)]
        table = PrefixTable(counter, t)
        assert [table.count(k) for k in range(len(t) + 1)] == true, repr(t)
        for budget in (0, 1, 3, true[-1]):
            assert table.fit(budget) == max(k for k, n in enumerate(true) if n <= budget), (repr(t), budget)


def test_count_tokens(docs, rows, empty, pieces):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, limit=50).collect())
    want = Counter()
    for i, t, *_ in rows:
        n = len(pieces.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 50] += 1
    assert got == want
    assert count_tokens(empty).count() == 0


def least_bins(items, size):
    """Martello and Toth's bound: items over half a bin never share one, so what
    room they leave limits the small ones. (The sum over the size is no fair bound
    where many items are large.)"""
    best = 0
    for a in range(size // 2 + 1):
        big, half = items[items > size - a], items[(items <= size - a) & (items > size / 2)]
        small = items[(items <= size / 2) & (items >= a)]
        more = np.ceil((small.sum() - (len(half) * size - half.sum())) / size)
        best = max(best, len(big) + len(half) + max(0, int(more)))
    return best


def test_best_fit_holds_every_constraint():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 100, 400)
    for rule in ("norm", "dot"):
        for cap in ((100, 1000, 100**2), (100, 3, 100**2), (100, 1000, 5_000)):
            items_ok = items[items.astype(float) ** 2 <= cap[2]]
            bins, offsets = best_fit(items_ok, cap, (1.0, 0.05, 0.05), rule)
            for b in np.unique(bins):
                mine = np.sort(offsets[bins == b])
                size = items_ok[bins == b][np.argsort(offsets[bins == b])]
                assert size.sum() <= cap[0] and len(size) <= cap[1] and (size.astype(float) ** 2).sum() <= cap[2]
                assert (mine == np.cumsum(size) - size).all()
    bins, _ = best_fit(items, (100, 1000, 100**2), (1.0, 0.05, 0.05))
    assert len(np.unique(bins)) <= 1.02 * least_bins(items, 100)
    with pytest.raises(ValueError):
        best_fit(np.array([101]), (100, 10, 1e9), (1, 1, 1))


def test_pack_documents(docs, rows, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = pack_documents(docs, max_tokens=64, group=20).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i if i is not None else -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, out.fillna({"doc_id": -1})[cols].astype(int).to_numpy().tolist())) == want
    out = out.sort_values(["sequence_id", "offset"])
    total = out.groupby("sequence_id")["length"]
    assert total.sum().max() <= 64 and (total.cumsum() - out["length"] == out["offset"]).all()
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 64) + 4
    assert pack_documents(empty).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [9007199254740993, None, 9007199254740995, -5]
    df = spark.createDataFrame([(i, "one two") for i in ids], "doc_id long, text string").coalesce(1)
    assert Counter(r.doc_id for r in pack_documents(df, max_tokens=64).collect()) == Counter(ids)


def test_one_long_word():
    from tokenizers import Tokenizer

    from gridfold.llm.words import LibraryTokenizer, encode_words, slices, split_words
    import pyarrow as pa

    text = "añb" * 3_500_000  # no space in ten million bytes
    batch = pa.array([text[:30], text, "end of it"])
    assert list(slices(batch)) == [(0, 1), (1, 2), (2, 3)]
    path = P.path("byte_bpe_50k.json")
    words = split_words(pa.array([text[:300_000]]))
    ids = encode_words(words.distinct, LibraryTokenizer(path)).take(words.codes)
    assert ids.flat.tolist() == Tokenizer.from_file(path).encode(text[:300_000]).ids


@pytest.mark.parametrize("name, specials", [("byte_bpe_50k.json", False), ("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_matches_reach_the_librarys_model_as_the_library_hands_them_on(name, specials, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from gridfold.llm.words import LibraryTokenizer, Remembered, split_words

    texts = ["Étude des eaux.\nÈre, ÑANDÚ ¡ya! x÷y ×2 3²½ \xb5\xaa\xba\xad ÿß", "it's I'll 'S ''t foo's,\nbar\n\nBaz\n qux.\n", "Ω Å K ſ İI ǅ ΑΣ ﬁ 漢字 가 é \x7f\x85\x1c a\tb  c\r\nd",
             "<|endoftext|> a<|startoftext|>b", "word. word, word Word WORD wörd WÖRD wörd. (wörd) «wörd» wörd1 1wörd", "", " ", "\n", "a\nb c\nd É\nÉ é.É", "The the. The\nthe"] * 2
    encode = LibraryTokenizer(P.path(name), plain_specials=specials)
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = specials
    one_by_one = []
    monkeypatch.setattr(encode, "single", lambda words: one_by_one.extend(words.to_pylist()) or LibraryTokenizer.single(encode, words))
    words = split_words(pa.array(texts), encode.found)
    remember = Remembered(encode)
    for _ in range(2):  # the second time by what is remembered
        spaced, codes = words.spaced() if encode.begins else (words.distinct, words.codes)
        ids = remember(spaced).take(codes).merge(words.starts)
        got = {row: ids.flat[ids.starts[k]:ids.starts[k + 1]].tolist() for k, row in enumerate(words.rows.tolist())}
        assert [got[k] for k in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert " des" not in one_by_one and not any("eaux.\nÈre," in w for w in one_by_one), "such words went one by one before"
    assert len(encode.known.words) and len(set(encode.known.words.to_pylist())) == len(encode.known.words), "each match is encoded once"


def test_a_task_gives_memory_back_and_works_on_slices(spark, monkeypatch):
    import pyarrow as pa

    from gridfold.llm import common

    freed, batch = [], pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 9, ""])], names=["text"])
    monkeypatch.setattr(common, "release", lambda: freed.append(1))
    assert [b.num_rows for b in common.sliced(iter([batch, batch.slice(0, 0)]), 0, 4)] == [2, 1, 1]
    assert len(list(common.released(lambda batches: batches)(iter([batch, batch])))) == 2 and len(freed) == 3
    common.release()
