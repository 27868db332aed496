import hashlib
from collections import Counter

import pytest

from gridfold.llm.alignment import align_documents

P = pytest.importorskip("public_tokenizers")


def brute(rows):
    """The contract read literally: byte ranges of both tokenizations, all pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}

    def spans(tokens):
        out, at = [], 0
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    found = []
    for doc_id, text in rows:
        whole = " " + (text or "")
        a = [(i, bytes(chars[c] for c in t)) for i, t in (lambda e: zip(e.ids, e.tokens))(tk.encode(whole, add_special_tokens=False))]
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text or ""))]
        if not text or b"".join(d for _, d in a) != whole.encode() or b"".join(d for _, d in b) != whole.encode():
            found.append((doc_id, [], [], [], ""))
            continue
        a, b = spans(a), spans(b)
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in x if low <= s < e) for x in (a, b)))
            low = e
        found.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(pair for *_, links, _ in found for pair in set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    return Counter((d, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[x] == best[x[0]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, links, g in found)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_against_brute_force(spark, docs, rows, empty):
    texts = ["x", " lead", "two  spaces", "tail ", "a\n b\n\n  c", "　wide 　 spaces", "mark▁inside", "<s> </s> <|endoftext|> <unk> <0x0A>",
             "né né ́x", "\x00 nul", "日本語 テキスト", "\U0001f600 \U0001f468‍\U0001f469", "a" * 300, " ", "   ", "\n", "it's we'll  they're", "a \x85b \xa0c"]
    more = [(i, t[:400] if t else t) for i, t, *_ in rows] + [(1000 + k, t) for k, t in enumerate(texts)] + [(None, "x"), (7, None), (8, "x"), (8, "x")]
    made = spark.createDataFrame([(i, t, "d", 1, 2) for i, t in more], "doc_id long, text string, digest string, copies int, pair int").repartition(4)
    want = brute(more)
    for heavy in ({}, {"heavy_pairs": 5, "heavy_texts": 1}, {"heavy_pairs": 0, "heavy_texts": 0}):
        out = align_documents(made, **heavy)
        assert Counter(tuple(r) for r in out.select(COLS).collect()) == want, heavy
    assert sum(1 for k in want if k[1] == 0) >= 5  # the null, the empty and the unspelled
    none = align_documents(empty)
    assert none.columns == COLS and none.count() == 0


def test_query(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    from gridfold.llm.queries import QUERIES

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op12_token_alignment"](spark, d).select("doc_id", "n_a", "n_b").collect()]
    assert sorted(got) == sorted((i, len(tk.encode(" " + t, add_special_tokens=False).ids), len(sp.encode(t))) for i, t in texts)
