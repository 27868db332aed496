import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridfold.llm import embed_dedup as E
from gridfold.llm.components import components
from gridfold.llm.fingerprints import fingerprint_documents, near_links
from gridfold.llm.line_dedup import dedup_line_documents, dedup_lines
from gridfold.llm.simhash_dedup import anchor_links, dedup_documents, keep_one


def roots(n, linked):
    label = np.arange(n)
    while True:
        new = np.array([label[linked[i]].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_dedup(docs, rows, empty):
    fps = np.array([brute_simhash(r[1]) for r in rows], dtype=np.uint64)
    label = roots(len(rows), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    first = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    want = Counter((r[0], f"{int(f):016x}", first[c]) for r, f, c in zip(rows, fps, label))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in dedup_documents(docs).collect()) == want
    assert dedup_documents(empty).count() == 0


def test_keep_one_keeps_one_row_of_each_group(docs, rows, empty):
    kept = keep_one(docs)
    assert kept.schema.names == docs.schema.names
    got = [r.doc_id for r in kept.collect()]
    want = {r.doc_id for r in dedup_documents(docs).where("kept").collect()}
    assert set(got) == want and len(got) == len(want)
    assert keep_one(empty).count() == 0


@pytest.mark.parametrize("homes", [4096, 3])
def test_anchor_covering_loses_no_link(spark, homes):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, d, replace=False)) for b in base for d in (1, 2, 3, 3, 4)]
    fps = np.unique(np.concatenate([base, np.array(flips, dtype=np.int64), np.array([0, 1, 3, 7, -1, -2])]))
    linked = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 3
    label = roots(len(fps), linked)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in components(anchor_links(df, 3, homes=homes), "a", "b").collect()}
    groups = {}
    for f, c in zip(fps, label):
        groups.setdefault(c, []).append(int(f))
    assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    pairs = {(r.fp, r.near) for r in near_links(df).collect()}
    assert pairs == {(int(fps[i]), int(fps[j])) for i, j in np.argwhere(linked) if i != j}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, **{k: 5 for k in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_votes(text):
    """Terms (a word, or two in a row) vote on each bit with their length, at most 15."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    votes, total = [0] * 64, 0
    for k, w in enumerate(words):
        for term in (w, " ".join(words[k:k + 2])):
            h, weight = xxhash.xxh64_intdigest(term.encode(), 42), min(len(term), 15)
            total += weight
            for b in range(64):
                votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def brute_fingerprints(rows):
    """A row of the result for each of ``rows``, (doc_id, text)."""
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = [(i, t or "") for i, t in rows]
    place = {d: (d[0] is None, d[0] or 0, signed(d[1])) for d in rows}
    order = sorted(place, key=place.get)
    fps = {d: brute_votes(d[1]) for d in order}
    out = {}
    for d, n in zip(order, order[1:] + order[:1]):
        t, q = d[1], len(d[1]) // 4
        edited = t[:len(t) - q] + n[1][:q]
        like = lambda x: 1 - (fps[d] ^ x).bit_count() / 64
        near = sum((fps[d] ^ fps[r]).bit_count() <= 3 for r in rows) - 1
        out[d] = (d[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[d]:016x}", f"{brute_votes(edited):016x}",
                  like(brute_votes(edited)), like(fps[n]), near)
    return Counter(out[r] for r in rows)


def test_fingerprints(docs, rows, empty):
    got = fingerprint_documents(docs)
    assert Counter(map(tuple, got.collect())) == brute_fingerprints([r[:2] for r in rows])
    assert fingerprint_documents(empty).count() == 0


def test_fingerprints_of_repeated_and_missing_ids_and_of_a_text_over_many_chunks(spark):
    rng = np.random.default_rng(12)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 70_000))  # more words than a chunk
    rows = [(7, "a b c d"), (7, "e f g h i"), (7, "a b c d"), (None, "x y"), (None, "z"), (None, "x y"), (3, long), (2**53 + 1, "p q"), (2**53 + 3, None)]
    got = fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_fingerprints(rows)


def brute_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], Counter()
    done = {}
    for i, t, *_ in order:
        t = t or ""
        if (i, t) not in done:
            keep = []
            for line in t.split("\n"):
                s = frozenset(w for w in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if w)
                if not s or not any(len(s & x) >= 0.8 * len(s | x) - 1e-9 for x in seen):
                    keep.append(line)
                if s:
                    seen.append(s)
            done[i, t] = "\n".join(keep)
        out[i, done[i, t]] += 1
    return out


def test_line_dedup(docs, rows, empty):
    got = dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id is not None) == Counter({k: n for k, n in brute_lines(rows).items() if k[0] is not None})
    assert len(got) == len(rows) and dedup_lines(empty).count() == 0
    whole = dedup_line_documents(docs)
    assert whole.schema.names == docs.schema.names
    assert Counter((r.doc_id, r.text or "") for r in whole.collect()) == Counter((r.doc_id, r.text) for r in got)


def test_line_dedup_of_many_variants_of_a_line(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(20)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.choice(20, rng.integers(0, 6), replace=False):
            w[k] = f"v{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_lines(rows)


def test_line_dedup_of_lines_from_few_words_and_words_that_occur_once(spark):
    rng = np.random.default_rng(21)
    line = lambda k: " ".join([f"w{j}" for j in rng.integers(0, 20, rng.integers(3, 9))] + [f"once{k}{e}" for e in "ab"[:k % 3]])
    lines = [line(k) for k in range(240)]
    rows = [(k, "\n".join(lines[8 * k:8 * k + 8])) for k in range(30)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_lines(rows)


@pytest.mark.parametrize("hot", [0, 13, 127])
def test_line_dedup_by_hot_words_and_by_others(spark, monkeypatch, hot):
    """The same lines go whether all words of prefixes are hot, some or none; lines
    on either side of the length at which the parity changes, cut at any white space."""
    from gridfold.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT", hot << 56)
    rng = np.random.default_rng(31)
    base = [f"w{k}" for k in range(66)]
    lines = [" ".join(base[:n]) + f" end{n}" for n in (52, 63, 64, 65, 66)]
    lines += ["\t".join(rng.permutation(base[:63])) + "\x0b\r tail", "  " + "\f".join(base[:30]), "\t\x0b\f\r ", "a  b\tc", "c\rb\x0ba", "A\x85b", "A\u00a0b"]
    for _ in range(90):
        w = [*base[:rng.integers(8, 14)]]
        for k in rng.choice(len(w), rng.integers(0, 4), replace=False):
            w[k] = f"v{rng.integers(0, 30)}"
        lines.append(" ".join(w))
    rows = [(k, "\n".join(lines[3 * k:3 * k + 3])) for k in range(len(lines) // 3)] + [(1, "\n".join(lines[3:6]))]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_lines(rows)


def test_line_sets_work_a_line_out_once(spark):
    """No regular expression cuts the words, each line is hashed once, and the classes are in no row."""
    from gridfold.llm import line_dedup

    docs = line_dedup.keyed(spark.createDataFrame([(1, "a b c\nd e"), (2, "a b d")], "doc_id long, text string"))
    plan = line_dedup.line_sets(docs, 0.8, line_dedup.rarity_classes(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\s+" not in plan and plan.count("array_distinct") == 1 and " AS rank#" not in plan


def test_embedding_graph(spark):
    rng = np.random.default_rng(2)
    far = rng.normal(size=(300, 16))
    dense = rng.normal(size=16) + 0.15 * rng.normal(size=(150, 16))
    x = np.concatenate([far, dense, far[:5], far[5:10] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), "l", i) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16]
    rows += [(1000 + k, v, "l", k) for k, v in enumerate(bad)] + [(None, x[0].tolist(), "l", 0), rows[3], (2000, [1.0, 2.0], "l", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string, a int")
    out = E.dedup_vectors(df, shard=64)
    got = out.collect()
    assert len(got) == len(rows)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = y @ y.T >= 0.9
    label = roots(len(x), linked)
    good = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < len(x)}
    times = np.where(np.arange(len(x)) == 3, 2, 1)  # row 3 is there twice
    found, true = sum(r.n_links for r in good.values()), (linked @ times - 1).sum()
    assert 0.97 * true <= found <= true
    assert sum(good[i].component_id == label[i] for i in good) >= 0.99 * len(x)
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id is None or r.vec_id >= 1000)
    assert E.dedup_vectors(df.limit(0)).count() == 0
    assert good[0].recall >= 0.9


def test_robust_prune_drops_what_a_nearer_one_covers():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.199], [0, 1]], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = E.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1]]), 3)
    assert out.tolist() == [[1, -1, -1]] or out.tolist() == [[1, 3, -1]]


def test_line_dedup_moves_little_that_does_not_match(spark, monkeypatch):
    """Long lines of common words that match nothing reach no comparison of texts."""
    from gridfold.llm import line_dedup

    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{j}" for j in rng.choice(400, 140, replace=False)) for _ in range(120)]
    rows = [(k, line) for k, line in enumerate(lines)] + [(200 + k, f"{line} new{k}") for k, line in enumerate(lines[:10])]
    seen = []

    def verified(pairs, *rest):
        seen.extend((r.x, r.y) for r in pairs.collect())
        return checked(pairs, *rest)

    checked = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", verified)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_lines(rows)
    assert len(seen) == 10


def test_bitmap_grows_with_its_keys(spark):
    from gridfold.llm.common import bitmap, in_bitmap

    keys = spark.range(200_000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(400_000).select("id", in_bitmap(bitmap(keys), F.xxhash64("id")).alias("hit"))
    hits = dict(rows.where("hit").groupBy((F.col("id") < 200_000).alias("own")).count().collect())
    assert hits[True] == 200_000 and hits.get(False, 0) < 20_000
    none = keys.where("key IS NULL")
    assert rows.sparkSession.range(9).where(in_bitmap(bitmap(none), F.xxhash64("id"))).count() == 0
