"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint holds two blocks of 31 bits. Two fingerprints within d bits
are within t = d // 2 bits on one of them. On a block the anchors are the words of
the Hamming code of 31 bits, a perfect covering code of radius 1. A block is at
home at the one anchor within that radius, and is sent to every anchor within
the radius plus t; so of two blocks within t, the second is sent to the first's
home. Rows are compared at each anchor on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridfold.llm.common import bitmap, in_bitmap, map_columns, text_or_empty
from gridfold.llm.components import components, local_roots
from gridfold.session import ship_package, stage

BLOCK, CHECKS = 31, 5  # the Hamming code of length 2**5 - 1
RADIUS = 1
#: Fingerprints at home at one anchor that one task holds; more are dealt by hash.
HOMES = 4096
#: Pairs compared at a time.
PAIRS = 1 << 20


def simhash(text: str, words: int) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half the XXH64 (seed 42)
    of the text's shingles, repeats included. A-Z are lower-cased; words are
    what stands between ASCII white space; fewer words than a shingle has are
    one shingle; a text without words has fingerprint 0."""
    import xxhash

    w = text.encode().lower().split()  # of bytes: ASCII only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) > words else [b" ".join(w)]
    seeded = xxhash.xxh64_intdigest
    h = np.fromiter((seeded(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (as a signed long) and ``key``, a hash of the text, per row; a null
    text counts as empty."""

    def make():
        return lambda ids, keys, texts: {"doc_id": ids, "key": keys, "fp": [simhash(t, words) for t in texts]}

    texts = text_or_empty(docs, "doc_id").select("doc_id", F.xxhash64("text").alias("key"), "text")
    return map_columns(texts, "doc_id long, key long, fp long", make)


def _checks(block: Column) -> Column:
    """Syndrome in the Hamming code whose k-th bit (from 1) has check word k."""
    masks = [sum(1 << (k - 1) for k in range(1, BLOCK + 1) if k >> j & 1) for j in range(CHECKS)]
    return sum((F.bit_count(block.bitwiseAND(F.lit(m))) % 2) * (1 << j) for j, m in enumerate(masks))


def _steps(weight: int) -> list[list[int]]:
    """For each syndrome, the changes of at most ``weight`` bits that have it;
    each takes a block of that syndrome to a code word."""
    out: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for n in range(weight + 1):
        for bits in combinations(range(1, BLOCK + 1), n):
            check = 0
            for k in bits:
                check ^= k
            out[check].append(sum(1 << (k - 1) for k in bits))
    return out


def _anchors(block: Column, weight: int) -> Column:
    steps = F.array(*(F.array(*(F.lit(s).cast("long") for s in xs)) for xs in _steps(weight)))
    return F.transform(F.element_at(steps, (_checks(block) + 1).cast("int")), lambda s: s.bitwiseXOR(block))


def anchor_links(fps: DataFrame, max_distance: int = 3, homes: int = HOMES) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp``, enough of them to join
    whatever is within ``max_distance`` bits, at most one for each row at an
    anchor (those of a batch are replaced by a tree)."""
    ship_package(fps.sparkSession)
    mask = (1 << BLOCK) - 1
    blocks = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", k * BLOCK).bitwiseAND(F.lit(mask)).alias("block")) for k in (0, 1)))
    split = fps.select("fp", F.explode(blocks).alias("b")).select("fp", "b.k", "b.block")

    def at(weight: int) -> DataFrame:
        anchor = F.explode(_anchors(F.col("block"), weight)).alias("anchor")
        return split.select("fp", "k", anchor).select("fp", (F.col("anchor") * 2 + F.col("k")).alias("anchor"))

    home = at(RADIUS).withColumn("visits", F.lit(0))
    visit = at(RADIUS + max_distance // 2).withColumn("visits", F.lit(1))
    # an anchor with many homes is dealt into salts, each of which sees every visitor
    salts = home.groupBy("anchor").agg(F.ceil(F.count("*") / homes).cast("int").alias("salts")).where("salts > 1")
    home = home.join(salts, "anchor", "left").select("fp", "anchor", "visits", F.coalesce(F.pmod(F.xxhash64("fp"), "salts"), F.lit(0)).alias("salt"))
    visit = visit.join(salts, "anchor", "left").select("fp", "anchor", "visits", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
    rows = home.union(visit).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # homes of the last anchor seen, whose visitors may go on
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "anchor", "salt", "visits")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            fp, anchor, salt, visits = cols
            if not len(fp):
                continue
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            starts, ends = np.append(0, new), np.append(new, len(fp))
            n_home = np.add.reduceat(visits == 0, starts)
            yield from _trees(fp, np.repeat(starts, n_home) + _ramp(n_home), np.repeat(starts + n_home, n_home), np.repeat(ends, n_home), max_distance)
            last = slice(starts[-1], starts[-1] + n_home[-1])
            held = [c[last].copy() for c in cols]

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _trees(fp: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, max_distance: int) -> Iterator[pa.RecordBatch]:
    """Compare row left[i] with rows lo[i]..hi[i]-1, and return (row, root)."""
    root, width = np.arange(len(fp)), hi - lo
    keep = width > 0
    left, lo, width = left[keep], lo[keep], width[keep]
    i = 0
    while i < len(left):
        if width[i] > PAIRS:  # one home with very many visitors
            a, b = np.full(width[i], left[i]), np.arange(lo[i], lo[i] + width[i])
            i += 1
        else:
            j = i + max(1, int(np.searchsorted(np.cumsum(width[i:i + PAIRS]), PAIRS, side="right")))
            a, b = np.repeat(left[i:j], width[i:j]), np.repeat(lo[i:j], width[i:j]) + _ramp(width[i:j])
            i = j
        linked = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= max_distance
        linked &= fp[a] != fp[b]
        root = local_roots(len(fp), a[linked], b[linked], root)
    off = np.flatnonzero(root != np.arange(len(fp)))
    if len(off):
        yield pa.RecordBatch.from_arrays([pa.array(fp[off]), pa.array(fp[root[off]])], names=["a", "b"])


def dedup_documents(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id, kept per row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most
    ``max_distance`` bits reach, ``kept`` whether the row has that id. Rows of
    one fingerprint are one class from the start, so copies are never compared.
    Null and empty texts have fingerprint zero and link like any other; a null
    doc_id never is a component_id while its component has others; repeated
    rows are kept; an empty table gives an empty result; other columns are
    ignored.
    """
    if max_distance < 0:
        raise ValueError("max_distance is a number of bits")
    rows = stage(docs.sparkSession, fingerprints(docs, words).drop("key"), "simhash-rows")
    by_fp = _members(rows, max_distance).drop("root")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _members(rows: DataFrame, max_distance: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint of ``rows``."""
    spark = rows.sparkSession
    classes = stage(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(anchor_links(classes.select("fp"), max_distance), "a", "b")
    member = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    whole = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return member.join(whole, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with every column: that of the smallest
    doc_id (a null one comes last), and among rows that share it, the one whose text
    has the smallest hash.

    Rows that share a doc_id and have different texts are decided each by itself, so
    that every component keeps a row. Rows that share both are one document. Null
    texts count as empty, an empty table gives an empty result, and columns of any
    name are kept as they are.
    """
    if max_distance < 0:
        raise ValueError("max_distance is a number of bits")
    rows = stage(docs.sparkSession, fingerprints(docs, words), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    rows = stage(docs.sparkSession, rows.join(_members(rows, max_distance).select("fp", "root"), "fp").select("root", place.alias("place")), "simhash-decided")
    first = rows.groupBy("root").agg(F.min("place").alias("first"))
    each = rows.groupBy("root", "place").agg(F.count("*").alias("rows")).join(first, "root")
    ids = each.select(F.col("place.doc_id").alias("other"), F.col("place.key").alias("other_key"), (F.col("place") == F.col("first")).alias("stays"), "rows")
    ids = stage(docs.sparkSession, ids.where("NOT stays OR rows > 1").drop("rows"), "simhash-others")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(ids["other"]) & (text == ids["other_key"])
    # rows that a bitmap shows to be none of these are not moved
    some = in_bitmap(bitmap(ids.select(F.xxhash64("other", "other_key").alias("key"))), F.xxhash64(docs["doc_id"].cast("long"), text))
    key = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    once = docs.where(some).join(ids.where("stays"), same, "left_semi").withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    left = docs.where(some).join(ids, same, "left_anti")
    return docs.where(~some).unionByName(left).unionByName(once.dropDuplicates(["doc_id", key]).drop(key))
