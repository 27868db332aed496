"""Alignment of two tokenizers over a corpus: which tokens cover the same bytes.

Copies are found by shuffling the full texts; each distinct text is tokenized
and aligned once, its id pairs weigh as many documents as it has copies, and
the measures go back to the documents by the digest of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridfold.llm.common import join_by_weight, map_texts, text_or_empty, tokenizer_path
from gridfold.llm.words import LibraryTokenizer, Ragged, Remembered, ragged, split_words, with_space
from gridfold.session import stage

#: Most id pairs, and most texts, that are broadcast: the heaviest ones.
HEAVY_PAIRS, HEAVY_TEXTS = 1 << 18, 1 << 12
#: Bytes of text aligned at once, and words that a task keeps the ids of: links and groups take many times the text.
SLICE, KEPT = 3 << 20, 1 << 18


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizers file."""
    from tokenizers import Tokenizer

    # The byte alphabet: printable Latin-1 characters stand for themselves, the
    # other bytes, in order, for the characters from U+0100 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    t = Tokenizer.from_file(path)
    vocab = t.get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model with byte fallback."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    """Aligns words; a word is text with the space before it."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = Remembered(LibraryTokenizer(path_a, plain_specials=True), KEPT)
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encode_b = Remembered(lambda words: ragged(model.encode(words.to_pylist(), num_threads=1)), KEPT)
        self.bytes_a, self.bytes_b = byte_level_tokens(path_a), piece_tokens(model)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def words(self, words: pa.Array) -> "AlignedWords":
        return AlignedWords(self, words)


class AlignedWords:
    """Ids, links and groups of each of some words. A word whose tokens do not
    spell it has none and is marked in ``lost``."""

    def __init__(self, by: Aligner, words: pa.Array):
        spaced = with_space(words)
        a = by.encode_a(spaced)
        b = by.encode_b(words)  # the model puts the space first itself
        spelled = spaced.cast(pa.binary()).to_pylist()
        ids_a, ids_b = a.flat.tolist(), b.flat.tolist()
        at_a, at_b = a.starts.tolist(), b.starts.tolist()
        self.lost = np.fromiter((
            b"".join([by.bytes_a[i] for i in ids_a[at_a[k]:at_a[k + 1]]]) != s
            or b"".join([by.bytes_b[i] for i in ids_b[at_b[k]:at_b[k + 1]]]) != s for k, s in enumerate(spelled)), bool, len(words))
        if self.lost.any():
            a, b = _emptied(a, self.lost), _emptied(b, self.lost)
        self.a, self.b = a, b
        # both now spell the same bytes: ends on one scale over all words
        ends_a, ends_b = np.cumsum(by.size_a[a.flat]), np.cumsum(by.size_b[b.flat])
        ends = np.union1d(ends_a, ends_b)
        # between two neighbouring ends lies the overlap of one A token and one B token
        left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.left, self.right = a.flat[left].astype(np.int64), b.flat[right].astype(np.int64)
        self.link_starts = np.searchsorted(left, a.starts)
        closes = (ends_a[left] == ends) & (ends_b[right] == ends)
        closed = np.concatenate([[0], np.cumsum(closes)])
        self.groups = np.diff(closed[self.link_starts])
        self.texts = self._texts(left, right, closes)

    def _texts(self, left: np.ndarray, right: np.ndarray, closes: np.ndarray) -> list[str]:
        """Each word's groups, written as ``a1,a2|b1;a3|b2,b3``."""
        a, b = list(map(str, self.a.flat.tolist())), list(map(str, self.b.flat.tolist()))
        to_a, to_b = (left[closes] + 1).tolist(), (right[closes] + 1).tolist()
        parts, at_a, at_b = [], 0, 0
        for i, j in zip(to_a, to_b):
            parts.append(f"{a[at_a]}|{b[at_b]}" if i - at_a == 1 == j - at_b else f"{','.join(a[at_a:i])}|{','.join(b[at_b:j])}")
            at_a, at_b = i, j
        cuts = np.concatenate([[0], np.cumsum(self.groups)]).tolist()
        return [";".join(parts[x:y]) for x, y in zip(cuts, cuts[1:])]


def _emptied(lists: Ragged, gone: np.ndarray) -> Ragged:
    sizes = np.where(gone, 0, lists.sizes)
    return Ragged(lists.flat[~np.repeat(gone, lists.sizes)], np.concatenate([[0], np.cumsum(sizes)]))


LINK = "array<struct<pair:long,times:int>>"
ALIGNED = f"digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {LINK}"


def align_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ALIGNED`` for each row of (text, digest, copies). A pair is written as
    one number, A id * B vocabulary + B id (see :func:`pair_base`)."""

    def make():
        by = Aligner(path_a, path_b)
        base = len(by.bytes_b)

        def work(batch):
            texts = batch.column("text")
            words = split_words(texts)
            aligned = by.words(words.distinct)
            bounds, order = words.starts, words.rows

            def total(per_word):
                return np.diff(np.concatenate([[0], np.cumsum(per_word[words.codes])])[bounds])

            lost = total(aligned.lost.astype(np.int64)) > 0
            pairs = Ragged(aligned.left * base + aligned.right, aligned.link_starts).take(words.codes).merge(bounds)
            of = np.repeat(np.arange(len(order)), pairs.sizes)
            kept = ~lost[of]
            known, number = np.unique(pairs.flat, return_inverse=True)
            both, times = np.unique(of[kept] * (len(known) + 1) + number[kept], return_counts=True)
            owner, pair = both // (len(known) + 1), known[both % (len(known) + 1)] if len(known) else both
            listed = np.searchsorted(owner, np.arange(len(order) + 1))
            links = pa.ListArray.from_arrays(pa.array(listed, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(pair, pa.int64()), pa.array(times, pa.int32())], names=["pair", "times"]))
            codes, cuts = words.codes.tolist(), bounds.tolist()
            shas = ["" if lost[k] or cuts[k] == cuts[k + 1] else hashlib.sha256(";".join([aligned.texts[c] for c in codes[cuts[k]:cuts[k + 1]]]).encode()).hexdigest()
                    for k in range(len(order))]
            rows = pa.array(order)
            counts = {n: np.where(lost, 0, total(x)) for n, x in (
                ("n_a", aligned.a.sizes), ("n_b", aligned.b.sizes), ("n_groups", aligned.groups), ("n_links", np.diff(aligned.link_starts)))}
            return {"digest": batch.column("digest").take(rows), "copies": batch.column("copies").take(rows),
                    **{n: pa.array(x, pa.int64()) for n, x in counts.items()}, "groups_sha256": shas, "links": links}

        return work

    return map_texts(texts, ALIGNED, make, SLICE)


def pair_base(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, a, b, documents, best): how many documents hold each linked id pair,
    and whether no other pair of its A id is held by more."""
    counts = aligned.select("copies", F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("documents"))
    counts = stage(aligned.sparkSession, counts.withColumn("a", F.floor(F.col("pair") / base)), "align-counts")
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", F.pmod("pair", F.lit(base)).alias("b"), "documents", (F.col("documents") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
                    heavy_pairs: int = HEAVY_PAIRS, heavy_texts: int = HEAVY_TEXTS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``.

    A are the tokens of a space and the text by a byte-level tokenizers file, B those
    of the text by a sentencepiece model. Bytes at which tokens of both end
    cut them into groups; an A and a B token that share bytes are linked.
    ``count_sum`` adds up, over the links, how many documents hold the id pair
    linked, ``n_best`` counts the links whose pair no other of its A id exceeds.

    Null and empty texts, and those that the tokens of A or B do not spell (with a
    space before), have zeros and the digest ''. Repeated rows and null doc_ids are
    kept, and each row counts as a document; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    whole = text_or_empty(docs, "doc_id")
    texts = whole.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "copies")
    aligned = align_texts(texts, path_a, path_b).withColumn("at", F.monotonically_increasing_id())
    aligned = stage(spark, aligned, "align-texts")
    pairs = stage(spark, pair_counts(aligned, pair_base(path_b)).select("pair", "documents", "best"), "align-pairs")
    links = aligned.select("at", F.inline("links"))
    scored = join_by_weight(links, pairs, "pair", "documents", heavy_pairs).groupBy("at").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    counted = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = aligned.drop("links").join(scored, "at", "left").select(
        "digest", "copies", "groups_sha256", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted])
    measures = stage(spark, measures, "align-measures")
    keyed = whole.where("text <> ''").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    out = ["doc_id", *counted, "groups_sha256"]
    none = whole.where("text = ''").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in counted], F.lit("").alias("groups_sha256"))
    return join_by_weight(keyed, measures, "digest", "copies", heavy_texts).select(out).unionByName(none)
