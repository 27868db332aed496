"""Vector best-fit packing of tokenized documents into fixed-size sequences."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridfold.llm.common import TEXT_ROWS, map_texts, text_or_empty, tokenizer_path
from gridfold.llm.words import LibraryTokenizer, Remembered, split_words
from gridfold.session import stage

#: Pieces packed together by one task. Waste is at most about one sequence a group.
GROUP = 16_384


def document_pieces(docs: DataFrame, max_tokens: int, end_id: int, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and
    ``end_id``; what is over ``max_tokens`` long is cut into pieces of that
    length, of which only the first may be shorter."""

    def make():
        tokenizer = LibraryTokenizer(path)
        encode = Remembered(tokenizer)

        def work(batch):
            words = split_words(batch.column("text"), tokenizer.found)
            spaced, codes = words.spaced()
            ids = encode(spaced).take(codes).merge(words.starts)
            rows, pieces = [], []
            for k, row in enumerate(words.rows.tolist()):
                data = np.append(ids.flat[ids.starts[k]:ids.starts[k + 1]], end_id).astype("<u4").tobytes()
                n, view = len(data) // 4, memoryview(data)
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                rows += [row] * (len(cuts) - 1)
                pieces += [(i, a, b - a, zlib.crc32(view[4 * a:4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            piece, start, length, crc = zip(*pieces)
            return {"doc_id": batch.column("doc_id").take(pa.array(rows)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return work

    return map_texts(text_or_empty(docs, "doc_id"), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def best_fit(tokens: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float],
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each item, the largest items first.

    An item asks for (tokens, one document, tokens squared as attention cost),
    each as a share of its capacity. Among open bins that have room in every
    dimension, ``norm`` takes the one whose weighted residual is left smallest,
    ``dot`` the one whose residual has the largest weighted dot-product with
    the item; equal scores go to the older bin; none open: a new bin.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    cap = np.asarray(capacity, dtype=float)
    need = np.stack([tokens, np.ones(len(tokens)), tokens.astype(float) ** 2])
    if (need > cap[:, None]).any():
        raise ValueError("an item is larger than a sequence may be")
    bins, offsets = np.empty(len(tokens), dtype=np.int64), np.empty(len(tokens), dtype=np.int64)
    order = np.argsort(-tokens, kind="stable")
    scale = np.asarray(weights, dtype=float) / cap**2
    room, label = np.empty((3, 256)), np.empty(256, dtype=np.int64)  # of the bins in use, oldest first: the first ``used``
    used = made = closed = 0
    for k in order:
        item = need[:, k]
        open_ = room[:, :used]
        fits = np.flatnonzero((open_[0] >= item[0]) & (open_[1] >= item[1]) & (open_[2] >= item[2]))
        if len(fits):
            left = open_[:, fits]
            score = -(scale @ (left - item[:, None]) ** 2) if rule == "norm" else (item * scale) @ left
            at = fits[int(score.argmax())]
        else:
            if used == len(label):
                room, label = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([label, np.empty_like(label)])
            room[:, used], label[used] = cap, made
            at, used, made = used, used + 1, made + 1
        bins[k], offsets[k] = label[at], int(cap[0] - room[0, at])
        room[:, at] -= item
        if (room[:, at] < need[:, order[-1]]).any():  # not even the smallest item fits any more: close it
            room[:, at], closed = -1, closed + 1
            if closed > 64 and 2 * closed > used:
                still = np.flatnonzero(room[0, :used] >= 0)
                room[:, :len(still)], label[:len(still)] = room[:, still], label[still]
                used, closed = len(still), 0
    return bins, offsets


def pack_documents(docs: DataFrame, max_tokens: int = 1024, max_docs: int = 1024, max_attention: int | None = None,
                   weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", end_id: int = 2,
                   path: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    A sequence holds at most ``max_tokens`` tokens, ``max_docs`` pieces and
    ``max_attention`` of summed squared lengths (by default what one full piece
    costs, so that it never binds alone). Pieces that fill a sequence get one
    each; the rest is dealt at random into groups of about ``group`` pieces,
    each packed by one task.

    A null or empty text is the one token ``end_id``; repeated rows are packed
    each; null doc_ids are kept; an empty table gives an empty result; other
    columns are ignored.
    """
    spark, path = docs.sparkSession, path or tokenizer_path("byte_bpe_50k.json")
    max_attention = max_attention or max_tokens**2
    pieces = document_pieces(docs, max_tokens, end_id, path).withColumn("at", F.monotonically_increasing_id())
    pieces = stage(spark, pieces, "pack-pieces", batch_rows=TEXT_ROWS)
    full = pieces.where(F.col("length") == max_tokens).select("*", (-F.col("at") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < max_tokens)
    groups = max(1, math.ceil(part.count() / group))

    def pack(key: tuple, pieces: pa.Table) -> pa.Table:
        bins, offsets = best_fit(pieces.column("length").to_numpy(), (max_tokens, max_docs, max_attention), weights, rule)
        sequences = pa.array(key[0].as_py() * (1 << 32) + bins)
        return pieces.drop_columns("group").append_column("sequence_id", sequences).append_column("offset", pa.array(offsets))

    dealt = part.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, at long, sequence_id long, offset long"
    return full.unionByName(dealt.groupBy("group").applyInArrow(pack, schema)).drop("at")
