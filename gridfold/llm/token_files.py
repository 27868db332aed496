"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A written folder holds three Parquet tables, whose commit protocol makes a
lost task harmless: ``code`` (id, bits), the code lengths from which the canonical
code follows; ``blocks``, one self-contained block of whole documents a row;
and ``parts``, where each part's ids begin in the order of all. A block is

    b"IDB1" | documents u32 | step u32 | padding u32 | stream bytes u64
    | doc_ids i64 each | null flags u8 each | ids per document u64 each
    | bits of every ``step`` ids u16 each (the checkpoints) | stream | crc32 u32

little-endian, the bits of the stream from the highest of each byte down. A reader
adds up checkpoints to start anywhere in the stream, and decodes all runs
between checkpoints side by side, one table look-up an id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridfold.llm.common import TEXT_ROWS, map_texts, text_or_empty, tokenizer_path
from gridfold.llm.words import SLICE, LibraryTokenizer, Remembered, split_words
from gridfold.session import scratch_path, ship_package, stage

MAGIC = b"IDB1"
HEAD = struct.Struct("<4sIIIQ")
#: Longest code; ids a block holds at least (of whole documents); ids between checkpoints.
MAX_BITS, BLOCK_IDS, STEP = 18, 1 << 16, 64


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most ``max_bits``, by
    package-merge. ``counts`` are positive."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    if n < 2:
        return np.ones(n, np.uint8)
    order = np.argsort(counts, kind="stable")
    single = counts[order].astype(np.float64) if counts.sum() > 1 << 62 else counts[order].astype(np.int64)
    merged, singles = single, []  # per level: how many of its first items are single symbols
    for level in range(max_bits):
        if level:
            even = len(merged) // 2 * 2
            items = np.concatenate([single, merged[0:even:2] + merged[1:even:2]])
            place = np.argsort(items, kind="stable")
            merged, is_single = items[place], place < n
        else:
            is_single = np.ones(n, bool)
        singles.append(np.concatenate([[0], np.cumsum(is_single)]))
    bits, take = np.zeros(n, np.uint8), 2 * n - 2
    for before in reversed(singles):
        bits[:before[take]] += 1
        take = 2 * (take - int(before[take]))
        if not take:
            break
    out = np.empty(n, np.uint8)
    out[order] = bits
    return out


@dataclass
class Code:
    """The canonical code of ``ids`` (ascending) with their ``bits``: codes go up
    by length, then by id. Plain arrays, small enough to send with a task."""

    ids: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        self.longest = int(self.bits.max(initial=1))
        self.order = np.lexsort((self.ids, self.bits))
        room = np.int64(1) << (self.longest - self.bits[self.order].astype(np.int64))  # places in a table of the longest code
        first = np.cumsum(room) - room
        self.codes = np.empty(len(self.ids), np.int64)
        self.codes[self.order] = first >> (self.longest - self.bits[self.order].astype(np.int64))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, bits) for every next ``longest`` bits."""
        room = np.int64(1) << (self.longest - self.bits[self.order].astype(np.int64))
        ids, bits = np.repeat(self.ids[self.order], room), np.repeat(self.bits[self.order], room)
        return np.resize(ids, 1 << self.longest).astype(np.uint32), np.resize(bits, 1 << self.longest).astype(np.uint8)

    @cached_property
    def place(self) -> np.ndarray:
        """Where each id is among ``ids``."""
        out = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The stream of ``ids`` and the bits of each id."""
        at = self.place[ids]
        bits = self.bits[at].astype(np.int64)
        ends = np.cumsum(bits)
        starts = ends - bits
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros(total // 32 + 2, np.uint64)
        # a code lies in one 32-bit word or in two neighbours: place it in both halves of 64 bits
        both = (self.codes[at] << (64 - bits - (starts & 31))).astype(np.uint64)
        word = starts >> 5
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        if len(runs):
            both = np.bitwise_or.reduceat(both, runs)
            words[word[runs]] |= both >> np.uint64(32)
            words[word[runs] + 1] |= both & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[:(total + 7) // 8], bits


def pack_block(code: Code, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, step: int = STEP) -> bytes:
    """One block: documents, in order, of ``sizes`` ids each."""
    stream, bits = code.pack(ids)
    marks = np.add.reduceat(bits, np.arange(0, len(ids), step)).astype("<u2") if len(ids) else np.empty(0, "<u2")
    body = b"".join((
        HEAD.pack(MAGIC, len(doc_ids), step, 0, len(stream)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(sizes, "<u8").tobytes(), marks.tobytes(), stream))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block's documents, and its ids from any place on."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("damaged block")
        magic, n, self.step, _, stream = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = HEAD.size
        ids, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        null, at = np.frombuffer(data, "u1", n, at), at + n
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.sizes, at = np.frombuffer(data, "<u8", n, at).astype(np.int64), at + 8 * n
        self.total = int(self.sizes.sum())
        runs = -(-self.total // self.step)
        self.marks, at = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u2", runs, at), dtype=np.int64)]), at + 2 * runs
        self.stream = data[at:at + stream]

    def ids(self, table: tuple[np.ndarray, np.ndarray], longest: int, first: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` ids from number ``first`` on; only the runs between
        checkpoints that hold them are decoded."""
        last = self.total if count is None else min(self.total, first + count)
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // self.step, -(-last // self.step)
        base = int(self.marks[a]) // 8
        part = self.stream[base:-(-int(self.marks[b]) // 8)] + bytes(self.step * longest // 8 + 8)
        octets = np.frombuffer(part, "u1").astype(np.uint32)
        next32 = (octets[:-3] << 24) | (octets[1:-2] << 16) | (octets[2:-1] << 8) | octets[3:]
        place = self.marks[a:b] - 8 * base
        of, bits = table
        out = np.empty((self.step, b - a), np.uint32)
        steps = self.step if b - a > 1 else last - a * self.step
        for k in range(steps):  # the k-th id of every run at once; past the last id it reads padding
            window = (next32[np.minimum(place >> 3, len(next32) - 1)] >> (32 - longest - (place & 7)).astype(np.uint32)) & np.uint32((1 << longest) - 1)
            out[k] = of[window]
            place = place + bits[window]
        return out.T.reshape(-1)[first - a * self.step:last - a * self.step]


# ------------------------------------------------------------------- on Spark

def id_type(path: str, end_id: int) -> str:
    """How a vocabulary's ids are held before they are coded: in 2 bytes if they fit."""
    largest = max(LibraryTokenizer(path).tokenizer.get_vocab().values())
    return "<u2" if max(largest, end_id) < 1 << 16 else "<u4"


def encode_ids(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, ids (with ``end_id`` at the end, as numbers of type ``kind``) and
    ``same``, equal for equal texts, per row."""

    def make():
        tokenizer = LibraryTokenizer(path)
        encode = Remembered(tokenizer)

        def work(batch):
            words = split_words(batch.column("text"), tokenizer.found)
            got = encode(words.distinct).take(words.codes).merge(words.starts)
            flat = np.insert(got.flat, got.starts[1:], end_id).astype(kind)
            ends = ((got.starts + np.arange(len(got.starts))) * flat.itemsize).astype(np.int32)
            rows = pa.array(words.rows)
            ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            return {"doc_id": batch.column("doc_id").take(rows), "same": batch.column("same").take(rows), "ids": ids}

        return work

    texts = text_or_empty(docs, "doc_id").withColumn("same", F.xxhash64("text"))
    return map_texts(texts, "doc_id long, same long, ids binary", make, 2 * SLICE)


def id_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, count) over all documents, counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            each = np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]))
            total = np.pad(total, (0, max(0, len(each) - len(total))))
            total[:len(each)] += each
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "count"])

    return encoded.select("ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_ids(encoded: DataFrame, path: str, kind: str, max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS, step: int = STEP) -> None:
    """Write documents (doc_id, ids of type ``kind``, and what orders rows of one
    doc_id: same, at) into the folder ``path``, in ascending doc_id order, null doc_ids first.

    Code lengths follow from the counts of ids over all documents. Rows are
    ranged over tasks, each of which writes blocks of at least ``block_ids`` ids
    (its last may be smaller), a longer document as one block.
    """
    if step * max_bits > 0xFFFF or not 1 <= max_bits <= 25:
        raise ValueError("a checkpoint counts up to 65,535 bits, a code has up to 25")
    spark = encoded.sparkSession
    ship_package(spark)
    counts = id_counts(encoded, kind).toPandas().sort_values("id")  # a row per id of the vocabulary
    bits = code_lengths(counts["count"].to_numpy(np.int64), max_bits)
    code = Code(counts["id"].to_numpy(np.int64), bits)
    spark.createDataFrame(list(zip(code.ids.tolist(), bits.tolist())), "id int, bits int").coalesce(1).write.parquet(f"{path}/code")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, flats, held, part, block, before = [], [], 0, None, 0, 0

        def out():
            nonlocal doc_ids, flats, held, block, before
            ids = np.concatenate(flats)
            data = pack_block(code, doc_ids, [len(f) for f in flats], ids, step)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                                              pa.array([data], pa.binary())], names=["part", "block", "start", "n_ids", "data"])
            doc_ids, flats, held, block, before = [], [], 0, block + 1, before + len(ids)
            return row

        for batch in batches:
            for doc_id, p, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids")):
                part = p
                doc_ids.append(doc_id)
                flats.append(np.frombuffer(ids.as_buffer(), kind))
                held += len(flats[-1])
                if held >= block_ids:
                    yield out()
        if doc_ids:
            yield out()

    order = ["doc_id", "same", "at"]
    placed = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.spark_partition_id().alias("part"), "ids")
    placed.mapInArrow(pack, "part int, block int, start long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect()  # a row per task
    ends = np.cumsum([r["n_ids"] for r in sizes]).tolist()
    parts = [(r["part"], e - r["n_ids"], r["n_ids"]) for r, e in zip(sizes, ends)]
    spark.createDataFrame(parts, "part int, start long, n_ids long").coalesce(1).write.parquet(f"{path}/parts")


def read_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.parquet(f"{path}/code").orderBy("id").collect()
    return Code(np.array([r["id"] for r in rows], np.int64), np.array([r["bits"] for r in rows], np.uint8))


def _located(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the ids of all blocks before them."""
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start"))
    return spark.read.parquet(f"{path}/blocks").join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("start")).alias("start"), "n_ids", "data")


def read_documents(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``) of each document of the folder."""
    ship_package(spark)
    code = read_code(spark, path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code.table()
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                block = Block(data.as_py())
                ids = block.ids(table, code.longest).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(block.sizes)])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                cols = [pa.array(block.doc_ids, pa.int64()), pa.array(start + cuts[:-1]), pa.array(block.sizes), pa.array(crcs, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    return _located(spark, path).select("start", "data").mapInArrow(unpack, schema)


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(at, ids): ``count`` ids from number ``first`` on in the order of the whole
    folder, a row per block that holds some, decoded from the checkpoint before them."""
    ship_package(spark)
    code = read_code(spark, path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code.table()
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                skip = max(0, first - start)
                ids = Block(data.as_py()).ids(table, code.longest, skip, first + count - start - skip)
                yield pa.RecordBatch.from_arrays([pa.array([start + skip]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["at", "ids"])

    held = _located(spark, path).where((F.col("start") < first + count) & (F.col("start") + F.col("n_ids") > first))
    return held.select("start", "data").mapInArrow(unpack, "at long, ids array<long>")


def token_file_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per row of ``docs``, read back from the
    files written to ``folder`` (default: a new one in the shared folder).

    A null or empty text is the one id ``end_id``. Documents lie in ascending
    doc_id order, null doc_ids first; rows that share a doc_id by a hash of
    their text, so equal rows are interchangeable. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    kind = id_type(path, end_id)
    encoded = encode_ids(docs, path, end_id, kind).withColumn("at", F.monotonically_increasing_id())
    folder = folder or scratch_path(spark, "token-files")
    write_ids(stage(spark, encoded, "token-ids", batch_rows=2 * TEXT_ROWS), folder, kind)
    return read_documents(spark, folder)
