"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridfold.llm.words import SLICE, slices
from gridfold.session import ship_package

#: Rows with whole texts that reach a Python task at once.
TEXT_ROWS = 2048
#: Bits that a bitmap has for each key, so that few other rows pass; and the most it has.
BITS, MOST_BITS = 16, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; after each batch that it gives, and when it ends,
    what it no longer holds goes back to the system: allocators would keep it,
    and the Python worker stays and goes on with other tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            release()
        release()

    return task


def release() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than GNU's has no such call
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``most`` bytes of the text in column ``at``, or of one row."""
    for batch in batches:
        for a, b in slices(batch.column(at), most):
            yield batch.slice(a, b - a)


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Arrow batches of ``df`` through ``make()``, called once per task.

    The function it returns takes one Python list per column of ``df`` (nulls
    as None) and returns a dict of lists, one per column of ``schema``.
    """
    ship_package(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.fieldNames()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(out), make()
        for batch in batches:
            if batch.num_rows:
                got = work(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[n], f.type) for n, f in zip(names, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], most: int = SLICE) -> DataFrame:
    """Arrow batches of ``df``, which has a column ``text``, in slices of ``most``
    bytes through ``make()``, called once per task. The function it returns takes
    a slice and returns a dict of Arrow arrays or lists, one per column of ``schema``."""
    ship_package(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    at = df.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(out), make()
        for batch in sliced(batches, at, most):
            got = work(batch)
            cols = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def bitmap(keys: DataFrame) -> Column:
    """A bitmap, of one row that plans refer to, with the bit of each hash in column
    ``key`` set. It spares rows a shuffle and decides nothing. Its size follows the
    number of keys (read twice: pass a written table), up to 32 MiB."""
    size = max(1 << 15, min(MOST_BITS, 1 << (BITS * keys.count()).bit_length()))
    bit = F.pmod("key", F.lit(size))
    out, run = bytearray(size // 8), 1 << 15  # bits that travel to the driver in one row
    parts = keys.groupBy(F.floor(bit / run).alias("at")).agg(F.bitmap_construct_agg(bit % run))
    for at, part in parts.toLocalIterator():  # at most size / run rows
        out[at * run // 8:(at + 1) * run // 8] = part
    return keys.sparkSession.createDataFrame([(out,)], "bits binary").scalar()


def in_bitmap(bits: Column, key: Column) -> Column:
    """Whether the bit of ``key`` is set: always so for the keys it was made of."""
    bit = F.pmod(key, 8 * F.length(bits).cast("long"))
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def join_by_weight(left: DataFrame, right: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """``left`` joined to ``right``, which has one row per ``key`` and how many
    rows of ``left`` have it, about, as ``weight``. The heaviest keys, at most ``most`` of
    them, are broadcast, so no hot key is shuffled; all others are joined by a
    shuffle. ``right`` is read more than once: pass a written table."""
    level = F.length(F.bin(weight))
    sizes = right.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    taken, floor = 0, None
    for row in sizes:
        taken += row["count"]
        if taken > most:
            break
        floor = 1 << (row["level"] - 1)
    if floor is None:  # no key is hot: the heaviest level alone has more keys than that
        return left.join(right, key)
    heavy, light = right.where(F.col(weight) >= floor), right.where(F.col(weight) < floor)
    hot = left.join(F.broadcast(heavy), key)
    if taken <= most:
        return hot
    return hot.unionByName(left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


class Memo(dict):
    """Word -> value, filled by ``make`` and held to ``limit`` entries: the
    frequent words come early and stay, later rare ones are worked out again."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


def text_or_empty(df: DataFrame, *keys: str):
    """``keys`` and the whole text, a null text as the empty one."""
    return df.select(*keys, F.coalesce("text", F.lit("")).alias("text"))


def rewrite_text(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """``docs`` with every column as it is, but for the text that ``make()``'s
    function returns and ``n_chars`` (where there is one) after it. A text it
    leaves alone stays as it was, null included."""
    ship_package(docs.sparkSession)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches, at):
            old = batch.column(at).to_pylist()
            new = [n if o is not None else None for o, n in zip(old, work([t or "" for t in old]))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if chars is not None:
                was = columns[chars].to_pylist()
                columns[chars] = pa.array([w if o == n else len(n) for o, n, w in zip(old, new, was)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def filter_text(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """Rows of ``docs``, with every column, for whose text (null: empty) the
    function from ``make()`` returns true."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches, at):
            keep = work([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
