"""M1/S5 sink: batches in hash buckets, replaced by copy on write under snapshots.

A store is a folder in any file system that Spark writes to:

    data/<write>/bucket=N/*.parquet    rows of the buckets that one write touched
    summary/<write>/bucket=N/*.parquet the same rows counted by batch key and summary columns
    ledger/<write>/*.parquet           ledger rows of one write (operators.ledger)
    snapshots/<version>.json           what makes up that version: a folder a bucket, ledger folders

Replacing batches rewrites the buckets that hold them to a new folder and
leaves all others where they are. The write takes effect when its snapshot file is
renamed into place; until then, and if the run dies, readers see the version
before, whole. A rename never replaces a file, so of two writers that started from one
version the second finds it taken: it goes on from the new version if that left
its buckets alone, and fails with :class:`StoreConflict` if not.

The summary of a bucket is written with its rows and found by the same folder name, so
one commit swaps both: reports by batch, period and file add up its counts (A1/A2),
and a file's rows are found without opening other buckets (P17).

The driver handles one entry per bucket and ledger write, never one per batch or row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.schema import FACT_SCHEMA
from gridfold.session import stage

BUCKETS = 64
#: Columns that rows are counted by, beside the batch key, where a schema has them.
SUMMARY = ("source_file", "period_type", "year", "is_estimate")
#: Ledger folders of a snapshot beyond which a write merges them into one.
LEDGER_FOLDERS = 32


class StoreConflict(RuntimeError):
    """Another writer changed a bucket or the ledger that this write started from."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    key: str
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)  # bucket -> folder under the root; absent: no row
    rows: dict[int, int] = field(default_factory=dict)
    ledger: tuple[str, ...] = ()
    schema: str = ""
    action: str = ""
    summary: tuple[str, ...] = ()

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Snapshot":
        d = json.loads(text)
        return Snapshot(**{**d, "folders": {int(k): v for k, v in d["folders"].items()},
                           "rows": {int(k): v for k, v in d["rows"].items()}, "ledger": tuple(d["ledger"]), "summary": tuple(d["summary"])})


class FactStore:
    """Rows by batch key. ``schema``, ``key``, ``buckets`` and ``summary`` (the columns to
    count rows by; None: those of SUMMARY that the schema has) count when the store
    is made; afterwards its first snapshot says what they are."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = FACT_SCHEMA, key: str = "batch_key", buckets: int = BUCKETS,
                 summary: Sequence[str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        if self._newest() is None:
            try:
                by = [c for c in SUMMARY if c in schema.names and c != key] if summary is None else summary
                self._commit(Snapshot(0, key, buckets, schema=schema.json(), action="create", summary=tuple(schema[c].name for c in by)))
            except FileExistsError:
                pass  # made by another session meanwhile
        first = self.snapshot()
        self.key, self.buckets, self.schema = first.key, first.buckets, T.StructType.fromJson(json.loads(first.schema))
        self._by = T.StructType([self.schema[c] for c in (first.key, *first.summary)])

    # ------------------------------------------------------------ snapshots
    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> int | None:
        fs, folder = self._files(), self._path("snapshots")
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=None)

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self._newest() if version is None else version
        stream = self._files().open(self._path(f"snapshots/{version:012d}.json"))
        try:
            return Snapshot.from_json(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, snapshot: Snapshot) -> None:
        """Write the snapshot beside its place and move it there, unless taken."""
        fs, part = self._files(), self._path(f"snapshots/{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        try:
            out.write(bytearray(snapshot.to_json().encode()))
        finally:
            out.close()
        place = self._path(f"snapshots/{snapshot.version:012d}.json")
        context = self._hadoop.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)  # no option: never replace a file
        try:
            context.rename(part, place, none)
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(str(place)) from None
            raise

    # -------------------------------------------------------------- reading
    def bucket_of(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def _read(self, snapshot: Snapshot, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = snapshot.folders if buckets is None else {b: snapshot.folders[b] for b in buckets if b in snapshot.folders}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{p}" for _, p in sorted(wanted.items())))

    def _summary(self, folders: dict[int, str]) -> DataFrame:
        schema = T.StructType([*self._by.fields, T.StructField("row_count", T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p.replace('data/', 'summary/', 1)}" for _, p in sorted(folders.items())))

    def summary(self, version: int | None = None) -> DataFrame:
        """Rows of a version by batch key and summary columns (``row_count``). It is
        kept up by every write, so no fact is read."""
        return self._summary(self.snapshot(version).folders)

    def read(self, keys: Iterable[str | None] | None = None, version: int | None = None, files: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version (default: the newest). ``keys``, a few batch
        keys, and ``files``, a few values of ``source_file``, restrict it to their
        rows: only the buckets that hold them are opened."""
        snapshot, buckets, some = self.snapshot(version), None, F.lit(True)
        if keys is not None:
            keys = list(keys)
            of = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
            buckets = {r[0] for r in of.select(self.bucket_of()).distinct().collect()}
            named = F.coalesce(F.col(self.key).isin([k for k in keys if k is not None]), F.lit(False))
            some = named | (F.col(self.key).isNull() if None in keys else F.lit(False))
        if files is not None:
            from_files = F.col("source_file").isin(list(files))
            held = self._summary(snapshot.folders).where(from_files) if "source_file" in self._by.names else None
            if held is not None:
                holding = {r[0] for r in held.select(self.bucket_of()).distinct().collect()}  # at most one per bucket
                buckets = holding if buckets is None else buckets & holding
            some = some & from_files
        return self._read(snapshot, buckets).where(some)

    def ledger(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        folders = self.snapshot(version).ledger
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in folders))

    # -------------------------------------------------------------- writing
    def replace(self, incoming: DataFrame, keys: DataFrame, ledger: DataFrame | None = None, action: str = "replace",
                base: Snapshot | None = None) -> int:
        """Replace the batches named in ``keys``, a frame with the key column, by the
        rows of ``incoming``; a key that gets no row is emptied. ``incoming`` must
        not hold other keys. ``ledger`` rows are committed with it. Returns
        the rows written for the replaced batches. Repeating a call leaves the same rows.
        ``base``: the snapshot that ``incoming`` was made from, if it was; a bucket
        that changed since is a :class:`StoreConflict`.

        Hot batches are split over tasks by REBALANCE, so a bucket is a folder of
        well-sized files, not one task's work."""
        base = base or self.snapshot()
        names = [f.name for f in self.schema.fields]
        keyed = stage(self.spark, keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias("_key")).distinct(), "store-keys")
        touched = {r[0] for r in keyed.select(self.bucket_of("_key")).distinct().collect()}
        new = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        kept = self._read(base, touched)
        kept = kept.join(keyed, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        write = uuid.uuid4().hex
        rows = kept.select(names).unionByName(new).withColumn("bucket", self.bucket_of())
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{write}")
        counts = self._summarise(write)
        if not set(counts) <= touched:
            raise ValueError("incoming rows belong to batches that are not named in keys")
        folders = {b: f"data/{write}/bucket={b}" for b in counts}
        self._finish(base, touched, folders, counts, self._write_ledger(ledger, write), action)
        written = self._summary(folders).join(keyed, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
        return written.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]

    def remove(self, keys: DataFrame, ledger: DataFrame | None = None) -> None:
        """M2: empty the batches named in ``keys``."""
        self.replace(self.spark.createDataFrame([], self.schema), keys, ledger, "remove")

    def note(self, ledger: DataFrame) -> None:
        """Commit ledger rows alone."""
        self._finish(self.snapshot(), set(), {}, {}, self._write_ledger(ledger, uuid.uuid4().hex), "note")

    def _summarise(self, write: str) -> dict[int, int]:
        """Count the rows of a write by key and summary columns and write that beside
        them, a folder per bucket; returns the rows per bucket."""
        place, bucket = f"{self.root}/data/{write}", T.StructField("bucket", T.IntegerType())
        if not any("=" in s.getPath().getName() for s in self._files().listStatus(self._path(f"data/{write}"))):
            return {}
        rows = self.spark.read.schema(T.StructType([*self._by.fields, bucket])).parquet(place)
        part = rows.groupBy("bucket", *self._by.names).agg(F.count(F.lit(1)).alias("row_count"))
        part.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/summary/{write}")
        found = self.spark.read.schema(T.StructType([T.StructField("row_count", T.LongType()), bucket])).parquet(f"{self.root}/summary/{write}")
        return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("row_count").alias("n")).collect()}

    def _write_ledger(self, ledger: DataFrame | None, write: str) -> tuple[str, ...]:
        if ledger is None:
            return ()
        ledger.write.parquet(f"{self.root}/ledger/{write}")
        return (f"ledger/{write}",)

    def _finish(self, base: Snapshot, touched: set[int], folders: dict[int, str], counts: dict[int, int], ledger: tuple[str, ...], action: str) -> None:
        now = base
        while True:
            all_ledger = now.ledger + ledger
            if ledger and len(all_ledger) > LEDGER_FOLDERS:
                merged = f"ledger/{uuid.uuid4().hex}"
                self.spark.read.parquet(*(f"{self.root}/{p}" for p in all_ledger)).coalesce(8).write.parquet(f"{self.root}/{merged}")
                all_ledger = (merged,)
            after = changed(
                now, version=now.version + 1, ledger=all_ledger, action=action,
                folders={b: p for b, p in now.folders.items() if b not in touched} | folders,
                rows={b: n for b, n in now.rows.items() if b not in touched} | counts)
            try:
                return self._commit(after)
            except FileExistsError:
                now = self.snapshot()
                moved = {b for b in touched if now.folders.get(b) != base.folders.get(b)}
                if moved or (ledger and now.ledger != base.ledger):
                    raise StoreConflict(f"version {now.version} changed what this write started from (version {base.version})") from None

    def expire(self, keep: int = 10) -> list[str]:
        """Drop all but the newest ``keep`` snapshots, and the folders that none of
        those uses. Not beside a running write: its folders are not in use yet."""
        newest = self._newest()
        first = max(0, newest - keep + 1)
        fs, gone = self._files(), []
        used: set[str] = set()
        for v in range(first, newest + 1):
            s = self.snapshot(v)
            used |= {p.split("/")[1] for p in (*s.folders.values(), *s.ledger)}
        for s in fs.listStatus(self._path("snapshots")):
            name = s.getPath().getName()
            if not name.endswith(".json") or int(name[:-5]) < first:
                fs.delete(s.getPath(), False)
                gone.append(f"snapshots/{name}")
        for kind in ("data", "summary", "ledger"):
            if fs.exists(self._path(kind)):
                for s in fs.listStatus(self._path(kind)):
                    if s.getPath().getName() not in used:
                        fs.delete(s.getPath(), True)
                        gone.append(f"{kind}/{s.getPath().getName()}")
        return gone
