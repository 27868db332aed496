"""Registered queries: every operator exercised on the driver's tables.

Each query builds its input from the tables (or from data Spark derives from
them) and returns a lazy DataFrame, except where an input must first be
staged (derived grids, written workbooks). Its DuckDB twin in
:mod:`gridfold.plans.oracles` computes the same answer straight from the base
tables by another route.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.names import unique_name, uploader
from gridfold.operators.batches import batch_counts, remove_batches, replace_batches, replaced_keys, winning_files
from gridfold.operators.checks import GroupCheck, RowCheck, batch_key_dated
from gridfold.operators.checks import check_report as check_set_report
from gridfold.operators.ledger import LEDGER_SCHEMA, ledger_report, pending
from gridfold.operators.quality import check_batch_key, check_scope, check_totals, key_report, run_checks
from gridfold.operators.report import period_summary, stored_batches, stored_period_summary
from gridfold.operators.runs import latest_attempts, run_outcomes
from gridfold.operators.shape import (
    band_rows,
    batch_keys,
    classify_headers,
    data_versions,
    file_plan,
    header_cells,
    wide_unpivot,
)
from gridfold.plans.grids import WIDE_LAYOUT, Grid, derived_grid, period_header
from gridfold.plans.ingest import Ingest, build_ingest
from gridfold.plans.ledger_ingest import apply_with_ledger, remove_from_store
from gridfold.session import scratch_path, spread, stage
from gridfold.sources.landing import guard_new_names, log_landings, newest_file, recent_landings
from gridfold.sources.latest import LatestLandings
from gridfold.sources.store import FactStore
from gridfold.sources.workbook import Scan

# ---------------------------------------------------------------------------
# Fixed values used to derive query inputs.
# ---------------------------------------------------------------------------
NEWEST_EXTS = (".xlsx", ".XLS", ".csv", ".Xlsx")
HEADER_VARIANTS = (
    "Q5 2026", "FY2000", "q1 2001", "Q2　2001　預估", " Q3 2001 ", "FY 2001 預估",
    "Q4 2001 預估 extra", "季度 (單位)", "Q1 2001", "Q1 2001",
)
NO_METRIC_FILE, NO_ESTIMATE_FILE = "AFRICA.xlsx", "AMERICA.xlsx"
BAD_DATE_FILES, BAD_DATE_SHEET = ("ASIA.xlsx", "EUROPE.xlsx"), "BLB_260231"
UNREADABLE_FILE, UNREADABLE_ERROR = "EUROPE.xlsx", "unreadable workbook: test"
TWO_FILE_YEARS, EMPTY_FILE_YEAR, BAD_FILE_YEAR = ("Y1996", "Y1998"), "Y2000", "Y1997"
REMOVED_BATCH = "Y1997"
REMOVED_DAYS, RETAKEN_DAY, RECOUNTED_DAY = "10", "05", "15"
LEAST_VALUE, TOP_VALUE = 5000, 300000
UNLOGGED_REGION, UNASSIGNED_FILE = "MIDDLE EAST", "unassigned"
EMPTY_SCOPE = "no_such_file.xlsx"
RUN_STATES = ("PENDING", "QUEUED", "BLOCKED", "RUNNING", "TERMINATING", "TERMINATED",
              "INTERNAL_ERROR", "SKIPPED", "WAITING")
TASK_STATES = ("TERMINATED", "RUNNING", "PENDING", "INTERNAL_ERROR")
OVERFLOW_TEXT = "9" * 32
# ---------------------------------------------------------------------------

_GRIDS: dict[tuple, Grid] = {}


# Row-heavy inputs: spread over the task slots when they arrive in fewer
# partitions (a one-row-group file scans as one task); no-op on large inputs.
HEAVY_TABLES = ("orders", "lineitem", "events", "documents")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return spread(df) if name in HEAVY_TABLES else df


def _grid(spark: SparkSession, sf: str, by: str = "region", variant: str = "") -> Grid:
    """Derived grid, staged once per session and parameter set."""
    key = (spark.sparkContext.applicationId, sf, by, variant)
    if key not in _GRIDS:
        est = (lambda k: (F.lit(1996) + k, F.lit(1) + k % 4)) if variant == "est_by_key" else None
        _GRIDS[key] = derived_grid(spark, sf, by, est_start=est)
    return _GRIDS[key]


def _ingest(spark: SparkSession, sf: str, by: str = "region", log: DataFrame | None = None) -> Ingest:
    g = _grid(spark, sf, by)
    return build_ingest(g.grid, g.files, log, WIDE_LAYOUT, materialize=True)


# --- S1/S2/P16 ---------------------------------------------------------------
def q_newest_file(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events").select("event_id", "ts")
    ext = F.element_at(F.array(*[F.lit(e) for e in NEWEST_EXTS]), (F.col("event_id") % 4 + 1).cast("int"))
    files = ev.select(
        F.concat(F.lit("upload_"), F.col("event_id").cast("string"), ext).alias("file_name"),
        F.col("ts").alias("modificationTime"), "event_id",
    )
    return newest_file(files, tie_col="event_id").select(
        "file_name", F.col("modificationTime").alias("modified_at"))


# --- S7/F5/F13 ---------------------------------------------------------------
def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    eid, uid = F.col("event_id"), F.col("user_id").cast("string")
    email = F.when(eid % 5 == 0, F.lit(None)).when(eid % 5 == 1, F.lit("")).otherwise(
        F.concat(F.lit("user"), uid, F.lit("@example.com")))
    pref = F.when(eid % 7 == 0, F.lit(None)).when(eid % 7 <= 2, F.lit("")).otherwise(F.concat(F.lit("pref."), uid))
    hdr = F.when(eid % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("hdr "), F.col("event_type")))
    name = F.concat(F.col("event_type"), F.lit(" report #"), eid.cast("string"),
                    F.when(eid % 2 == 0, F.lit(".XLSX")).otherwise(F.lit(".xls")))
    return ev.select(name.alias("original_name"), (eid * 1000 + F.col("user_id")).alias("size"),
                     uploader(email, pref, hdr).alias("user"), "ts")


def q_landing_log(spark: SparkSession, sf: str) -> DataFrame:
    up = _uploads(spark, sf)
    return log_landings(up, "original_name", "size", F.col("user"), now=F.col("ts"))


# --- F1-F3/S8 ----------------------------------------------------------------
def q_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "text", "source")
    ext = F.when(F.col("doc_id") % 3 == 0, F.lit(".Xlsx")).when(F.col("doc_id") % 3 == 1, F.lit(".xls")).otherwise(
        F.lit(".docx"))
    # every fifth upload comes at one time, so copies of a text collide within the call
    shift = F.when(F.col("doc_id") % 5 == 0, F.lit(0)).otherwise(F.col("doc_id"))
    ts = F.timestamp_add("SECOND", shift, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    d = d.withColumn("ts", ts)
    incoming = d.select("doc_id", F.concat("text", ext).alias("original_name"), "source", "ts").select(
        "doc_id", "original_name", unique_name(F.col("original_name"), F.col("source"), F.col("ts")).alias("file_name"))
    later = F.when(F.col("doc_id") % 2 == 0, F.col("ts")).otherwise(F.timestamp_add("DAY", F.lit(1), F.col("ts")))
    landed = d.select(F.concat("text", ext).alias("original_name"), "source", later.alias("ts"), "doc_id").select(
        unique_name(F.col("original_name"), F.col("source"), F.col("ts")).alias("file_name"))
    return guard_new_names(incoming, landed).select("doc_id", "file_name", "error")


# --- S9/L1/F11/F12/F16 -------------------------------------------------------
def landing_log_from_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    eid = F.col("event_id")
    size = (F.when(eid % 10 == 0, F.lit(None))
            .when(eid % 4 == 0, eid % 1000)
            .when(eid % 4 == 1, (eid * 37) % 900000 + 1024)
            .when(eid % 4 == 2, (eid * 7919) % 50000000 + 1048576))
    return ev.select(
        F.concat(F.lit("evt_"), eid.cast("string"), F.lit(".xlsx")).alias("file_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("uploaded_by"),
        size.cast("long").alias("size_bytes"),
        F.when(eid % 3 == 0, F.lit(None)).otherwise(F.lit("landed")).alias("status"),
        F.col("ts").alias("uploaded_at"),
    )


def q_recent_landings(spark: SparkSession, sf: str) -> DataFrame:
    return recent_landings(landing_log_from_events(spark, sf), 10)


# --- P1-P3/F6 ----------------------------------------------------------------
def q_row_band(spark: SparkSession, sf: str) -> DataFrame:
    return band_rows(_grid(spark, sf, "customer").grid, WIDE_LAYOUT)


# --- P5/P7/P11/F7/F8 ---------------------------------------------------------
def q_header_classes(spark: SparkSession, sf: str) -> DataFrame:
    heads = header_cells(_grid(spark, sf, "customer").grid, WIDE_LAYOUT)
    last = heads.groupBy("source_file").agg(F.max("col").alias("last"))
    variants = last.select(
        "source_file", "last", F.posexplode(F.array(*[F.lit(v) for v in HEADER_VARIANTS])).alias("pos", "text")
    ).select("source_file", (F.col("last") + F.col("pos") + 1).cast("int").alias("col"), "text")
    return classify_headers(heads.unionByName(variants), WIDE_LAYOUT)


# --- P6 ----------------------------------------------------------------------
def q_file_errors(spark: SparkSession, sf: str) -> DataFrame:
    g = _grid(spark, sf)
    at_header = F.col("row") == WIDE_LAYOUT.header_row
    grid = g.grid.withColumn(
        "cells",
        F.when(at_header & (F.col("source_file") == NO_METRIC_FILE), F.map_filter("cells", lambda k, v: k != 2))
        .otherwise(F.col("cells")),
    ).withColumn(
        "cells",
        F.when(at_header & F.col("source_file").isin(NO_METRIC_FILE, NO_ESTIMATE_FILE),
               F.transform_values("cells", lambda k, v: F.regexp_replace(v, r"[\s\p{Z}]+預估", "")))
        .otherwise(F.col("cells")),
    )
    files = g.files.withColumn(
        "sheet_name", F.when(F.col("source_file").isin(*BAD_DATE_FILES), F.lit(BAD_DATE_SHEET)).otherwise(F.col("sheet_name"))
    ).withColumn(
        "scan_error", F.when(F.col("source_file") == UNREADABLE_FILE, F.lit(UNREADABLE_ERROR)).otherwise(F.col("scan_error"))
    )
    return file_plan(files, grid, WIDE_LAYOUT).select("source_file", "batch_key", "error")


# --- P8/A5 -------------------------------------------------------------------
def q_data_versions(spark: SparkSession, sf: str) -> DataFrame:
    g = _grid(spark, sf, variant="est_by_key")
    return data_versions(classify_headers(header_cells(g.grid, WIDE_LAYOUT), WIDE_LAYOUT))


# --- P9/F10 ------------------------------------------------------------------
def q_batch_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    digits = (F.when(k % 5 == 0, (k % 100000).cast("string"))
              .when(k % 5 == 1, F.lpad(((k * 7919) % 100000000).cast("string"), 8, "0"))
              .otherwise(F.lpad(((k * 7919) % 1000000).cast("string"), 6, "0")))
    prefix = F.element_at(F.array(F.lit("BLB_"), F.lit("Sheet"), F.lit("X-"), F.lit("")), (k % 4 + 1).cast("int"))
    files = _t(spark, sf, "orders").select(k.cast("string").alias("source_file"), "o_orderkey",
                                           F.concat(prefix, digits).alias("sheet_name"))
    keys = batch_keys(files)
    return files.select("source_file", "o_orderkey", "sheet_name").join(keys, "source_file").select(
        "o_orderkey", "sheet_name", "batch_key", F.col("batch_date").cast("date").alias("batch_date"), "date_ok")


# --- P10-P13/J2 --------------------------------------------------------------
def q_long_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf).incoming


def q_long_facts_bench(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf, by="customer").incoming


# --- P10 wide form -----------------------------------------------------------
def q_wide_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("year"),
        F.quarter("o_orderdate").alias("quarter"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    q = o.groupBy("metric", "year", "quarter").agg(F.sum("price").alias("v")).select(
        "metric", "year", F.col("quarter").alias("qsort"), "v")
    fy = o.groupBy("metric", "year").agg(F.sum("price").alias("v")).select(
        "metric", "year", F.lit(5).alias("qsort"), "v")
    long_in = q.unionByName(fy).select(
        "metric", period_header(F.col("year"), F.col("qsort")).alias("h"), F.col("v").cast("string").alias("text"))
    wide = long_in.groupBy("metric").pivot("h").agg(F.first("text"))
    return wide_unpivot(wide, "metric", [c for c in wide.columns if c != "metric"])


# --- P12/P13/F9 --------------------------------------------------------------
def q_scaled_values(spark: SparkSession, sf: str) -> DataFrame:
    from gridfold.functions.text import scale_value

    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    m = (F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey")) % 10
    dec = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    nine = F.concat((F.col("l_orderkey") % 1000).cast("string"), F.lit("."),
                    F.lpad(((F.col("l_partkey") * 7919 + F.col("l_suppkey")) % 1000000000).cast("string"), 9, "0"))
    text = (F.when(m == 0, dec)
            .when(m == 1, F.lit("n/a"))
            .when(m == 2, F.concat(F.col("l_linenumber").cast("string"), F.lit(".5e2")))
            .when(m == 3, F.concat(F.col("l_linenumber").cast("string"), F.lit(",234")))
            .when(m == 4, F.lit(""))
            .when(m == 5, F.concat(F.lit("  "), dec, F.lit(" ")))
            .when(m == 6, F.lit(OVERFLOW_TEXT))
            .when(m == 7, F.concat(F.lit("-"), dec))
            .when(m == 8, F.lit("abc"))
            .otherwise(nine))
    t = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))
    return t.withColumn("value", scale_value("text")).where(F.col("value").isNotNull())


# --- J1/W1/P14/F17 -----------------------------------------------------------
def landing_log_for_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a landing: of a region's file when user_id mod 7 is a
    region key, else of an unassigned file. One region's landings carry
    another extension, so its workbook has no log record."""
    ev = _t(spark, sf, "events")
    r = _t(spark, sf, "region")
    ext = F.when(F.col("r_name") == UNLOGGED_REGION, F.lit(".xls")).otherwise(F.lit(".xlsx"))
    return ev.join(r, (F.col("user_id") % 7) == r.r_regionkey, "left").select(
        F.concat(F.coalesce(F.col("r_name"), F.lit(UNASSIGNED_FILE)), ext).alias("file_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("uploaded_by"),
        F.lit(None).cast("long").alias("size_bytes"),
        F.lit("landed").alias("status"),
        F.col("ts").alias("uploaded_at"),
    )


def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf, log=landing_log_for_regions(spark, sf)).incoming


# --- W3/M1/J3 ----------------------------------------------------------------
def _existing_batches(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("Y"), F.year("o_orderdate").cast("string")).alias("batch_key"),
        "o_orderkey",
        F.lit("old.xlsx").alias("source_file"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
    )


def _replacement(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(existing rows, incoming rows, valid files) of a run that re-delivers some batches."""
    existing = _existing_batches(spark, sf)
    years = existing.select("batch_key").distinct()
    t0 = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    spec = F.array(
        F.struct(F.lit("a").alias("tag"), t0.alias("ts"), F.lit("even").alias("pick"), F.lit(None).cast("string").alias("error")),
        F.struct(F.lit("b").alias("tag"), F.timestamp_add("DAY", F.lit(1), t0).alias("ts"), F.lit("third").alias("pick"),
                 F.lit(None).cast("string").alias("error")),
    )
    two = years.where(F.col("batch_key").isin(*TWO_FILE_YEARS)).select("batch_key", F.explode(spec).alias("f"))
    empty = years.where(F.col("batch_key") == EMPTY_FILE_YEAR).select(
        "batch_key", F.struct(F.lit("a").alias("tag"), t0.alias("ts"), F.lit("none").alias("pick"),
                              F.lit(None).cast("string").alias("error")).alias("f"))
    bad = years.where(F.col("batch_key") == BAD_FILE_YEAR).select(
        "batch_key", F.struct(F.lit("a").alias("tag"), t0.alias("ts"), F.lit("fifth").alias("pick"),
                              F.lit("unreadable workbook").alias("error")).alias("f"))
    files = two.unionByName(empty).unionByName(bad).select(
        F.concat(F.lit("f_"), F.col("batch_key"), F.lit("_"), F.col("f.tag"), F.lit(".xlsx")).alias("source_file"),
        "batch_key", F.col("f.ts").alias("upload_datetime"), F.col("f.ts").alias("modified_at"),
        F.col("f.pick").alias("pick"), F.col("f.error").alias("error"))
    # each file holds every order of its year, valued differently; the empty
    # file holds none
    bump = {"even": 0, "third": 1, "fifth": 2}
    rows = existing.drop("source_file").join(
        files.where(F.col("pick") != "none").select("source_file", "batch_key", "pick"), "batch_key")
    offset = F.when(F.col("pick") == "even", bump["even"]).when(F.col("pick") == "third", bump["third"]).otherwise(bump["fifth"])
    rows = rows.withColumn("value", (F.col("value") + offset).cast("decimal(18,2)"))
    valid = winning_files(files.where(F.col("error").isNull()))
    winners = valid.where(F.col("is_winner")).select("source_file")
    return existing, rows.join(winners, "source_file", "left_semi").select(*existing.columns), valid


def q_replace_batches(spark: SparkSession, sf: str) -> DataFrame:
    existing, incoming, valid = _replacement(spark, sf)
    return replace_batches(existing, incoming, replaced_keys(valid))


def q_sink_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Written, re-delivered twice (one batch emptied by it), one batch removed, read back."""
    existing, incoming, valid = _replacement(spark, sf)
    store = FactStore(spark, scratch_path(spark, "sink-q"), existing.schema, buckets=16)
    store.replace(existing, existing.select("batch_key"))
    for _ in range(2):
        store.replace(incoming, replaced_keys(valid))
    store.remove(spark.createDataFrame([(REMOVED_BATCH,)], "batch_key string"))
    return store.read()


# --- M2/A6: ledger -------------------------------------------------------------
def q_ledger_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Four steps over the customers' workbooks: all of them; batches of some days
    removed; a run that finds only what failed before; one day's files taken again."""
    g = _grid(spark, sf, "customer")
    files = g.files.withColumn("digest", F.sha2("source_file", 256))
    store = FactStore(spark, scratch_path(spark, "ledger-q"))
    day = F.substring("batch_key", -2, 2)

    def run(taken: DataFrame, name: str, again: bool = False) -> None:
        apply_with_ledger(store, Scan(g.grid, taken), None, WIDE_LAYOUT, again, name, "the grid", raise_on_check=False, raise_on_error=False)

    run(files, "run1")
    remove_from_store(store, store.read().select("batch_key").where(day <= REMOVED_DAYS).distinct(), "remove")
    run(pending(files, store.ledger(LEDGER_SCHEMA)), "run2")
    run(files.where(F.substring("sheet_name", -2, 2) == RETAKEN_DAY), "run3", again=True)
    held = store.read().groupBy("source_file").agg(F.count(F.lit(1)).alias("table_rows"))
    return ledger_report(store.ledger(LEDGER_SCHEMA)).join(held, "source_file", "left").select(
        "source_file", "batch_key", "outcome", "error", "row_count", "entries", F.coalesce("table_rows", F.lit(0)).alias("table_rows"))


# --- M2/A1 -------------------------------------------------------------------
def q_remove_batch(spark: SparkSession, sf: str) -> DataFrame:
    existing = _existing_batches(spark, sf)
    gone = existing.select("batch_key").where(F.col("batch_key") == REMOVED_BATCH).distinct()
    return batch_counts(remove_batches(existing, gone), keys=existing.select("batch_key").distinct())


# --- A2/L2 -------------------------------------------------------------------
def q_period_summary(spark: SparkSession, sf: str) -> DataFrame:
    return period_summary(_ingest(spark, sf, by="customer").incoming)


def _kept_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that a store keeps, after all batches came, those of some days went
    and one day's came again with their whole years only."""
    facts = stage(spark, _ingest(spark, sf, by="customer").incoming, "kept-facts")  # the body pass runs once, for keys and rows
    store, day = FactStore(spark, scratch_path(spark, "summary-q")), F.substring("batch_key", -2, 2)
    store.replace(facts, facts.select("batch_key"))
    store.remove(store.summary().select("batch_key").where(day <= REMOVED_DAYS))
    again = store.read().where(day == RECOUNTED_DAY)
    store.replace(again.where("period_type = 'FY'"), again.select("batch_key"))
    return store.summary()


def q_stored_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stored_period_summary(_kept_counts(spark, sf))


def q_stored_batches(spark: SparkSession, sf: str) -> DataFrame:
    return stored_batches(_kept_counts(spark, sf))


# --- J1 ----------------------------------------------------------------------
def q_latest_landing(spark: SparkSession, sf: str) -> DataFrame:
    """Landings (the events) merged in three parts, the last one twice."""
    log = _t(spark, sf, "events").select(
        F.concat(F.lit("f_"), F.expr("user_id DIV 2").cast("string"), F.lit(".xlsx")).alias("file_name"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uploaded_by"), F.col("ts").alias("uploaded_at"), (F.col("event_id") % 3).alias("part"))
    latest = LatestLandings(spark, scratch_path(spark, "latest-q"), log.schema["uploaded_at"].dataType, buckets=16)
    for part in (2, 0, 1, 1):
        latest.add(log.where(F.col("part") == part))
    return latest.read()


# --- C1/A3/F7/F10 ------------------------------------------------------------
def checked_keys(spark: SparkSession, sf: str, **more: Column) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate", *[c.alias(n) for n, c in more.items()])
    k = F.col("o_orderkey") % 5
    key = (F.when(k == 0, F.concat(F.lit("BLB_"), F.date_format("o_orderdate", "yyMMdd")))
           .when(k == 1, F.lit("Sheet1"))
           .when(k == 2, F.concat(F.lit("BLB_"), F.date_format("o_orderdate", "yyMM")))
           .when(k == 3, F.lit(BAD_DATE_SHEET)))
    return o.select(key.alias("batch_key"),
                    F.concat(F.lit("src_"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".xlsx")).alias("source_file"), *more)


def q_key_check(spark: SparkSession, sf: str) -> DataFrame:
    rep = key_report(check_batch_key(checked_keys(spark, sf)))
    return rep.select("batch_key", "row_count", F.col("batch_date").cast("date").alias("batch_date"), "passed")


# --- C2/C4 -------------------------------------------------------------------
def q_check_report(spark: SparkSession, sf: str) -> DataFrame:
    df = checked_keys(spark, sf)
    whole = run_checks(check_scope(df)).withColumn("scope", F.lit("all"))
    empty = run_checks(check_scope(df, EMPTY_SCOPE)).withColumn("scope", F.lit(EMPTY_SCOPE))
    return whole.unionByName(empty)


def q_check_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = checked_keys(spark, sf, value=F.col("o_totalprice").cast("decimal(18,2)"), metric=F.col("o_orderpriority"))
    checks = [
        batch_key_dated(), RowCheck("least_value", f"value >= {LEAST_VALUE}"), RowCheck("metric_spelled", "metric LIKE '_-%'"),
        GroupCheck("top_value", "max(value)", lambda top: top < TOP_VALUE), GroupCheck("two_metrics", "count(DISTINCT metric)", lambda n: n >= 2),
    ]
    return check_set_report(rows, checks)


def q_file_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf, by="customer").checks.withColumn("batch_date", F.col("batch_date").cast("date"))


# --- A4 ----------------------------------------------------------------------
def q_check_totals(spark: SparkSession, sf: str) -> DataFrame:
    return check_totals(key_report(check_batch_key(checked_keys(spark, sf))))


# --- W2 ----------------------------------------------------------------------
def run_log_from_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")
    pk = F.col("l_partkey")
    result = (F.when(pk % 5 == 0, F.lit("SUCCESS")).when(pk % 5 == 1, F.lit("FAILED"))
              .when(pk % 5 == 2, F.lit("CANCELED")).when(pk % 5 == 3, F.lit("")))
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.when(F.col("l_returnflag") == "N", F.lit("quality_check")).otherwise(F.lit("ingest")).alias("task_key"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).otherwise(F.col("l_linenumber") % 3).cast("int")
        .alias("attempt_number"),
        F.col("l_linenumber").alias("list_pos"),
        F.element_at(F.array(*[F.lit(s) for s in TASK_STATES]), (pk % 4 + 1).cast("int")).alias("life_cycle_state"),
        result.alias("result_state"),
        F.when(result == "FAILED", F.concat(F.lit("AssertionError: check failed for part "), pk.cast("string")))
        .alias("error"),
        "l_partkey", "l_suppkey",
    )


def q_latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return latest_attempts(run_log_from_lineitem(spark, sf), ("l_partkey", "l_suppkey")).drop("l_partkey", "l_suppkey")


# --- F14/F15 -----------------------------------------------------------------
def q_run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = _t(spark, sf, "orders").select(
        k.alias("run_id"),
        F.element_at(F.array(*[F.lit(s) for s in RUN_STATES]), (k % len(RUN_STATES) + 1).cast("int"))
        .alias("life_cycle_state"),
        F.when((k / 9).cast("long") % 4 == 0, F.lit("SUCCESS")).when((k / 9).cast("long") % 4 == 1, F.lit("FAILED"))
        .when((k / 9).cast("long") % 4 == 2, F.lit(None)).otherwise(F.lit("CANCELED")).alias("result_state"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("run "), k.cast("string"), F.lit(" stopped"))).alias("state_message"),
    )
    return run_outcomes(runs, run_log_from_lineitem(spark, sf), ("l_partkey", "l_suppkey"))


# --- R1 ----------------------------------------------------------------------
def q_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    from gridfold.streaming.ingest import stream_region_workbooks

    return stream_region_workbooks(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "newest_file": q_newest_file,
    "landing_log": q_landing_log,
    "unique_names": q_unique_names,
    "recent_landings": q_recent_landings,
    "row_band": q_row_band,
    "header_classes": q_header_classes,
    "file_errors": q_file_errors,
    "data_versions": q_data_versions,
    "batch_dates": q_batch_dates,
    "long_facts": q_long_facts,
    "long_facts_bench": q_long_facts_bench,
    "wide_unpivot": q_wide_unpivot,
    "scaled_values": q_scaled_values,
    "lineage": q_lineage,
    "replace_batches": q_replace_batches,
    "remove_batch": q_remove_batch,
    "period_summary": q_period_summary,
    "key_check": q_key_check,
    "check_report": q_check_report,
    "check_totals": q_check_totals,
    "latest_attempt": q_latest_attempt,
    "run_outcomes": q_run_outcomes,
    "stream_ingest": q_stream_ingest,
    "sink_replace": q_sink_replace,
    "ledger_ingest": q_ledger_ingest,
    "file_checks": q_file_checks,
    "check_set": q_check_set,
    "stored_summary": q_stored_summary,
    "stored_batches": q_stored_batches,
    "latest_landing": q_latest_landing,
}
