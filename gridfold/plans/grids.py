"""Workbook-shaped grids derived from the driver's tables.

A "file" per region (or per customer) holds a consensus-style sheet:
header row 4 with the metric header, one column per quarter and per full
year of ``o_orderdate`` (estimates from 2000 on), junk headers; body labels
are order priorities and each value is the sum of ``o_totalprice`` in the
period. Decoy rows sit before the start marker and after the end marker; a
repeated header row, a blank label and a missing-value label sit inside.

Everything is a Spark aggregation of the tables, so the grid grows with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.schema import END_MARKER, ESTIMATE_SUFFIX, START_MARKER, Layout

# ---------------------------------------------------------------------------
# Fixed values of the derived sheets.
# ---------------------------------------------------------------------------
METRIC_HEADER = "項目 (單位: 百萬)"
TITLE = "Consensus model"
ESTIMATE_FROM_YEAR = 2000
IDEOGRAPHIC_SPACE = "　"
DECOY_BEFORE, DECOY_BEFORE_VALUE = "ignored before start", "9"
DECOY_AFTER, DECOY_AFTER_VALUE = "after end", "8"
BLANK_LABEL, BLANK_VALUE = "  ", "5"
NA_LABEL, NA_VALUE = "N/A", "4"
JUNK_HEADERS = ("Notes", "Q5 2026")
JUNK_VALUE = "7"
NO_YEAR = -(10**9)  # in a period's code, for orders without a date
BATCH_FILES = 2  # customer files that share a sheet name, so a batch
BATCH_DAYS = 36525  # sheet names there can be: the days that six digits name
# sheet rows
ROW_TITLE, ROW_NAME, ROW_DECOY, ROW_START, ROW_FIRST_LABEL = 1, 2, 5, 6, 7
# rows after the labels, relative to the last label row
OFF_REPEAT, OFF_BLANK, OFF_NA, OFF_END, OFF_AFTER = 1, 2, 3, 4, 5
# ---------------------------------------------------------------------------

# Layout with the column window lifted (a derived sheet has ~40 columns).
WIDE_LAYOUT = Layout(last_col=500)


@dataclass
class Grid:
    grid: DataFrame  # GRID_SCHEMA
    files: DataFrame  # SCAN_SCHEMA


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from gridfold.session import spread

    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name == "orders" else df


def order_facts(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """(source_file, file_key, metric, year, quarter, price DECIMAL(18,2))."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    if by == "region":
        n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        r = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
        j = j.join(n, j.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
        file_col, key_col = F.concat("r_name", F.lit(".xlsx")), F.col("r_regionkey").cast("long")
    elif by == "customer":
        file_col, key_col = F.concat("c_name", F.lit(".xlsx")), F.col("c_custkey").cast("long")
    else:
        raise ValueError(by)
    return j.select(
        file_col.alias("source_file"),
        key_col.alias("file_key"),
        F.col("o_orderpriority").alias("metric"),
        F.year("o_orderdate").alias("year"),
        F.quarter("o_orderdate").alias("quarter"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )


def sheet_name_for(file_key, by: str = "region"):
    """BLB_yyMMdd: a real date per file key."""
    if by == "region":
        return F.concat(F.lit("BLB_2601"), F.lpad((file_key + 1).cast("string"), 2, "0"))
    # neighbouring customers deliver the same batch
    day = F.floor(file_key / BATCH_FILES) % BATCH_DAYS
    return F.concat(F.lit("BLB_"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), day.cast("int")), "yyMMdd"))


def period_header(year, qsort, est_year=None, est_quarter=None):
    """Header text: ``Q{q} {y}`` / ``FY {y}``; a quarter is an estimate from
    (est_year, est_quarter) on, a full year from est_year on (default 2000 Q1).
    Even quarters use an ideographic space before the suffix."""
    est_year = F.lit(ESTIMATE_FROM_YEAR) if est_year is None else est_year
    est_quarter = F.lit(1) if est_quarter is None else est_quarter
    is_est = F.when(qsort == 5, year >= est_year).otherwise(year * 10 + qsort >= est_year * 10 + est_quarter)
    est_sep = F.when((qsort % 2) == 0, F.lit(IDEOGRAPHIC_SPACE)).otherwise(F.lit(" "))
    suffix = F.when(is_est, F.concat(est_sep, F.lit(ESTIMATE_SUFFIX))).otherwise(F.lit(""))
    base = F.when(qsort == 5, F.concat(F.lit("FY "), year.cast("string"))).otherwise(
        F.concat(F.lit("Q"), qsort.cast("string"), F.lit(" "), year.cast("string")))
    return F.concat(base, suffix)


def period_values(facts: DataFrame) -> DataFrame:
    """(source_file, file_key, metric, year, qsort, value_text); qsort 5 = FY.
    One pass: every order counts for its quarter and for its full year."""
    return facts.withColumn("qsort", F.explode(F.array("quarter", F.lit(5)))).groupBy(
        "source_file", "file_key", "metric", "year", "qsort").agg(F.sum("price").cast("string").alias("value_text"))


def period_code(year, qsort):
    """A long that sorts as (year, qsort) do, nulls first, so that a sheet's
    periods are told apart and placed as plain numbers."""
    return F.shiftleft(F.coalesce(year.cast("long"), F.lit(NO_YEAR)), 3) + F.coalesce(qsort, F.lit(0))


def code_year(code):
    return F.nullif(F.shiftright(code, 3), F.lit(NO_YEAR))


def code_qsort(code):
    return F.nullif(code.bitwiseAND(F.lit(7)), F.lit(0))


def sheet_values(values: DataFrame) -> DataFrame:
    """(source_file, vals): the values of a sheet in one record, as many as its
    cells. Values without a file make no sheet: only their metrics stay."""
    named = F.col("source_file").isNotNull()
    period = period_code(F.col("year"), F.col("qsort"))
    kept = {"file_key": F.col("file_key"), "period": period, "value_text": F.col("value_text")}
    return values.groupBy("source_file").agg(
        F.collect_set(F.struct("metric", *[F.when(named, c).alias(n) for n, c in kept.items()])).alias("vals"))


def label_rows(sheets: DataFrame) -> DataFrame:
    """(labels): the metrics in order (a handful of values), one label row each."""
    metrics = sheets.select(F.explode("vals.metric").alias("metric")).distinct()
    return metrics.agg(F.transform(F.sort_array(F.collect_list(F.struct("metric"))), lambda x: x["metric"]).alias("labels"))


def _entry(col, text):
    return F.struct(F.lit(col).cast("int").alias("col"), F.lit(text).cast("string").alias("text"))


def _row(row, *entries):
    """A sheet row: ``entries`` are arrays of cells; two in one column are an error."""
    return F.struct(F.lit(row).cast("int").alias("row"), F.map_from_entries(F.concat(*entries)).alias("cells"))


def sheet_rows(sheets: DataFrame, labels: DataFrame, by: str = "region", junk: bool = True, est_start=None) -> DataFrame:
    """Decoder-like records of each sheet (row 0: its status), made from its one
    record of values without moving it.

    ``est_start``: optional function file_key -> (est_year, est_quarter).
    """
    col = F.col
    in_body = lambda x: (F.shiftright(x["period"], 3) != NO_YEAR) & (x["period"].bitwiseAND(F.lit(7)) != 0) & x["metric"].isNotNull()
    place = lambda period: (F.array_position("periods", period) + 2).cast("int")

    def heads_of(key):
        """The period columns that one key has values for; two of one name are an error."""
        ey, eq = est_start(key) if est_start else (None, None)
        own = F.array_distinct(F.transform(F.filter("vals", lambda x: x["file_key"] == key), lambda x: x["period"]))
        return F.transform(F.sort_array(own), lambda p: F.struct(
            place(p).alias("col"), period_header(code_year(p), code_qsort(p), ey, eq).alias("header")))

    s = sheets.where(col("source_file").isNotNull() & F.exists("vals", in_body)).crossJoin(F.broadcast(labels))
    s = s.withColumns({"periods": F.sort_array(F.array_distinct("vals.period")), "keys": F.array_distinct("vals.file_key")})
    s = s.withColumns({
        # one sheet column per period
        "heads": F.flatten(F.transform("keys", heads_of)),
        "body": F.transform(F.filter("vals", in_body), lambda x: F.struct(
            (F.array_position("labels", x["metric"]) + ROW_FIRST_LABEL - 1).cast("int").alias("row"),
            place(x["period"]).alias("col"), x["value_text"].alias("text"), x["file_key"].alias("file_key"))),
        "last_col": F.size("periods") + 2,
    })
    s = s.withColumns({"last": F.array_max("body.row"), "file_key": F.array_max("body.file_key")})
    last, last_col = col("last"), col("last_col")
    # every period column: header, decoys, repeated header, blank and N/A rows
    across = lambda text: F.transform("heads", lambda h: _entry(h["col"], text))
    headers = F.transform("heads", lambda h: _entry(h["col"], h["header"]))
    first = lambda text: F.array(_entry(2, text))
    more, marks = [], []
    if junk:
        # a repeated period header (the first one): a second column of that name is not a period
        texts = [*JUNK_HEADERS, F.array_min("heads")["header"]]
        more = [F.array(*[_entry(last_col + i + 1, t) for i, t in enumerate(texts)])]
        marks = [F.array(*[_entry(last_col + i + 1, JUNK_VALUE) for i in range(len(texts))])]
    label = lambda row: _row(
        row, first(F.element_at("labels", row - (ROW_FIRST_LABEL - 1))),
        F.transform(F.filter("body", lambda b: b["row"] == row), lambda b: _entry(b["col"], b["text"])), *marks)
    rows = F.concat(
        F.array(
            F.struct(F.lit(0).alias("row"), F.lit(None).cast("map<int,string>").alias("cells")),
            _row(ROW_TITLE, first(TITLE)),
            _row(ROW_NAME, first(col("source_file"))),
            _row(4, first(METRIC_HEADER), headers, *more),
            _row(ROW_DECOY, first(DECOY_BEFORE), across(DECOY_BEFORE_VALUE)),
            _row(ROW_START, first(START_MARKER)),
        ),
        F.transform(F.array_distinct("body.row"), label),
        F.array(
            _row(last + OFF_REPEAT, first(METRIC_HEADER), headers),
            _row(last + OFF_BLANK, first(BLANK_LABEL), across(BLANK_VALUE)),
            _row(last + OFF_NA, first(NA_LABEL), across(NA_VALUE)),
            _row(last + OFF_END, first(END_MARKER)),
            _row(last + OFF_AFTER, first(DECOY_AFTER), across(DECOY_AFTER_VALUE)),
        ),
    )
    noted = F.when(col("r.row") == 0, F.timestamp_seconds(F.lit(1767225600) + col("file_key") * 3600))
    return s.select(
        "source_file", sheet_name_for(col("file_key"), by).alias("sheet_name"), "file_key", F.explode(rows).alias("r"),
    ).select(
        "source_file", "sheet_name", "r.row", "r.cells", noted.alias("modified_at"),
        F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("scan_error"))


def derived_grid(spark: SparkSession, sf_dir: str, by: str = "region", junk: bool = True,
                 stage_grid: bool = True, est_start=None, buckets: int | None = None) -> Grid:
    """Grid rows and file list for one derived sheet per region / customer.

    With ``stage_grid`` the grid is written once as Parquet in the shared
    checkpoint folder and read back, as decoded workbooks are; ``buckets``
    stages it bucketed by source_file, as :func:`scan_workbooks` does (default:
    for so many customers that their per-file plan is not broadcast).
    """
    from gridfold.plans.ingest import BROADCAST_MAX_FILES
    from gridfold.session import sql_conf, stage, stage_bucketed
    from gridfold.sources.workbook import split_scan, with_label

    sheets = sheet_values(period_values(order_facts(spark, sf_dir, by)))
    if not stage_grid:
        scan = split_scan(sheet_rows(sheets, label_rows(sheets), by, junk, est_start))
        return Grid(grid=scan.grid, files=scan.files)
    if buckets is None and by == "customer" and _t(spark, sf_dir, "customer").count() > BROADCAST_MAX_FILES:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets:
        # every task holds one bucket's sheets, so nothing is sorted or moved to write it
        aligned = {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false",
                   "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "4"}
        put = lambda df, label: stage_bucketed(spark, df, label, "source_file", buckets)
    else:
        aligned = {}
        put = lambda df, label: stage(spark, df, label)
    with sql_conf(spark, aligned):
        # every sheet below reads its own values: aggregate orders once
        sheets = put(sheets, "derived-values")
        raw = sheet_rows(sheets, label_rows(sheets), by, junk, est_start)
        scan = split_scan(put(with_label(raw, WIDE_LAYOUT), "derived-grid"))
    return Grid(grid=scan.grid, files=scan.files)
