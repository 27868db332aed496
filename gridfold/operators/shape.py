"""From grid rows to long facts: headers, bands, per-file plan, unpivot.

The grid holds one record per sheet row. Everything that is decided per file
(header classes, data band, metric column, period columns, version, batch
key, errors) is an aggregate with one row per file; the body pass then joins
each row record to its file's plan and explodes the period columns. The
body never shuffles to be put back together, because a sheet row's cells
travel in one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.text import (
    header_class,
    is_blank_label,
    metric_label,
    parse_period,
    quarter_estimate,
    scale_value,
    sheet_date_digits,
    short_date,
    trim_u,
)
from gridfold.schema import DEFAULT_LAYOUT, SCALE, VERSION_FORMAT, Layout

_NO_END = 2**31 - 1

# ---------------------------------------------------------------------------
# Per-file error texts, in the order the checks apply.
# ---------------------------------------------------------------------------
ERR_BAD_DATE = "sheet name holds a six-digit date that is not a real yyMMdd date"
ERR_NO_METRIC = "cannot find the metric column (no header contains the metric marker)"
ERR_NO_ESTIMATE = "no quarterly estimate column, cannot derive data_version"
# ---------------------------------------------------------------------------


def cells_long(grid: DataFrame) -> DataFrame:
    """Long cell form ``(source_file, sheet_name, row, col, text)``."""
    return grid.select(
        "source_file", "sheet_name", "row", F.explode("cells").alias("col", "text")
    )


def grid_from_cells(cells: DataFrame) -> DataFrame:
    """Grid rows from long cells (one shuffle on (source_file, row))."""
    return cells.groupBy("source_file", "sheet_name", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells")
    )


def header_cells(grid: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Header row cells inside the column window."""
    return (
        grid.where(F.col("row") == layout.header_row)
        .select("source_file", F.explode("cells").alias("col", "text"))
        .where(F.col("col").between(layout.first_col, layout.last_col))
    )


def classify_headers(headers: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Class of each header (metric / period / skipped) and its
    parsed period.

    A reader that names columns by header text renames a repeated header, so
    only the first (lowest column) of identical period headers is a period.
    The rule is applied inside one per-file aggregate (a file has at most
    ``last_col - first_col + 1`` headers), so classifying costs one shuffle
    on source_file, and the per-file plan built on top reuses it.
    """
    # only column and text travel; class and period follow from the text
    per_file = headers.groupBy("source_file").agg(F.collect_list(F.struct("col", "text")).alias("hs"))

    def with_repeat(x):
        repeated = F.exists("hs", lambda y: (y["text"] == x["text"]) & (y["col"] < x["col"]))
        return F.struct(x["col"].alias("col"), x["text"].alias("text"), repeated.alias("repeated"))

    h = per_file.select("source_file", F.explode(F.transform("hs", with_repeat)).alias("h")).select("source_file", "h.*")
    cls = header_class("text", layout.metric_marker, layout.estimate_suffix)
    h = h.select(
        "source_file", "col", "text",
        F.when((cls == "period") & F.col("repeated"), F.lit("skipped")).otherwise(cls).alias("header_class"),
        parse_period("text", layout.estimate_suffix).alias("p"),
    )
    is_period = F.col("header_class") == "period"
    return h.select(
        "source_file", "col", "text", "header_class",
        *[F.when(is_period, F.col(f"p.{f}")).alias(f) for f in ("period_type", "year", "quarter", "is_estimate")],
    )


def version_text(ver: Column) -> Column:
    """``V_Q{quarter}_{year}_ESTIMATE`` from struct(year, quarter)."""
    fmt = VERSION_FORMAT.replace("{quarter}", "%d").replace("{year}", "%d")
    return F.when(ver.isNotNull(), F.format_string(fmt, ver["quarter"], ver["year"]))


def header_plan(classified: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Per file: metric column (last one wins), period columns, data_version
    (P8: earliest quarterly estimate by (year, quarter))."""
    is_period = F.col("header_class") == "period"
    est = F.when(is_period, quarter_estimate("text", layout.estimate_suffix))
    return classified.groupBy("source_file").agg(
        F.max(F.when(F.col("header_class") == "metric", F.col("col"))).alias("metric_col"),
        F.sort_array(
            F.collect_list(
                F.when(is_period, F.struct("col", "period_type", "year", "quarter", "is_estimate"))
            )
        ).alias("periods"),
        F.min(est).alias("first_estimate"),
    ).select(
        "source_file", "metric_col", "periods", version_text(F.col("first_estimate")).alias("data_version")
    )


def data_versions(classified: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """``(source_file, data_version)`` for files with a quarterly estimate."""
    return header_plan(classified, layout).where(F.col("data_version").isNotNull()).select("source_file", "data_version")


def label_of(grid: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> Column:
    """The row label (column-B cell): the staged ``label`` column when the
    grid has one (a prunable Parquet column), else the map lookup."""
    return F.col("label") if "label" in grid.columns else F.col("cells")[layout.first_col]


def bands(grid: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """First start-marker row and first end-marker row below the header,
    per file (NULL when absent)."""
    label = trim_u(label_of(grid, layout))
    return (
        grid.where(F.col("row") > layout.header_row)
        .select("source_file", "row", label.alias("label"))
        .where(F.col("label").isin(layout.start_marker, layout.end_marker))
        .groupBy("source_file")
        .agg(
            F.min(F.when(F.col("label") == layout.start_marker, F.col("row"))).alias("band_start"),
            F.min(F.when(F.col("label") == layout.end_marker, F.col("row"))).alias("band_end"),
        )
    )


def in_band(layout: Layout = DEFAULT_LAYOUT) -> Column:
    """Row strictly after the start marker (else after the header) and
    strictly before the end marker (else to the bottom); an end above the
    start leaves nothing."""
    lo = F.coalesce(F.col("band_start"), F.lit(layout.header_row))
    hi = F.coalesce(F.col("band_end"), F.lit(_NO_END))
    return (F.col("row") > lo) & (F.col("row") < hi)


def keeps_label(layout: Layout = DEFAULT_LAYOUT, label: Column | None = None) -> Column:
    """The column-B label is present and not blank."""
    return ~is_blank_label(F.col("cells")[layout.first_col] if label is None else label)


def band_rows(grid: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """P1+P2: ``(source_file, row, label)`` of the rows kept for unpivoting."""
    body = grid.where(F.col("row") > layout.header_row).select("source_file", "row", "cells")
    return (
        body.join(bands(grid, layout), "source_file", "left")
        .where(in_band(layout) & keeps_label(layout))
        .select("source_file", "row", F.col("cells")[layout.first_col].alias("label"))
    )


def batch_keys(files: DataFrame) -> DataFrame:
    """batch_key (= sheet name) and the date gate on six digits in it.

    ``date_ok`` is false only when six digits are present and are not a real
    yyMMdd date; a name without digits passes here (the quality check flags it).
    """
    return with_date_gate(files).select("source_file", "batch_key", "batch_date", "date_ok")


def with_date_gate(files: DataFrame) -> DataFrame:
    """Adds ``batch_key``, ``batch_date`` and ``date_ok`` (see :func:`batch_keys`)."""
    digits = sheet_date_digits("sheet_name")
    return files.withColumns({
        "batch_key": F.col("sheet_name"),
        "batch_date": short_date(digits),
        "date_ok": digits.isNull() | short_date(digits).isNotNull(),
    })


def error_rule() -> Column:
    """The first failing rule, in the reference order: unreadable, bad
    sheet-name date, no metric column, no quarterly estimate. Needs the
    columns of :func:`with_date_gate` and :func:`header_plan`."""
    return (
        F.when(F.col("scan_error").isNotNull(), F.col("scan_error"))
        .when(~F.col("date_ok"), F.lit(ERR_BAD_DATE))
        .when(F.col("metric_col").isNull(), F.lit(ERR_NO_METRIC))
        .when(F.col("data_version").isNull(), F.lit(ERR_NO_ESTIMATE))
    )


def file_errors(files: DataFrame, hplan: DataFrame) -> DataFrame:
    """P6 as a table: ``(source_file, error)``, NULL error for a valid file."""
    return (
        with_date_gate(files.select("source_file", "sheet_name", "scan_error"))
        .join(hplan, "source_file", "left")
        .select("source_file", error_rule().alias("error"))
    )


def file_plan(files: DataFrame, grid: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """One row per file with everything the body pass needs, plus ``error``.

    Columns: source_file, sheet_name, batch_key, modified_at, error,
    metric_col, periods, data_version, band_start, band_end.
    The two per-file aggregates come out hash-partitioned by source_file, so
    only the (one row per file) status side shuffles to meet them. ``grid`` may
    hold more files than ``files`` names: their rows go before any is parsed.
    """
    grid = grid.join(files.select("source_file"), "source_file", "left_semi")
    hplan = header_plan(classify_headers(header_cells(grid, layout), layout), layout)
    return (
        with_date_gate(files.select("source_file", "sheet_name", "modified_at", "scan_error"))
        .join(hplan, "source_file", "left")
        .join(bands(grid, layout), "source_file", "left")
        .select(
            "source_file", "sheet_name", "batch_key", "modified_at", error_rule().alias("error"),
            "metric_col", F.coalesce(F.col("periods"), F.array()).alias("periods"), "data_version",
            "band_start", "band_end",
        )
    )


def to_long(grid: DataFrame, plan: DataFrame, layout: Layout = DEFAULT_LAYOUT,
            broadcast_plan: bool = False) -> DataFrame:
    """P10/J2 + P12/P13: one row per (kept sheet row x period column) with a
    numeric value.

    ``plan`` must hold only the files to emit (valid ones) and may carry extra
    per-file columns (lineage, flags); they are passed through.
    """
    # small plan: broadcast, the body is never shuffled; large plan: hash
    # join building on the plan side (no sort of the body; with a grid
    # bucketed by source_file the body side is not shuffled either)
    plan_side = F.broadcast(plan) if broadcast_plan else plan.hint("shuffle_hash")
    body = grid.where(F.col("row") > layout.header_row).select(
        "source_file", "row", "cells", label_of(grid, layout).alias("label"))
    rows = body.join(plan_side, "source_file").where(in_band(layout) & keeps_label(layout, F.col("label")))
    extra = [c for c in plan.columns if c not in (
        "source_file", "periods", "metric_col", "band_start", "band_end", "error", "sheet_name")]
    long = rows.select(
        "source_file",
        metric_label(F.col("cells")[F.col("metric_col")]).alias("metric"),
        F.explode("periods").alias("p"),
        F.col("cells"),
        *extra,
    )
    return (
        long.select(
            "metric",
            F.col("p.period_type").alias("period_type"),
            F.col("p.year").alias("year"),
            F.col("p.quarter").alias("quarter"),
            F.col("p.is_estimate").alias("is_estimate"),
            scale_value(F.col("cells")[F.col("p.col")], layout.scale).alias("value"),
            "source_file",
            *extra,
        ).where(F.col("value").isNotNull())
    )


def wide_unpivot(wide: DataFrame, label_col: str, period_cols: list[str], scale: int = SCALE) -> DataFrame:
    """P10 wide form: a frame with one column per period header -> one row
    per (label, header) -> parsed long rows.

    The unpivot is an explode of (header, value) pairs over positionally
    renamed columns (header texts are arbitrary strings, kept as values, not
    as identifiers). Like ``DataFrame.unpivot`` it keeps NULL values; they
    are dropped with the non-numeric ones after scaling.
    """
    safe = wide.select(F.col(label_col).alias("_label"),
                       *[F.col(f"`{c}`").cast("string").alias(f"_p{i}") for i, c in enumerate(period_cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("period_raw"), F.col(f"_p{i}").alias("value_text"))
                      for i, c in enumerate(period_cols)])
    long = safe.select("_label", F.explode(pairs).alias("kv"))
    p = parse_period(F.col("kv.period_raw"))
    return long.select(
        F.col("_label").alias("metric"),
        p["period_type"].alias("period_type"),
        p["year"].alias("year"),
        p["quarter"].alias("quarter"),
        p["is_estimate"].alias("is_estimate"),
        scale_value(F.col("kv.value_text"), scale).alias("value"),
    ).where(F.col("value").isNotNull())
