"""Column functions for sheet text: trimming, labels, headers, periods, values.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.schema import (
    BATCH_DATE_FORMAT,
    ESTIMATE_SUFFIX,
    METRIC_MARKER,
    NA_VALUES,
    SCALE,
    SHEET_DATE_REGEX,
    VALUE_TYPE,
    WS,
    period_regex,
    quarter_estimate_regex,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_u(col: Column | str) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does
    (Unicode separators such as U+3000 included; Spark ``trim`` drops only
    ASCII spaces)."""
    return F.regexp_replace(_c(col), rf"^{WS}+|{WS}+$", "")


def is_missing(col: Column | str) -> Column:
    """A cell the workbook reader treats as missing: absent or one of the
    default missing-value spellings."""
    c = _c(col)
    return c.isNull() | c.isin(*NA_VALUES)


def is_blank_label(col: Column | str) -> Column:
    """Row label that drops the row: missing, blank after stripping, or the
    text ``nan`` in any case."""
    t = trim_u(col)
    return is_missing(col) | (t == "") | (F.lower(t) == "nan")


def metric_label(col: Column | str) -> Column:
    """Metric text as written: unstripped, with a missing cell spelled ``nan``
    (what a stringified missing value looks like)."""
    c = _c(col)
    return F.when(is_missing(c), F.lit("nan")).otherwise(c)


def header_class(col: Column | str, metric_marker: str = METRIC_MARKER, estimate_suffix: str = ESTIMATE_SUFFIX) -> Column:
    """``metric`` if the header contains the marker, else ``period`` if the
    stripped header is a period header, else ``skipped``. Tested in order."""
    c = _c(col)
    return (
        F.when(c.contains(metric_marker), F.lit("metric"))
        .when(trim_u(c).rlike(period_regex(estimate_suffix)), F.lit("period"))
        .otherwise(F.lit("skipped"))
    )


def parse_period(col: Column | str, estimate_suffix: str = ESTIMATE_SUFFIX) -> Column:
    """Struct(period_type, year, quarter, is_estimate) from a period header.

    The header is parsed after stripping, so a leading space does not turn a
    quarter into a full year. Non-period text gives NULL fields.
    """
    h = trim_u(col)
    pattern = period_regex(estimate_suffix)
    ok = h.rlike(pattern)
    kind = F.regexp_extract(h, pattern, 1)
    ptype = F.when(ok, F.when(kind == "FY", F.lit("FY")).otherwise(F.lit("Q")))
    year = F.when(ok, F.regexp_extract(h, pattern, 2).cast("int"))
    quarter = F.when(ok & (kind != "FY"), F.substring(kind, 2, 1).cast("int"))
    est = F.when(ok, _c(col).contains(estimate_suffix))
    return F.struct(
        ptype.alias("period_type"),
        year.alias("year"),
        quarter.alias("quarter"),
        est.alias("is_estimate"),
    )


def quarter_estimate(col: Column | str, estimate_suffix: str = ESTIMATE_SUFFIX) -> Column:
    """Struct(year, quarter) of a quarterly estimate header, else NULL."""
    h = trim_u(col)
    pattern = quarter_estimate_regex(estimate_suffix)
    return F.when(
        h.rlike(pattern),
        F.struct(
            F.regexp_extract(h, pattern, 2).cast("int").alias("year"),
            F.regexp_extract(h, pattern, 1).cast("int").alias("quarter"),
        ),
    )


def scale_value(col: Column | str, scale: int = SCALE) -> Column:
    """Cell text -> DECIMAL(38,7) in units, NULL when not a number or when
    the scaled value does not fit (never an error)."""
    parsed = _c(col).try_cast(VALUE_TYPE)
    return F.try_multiply(parsed, F.lit(scale)).try_cast(VALUE_TYPE)


def short_date(col: Column | str, fmt: str = BATCH_DATE_FORMAT) -> Column:
    """Parse e.g. ``yyMMdd`` text; NULL when empty or not a real date."""
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def sheet_date_digits(col: Column | str) -> Column:
    """First six consecutive ASCII digits anywhere in a sheet name, else NULL."""
    d = F.regexp_extract(_c(col), SHEET_DATE_REGEX, 1)
    return F.when(d != "", d)
