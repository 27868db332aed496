"""Types, layout constants and patterns shared by every operator.

Everything a user may want to change (markers, header row, column window,
patterns) is a default here and a parameter of the functions that use it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the workbook convention the engine ingests;
# they are stated here once, in natural order, and passed around as defaults.
# ---------------------------------------------------------------------------
START_MARKER = "文字版本"  # column-B cell on the row before the data band ("text version")
END_MARKER = "圖"  # column-B cell on the row after the data band ("chart")
METRIC_MARKER = "單位"  # substring of the metric (label) column header ("unit")
ESTIMATE_SUFFIX = "預估"  # suffix of period headers holding estimates ("estimate")
HEADER_ROW = 4  # 1-based sheet row holding the headers
FIRST_COL = 2  # column B
LAST_COL = 12  # column L
SCALE = 1000000  # workbook values are in millions
BATCH_KEY_REGEX = r"^BLB_([0-9]{6})$"  # quality check: group 1 is the date part
BATCH_DATE_FORMAT = "yyMMdd"
SHEET_DATE_REGEX = r"([0-9]{6})"  # ingest gate: first six digits anywhere in the sheet name
VERSION_FORMAT = "V_Q{quarter}_{year}_ESTIMATE"
LANDED = "landed"
UNKNOWN_USER = "unknown"
WORKBOOK_NAME_REGEX = r"\.xlsx?$"  # applied to the lower-cased name
NAME_TIME_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
ISO_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
# pandas' default spellings of a missing value (read_excel / read_csv na_values)
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ---------------------------------------------------------------------------

# Whitespace as Python's str.strip()/\s see it, written for Java regex:
# ASCII \s, every Unicode separator (incl. U+3000), and the C0/C1 separators.
WS = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"


def period_regex(suffix: str) -> str:
    """A period header after trimming: Q1..Q4 or FY, a 4-digit year, optional suffix."""
    return r"^(Q[1-4]|FY)[\s\p{Z}]+([0-9]{4})([\s\p{Z}]+" + re.escape(suffix) + r")?$"


def quarter_estimate_regex(suffix: str) -> str:
    """A quarterly estimate header (the ones that define data_version)."""
    return r"^Q([1-4])[\s\p{Z}]+([0-9]{4})[\s\p{Z}]+" + re.escape(suffix) + r"$"


PERIOD_REGEX = period_regex(ESTIMATE_SUFFIX)
# Characters allowed in a landed file-name part; every other run becomes '_'.
NAME_UNSAFE_REGEX = r"[^\p{L}\p{N}_.\-]+"


@dataclass(frozen=True)
class Layout:
    """Where the table sits in a sheet and how it is marked."""

    header_row: int = HEADER_ROW
    first_col: int = FIRST_COL
    last_col: int = LAST_COL
    start_marker: str = START_MARKER
    end_marker: str = END_MARKER
    metric_marker: str = METRIC_MARKER
    estimate_suffix: str = ESTIMATE_SUFFIX
    scale: int = SCALE


DEFAULT_LAYOUT = Layout()


def _f(name: str, dtype: T.DataType, comment: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable, metadata={"comment": comment})


VALUE_TYPE = T.DecimalType(38, 7)

# Long fact table, in table order; batch_key is the partition column.
FACT_SCHEMA = T.StructType([
    _f("metric", T.StringType(), "Row label of the metric, as the sheet spells it"),
    _f("period_type", T.StringType(), "Q for a quarter, FY for a whole fiscal year"),
    _f("year", T.IntegerType(), "Four-digit year of the period"),
    _f("quarter", T.IntegerType(), "1 to 4; empty for a whole year"),
    _f("is_estimate", T.BooleanType(), "True where the period header carries the estimate suffix"),
    _f("value", VALUE_TYPE, "Amount in single units, after scaling the sheet figure"),
    _f("source_file", T.StringType(), "Landed workbook this row was read from"),
    _f("upload_user", T.StringType(), "Who landed that workbook, from the landing log"),
    _f("upload_datetime", T.TimestampType(), "When that workbook landed, from the landing log"),
    _f("data_version", T.StringType(), "Earliest estimated quarter of the workbook, as V_Q<quarter>_<year>_ESTIMATE"),
    _f("batch_key", T.StringType(), "Partition key: name of the sheet, which a later file replaces whole"),
])
FACT_COLUMNS = [f.name for f in FACT_SCHEMA.fields]

LANDING_SCHEMA = T.StructType([
    _f("file_name", T.StringType(), "Collision-free name under which the file landed"),
    _f("uploaded_by", T.StringType(), "First known identity of the sender"),
    _f("size_bytes", T.LongType(), "Length of the file in bytes"),
    _f("status", T.StringType(), "landed until the file is read, then ingested"),
    _f("uploaded_at", T.TimestampType(), "When the file landed"),
])
LANDING_COLUMNS = [f.name for f in LANDING_SCHEMA.fields]

# Long cell form: one row per non-empty cell, 1-based row/col as in the sheet.
CELL_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

# Grid form: one record per sheet row holding its cells by column number.
# This is what the decoder emits and what the ingest plan reads: a row's
# label, metric and values sit in one record, so no shuffle is needed to put
# a row back together.
GRID_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("cells", T.MapType(T.IntegerType(), T.StringType())),
])

# One record per landed file, as the decoder saw it.
SCAN_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("scan_error", T.StringType()),
])

RUN_TASK_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("task_key", T.StringType()),
    T.StructField("attempt_number", T.IntegerType()),
    T.StructField("list_pos", T.IntegerType()),
    T.StructField("life_cycle_state", T.StringType()),
    T.StructField("result_state", T.StringType()),
    T.StructField("error", T.StringType()),
])

INGEST_TASK = "ingest"
QUALITY_TASK = "quality_check"
