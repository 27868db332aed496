"""Scalar column functions (all built-in Spark expressions)."""

from gridfold.functions.display import classify_run, display_status, human_size, iso_time
from gridfold.functions.names import (
    base_name,
    decode_name,
    is_workbook,
    sanitize_part,
    split_ext,
    unique_name,
    uploader,
    utc_wall,
)
from gridfold.functions.text import (
    header_class,
    is_blank_label,
    is_missing,
    metric_label,
    parse_period,
    quarter_estimate,
    scale_value,
    sheet_date_digits,
    short_date,
    trim_u,
)

__all__ = [
    "base_name", "classify_run", "decode_name", "display_status", "header_class", "human_size",
    "is_blank_label", "is_missing", "is_workbook", "iso_time", "metric_label", "parse_period",
    "quarter_estimate", "sanitize_part", "scale_value", "sheet_date_digits", "short_date",
    "split_ext", "trim_u", "unique_name", "uploader", "utc_wall",
]
