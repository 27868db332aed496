"""Column functions for landed file names and uploaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.text import trim_u
from gridfold.schema import NAME_TIME_FORMAT, NAME_UNSAFE_REGEX, UNKNOWN_USER


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sanitize_part(col: Column | str) -> Column:
    """Runs of characters outside letters/digits/``_.-`` become one ``_``;
    ``_`` is stripped at both ends; an empty result becomes ``file``."""
    s = F.btrim(F.regexp_replace(_c(col), NAME_UNSAFE_REGEX, "_"), F.lit("_"))
    return F.when(s == "", F.lit("file")).otherwise(s)


def split_ext(col: Column | str) -> Column:
    """Struct(stem, ext) split at the last dot, like ``os.path.splitext``.

    The extension starts at the last dot of the last path component, and
    exists only if that component has a non-dot character before the dot
    (so ``.xlsx`` alone has none). String functions, not a regex: names may
    be whole documents, and this stays one cheap pass.
    """
    c = _c(col)
    r = F.reverse(c)
    n = F.length(c)
    dpos = F.instr(r, ".")  # 1-based position from the end, 0 = no dot
    spos = F.instr(r, "/")
    dot = n - dpos + 1  # 1-based index of the last dot
    start = F.when(spos > 0, n - spos + 2).otherwise(F.lit(1))  # first char of the last component
    before = c.substr(start, dot - start)
    has_ext = (dpos > 0) & ((spos == 0) | (dpos < spos)) & (F.ltrim(before, F.lit(".")) != "")
    return F.struct(
        F.when(has_ext, c.substr(F.lit(1), dot - 1)).otherwise(c).alias("stem"),
        F.when(has_ext, c.substr(dot, dpos)).otherwise(F.lit("")).alias("ext"),
    )


def utc_wall(df: DataFrame, name: str) -> Column:
    """A timestamp column as UTC wall-clock TIMESTAMP_NTZ.

    TIMESTAMP_NTZ input is taken to be UTC already; TIMESTAMP (an instant) is
    converted from the session time zone.
    """
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.col(name)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz"))


def unique_name(name: Column | str, user: Column | str, utc_ts: Column | str) -> Column:
    """``<stem>__<user>__<yyyyMMdd'T'HHmmss'Z'><ext lower>``.

    ``utc_ts`` is a UTC wall-clock timestamp (see :func:`utc_wall`). The
    extension is lower-cased but not sanitised.
    """
    parts = split_ext(name)
    return F.concat(
        sanitize_part(parts["stem"]),
        F.lit("__"),
        sanitize_part(_c(user)),
        F.lit("__"),
        F.date_format(_c(utc_ts), NAME_TIME_FORMAT),
        F.lower(parts["ext"]),
    )


def decode_name(col: Column | str) -> Column:
    """URL-decode a file name passed as a parameter and strip it.

    ``+`` stays ``+``; a name with a malformed escape is kept as given.
    """
    c = _c(col)
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return trim_u(F.coalesce(decoded, c))


def uploader(*cols: Column | str) -> Column:
    """First non-empty identity among ``cols``, else ``unknown``."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(UNKNOWN_USER))


def is_workbook(col: Column | str) -> Column:
    """Name ends with ``.xlsx`` or ``.xls`` in any case."""
    low = F.lower(_c(col))
    return low.endswith(".xlsx") | low.endswith(".xls")


def base_name(col: Column | str) -> Column:
    """Last path component of a path or URI."""
    return F.regexp_extract(_c(col), r"([^/]*)$", 1)
