"""DuckDB SQL twins of the registered queries, straight from the base tables.

Derived sheets are not rebuilt cell by cell here: each oracle states the
answer the rules imply (e.g. the long facts are a plain group-by times one
million), so the Spark plan and the SQL reach it by different routes.
"""

from __future__ import annotations

from gridfold.operators.shape import ERR_BAD_DATE, ERR_NO_ESTIMATE, ERR_NO_METRIC
from gridfold.plans import queries as Q
from gridfold.plans.grids import BATCH_DAYS, BATCH_FILES
from gridfold.schema import NAME_UNSAFE_REGEX, PERIOD_REGEX, WS
from gridfold.sources.landing import ERR_NAME_TAKEN, ERR_NOT_WORKBOOK, ERR_NO_NAME


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_EXT = r"(?s)^(.*[^./][^/]*)(\.[^./]*)$"
_TRIM = f"^{WS}+|{WS}+$"


def _trim(e: str) -> str:
    return f"regexp_replace({e}, {_s(_TRIM)}, '', 'g')"


def _san(e: str) -> str:
    x = f"regexp_replace(regexp_replace({e}, {_s(NAME_UNSAFE_REGEX)}, '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN {x} = '' THEN 'file' ELSE {x} END)"


def _unique(name: str, user: str, ts: str) -> str:
    stem = f"(CASE WHEN regexp_matches({name}, {_s(_EXT)}) THEN regexp_extract({name}, {_s(_EXT)}, 1) ELSE {name} END)"
    ext = f"(CASE WHEN regexp_matches({name}, {_s(_EXT)}) THEN regexp_extract({name}, {_s(_EXT)}, 2) ELSE '' END)"
    return f"{_san(stem)} || '__' || {_san(user)} || '__' || strftime({ts}, '%Y%m%dT%H%M%SZ') || lower({ext})"


def _in(vals) -> str:
    return "(" + ", ".join(_s(v) for v in vals) + ")"


# orders joined to their region or customer "file"
def _base(by: str = "region") -> str:
    if by == "region":
        f = "r.r_name || '.xlsx'"
        k = "CAST(r.r_regionkey AS BIGINT)"
        joins = ("JOIN nation n ON c.c_nationkey = n.n_nationkey "
                 "JOIN region r ON n.n_regionkey = r.r_regionkey")
    else:
        f = "c.c_name || '.xlsx'"
        k = "CAST(c.c_custkey AS BIGINT)"
        joins = ""
    return f"""base AS (
  SELECT {f} AS source_file, {k} AS file_key, o.o_orderpriority AS metric,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(quarter(o.o_orderdate) AS INTEGER) AS quarter,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey {joins})"""


def _sheet(by: str) -> str:
    if by == "region":
        return "'BLB_2601' || lpad(CAST(file_key + 1 AS VARCHAR), 2, '0')"
    return f"'BLB_' || strftime(DATE '2000-01-01' + CAST((file_key // {BATCH_FILES}) % {BATCH_DAYS} AS INTEGER), '%y%m%d')"


def _facts(by: str = "region", lineage: bool = False) -> str:
    lin = ""
    user, when = "CAST(NULL AS VARCHAR)", "CAST(NULL AS TIMESTAMP)"
    if lineage:
        lin = """,
lg AS (SELECT coalesce(r_name, {unassigned}) || CASE WHEN r_name = {unlogged} THEN '.xls' ELSE '.xlsx' END AS file_name,
              'user' || CAST(user_id AS VARCHAR) AS uploaded_by, ts AS uploaded_at
       FROM events LEFT JOIN region ON user_id % 7 = r_regionkey),
latest AS (SELECT file_name, uploaded_by, uploaded_at FROM lg
           QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY uploaded_at DESC, uploaded_by DESC) = 1)""".format(
            unassigned=_s(Q.UNASSIGNED_FILE), unlogged=_s(Q.UNLOGGED_REGION))
        user, when = "latest.uploaded_by", "latest.uploaded_at"
    join = "LEFT JOIN latest ON latest.file_name = v.source_file" if lineage else ""
    # the last valid file per batch key wins: valid = has a quarterly estimate;
    # newest landing (log) else modification time (grows with the key), then name
    order = "latest.uploaded_at DESC NULLS LAST, " if lineage else ""
    lj = "LEFT JOIN latest ON latest.file_name = f.source_file" if lineage else ""
    win = f""",
files AS (SELECT DISTINCT source_file, file_key, {_sheet(by)} AS batch_key FROM base),
winners AS (SELECT f.source_file FROM files f JOIN ver ON ver.source_file = f.source_file {lj}
            QUALIFY row_number() OVER (PARTITION BY f.batch_key
                                       ORDER BY {order}f.file_key DESC, f.source_file DESC) = 1)"""
    return f"""WITH {_base(by)},
vals AS (
  SELECT source_file, file_key, metric, year, quarter AS qsort, SUM(price) AS v FROM base GROUP BY 1, 2, 3, 4, 5
  UNION ALL
  SELECT source_file, file_key, metric, year, 5 AS qsort, SUM(price) AS v FROM base GROUP BY 1, 2, 3, 4),
ver AS (
  SELECT source_file, 'V_Q' || CAST(m % 10 AS VARCHAR) || '_' || CAST(m // 10 AS VARCHAR) || '_ESTIMATE' AS data_version
  FROM (SELECT source_file, min(year * 10 + quarter) AS m FROM base WHERE year >= 2000 GROUP BY 1)){lin}
{win}
SELECT v.metric,
       CASE WHEN v.qsort = 5 THEN 'FY' ELSE 'Q' END AS period_type,
       v.year,
       CAST(CASE WHEN v.qsort = 5 THEN NULL ELSE v.qsort END AS INTEGER) AS quarter,
       v.year >= 2000 AS is_estimate,
       CAST(v.v * 1000000 AS DECIMAL(38,7)) AS value,
       v.source_file,
       {user} AS upload_user,
       {when} AS upload_datetime,
       ver.data_version,
       {_sheet(by).replace('file_key', 'v.file_key')} AS batch_key
FROM vals v JOIN ver ON ver.source_file = v.source_file {join}
WHERE v.source_file IN (SELECT source_file FROM winners)"""


NEWEST_FILE = f"""
SELECT file_name, ts AS modified_at FROM (
  SELECT 'upload_' || CAST(event_id AS VARCHAR) ||
         CASE event_id % 4 WHEN 0 THEN {_s(Q.NEWEST_EXTS[0])} WHEN 1 THEN {_s(Q.NEWEST_EXTS[1])}
                           WHEN 2 THEN {_s(Q.NEWEST_EXTS[2])} ELSE {_s(Q.NEWEST_EXTS[3])} END AS file_name,
         ts, event_id
  FROM events)
WHERE lower(file_name) LIKE '%.xlsx' OR lower(file_name) LIKE '%.xls'
ORDER BY ts DESC, event_id DESC
LIMIT 1"""

LANDING_LOG = f"""
WITH u AS (
  SELECT event_type || ' report #' || CAST(event_id AS VARCHAR) ||
         CASE WHEN event_id % 2 = 0 THEN '.XLSX' ELSE '.xls' END AS original_name,
         event_id * 1000 + user_id AS size_bytes,
         coalesce(
           nullif(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN ''
                       ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END, ''),
           nullif(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 <= 2 THEN ''
                       ELSE 'pref.' || CAST(user_id AS VARCHAR) END, ''),
           nullif(CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'hdr ' || event_type END, ''),
           'unknown') AS uploaded_by,
         ts
  FROM events)
SELECT {_unique('original_name', 'uploaded_by', 'ts')} AS file_name,
       uploaded_by, CAST(size_bytes AS BIGINT) AS size_bytes, 'landed' AS status, ts AS uploaded_at, original_name
FROM u"""

UNIQUE_NAMES = f"""
WITH d AS (
  SELECT doc_id,
         text || CASE doc_id % 3 WHEN 0 THEN '.Xlsx' WHEN 1 THEN '.xls' ELSE '.docx' END AS original_name,
         source, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END) AS ts
  FROM documents),
n AS (SELECT doc_id, original_name, {_unique('original_name', 'source', 'ts')} AS file_name FROM d),
later AS (SELECT original_name, source,
                 CASE WHEN doc_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 DAY END AS ts FROM d),
taken AS (SELECT DISTINCT {_unique('original_name', 'source', 'ts')} AS file_name FROM later),
e AS (
SELECT n.doc_id, n.file_name,
       CASE WHEN coalesce(n.original_name, '') = '' THEN {_s(ERR_NO_NAME)}
            WHEN NOT (lower(n.original_name) LIKE '%.xlsx' OR lower(n.original_name) LIKE '%.xls')
              THEN {_s(ERR_NOT_WORKBOOK)}
            WHEN t.file_name IS NOT NULL THEN {_s(ERR_NAME_TAKEN)} END AS error
FROM n LEFT JOIN taken t ON t.file_name = n.file_name)
SELECT doc_id, file_name,
       CASE WHEN error IS NULL AND row_number() OVER (PARTITION BY file_name, error IS NULL ORDER BY doc_id) > 1
            THEN {_s(ERR_NAME_TAKEN)} ELSE error END AS error
FROM e"""


def _tenths(col: str, div: int) -> str:
    t = f"(({col} * 10 + {div // 2}) // {div})"
    return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR)"


RECENT_LANDINGS = f"""
WITH l AS (
  SELECT 'evt_' || CAST(event_id AS VARCHAR) || '.xlsx' AS file_name,
         'user' || CAST(user_id AS VARCHAR) AS uploaded_by,
         CAST(CASE WHEN event_id % 10 = 0 THEN NULL
                   WHEN event_id % 4 = 0 THEN event_id % 1000
                   WHEN event_id % 4 = 1 THEN (event_id * 37) % 900000 + 1024
                   WHEN event_id % 4 = 2 THEN (event_id * 7919) % 50000000 + 1048576 END AS BIGINT) AS size_bytes,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'landed' END AS status,
         ts AS uploaded_at
  FROM events),
top AS (SELECT * FROM l ORDER BY uploaded_at DESC, file_name DESC LIMIT 10)
SELECT file_name, uploaded_by AS "user", size_bytes, coalesce(status, 'landed') AS status,
       strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS uploaded_at,
       CASE WHEN size_bytes IS NULL THEN '—'
            WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B'
            WHEN size_bytes < 1048576 THEN {_tenths('size_bytes', 1024)} || ' KB'
            ELSE {_tenths('size_bytes', 1048576)} || ' MB' END AS size_text
FROM top"""

ROW_BAND = f"""
WITH {_base("customer")},
pr AS (SELECT metric, CAST(6 + row_number() OVER (ORDER BY metric) AS INTEGER) AS row
       FROM (SELECT DISTINCT metric FROM base)),
lab AS (SELECT fm.source_file, pr.row, fm.metric AS label
        FROM (SELECT DISTINCT source_file, metric FROM base) fm JOIN pr ON pr.metric = fm.metric)
SELECT source_file, row, label FROM lab
UNION ALL
SELECT source_file, CAST(max(row) + 1 AS INTEGER) AS row, '項目 (單位: 百萬)' AS label FROM lab GROUP BY source_file"""


def _period_text(year: str, qsort: str, est: str) -> str:
    return (f"(CASE WHEN {qsort} = 5 THEN 'FY ' || CAST({year} AS VARCHAR) "
            f"ELSE 'Q' || CAST({qsort} AS VARCHAR) || ' ' || CAST({year} AS VARCHAR) END || "
            f"CASE WHEN {est} THEN (CASE WHEN {qsort} % 2 = 0 THEN '　' ELSE ' ' END) || '預估' ELSE '' END)")


_VARIANTS_LIST = "[" + ", ".join(_s(v) for v in Q.HEADER_VARIANTS) + "]"
_RE = _s(PERIOD_REGEX)

HEADER_CLASSES = f"""
WITH {_base("customer")},
per AS (SELECT DISTINCT source_file, year, qsort FROM (
          SELECT source_file, year, quarter AS qsort FROM base UNION ALL SELECT source_file, year, 5 FROM base)),
pc AS (SELECT source_file, year, qsort,
              CAST(2 + dense_rank() OVER (PARTITION BY source_file ORDER BY year, qsort) AS INTEGER) AS col,
              {_period_text('year', 'qsort', "CASE WHEN qsort = 5 THEN year >= 2000 ELSE year * 10 + qsort >= 20001 END")} AS text
       FROM per),
sh AS (SELECT source_file, max(col) AS last_col, arg_min(text, col) AS first_text FROM pc GROUP BY 1),
heads AS (
  SELECT source_file, col, text FROM pc
  UNION ALL SELECT source_file, 2, '項目 (單位: 百萬)' FROM sh
  UNION ALL SELECT source_file, CAST(last_col + 1 AS INTEGER), 'Notes' FROM sh
  UNION ALL SELECT source_file, CAST(last_col + 2 AS INTEGER), 'Q5 2026' FROM sh
  UNION ALL SELECT source_file, CAST(last_col + 3 AS INTEGER), first_text FROM sh
  UNION ALL SELECT source_file, CAST(last_col + 3 + i AS INTEGER), {_VARIANTS_LIST}[i] FROM (
      SELECT source_file, last_col, unnest(range(1, {len(Q.HEADER_VARIANTS) + 1})) AS i FROM sh)),
c0 AS (SELECT source_file, col, text, {_trim('text')} AS t,
              CASE WHEN contains(text, '單位') THEN 'metric'
                   WHEN regexp_matches({_trim('text')}, {_RE}) THEN 'period' ELSE 'skipped' END AS k,
              row_number() OVER (PARTITION BY source_file, text ORDER BY col) AS rn
       FROM heads),
c1 AS (SELECT *, CASE WHEN k = 'period' AND rn > 1 THEN 'skipped' ELSE k END AS header_class FROM c0)
SELECT source_file, col, text, header_class,
       CASE WHEN header_class = 'period' THEN
            CASE WHEN regexp_extract(t, {_RE}, 1) = 'FY' THEN 'FY' ELSE 'Q' END END AS period_type,
       CASE WHEN header_class = 'period' THEN CAST(regexp_extract(t, {_RE}, 2) AS INTEGER) END AS year,
       CASE WHEN header_class = 'period' AND regexp_extract(t, {_RE}, 1) <> 'FY'
            THEN CAST(substr(regexp_extract(t, {_RE}, 1), 2, 1) AS INTEGER) END AS quarter,
       CASE WHEN header_class = 'period' THEN contains(text, '預估') END AS is_estimate
FROM c1"""

FILE_ERRORS = f"""
SELECT r_name || '.xlsx' AS source_file,
       CASE WHEN r_name || '.xlsx' IN {_in(Q.BAD_DATE_FILES)} THEN {_s(Q.BAD_DATE_SHEET)}
            ELSE 'BLB_2601' || lpad(CAST(r_regionkey + 1 AS VARCHAR), 2, '0') END AS batch_key,
       CASE WHEN r_name || '.xlsx' = {_s(Q.UNREADABLE_FILE)} THEN {_s(Q.UNREADABLE_ERROR)}
            WHEN r_name || '.xlsx' IN {_in(Q.BAD_DATE_FILES)} THEN {_s(ERR_BAD_DATE)}
            WHEN r_name || '.xlsx' = {_s(Q.NO_METRIC_FILE)} THEN {_s(ERR_NO_METRIC)}
            WHEN r_name || '.xlsx' = {_s(Q.NO_ESTIMATE_FILE)} THEN {_s(ERR_NO_ESTIMATE)} END AS error
FROM region
WHERE r_regionkey IN (SELECT n.n_regionkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                      JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

DATA_VERSIONS = f"""
WITH {_base()}
SELECT source_file, 'V_Q' || CAST(m % 10 AS VARCHAR) || '_' || CAST(m // 10 AS VARCHAR) || '_ESTIMATE' AS data_version
FROM (SELECT source_file, min(year * 10 + quarter) AS m FROM base
      WHERE year * 10 + quarter >= (1996 + file_key) * 10 + 1 + file_key % 4 GROUP BY 1)"""

BATCH_DATES = """
WITH f AS (
  SELECT o_orderkey,
         CASE o_orderkey % 4 WHEN 0 THEN 'BLB_' WHEN 1 THEN 'Sheet' WHEN 2 THEN 'X-' ELSE '' END ||
         CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 100000 AS VARCHAR)
              WHEN o_orderkey % 5 = 1 THEN lpad(CAST((o_orderkey * 7919) % 100000000 AS VARCHAR), 8, '0')
              ELSE lpad(CAST((o_orderkey * 7919) % 1000000 AS VARCHAR), 6, '0') END AS sheet_name
  FROM orders),
d AS (SELECT *, nullif(regexp_extract(sheet_name, '([0-9]{6})', 1), '') AS dg FROM f)
SELECT o_orderkey, sheet_name, sheet_name AS batch_key,
       CAST(try_strptime('20' || dg, '%Y%m%d') AS DATE) AS batch_date,
       (dg IS NULL OR try_strptime('20' || dg, '%Y%m%d') IS NOT NULL) AS date_ok
FROM d"""

WIDE_UNPIVOT = """
WITH b AS (SELECT o_orderpriority AS metric, CAST(year(o_orderdate) AS INTEGER) AS year,
                  CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
SELECT metric, 'Q' AS period_type, year, q AS quarter, year >= 2000 AS is_estimate,
       CAST(sum(price) * 1000000 AS DECIMAL(38,7)) AS value FROM b GROUP BY metric, year, q
UNION ALL
SELECT metric, 'FY', year, CAST(NULL AS INTEGER), year >= 2000,
       CAST(sum(price) * 1000000 AS DECIMAL(38,7)) FROM b GROUP BY metric, year"""

SCALED_VALUES = f"""
WITH t AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE (l_orderkey + l_linenumber + l_partkey) % 10
           WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
           WHEN 1 THEN 'n/a'
           WHEN 2 THEN CAST(l_linenumber AS VARCHAR) || '.5e2'
           WHEN 3 THEN CAST(l_linenumber AS VARCHAR) || ',234'
           WHEN 4 THEN ''
           WHEN 5 THEN '  ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' '
           WHEN 6 THEN {_s(Q.OVERFLOW_TEXT)}
           WHEN 7 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
           WHEN 8 THEN 'abc'
           ELSE CAST(l_orderkey % 1000 AS VARCHAR) || '.' ||
                lpad(CAST((l_partkey * 7919 + l_suppkey) % 1000000000 AS VARCHAR), 9, '0') END AS text
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, text,
       CAST(try_cast(text AS DECIMAL(32,7)) * 1000000 AS DECIMAL(38,7)) AS value
FROM t WHERE try_cast(text AS DECIMAL(32,7)) IS NOT NULL"""

_EXISTING = """ex AS (SELECT 'Y' || CAST(year(o_orderdate) AS VARCHAR) AS batch_key, o_orderkey,
                  'old.xlsx' AS source_file, CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders)"""

_REPLACED = tuple(Q.TWO_FILE_YEARS) + (Q.EMPTY_FILE_YEAR,)
REPLACE_BATCHES = f"""
WITH {_EXISTING}
SELECT batch_key, o_orderkey, source_file, value FROM ex WHERE batch_key NOT IN {_in(_REPLACED)}
UNION ALL
SELECT batch_key, o_orderkey, 'f_' || batch_key || '_b.xlsx' AS source_file,
       CAST(value + 1 AS DECIMAL(18,2)) AS value
FROM ex WHERE batch_key IN {_in(Q.TWO_FILE_YEARS)}"""

SINK_REPLACE = f"SELECT * FROM ({REPLACE_BATCHES}) r WHERE batch_key <> {_s(Q.REMOVED_BATCH)}"

REMOVE_BATCH = f"""
WITH {_EXISTING}
SELECT batch_key, CAST(count(*) FILTER (WHERE batch_key <> {_s(Q.REMOVED_BATCH)}) AS BIGINT) AS row_count
FROM ex GROUP BY batch_key"""

PERIOD_SUMMARY = f"""
SELECT period_type, year, is_estimate, count(*) AS row_count FROM ({_facts("customer")}) f
GROUP BY period_type, year, is_estimate ORDER BY period_type, year, is_estimate"""

_KEYS = f"""k AS (
  SELECT CASE o_orderkey % 5 WHEN 0 THEN 'BLB_' || strftime(o_orderdate, '%y%m%d') WHEN 1 THEN 'Sheet1'
              WHEN 2 THEN 'BLB_' || strftime(o_orderdate, '%y%m') WHEN 3 THEN {_s(Q.BAD_DATE_SHEET)} END AS batch_key,
         'src_' || CAST(o_orderkey % 3 AS VARCHAR) || '.xlsx' AS source_file
  FROM orders),
rep AS (
  SELECT batch_key, count(*) AS row_count,
         max(try_strptime('20' || nullif(regexp_extract(batch_key, '^BLB_([0-9]{{6}})$', 1), ''), '%Y%m%d')) AS bd
  FROM k GROUP BY batch_key)"""

_CUSTOMER_FILES = f"""{_base("customer")},
vals AS (SELECT source_file, file_key, metric, year, quarter FROM base GROUP BY ALL
         UNION ALL SELECT source_file, file_key, metric, year, 5 FROM base GROUP BY ALL),
files AS (SELECT source_file, file_key, {_sheet("customer")} AS batch_key, bool_or(year >= 2000) AS valid, CAST(count(*) AS BIGINT) AS n
          FROM vals GROUP BY source_file, file_key),
won AS (SELECT *, valid AND file_key = max(file_key) FILTER (WHERE valid) OVER (PARTITION BY batch_key) AS wins, right(batch_key, 2) AS day FROM files)"""

FILE_CHECKS = f"""
WITH {_CUSTOMER_FILES}
SELECT source_file, batch_key, n AS row_count, strptime('20' || right(batch_key, 6), '%Y%m%d')::DATE AS batch_date,
       true AS not_empty, true AS key_ok, true AS passed
FROM files WHERE valid"""

LEDGER_INGEST = f"""
WITH {_CUSTOMER_FILES},
st AS (SELECT *, valid AND day <= {_s(Q.REMOVED_DAYS)} AND day <> {_s(Q.RETAKEN_DAY)} AS gone FROM won)
SELECT source_file, batch_key,
       CASE WHEN NOT valid THEN 'failed' WHEN gone THEN 'removed' WHEN wins THEN 'landed' ELSE 'superseded' END AS outcome,
       CASE WHEN NOT valid THEN {_s(ERR_NO_ESTIMATE)} END AS error,
       CASE WHEN NOT valid THEN NULL WHEN gone THEN 0 ELSE n END AS row_count,
       CAST(1 + CASE WHEN NOT valid THEN 1 WHEN day <= {_s(Q.REMOVED_DAYS)} THEN 1 ELSE 0 END
              + CASE WHEN day = {_s(Q.RETAKEN_DAY)} THEN 1 ELSE 0 END AS BIGINT) AS entries,
       CASE WHEN wins AND NOT gone THEN n ELSE 0 END AS table_rows
FROM st"""

_KEPT = f"""SELECT * FROM ({_facts("customer")}) f
WHERE right(batch_key, 2) > {_s(Q.REMOVED_DAYS)} AND (right(batch_key, 2) <> {_s(Q.RECOUNTED_DAY)} OR period_type = 'FY')"""

STORED_SUMMARY = f"""
SELECT period_type, year, is_estimate, count(*) AS row_count FROM ({_KEPT}) k
GROUP BY period_type, year, is_estimate ORDER BY period_type, year, is_estimate"""

STORED_BATCHES = f"SELECT batch_key, source_file, count(*) AS row_count FROM ({_KEPT}) k GROUP BY batch_key, source_file"

LATEST_LANDING = """
SELECT 'f_' || CAST(user_id // 2 AS VARCHAR) || '.xlsx' AS file_name, 'u' || CAST(user_id AS VARCHAR) AS uploaded_by, ts AS uploaded_at
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id // 2 ORDER BY ts DESC NULLS LAST, 'u' || CAST(user_id AS VARCHAR) DESC NULLS LAST) = 1"""

CHECK_SET = f"""
WITH f AS (
  SELECT CASE o_orderkey % 5 WHEN 0 THEN 'BLB_' || strftime(o_orderdate, '%y%m%d') WHEN 1 THEN 'Sheet1'
              WHEN 2 THEN 'BLB_' || strftime(o_orderdate, '%y%m') WHEN 3 THEN {_s(Q.BAD_DATE_SHEET)} END AS batch_key,
         'src_' || CAST(o_orderkey % 3 AS VARCHAR) || '.xlsx' AS source_file, CAST(o_totalprice AS DECIMAL(18,2)) AS value,
         o_orderpriority AS metric
  FROM orders),
g AS (SELECT source_file, batch_key, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(value >= {Q.LEAST_VALUE}, false)) AS low,
             count(*) FILTER (WHERE metric NOT LIKE '_-%') AS spelled, max(value) AS top, count(DISTINCT metric) AS kinds,
             max(try_strptime('20' || nullif(regexp_extract(batch_key, '^BLB_([0-9]{{6}})$', 1), ''), '%Y%m%d')) AS bd
      FROM f GROUP BY source_file, batch_key),
r AS (
  SELECT source_file, batch_key, 'batch_key_date' AS "check", n, CASE WHEN bd IS NULL THEN n ELSE 0 END AS bad FROM g
  UNION ALL SELECT source_file, batch_key, 'least_value', n, low FROM g
  UNION ALL SELECT source_file, batch_key, 'metric_spelled', n, spelled FROM g
  UNION ALL SELECT source_file, batch_key, 'top_value', n, CASE WHEN top < {Q.TOP_VALUE} THEN 0 ELSE n END FROM g
  UNION ALL SELECT source_file, batch_key, 'two_metrics', n, CASE WHEN kinds >= 2 THEN 0 ELSE n END FROM g
  UNION ALL SELECT NULL, NULL, 'not_empty', (SELECT count(*) FROM f), 0)
SELECT source_file, batch_key, "check", CAST(n AS BIGINT) AS row_count, CAST(bad AS BIGINT) AS failed_rows,
       CASE WHEN "check" = 'not_empty' THEN n > 0 ELSE bad = 0 END AS passed
FROM r"""

KEY_CHECK = f"""
WITH {_KEYS}
SELECT batch_key, row_count, CAST(bd AS DATE) AS batch_date, bd IS NOT NULL AS passed FROM rep"""

CHECK_REPORT = f"""
WITH {_KEYS}
SELECT 0 AS check_order, 'not_empty' AS "check", CAST(NULL AS VARCHAR) AS batch_key,
       CAST(count(*) AS BIGINT) AS row_count, count(*) > 0 AS passed, 'all' AS scope FROM k
UNION ALL
SELECT 1, 'batch_key_date', batch_key, CAST(row_count AS BIGINT), bd IS NOT NULL, 'all' FROM rep
UNION ALL
SELECT 0, 'not_empty', NULL, CAST(count(*) AS BIGINT), count(*) > 0, {_s(Q.EMPTY_SCOPE)}
FROM k WHERE source_file = {_s(Q.EMPTY_SCOPE)}"""

CHECK_TOTALS = f"""
WITH {_KEYS}
SELECT CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(CASE WHEN bd IS NULL THEN row_count END), 0) AS BIGINT) AS failed_rows,
       count(CASE WHEN bd IS NULL THEN 1 END) AS failed_keys
FROM rep"""

_RUN_LOG = """lg AS (
  SELECT l_orderkey AS run_id,
         CASE WHEN l_returnflag = 'N' THEN 'quality_check' ELSE 'ingest' END AS task_key,
         CAST(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber % 3 END AS INTEGER) AS attempt_number,
         l_linenumber AS list_pos,
         CASE l_partkey % 4 WHEN 0 THEN 'TERMINATED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PENDING'
                            ELSE 'INTERNAL_ERROR' END AS life_cycle_state,
         CASE l_partkey % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'CANCELED' WHEN 3 THEN '' END
           AS result_state,
         CASE WHEN l_partkey % 5 = 1 THEN 'AssertionError: check failed for part ' || CAST(l_partkey AS VARCHAR) END
           AS error,
         l_partkey, l_suppkey
  FROM lineitem),
latest AS (
  SELECT * FROM lg QUALIFY row_number() OVER (
    PARTITION BY run_id, task_key
    ORDER BY coalesce(attempt_number, 0) DESC, list_pos DESC, l_partkey DESC, l_suppkey DESC) = 1)"""

LATEST_ATTEMPT = f"""
WITH {_RUN_LOG}
SELECT run_id, task_key, attempt_number, list_pos, life_cycle_state, result_state, error FROM latest"""


def _js_or(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


RUN_OUTCOMES = f"""
WITH {_RUN_LOG},
runs AS (
  SELECT o_orderkey AS run_id,
         ['PENDING', 'QUEUED', 'BLOCKED', 'RUNNING', 'TERMINATING', 'TERMINATED', 'INTERNAL_ERROR', 'SKIPPED',
          'WAITING'][o_orderkey % 9 + 1] AS life,
         CASE (o_orderkey // 9) % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' WHEN 2 THEN NULL ELSE 'CANCELED' END
           AS result,
         CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL
              ELSE 'run ' || CAST(o_orderkey AS VARCHAR) || ' stopped' END AS msg
  FROM orders),
t AS (
  SELECT run_id,
         max(CASE WHEN task_key = 'ingest' THEN result_state END) AS i_res,
         max(CASE WHEN task_key = 'ingest' THEN error END) AS i_err,
         max(CASE WHEN task_key = 'quality_check' THEN result_state END) AS q_res,
         max(CASE WHEN task_key = 'quality_check' THEN error END) AS q_err
  FROM latest GROUP BY run_id),
j AS (
  SELECT r.*, t.i_res, t.i_err, t.q_res, t.q_err,
         coalesce(t.i_res = 'SUCCESS', false) AS done,
         r.life IN ('PENDING', 'QUEUED', 'BLOCKED', 'RUNNING', 'TERMINATING') AS active,
         r.life IN ('RUNNING', 'TERMINATING') AS running,
         r.life IN ('TERMINATED', 'INTERNAL_ERROR', 'SKIPPED') AS terminal
  FROM runs r LEFT JOIN t ON t.run_id = r.run_id)
SELECT run_id,
  CASE WHEN active AND done THEN 'Data ingested'
       WHEN active AND running THEN 'Ingesting data...'
       WHEN active THEN 'Job ' || lower(life) || '...'
       WHEN terminal AND coalesce(result = 'SUCCESS', false) THEN 'Data ingested'
       WHEN terminal AND done THEN 'Data ingested'
       WHEN terminal THEN 'Ingestion ' || lower({_js_or('i_res', 'result', 'life', "'failed'")})
       ELSE 'Ingesting data...' END AS step1,
  CASE WHEN active AND done THEN 'done' WHEN active THEN 'active'
       WHEN terminal AND (coalesce(result = 'SUCCESS', false) OR done) THEN 'done'
       WHEN terminal THEN 'failed' END AS step1_state,
  CASE WHEN active AND done THEN 'Running data quality check...'
       WHEN active THEN 'Data quality check'
       WHEN terminal AND coalesce(result = 'SUCCESS', false) THEN 'Data quality check passed'
       WHEN terminal AND done THEN 'Data quality check failed'
       WHEN terminal THEN 'Data quality check skipped'
       ELSE 'Data quality check' END AS step2,
  CASE WHEN active AND done THEN 'active' WHEN active THEN NULL
       WHEN terminal AND coalesce(result = 'SUCCESS', false) THEN 'done'
       WHEN terminal THEN 'failed' END AS step2_state,
  CAST(CASE WHEN active AND done THEN 85 WHEN active AND running THEN 65 WHEN active THEN 40
            WHEN terminal THEN 100 ELSE 50 END AS INTEGER) AS percent,
  CASE WHEN active THEN NULL
       WHEN terminal AND coalesce(result = 'SUCCESS', false)
         THEN 'Data has been ingested into the table and passed the quality check.'
       WHEN terminal AND done THEN
         CASE WHEN nullif(q_err, '') IS NOT NULL THEN regexp_replace(q_err, '^AssertionError:\\s*', '')
              ELSE 'Data was ingested but the quality check ended with state: ' || {_js_or('q_res', 'result', 'life')} END
       WHEN terminal THEN
         CASE WHEN {_js_or('i_err', 'msg')} IS NOT NULL THEN 'Error: ' || {_js_or('i_err', 'msg')}
              ELSE 'Job ended with state: ' || {_js_or('result', 'life')} END
  END AS message
FROM j"""

ORACLES: dict[str, str] = {
    "newest_file": NEWEST_FILE,
    "landing_log": LANDING_LOG,
    "unique_names": UNIQUE_NAMES,
    "recent_landings": RECENT_LANDINGS,
    "row_band": ROW_BAND,
    "header_classes": HEADER_CLASSES,
    "file_errors": FILE_ERRORS,
    "data_versions": DATA_VERSIONS,
    "batch_dates": BATCH_DATES,
    "long_facts": _facts("region"),
    "long_facts_bench": _facts("customer"),
    "wide_unpivot": WIDE_UNPIVOT,
    "scaled_values": SCALED_VALUES,
    "lineage": _facts("region", lineage=True),
    "replace_batches": REPLACE_BATCHES,
    "remove_batch": REMOVE_BATCH,
    "period_summary": PERIOD_SUMMARY,
    "key_check": KEY_CHECK,
    "check_report": CHECK_REPORT,
    "check_totals": CHECK_TOTALS,
    "latest_attempt": LATEST_ATTEMPT,
    "run_outcomes": RUN_OUTCOMES,
    "stream_ingest": _facts("region"),
    "sink_replace": SINK_REPLACE,
    "ledger_ingest": LEDGER_INGEST,
    "file_checks": FILE_CHECKS,
    "check_set": CHECK_SET,
    "stored_summary": STORED_SUMMARY,
    "stored_batches": STORED_BATCHES,
    "latest_landing": LATEST_LANDING,
}
