"""Declared checks, compiled into one pass over the rows.

A check is an aggregate expression per group and a test on it. All checks of a
set, the default ones and a user's alike, share one scan and one shuffle by
the group columns, however many there are; the report and the check of the whole
table read the groups that pass wrote. Nothing here writes to the checked table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.operators.quality import CHECK_BATCH_KEY, CHECK_NOT_EMPTY, check_scope, key_date
from gridfold.session import stage

#: Group columns of a run's checks: each file's rows of each batch.
BY_FILE = ("source_file", "batch_key")
REPORT_COLUMNS = ("check", "row_count", "failed_rows", "passed")


#: SQL text, a column, or a function that makes one (a check may be declared before there is a session).
Expression = str | Column | Callable[[], Column]


def _column(e: Expression) -> Column:
    return F.expr(e) if isinstance(e, str) else e if isinstance(e, Column) else e()


@dataclass(frozen=True)
class RowCheck:
    """Every row must meet ``rule``; NULL is a failure."""

    name: str
    rule: Expression

    def measure(self) -> Column:
        return F.count_if(~F.coalesce(_column(self.rule), F.lit(False)))

    @staticmethod
    def failing(measure: Column, rows: Column) -> Column:
        return measure


@dataclass(frozen=True)
class GroupCheck:
    """Each group's ``aggregate`` must meet ``test``; a group that does not, or for
    which the answer is NULL, fails with all its rows."""

    name: str
    aggregate: Expression
    test: Callable[[Column], Column]

    def measure(self) -> Column:
        return _column(self.aggregate)

    def failing(self, measure: Column, rows: Column) -> Column:
        return F.when(F.coalesce(self.test(measure), F.lit(False)), F.lit(0)).otherwise(rows)


Check = RowCheck | GroupCheck


def batch_key_dated() -> GroupCheck:
    """The batch key holds a real date."""
    return GroupCheck(CHECK_BATCH_KEY, lambda: F.max(key_date(F.col("batch_key"))), lambda d: d.isNotNull())


def check_groups(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = BY_FILE) -> DataFrame:
    """One row per group: its columns, ``row_count``, and each check's measure as ``m0``, ``m1`` ..."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *[c.measure().alias(f"m{i}") for i, c in enumerate(checks)])


def check_report(df: DataFrame, checks: Sequence[Check] | None = None, by: Sequence[str] = BY_FILE) -> DataFrame:
    """C4: (``by`` ..., check, row_count, failed_rows, passed): a row per group and
    check, and first of all C2 for the whole: NULL group columns, failed when there is no row.

    ``checks`` defaults to C1. Names must differ."""
    checks = [batch_key_dated()] if checks is None else list(checks)
    if len({c.name for c in checks} | {CHECK_NOT_EMPTY}) <= len(checks):
        raise ValueError("checks need different names")
    groups = stage(df.sparkSession, check_groups(df, checks, by), "check-groups")  # read twice: for the groups, and for the whole
    whole = groups.agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("row_count")).select(
        *[F.lit(None).cast(df.schema[b].dataType).alias(b) for b in by], F.lit(CHECK_NOT_EMPTY).alias("check"), "row_count",
        F.lit(0).cast("long").alias("failed_rows"), (F.col("row_count") > 0).alias("passed"))
    if not checks:
        return whole
    rows = F.col("row_count")
    each = [F.struct(F.lit(c.name).alias("check"), rows.alias("row_count"), c.failing(F.col(f"m{i}"), rows).cast("long").alias("failed_rows")) for i, c in enumerate(checks)]
    listed = groups.select(*by, F.explode(F.array(*each)).alias("r")).select(*by, "r.*")
    return whole.unionByName(listed.withColumn("passed", F.col("failed_rows") == 0))


class CheckFailure(AssertionError):
    """Checks failed. ``quarantine`` is where every failing group is written, if anywhere."""

    def __init__(self, message: str, quarantine: str | None = None):
        super().__init__(message)
        self.quarantine = quarantine


def quarantine(report: DataFrame, path: str, run_id: str) -> str:
    """Write every failing row of the report, however many, to the folder of
    this run. A repeated run writes the same folder again, so there is one copy."""
    place = f"{path.rstrip('/')}/run_id={run_id}"
    report.where("NOT passed").write.mode("overwrite").parquet(place)
    return place


def raise_on_report(report: DataFrame, where: str, quarantined: str | None = None, shown: int = 5) -> int:
    """Raise :class:`CheckFailure` when the report holds a failure, else return the
    rows checked. The message counts all failures and names ``shown`` of them;
    the driver gets one row per check and those."""
    totals = report.groupBy("check").agg(F.count_if(~F.col("passed")).alias("groups"), F.sum("failed_rows").alias("failed_rows"),
                                         F.sum("row_count").alias("rows")).collect()
    bad = sorted((r for r in totals if r["groups"]), key=lambda r: r["check"])
    if not bad:
        return next(r["rows"] for r in totals if r["check"] == CHECK_NOT_EMPTY)
    if any(r["check"] == CHECK_NOT_EMPTY and not r["rows"] and len(totals) == 1 for r in bad):
        raise CheckFailure(f"{where} has no rows: nothing was checked", quarantined)
    by = [c for c in report.columns if c not in REPORT_COLUMNS]
    some = report.where("NOT passed").orderBy("check", *by).limit(shown).collect()
    text = "; ".join(f"{r['check']}: {r['groups']} groups, {r['failed_rows']} rows" for r in bad)
    named = ", ".join(f"{r['check']}({', '.join(repr(r[b]) for b in by)})" for r in some)
    more = f"; all of them in {quarantined}" if quarantined else ""
    raise CheckFailure(f"Checks failed in {where}: {text}, such as {named}{more}", quarantined)


def run_check_set(df: DataFrame, checks: Sequence[Check] | None, where: str, quarantine_path: str | None = None, run_id: str = "", by: Sequence[str] = BY_FILE) -> int:
    """Check rows, quarantine what fails, raise: what a run does after its write."""
    report = stage(df.sparkSession, check_report(df, checks, by), "check-report")
    failed = not report.where("NOT passed").isEmpty()
    place = quarantine(report, quarantine_path, run_id) if failed and quarantine_path else None
    return raise_on_report(report, where, place)


def check_table(facts: DataFrame, file: str | None = None, checks: Sequence[Check] | None = None, where: str = "the table",
                quarantine_path: str | None = None, run_id: str = "") -> int:
    """Check a table's rows, or those of one source file, as a step of its own."""
    return run_check_set(check_scope(facts, file), checks, f"{where}, source_file={file!r}" if file else where, quarantine_path, run_id)


def failing_checks(report: DataFrame) -> DataFrame:
    """Per check: groups and rows that failed, of how many."""
    sums = [F.count(F.lit(1)).alias("groups"), F.count_if(~F.col("passed")).alias("failed_groups"), F.sum("row_count").cast("long").alias("row_count"),
            F.sum("failed_rows").cast("long").alias("failed_rows")]
    return report.groupBy("check").agg(*sums)
