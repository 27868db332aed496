"""Column functions for landing-history display and run roll-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.schema import ISO_TIME_FORMAT, LANDED

# ---------------------------------------------------------------------------
# Run states and the texts shown for them.
# ---------------------------------------------------------------------------
ACTIVE_STATES = ("PENDING", "QUEUED", "BLOCKED", "RUNNING", "TERMINATING")
RUNNING_STATES = ("RUNNING", "TERMINATING")
TERMINAL_STATES = ("TERMINATED", "INTERNAL_ERROR", "SKIPPED")
SUCCESS = "SUCCESS"
STEP1_DEFAULT = "Ingesting data..."
STEP2_DEFAULT = "Data quality check"
INGESTED = "Data ingested"
CHECK_RUNNING = "Running data quality check..."
CHECK_PASSED = "Data quality check passed"
CHECK_FAILED = "Data quality check failed"
CHECK_SKIPPED = "Data quality check skipped"
PASSED_MESSAGE = "Data has been ingested into the table and passed the quality check."
CHECK_ENDED_PREFIX = "Data was ingested but the quality check ended with state: "
ERROR_PREFIX = "Error: "
JOB_ENDED_PREFIX = "Job ended with state: "
ASSERTION_PREFIX_REGEX = r"^AssertionError:\s*"
NO_SIZE = "—"
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _first_text(*cols: Column) -> Column:
    """First non-NULL, non-empty string (JavaScript ``a || b``)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def iso_time(utc_ts: Column | str) -> Column:
    """ISO-8601 text of a UTC wall-clock timestamp, with ``Z`` as offset."""
    return F.concat(F.date_format(_c(utc_ts), ISO_TIME_FORMAT), F.lit("Z"))


def human_size(col: Column | str) -> Column:
    """``—`` for NULL, ``N B`` below 1 KiB, else KB / MB with one decimal,
    rounded half up on the exact quotient."""
    b = _c(col).cast("decimal(20,0)")

    def one_decimal(div: int) -> Column:
        return F.round(b / F.lit(div).cast("decimal(20,0)"), 1).cast("decimal(21,1)").cast("string")

    return (
        F.when(b.isNull(), F.lit(NO_SIZE))
        .when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
        .when(b < 1024 * 1024, F.concat(one_decimal(1024), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(1024 * 1024), F.lit(" MB")))
    )


def display_status(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(LANDED))


def classify_run(
    life: Column | str,
    result: Column | str,
    state_message: Column | str,
    ingest_result: Column | str,
    ingest_error: Column | str,
    quality_result: Column | str,
    quality_error: Column | str,
) -> Column:
    """Progress roll-up of one run from its run state and its two tasks.

    Returns struct(step1, step1_state, step2, step2_state, percent, message).
    """
    life, result, msg = _c(life), _c(result), _c(state_message)
    i_res, i_err, q_res, q_err = _c(ingest_result), _c(ingest_error), _c(quality_result), _c(quality_error)
    ingest_done = F.coalesce(i_res == SUCCESS, F.lit(False))
    active = life.isin(*ACTIVE_STATES)
    running = life.isin(*RUNNING_STATES)
    terminal = life.isin(*TERMINAL_STATES)
    passed = F.coalesce(result == SUCCESS, F.lit(False))

    def pick(a1, a2, a3, b1, b2, b3, other):
        return (
            F.when(active & ingest_done, a1)
            .when(active & running, a2)
            .when(active, a3)
            .when(terminal & passed, b1)
            .when(terminal & ingest_done, b2)
            .when(terminal, b3)
            .otherwise(other)
        )

    lit = F.lit
    step1 = pick(
        lit(INGESTED), lit(STEP1_DEFAULT), F.concat(lit("Job "), F.lower(life), lit("...")),
        lit(INGESTED), lit(INGESTED),
        F.concat(lit("Ingestion "), F.lower(_first_text(i_res, result, life, lit("failed")))),
        lit(STEP1_DEFAULT),
    )
    step1_state = pick(lit("done"), lit("active"), lit("active"), lit("done"), lit("done"), lit("failed"), lit(None))
    step2 = pick(
        lit(CHECK_RUNNING), lit(STEP2_DEFAULT), lit(STEP2_DEFAULT),
        lit(CHECK_PASSED), lit(CHECK_FAILED), lit(CHECK_SKIPPED), lit(STEP2_DEFAULT),
    )
    step2_state = pick(lit("active"), lit(None), lit(None), lit("done"), lit("failed"), lit("failed"), lit(None))
    percent = pick(lit(85), lit(65), lit(40), lit(100), lit(100), lit(100), lit(50))
    message = pick(
        lit(None), lit(None), lit(None),
        lit(PASSED_MESSAGE),
        run_message_check(q_err, q_res, result, life),
        run_message_ingest(i_err, msg, result, life),
        lit(None),
    )
    return F.struct(
        step1.cast("string").alias("step1"),
        step1_state.cast("string").alias("step1_state"),
        step2.cast("string").alias("step2"),
        step2_state.cast("string").alias("step2_state"),
        percent.cast("int").alias("percent"),
        message.cast("string").alias("message"),
    )


def run_message_check(q_err: Column, q_res: Column, result: Column, life: Column) -> Column:
    """Text for an ingested run whose check failed: the check's error without
    its ``AssertionError:`` prefix, else the state it ended with."""
    err = F.nullif(q_err, F.lit(""))
    return F.when(err.isNotNull(), F.regexp_replace(err, ASSERTION_PREFIX_REGEX, "")).otherwise(
        F.concat(F.lit(CHECK_ENDED_PREFIX), _first_text(q_res, result, life))
    )


def run_message_ingest(i_err: Column, state_message: Column, result: Column, life: Column) -> Column:
    """Text for a run whose ingest failed: its error (or the run message),
    else the state the job ended with."""
    err = _first_text(i_err, state_message)
    return F.when(err.isNotNull(), F.concat(F.lit(ERROR_PREFIX), err)).otherwise(
        F.concat(F.lit(JOB_ENDED_PREFIX), _first_text(result, life))
    )
