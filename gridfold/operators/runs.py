"""W2 + F14/F15: latest task attempts and the run progress roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions.display import classify_run
from gridfold.schema import INGEST_TASK, QUALITY_TASK


def latest_attempts(run_log: DataFrame, tie_breaks: tuple[str, ...] = ()) -> DataFrame:
    """One row per (run_id, task_key): the highest attempt (missing = 0),
    the later list item on ties (then ``tie_breaks``, descending)."""
    w = Window.partitionBy("run_id", "task_key").orderBy(
        F.coalesce(F.col("attempt_number"), F.lit(0)).desc(), F.col("list_pos").desc(),
        *[F.col(c).desc() for c in tie_breaks]
    )
    return run_log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def attempt_order(tie_breaks: tuple[str, ...] = ()):
    """Ordering of attempts (W2/T14): attempt number (missing = 0), then list
    position, then ``tie_breaks``; the greatest is the latest."""
    return F.struct(
        F.coalesce(F.col("attempt_number"), F.lit(0)).alias("a"), F.col("list_pos").alias("p"),
        *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_breaks)],
    )


def run_outcomes(runs: DataFrame, run_log: DataFrame, tie_breaks: tuple[str, ...] = (),
                 ingest_task: str = INGEST_TASK, quality_task: str = QUALITY_TASK) -> DataFrame:
    """F14/F15 per run.

    ``runs``: ``(run_id, life_cycle_state, result_state, state_message)``;
    ``run_log``: task attempts (``RUN_TASK_SCHEMA``). The latest attempt of
    the two tasks is found in one aggregate per run (``max_by`` on the
    attempt order, partially aggregated before the shuffle, so a run with
    very many attempts costs one row per map task). An error text counts only
    where the attempt's result is ``FAILED``. Output: run_id, step1,
    step1_state, step2, step2_state, percent, message.
    """
    order = attempt_order(tie_breaks)

    def latest(task: str):
        return F.max_by(F.struct("result_state", F.when(F.col("result_state") == "FAILED", F.col("error")).alias("error")), F.when(F.col("task_key") == task, order)).alias(task)

    per_run = run_log.groupBy("run_id").agg(latest(ingest_task), latest(quality_task))
    j = runs.join(per_run, "run_id", "left")
    o = classify_run(
        "life_cycle_state", "result_state", "state_message",
        F.col(f"{ingest_task}.result_state"), F.col(f"{ingest_task}.error"),
        F.col(f"{quality_task}.result_state"), F.col(f"{quality_task}.error"),
    )
    return j.select("run_id", o.alias("o")).select("run_id", "o.*")
