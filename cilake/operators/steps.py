"""Steps and jobs: ids, what ran, status, needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.functions.text import slug
from cilake.operators.running import BLOCK_ROWS, Run, numbered, running


def step_ids(steps: DataFrame, order: str = "pos", ties: list[str] | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `step_idx` (0-based position in the job) and `step_id` = index_slug."""
    out = numbered(steps, ["job_id"], order, "step_idx", ties=ties, block_rows=block_rows)
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    named = [full(c) for c in ("id", "name") if c in steps.columns]
    return out.withColumn("step_id", F.concat_ws("_", F.col("step_idx").cast("string"),
                                                 slug(F.coalesce(*named, F.lit("<unnamed>")))))


def executed_steps(steps: DataFrame, order: str = "pos", ties: list[str] | None = None,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Steps that ran: those not after the first failure of their job."""
    failed = F.when(F.col("status") == "Failed", 1).otherwise(0)
    out = running(steps, ["job_id"], order, [Run("_failed", "max", failed)], inclusive=False, ties=ties,
                  block_rows=block_rows)
    return out.filter(F.coalesce("_failed", F.lit(0)) == 0).drop("_failed")


def job_status(steps: DataFrame, order: list[str], keys: list[str], reason: str = "reason") -> DataFrame:
    """Failed with the reason of the first failed step, else Succeeded."""
    bad = F.col("status") == "Failed"
    agg = steps.groupBy(*keys).agg(
        F.bool_or(bad).alias("_bad"), F.min_by(F.col(reason), F.when(bad, F.struct(*order))).alias("reason"))
    return agg.select(*keys, F.when(F.col("_bad"), "Failed").otherwise("Succeeded").alias("status"),
                      F.when(F.col("_bad"), F.col("reason")).alias("reason"))


def first_error(violations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only the first error by position."""
    return violations.groupBy(*keys).agg(F.min_by("message", F.struct(*order)).alias("message"))


def attach_needs(edges: DataFrame, results: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Per needed job: its result and each of its outputs (NULL where the job does not exist).

    `edges` (keys, job_id, needs_job_id), `results` (keys, job_id, result), `outputs` (keys, job_id, key, value).
    """
    res = results.withColumnRenamed("job_id", "needs_job_id")
    out = outputs.withColumnRenamed("job_id", "needs_job_id")
    return edges.join(res, [*keys, "needs_job_id"], "left").join(out, [*keys, "needs_job_id"], "left").select(
        *keys, "job_id", "needs_job_id", "result", "key", "value")


def step_results(steps: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outcome (before continue-on-error), conclusion (after), and outputs of each step as rows."""
    outcome = F.when(F.col("status") == "Failed", "failure").when(F.col("status") == "Canceled", "cancelled").when(
        F.col("status") == "Skipped", "skipped").otherwise("success")
    rows = steps.withColumn("outcome", outcome).withColumn(
        "conclusion", F.when((F.col("outcome") == "failure") & F.col("continue_on_error"), "success").otherwise(
            F.col("outcome")))
    return rows.join(outputs, ["job_id", "step_idx"], "left").select(
        "job_id", "step_idx", "outcome", "conclusion", "key", "value")
