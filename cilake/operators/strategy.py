"""Strategies of job documents as the tables that the matrix operators take.

Values keep their type: they travel as JSON text, so the number 1 and the text "1" stay different values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.operators.documents import fields, get, text_at

RULES = ["include", "exclude"]
_LIST = "array<variant>"


@dataclass(frozen=True)
class Strategy:
    """jobs (job_id, fail_fast, max_parallel), dims (job_id, dim, pos, value), empty_dims (job_id), excludes and
    includes (job_id, rule_pos, dim, value)."""

    jobs: DataFrame
    dims: DataFrame
    empty_dims: DataFrame
    excludes: DataFrame
    includes: DataFrame


def strategy_rows(job_rows: DataFrame, job_id: Column) -> DataFrame:
    """One row per row with a `job` body: its strategy, lists and rules as arrays; `job_id` names the job across documents."""
    text = lambda n: F.coalesce(text_at(F.col("_s"), n), F.lit(""))
    rows = job_rows.select(job_id.alias("job_id"), get(F.col("job"), "strategy").alias("_s")).withColumn("_m", get(F.col("_s"), "matrix"))
    entries = F.filter(fields(F.col("_m")), lambda e: ~e["key"].isin(RULES))
    lists = F.transform(entries, lambda e: F.struct(
        e["key"].alias("dim"), F.transform(e["value"].try_cast(_LIST), lambda x: F.to_json(x)).alias("values")))

    def rules(name: str) -> Column:
        return F.transform(get(F.col("_m"), name).try_cast(_LIST), lambda r: F.transform(
            fields(r), lambda e: F.struct(e["key"].alias("dim"), F.to_json(e["value"]).alias("value"))))

    return rows.select("job_id", dy.fail_fast(text("fail-fast")).alias("fail_fast"), dy.max_parallel(text("max-parallel")).alias("max_parallel"),
                       F.filter(lists, lambda x: x["values"].isNotNull()).alias("lists"), *[rules(n).alias(n) for n in RULES])


def strategy_tables(rows: DataFrame) -> Strategy:
    """The tables of `strategy_rows`, which are best written first: each table reads them."""
    lists = rows.select("job_id", F.explode("lists").alias("_l")).select("job_id", "_l.dim", "_l.values")
    dims = lists.select("job_id", "dim", F.posexplode("values").alias("pos", "value")).select(
        "job_id", "dim", F.col("pos").cast("bigint").alias("pos"), "value")

    def rules(name: str) -> DataFrame:
        each = rows.select("job_id", F.posexplode(name).alias("rule_pos", "_r"))
        return each.select("job_id", F.col("rule_pos").cast("bigint").alias("rule_pos"), F.inline("_r"))

    return Strategy(rows.select("job_id", "fail_fast", "max_parallel"), dims, lists.filter(F.size("values") == 0).select("job_id").distinct(),
                    rules("exclude"), rules("include"))


def strategy_of(job_rows: DataFrame, job_id: Column) -> Strategy:
    """Strategies of rows with a `job` body; `job_id` names the job across documents.

    Only lists are dimensions; a job without a matrix has no rows in the other tables.
    """
    return strategy_tables(strategy_rows(job_rows, job_id))
