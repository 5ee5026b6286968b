"""Log records `(run_id, ts, level, msg, src)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.functions.text import level_rank, parse_level


def level_filter(records: DataFrame, minimum: str) -> DataFrame:
    """Records at or above a level."""
    return records.filter(level_rank(parse_level(F.col("level"))) >= level_rank(F.lit(minimum)))


def elapsed(records: DataFrame) -> DataFrame:
    """Add microseconds since the first record of the run.

    The start is one aggregate per run (combined before the shuffle) joined back, so a run is
    never sorted or gathered in one task.
    """
    start = records.groupBy("run_id").agg(F.min("ts").alias("_start"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return records.join(start, "run_id").withColumn("elapsed_us", micros("ts") - micros("_start")).drop("_start")


def record_text(records: DataFrame, fmt: str = "json") -> DataFrame:
    """Records as one text column: JSON, or `key=value` pairs."""
    names = records.columns
    if fmt == "json":
        text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    else:
        text = F.concat_ws(" ", *[F.concat(F.lit(n + "="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    return records.select(text.alias("value"))


def write_records(records: DataFrame, path: str, fmt: str = "json") -> None:
    record_text(records, fmt).write.mode("append").text(path)
