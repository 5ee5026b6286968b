"""Console text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def console_text(view: DataFrame, text: str = "text") -> DataFrame:
    """One value per printed row, without its own last line break (the writer adds one)."""
    return view.select(F.regexp_replace(text, r"\n\z", "").alias("value"))


def write_console(view: DataFrame, path: str, text: str = "text") -> None:
    """Console text of each job, in order, under `path`; files are cut by range of (job, seq, sub)."""
    by = [c for c in ("job_id", "seq", "sub") if c in view.columns]
    ordered = view.repartitionByRange(*by).sortWithinPartitions(*by) if by else view
    console_text(ordered, text).write.mode("append").text(path)
