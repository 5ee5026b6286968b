"""Stateful streams as micro-batches over state tables.

Each micro-batch reads the state, runs the batch operators (so a hot job or stream is split over tasks exactly as in
a batch job, with no Python state), and writes its output and the rows of state it changed into folders named by batch
id. State is the merge of changes; every `compact` batches the merge is written whole, and later batches
read that and the changes since, so what a batch writes follows its input, and what it reads stays bounded by the
live state. A batch that is replayed after a failure overwrites the same folders with the same rows, which makes the
result exactly-once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = 16
State = dict[str, DataFrame]
Step = Callable[[DataFrame, State], tuple[State, State]]


@dataclass(frozen=True)
class Kept:
    """One state table: its schema, and how changes (its rows with a `batch`) merge into current rows."""

    schema: str
    merge: Callable[[DataFrame], DataFrame]


def state_before(spark: SparkSession, root: str, name: str, kept: Kept, batch_id: int, compact: int = COMPACT) -> DataFrame:
    """The state that a batch finds; which folders hold it follows from the batch id alone."""
    whole = batch_id // compact * compact - 1
    paths = [f"{root}/state/{name}/batch={b}" for b in range(whole + 1, batch_id)]
    paths += [f"{root}/whole/{name}/batch={whole}"] if whole >= 0 else []
    schema = f"{kept.schema}, batch bigint"
    return kept.merge(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))


def newest_whole(spark: SparkSession, path: str) -> int:
    """Batch of the newest whole table; folders are listed, not read."""
    return max(int(re.findall(r"batch=([0-9]+)/", f)[-1]) for f in spark.read.parquet(path).inputFiles())


def current_rows(spark: SparkSession, wholes: str, changes: str, kept: Kept, whole: int | None, last: int | None = None) -> DataFrame:
    """Current rows from the whole table of a batch (if any) and the changes after it, up to `last`."""
    schema = f"{kept.schema}, batch bigint"
    since = spark.read.schema(schema).parquet(changes).filter(F.col("batch") > (-1 if whole is None else whole))
    since = since if last is None else since.filter(F.col("batch") <= last)
    return kept.merge(since if whole is None else spark.read.schema(schema).option("basePath", wholes).parquet(
        f"{wholes}/batch={whole}").unionByName(since))


def run_batches(stream: DataFrame, root: str, step: Step, states: dict[str, Kept], trigger: dict | None = None,
                compact: int = COMPACT) -> None:
    """Drive the stream. `step(batch, state)` gives (outputs, changes of state) by name.

    `trigger` are the arguments of `DataStreamWriter.trigger`; by default all available input is read and the call returns.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the stream's own session; what a write has shuffled goes with its end, not when the driver's heap is next collected
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        state = {n: state_before(spark, root, n, k, batch_id, compact) for n, k in states.items()}
        outputs, changes = step(batch, state)
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{root}/out/{name}/batch={batch_id}")
        for name, df in changes.items():
            rows = df.withColumn("batch", F.lit(batch_id).cast("bigint"))
            rows.write.mode("overwrite").parquet(f"{root}/state/{name}/batch={batch_id}")
        if (batch_id + 1) % compact == 0:
            for name, kept in states.items():
                changes = spark.read.parquet(f"{root}/state/{name}/batch={batch_id}").select(*state[name].columns)
                merged = kept.merge(state[name].withColumn("batch", F.lit(batch_id - 1).cast("bigint")).unionByName(
                    changes.withColumn("batch", F.lit(batch_id).cast("bigint"))))
                merged.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
                    f"{root}/whole/{name}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def result(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Everything the batches put out under a name, with its `batch`."""
    return spark.read.parquet(f"{root}/out/{name}")
