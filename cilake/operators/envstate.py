"""Job state folded from key/value writes: env, outputs, states, PATH, layers, gates.

Writes are rows `(job_id, step_idx, ord, kind, key, value)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.functions.dynamic import parse_bool
from cilake.operators.running import BLOCK_ROWS, Run, last_per_key, ordered_text, running

# Keys that may not be written, by kind of file, and the gate of set-env.
BLOCKED = [("env", "NODE_OPTIONS")]
GATE_KEY = "ACTIONS_ALLOW_UNSECURE_COMMANDS"


def is_blocked(kind: Column, key: Column) -> Column:
    hit = F.lit(False)
    for k, name in BLOCKED:
        hit = hit | ((kind == k) & (key == name))
    return hit


def drop_blocked(writes: DataFrame, file_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept writes, failed files): one blocked key rejects its whole file."""
    bad = writes.filter(is_blocked(F.col("kind"), F.col("key")))
    failed = bad.groupBy(*file_keys).agg(F.min("key").alias("blocked_key"))
    return writes.join(failed.select(*file_keys), file_keys, "left_anti"), failed


def final_env(writes: DataFrame) -> DataFrame:
    """Last write per (job, key), in step and file order."""
    return last_per_key(writes.filter(F.col("kind") == "env"), ["job_id", "key"], ["step_idx", "ord"])


def step_values(writes: DataFrame, kind: str) -> DataFrame:
    """Last write per (job, step, key) of one kind: outputs or saved states."""
    return last_per_key(writes.filter(F.col("kind") == kind), ["job_id", "step_idx", "key"], ["ord"])


def step_outputs(writes: DataFrame) -> DataFrame:
    return step_values(writes, "output")


def step_states(writes: DataFrame) -> DataFrame:
    return step_values(writes, "state")


def as_map(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """De-duplicated (key, value) rows to one map per group, for presentation."""
    return values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(name))


def step_summaries(files: DataFrame) -> DataFrame:
    """One text per step: the latest file of the step; missing or empty is ''."""
    latest = files.groupBy("job_id", "step_idx").agg(F.max_by("content", "ord").alias("summary"))
    return latest.withColumn("summary", F.coalesce("summary", F.lit("")))


def env_asof_step(probes: DataFrame, writes: DataFrame, initial: DataFrame,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Value of a key as a step sees it, for probes `(job_id, step_idx, key)`.

    Writes of earlier steps overlay the initial env `(job_id, key, value)`; a step never sees its
    own writes. This is an as-of join: probes and writes run through one ordered pass per
    (job, key), so no step is paired with all writes of its job.
    """
    asked = probes.select("job_id", "step_idx", "key").distinct().withColumn("_asked", F.lit(True))
    last = last_per_key(writes.filter(F.col("kind") == "env"), ["job_id", "step_idx", "key"], ["ord"])
    marks = asked.join(last, ["job_id", "step_idx", "key"], "full_outer")
    seen = running(marks, ["job_id", "key"], "step_idx", [Run("_seen", "last", F.col("value"))], inclusive=False,
                   block_rows=block_rows).filter("_asked")
    base = initial.select("job_id", "key", F.col("value").alias("_initial"))
    return seen.join(base, ["job_id", "key"], "left").select(
        "job_id", "step_idx", "key", F.coalesce("_seen", "_initial").alias("value"),
        F.col("_initial").alias("initial")
    )


def unsecure_gate(steps: DataFrame, writes: DataFrame, initial: DataFrame,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per (job, step): may set-env run? True if the gate variable parses as true in the initial
    env, or as true in the env written by earlier steps."""
    probes = steps.select("job_id", "step_idx", F.lit(GATE_KEY).alias("key"))
    gate = lambda df: df.filter(F.col("key") == GATE_KEY)
    seen = env_asof_step(probes, gate(writes), gate(initial), block_rows)
    ok = lambda c: F.coalesce(parse_bool(F.col(c)), F.lit(False))
    return seen.select("job_id", "step_idx", (ok("value") | ok("initial")).alias("allowed"))


def path_entries(entries: DataFrame) -> DataFrame:
    """Distinct non-empty PATH entries with their latest position: re-adding moves to the end."""
    return entries.filter(F.col("entry") != "").groupBy("job_id", "entry").agg(F.max("ord").alias("ord"))


def path_list(entries: DataFrame, original: str = "/usr/bin:/bin", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Effective PATH per job: newest entry first, then the original PATH."""
    newest = path_entries(entries).withColumn("_back", -F.col("ord"))
    joined = ordered_text(newest, ["job_id"], "_back", "entry", ":", "path", block_rows=block_rows)
    return joined.withColumn("path", F.concat_ws(":", "path", F.lit(original)))


def overlay(layers: DataFrame, keys: list[str], priority: str = "priority") -> DataFrame:
    """Union of layered maps in rows; the highest priority wins per key."""
    return last_per_key(layers, [*keys, "key"], [priority])


def contexts(layers: DataFrame, keys: list[str], priority: str = "priority") -> DataFrame:
    """One env map per evaluation, taken whole from the innermost layer that has any entry."""
    best = layers.groupBy(*keys).agg(F.max(priority).alias(priority))
    return layers.join(best, [*keys, priority], "left_semi").select(*keys, priority, "key", "value")
