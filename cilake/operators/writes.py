"""From log lines to the writes that the state operators consume, with the set-env gate in between.

A set-env line counts only where its step may run it: the gate variable is true in the initial env, or was
last set to true by an earlier step. A refused set-env that would open the gate changes nothing, and one that is
allowed finds it open, so set-env lines can only ever close it; that keeps the gate free of recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.functions.dynamic import parse_bool
from cilake.operators import loglines as ll
from cilake.operators.binding import bind
from cilake.operators.envstate import GATE_KEY, unsecure_gate
from cilake.operators.running import BLOCK_ROWS

KINDS = ["env", "output", "state", "path"]


def command_writes(lines: DataFrame) -> DataFrame:
    """`(job_id, step_idx, ord, kind, key, value)` of the well-formed write commands; a path has no key."""
    parsed = ll.classify_lines(ll.parse_commands(lines)).filter(F.col("effect").isin(KINDS))
    good = bind(ll.with_name(parsed), error=ll.error_of()).filter(F.col("error").isNull())
    return good.select("job_id", "step_idx", F.col("seq").alias("ord"), F.col("effect").alias("kind"),
                       F.when(F.col("effect") != "path", F.col("name")).alias("key"), F.col("data").alias("value"))


def gate_of_steps(lines: DataFrame, initial: DataFrame, files: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`(job_id, step_idx, allowed)` for every step that has lines; `files` are writes from command files."""
    return _gate(lines, command_writes(lines), initial, files, block_rows)


def closing_writes(commands: DataFrame) -> DataFrame:
    """Those of the `command_writes` that close the gate: all that a line can do to it."""
    return commands.filter((F.col("kind") == "env") & (F.col("key") == GATE_KEY) & ~F.coalesce(parse_bool(F.col("value")), F.lit(False)))


def gate_after(lines: DataFrame, closing: DataFrame, initial: DataFrame, files: DataFrame | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gate of the steps of `lines` under the known closing lines and the writes of files."""
    known = closing if files is None else closing.unionByName(files.select(*closing.columns))
    return unsecure_gate(lines, known, initial, block_rows)


def _gate(lines: DataFrame, commands: DataFrame, initial: DataFrame, files: DataFrame | None, block_rows: int) -> DataFrame:
    return gate_after(lines, closing_writes(commands), initial, files, block_rows)


def writes_of(lines: DataFrame, initial: DataFrame, files: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All accepted writes of lines and command files, ready for final_env, step_outputs, path_list and the like."""
    commands = command_writes(lines)
    gate = _gate(lines, commands, initial, files, block_rows)
    accepted = commands.join(gate, ["job_id", "step_idx"]).filter((F.col("kind") != "env") | F.col("allowed")).drop("allowed")
    return accepted if files is None else accepted.unionByName(files.select(*accepted.columns))


def with_gate(lines: DataFrame, gate: DataFrame) -> DataFrame:
    """`lines` with the `allowed` of their step; steps the gate does not know are closed."""
    return lines.join(gate, ["job_id", "step_idx"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
