"""The streaming jobs: command extraction, framing, env, masking with echo, fail-stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cilake.operators import loglines as ll
from cilake.operators.binding import bind
from cilake.operators.running import BLOCK_ROWS
from cilake.operators import writes as wr
from cilake.session import written
from cilake.sources.framing import frame_batch
from cilake.streaming.batches import COMPACT, Kept, current_rows, newest_whole, run_batches


def stream_commands(lines: DataFrame, root: str, trigger: dict | None = None) -> None:
    """Stateless: lines to classified commands, appended to `root/out`."""
    parsed = ll.classify_lines(ll.parse_commands(lines))
    query = parsed.writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


#: The partial last line of a stream; an ended stream leaves none.
REST = Kept("stream bigint, rest string, next_line bigint, ended boolean", lambda rows: rows.groupBy("stream").agg(
    F.max_by(F.struct("rest", "next_line", "ended"), "batch").alias("_s")).select("stream", "_s.*").filter("NOT ended"))


def stream_framing(chunks: DataFrame, root: str, block_rows: int = BLOCK_ROWS, trigger: dict | None = None) -> None:
    """Chunks `(stream, seq, chunk, eof)` to output `lines (stream, line_no, line)`.

    The partial last line of each stream is the state. A row with `eof` ends its stream: a
    non-empty rest becomes its last line and the state goes.
    """

    def step(batch, state):
        # read by several jobs below; a batch of a stream is computed anew for each
        batch = written(batch, "chunks")
        here = batch.select("stream").distinct()
        carry = state["rest"].join(here, "stream", "left_semi")
        ended = batch.filter("eof").select("stream").distinct()
        framed = frame_batch(batch, carry, block_rows)
        open_ = framed.filter("NOT closed").join(ended.withColumn("ended", F.lit(True)), "stream", "left")
        flushed = open_.filter(F.col("ended") & (F.length("line") > 0))
        rest = open_.select("stream", F.col("line").alias("rest"), F.col("line_no").alias("next_line"),
                            F.coalesce("ended", F.lit(False)).alias("ended"))
        lines = framed.filter("closed").select("stream", "line_no", "line").unionByName(flushed.select("stream", "line_no", "line"))
        return {"lines": lines}, {"rest": rest}

    run_batches(chunks, root, step, {"rest": REST}, trigger)


ENV = Kept("job_id bigint, key string, value string",
           lambda rows: rows.groupBy("job_id", "key").agg(F.max_by("value", "batch").alias("value")))


def stream_env(writes: DataFrame, root: str, trigger: dict | None = None, compact: int = COMPACT) -> None:
    """Last-write-wins env per (job, key), kept in Spark's own aggregation state.

    Each batch writes the keys it changed; the first and each `compact`-th after it also write the env whole, from the whole one
    before and the changes since. `read_env` reads the newest whole env and the changes after it.
    """
    agg = writes.filter(F.col("kind") == "env").groupBy("job_id", "key").agg(
        F.max(F.struct("step_idx", "ord", "value")).alias("last")).select("job_id", "key", "last.value")

    def one(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(f"{root}/out/env/batch={batch_id}")
        if batch_id % compact == 0:
            whole = batch_id - compact if batch_id else None
            env = current_rows(spark, f"{root}/whole/env", f"{root}/out/env", ENV, whole, batch_id)
            env.write.mode("overwrite").parquet(f"{root}/whole/env/batch={batch_id}")

    query = agg.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint").trigger(
        **(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def read_env(spark: SparkSession, root: str) -> DataFrame:
    """The env after the last batch; what it reads follows the live keys and at most `compact` batches of changes."""
    return current_rows(spark, f"{root}/whole/env", f"{root}/out/env", ENV, newest_whole(spark, f"{root}/whole/env"))


GATE = Kept("job_id bigint, step_idx bigint, ord bigint, value string", lambda rows: rows.groupBy("job_id", "step_idx").agg(
    F.max(F.struct("ord", "value")).alias("_w")).select("job_id", "step_idx", "_w.*"))


def gated(batch: DataFrame, closed: DataFrame, initial: DataFrame, files: DataFrame | None,
          block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(`batch` with `allowed`, its lines that close the gate): as `writes.with_gate`, over the lines of all batches so far.

    `closed` is the state. `initial` and `files` are tables; steps of a batch must find the files of earlier steps in them.
    """
    # read by the gate and by the change of state; these few rows are parsed out of the batch once
    new = written(wr.closing_writes(wr.command_writes(batch)), "closing")
    here = batch.select("job_id").distinct()
    known = closed.join(here, "job_id", "left_semi").withColumns({"kind": F.lit("env"), "key": F.lit(wr.GATE_KEY)}).unionByName(new)
    gate = wr.gate_after(batch, known, initial, files, block_rows)
    return wr.with_gate(batch, gate), new.select("job_id", "step_idx", "ord", "value")


MASKS = Kept("job_id bigint, mask string, mask_seq bigint",
             lambda rows: rows.groupBy("job_id", "mask").agg(F.min("mask_seq").alias("mask_seq")))
ECHO = Kept("job_id bigint, step_idx bigint, flag int",
            lambda rows: rows.groupBy("job_id", "step_idx").agg(F.max_by("flag", "batch").alias("flag")))


def stream_masking(lines: DataFrame, root: str, *, debug: bool = False, block_rows: int = BLOCK_ROWS,
                   trigger: dict | None = None, initial: DataFrame | None = None, files: DataFrame | None = None) -> None:
    """Console rows, masked, to output `console`; state: masks seen per job, echo flag per step, lines that closed the gate.

    Later batches hold later lines of a job. With `initial` (and `files`) a refused set-env is not echoed (see `gated`); without
    it every set-env counts. A batch is parsed once.
    """

    def step(batch, state):
        lines, closing = (batch, None) if initial is None else gated(batch, state["gate"], initial, files, block_rows)
        flagged = written(ll.echo_flags(lines, block_rows), "flagged")
        new = ll.masks_of(flagged)
        masks = state["masks"].join(flagged.select("job_id").distinct(), "job_id", "left_semi").unionByName(new).groupBy(
            "job_id", "mask").agg(F.min("mask_seq").alias("mask_seq"))
        old = state["echo"].select("job_id", "step_idx", F.col("flag").alias("_old"))
        seen = flagged.join(old, ["job_id", "step_idx"], "left").withColumn(
            "echo", F.coalesce("flag", "_old", F.lit(0)) == 1).drop("flag", "_old")
        view = ll.mask_lines(ll.console_rows(seen, debug), masks, "text", keys=["job_id", "seq", "sub"])
        latest = bind(flagged.drop("flag"), _flag=ll.echo_flag()).filter(F.col("_flag").isNotNull()).groupBy("job_id", "step_idx").agg(
            F.max_by("_flag", "seq").alias("flag"))
        return {"console": view}, {"masks": new, "echo": latest} | ({} if closing is None else {"gate": closing})

    run_batches(lines, root, step, {"masks": MASKS, "echo": ECHO} | ({} if initial is None else {"gate": GATE}), trigger)


def split_at_error(judged: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): rows before the first error of their step, and rows after it."""
    joined = judged.join(first, ["job_id", "step_idx"], "left")
    before = F.col("error_seq").isNull() | (F.col("seq") < F.col("error_seq"))
    accepted = joined.filter(before).drop("error_seq", "first_error")
    refused = joined.filter(F.col("seq") > F.col("error_seq")).drop("error_seq", "first_error")
    return accepted, refused


def first_errors(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("error").isNotNull()).groupBy("job_id", "step_idx").agg(
        F.min("seq").alias("error_seq"), F.min_by("error", "seq").alias("first_error"))


def judge(lines: DataFrame) -> DataFrame:
    """Lines with `effect` and `error`; an `allowed` column of the lines tells whether set-env may run, and goes."""
    classified = ll.with_name(ll.classify_lines(ll.parse_commands(lines)))
    allowed = F.col("allowed") if "allowed" in lines.columns else None
    return bind(classified, error=ll.error_of(allowed)).select(*[c for c in lines.columns if c != "allowed"], "effect", "error")


FAILED = Kept("job_id bigint, step_idx bigint, error_seq bigint, first_error string",
              lambda rows: rows.groupBy("job_id", "step_idx").agg(
                  F.min_by("first_error", "error_seq").alias("first_error"), F.min("error_seq").alias("error_seq")))


def stream_fail_stop(lines: DataFrame, root: str, trigger: dict | None = None, *, initial: DataFrame | None = None,
                     files: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> None:
    """After its first error a step accepts nothing more: outputs `accepted` and `refused`; the first
    error of each step is kept as state. With `initial` (and `files`) a refused set-env is an error (see `gated`)."""

    def step(batch, state):
        here, closing = (batch, None) if initial is None else gated(batch, state["gate"], initial, files, block_rows)
        judged = written(judge(here), "judged")
        new = first_errors(judged)
        failed = state["failed"].unionByName(new).groupBy("job_id", "step_idx").agg(
            F.min_by("first_error", "error_seq").alias("first_error"), F.min("error_seq").alias("error_seq"))
        accepted, refused = split_at_error(judged, failed)
        return {"accepted": accepted, "refused": refused}, {"failed": new} | ({} if closing is None else {"gate": closing})

    run_batches(lines, root, step, {"failed": FAILED} | ({} if initial is None else {"gate": GATE}), trigger)
