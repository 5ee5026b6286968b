"""Byte chunks to lines, and log text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cilake.operators.running import BLOCK_ROWS, Run, running
from cilake.session import written


def number_fragments(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Chunks `(stream, seq, chunk)` with `_base`, the line number their first fragment belongs to."""
    breaks = (F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"), F.lit("")))).cast("bigint")
    out = running(chunks, ["stream"], "seq", [Run("_base", "sum", breaks)], inclusive=False, block_rows=block_rows)
    return out.withColumn("_base", F.coalesce("_base", F.lit(0).cast("bigint")))


def fragments(numbered: DataFrame) -> DataFrame:
    """Rows `(stream, line_no, seq, frag, closed, inner)`; `closed`: a line break ends the fragment."""
    parts = F.split("chunk", "\n", -1)
    f = numbered.withColumn("_n", F.size(parts)).select("*", F.posexplode(parts).alias("_pos", "frag"))
    return f.select(
        "stream",
        (F.col("_base") + F.col("_pos")).alias("line_no"),
        "seq",
        "frag",
        (F.col("_pos") < F.col("_n") - 1).alias("closed"),
        ((F.col("_pos") > 0) & (F.col("_pos") < F.col("_n") - 1)).alias("inner"),
    )


def frame_lines(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lines `(stream, line_no, line)`: a partial line is carried to the next chunk; at the end a
    non-empty rest is a line, an empty one is not.

    Only the first and last fragment of a chunk can continue in another chunk, so only those are
    grouped; lines lying inside one chunk pass straight through.
    """
    pieces = fragments(number_fragments(chunks, block_rows))
    inner = pieces.filter("inner").select("stream", "line_no", F.col("frag").alias("line"))
    edges = pieces.filter("NOT inner").groupBy("stream", "line_no").agg(
        F.expr("listagg(frag, '') within group (order by seq)").alias("line"), F.max("closed").alias("_closed")
    )
    return inner.unionByName(
        edges.filter(F.col("_closed") | (F.length("line") > 0)).select("stream", "line_no", "line")
    )


def frame_batch(chunks: DataFrame, carry: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows `(stream, line_no, line, closed)` of a batch; the line that is still open in a stream is not `closed`.

    `carry`: the rest that earlier batches left of a stream, and the number of the line that it begins. Chunks are shuffled and
    sorted once, and the rows written, as closed and open lines go different ways.
    """
    # carried text goes before all chunks of the batch
    before = carry.select("stream", F.lit(-1).cast("bigint").alias("seq"), F.col("rest").alias("chunk"))
    pieces = fragments(number_fragments(before.unionByName(chunks.select("stream", "seq", "chunk")), block_rows))
    base = carry.select("stream", F.col("next_line").alias("_base"))
    shifted = pieces.join(base, "stream", "left").withColumn(
        "line_no", F.col("line_no") + F.coalesce("_base", F.lit(0).cast("bigint"))).drop("_base")
    inner = shifted.filter("inner").select("stream", "line_no", F.col("frag").alias("line"), "closed")
    edges = shifted.filter("NOT inner").groupBy("stream", "line_no").agg(
        F.expr("listagg(frag, '') within group (order by seq)").alias("line"), F.max("closed").alias("closed"))
    return written(inner.unionByName(edges), "framed", "zstd")


def read_log_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text logs, one row per line, with the file they come from."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Whole step summary files; an empty one is ''."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.coalesce("value", F.lit("")).alias("summary")
    )
