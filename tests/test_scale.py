"""Steps whose cost may not grow faster than their input."""

from pyspark.sql import functions as F

from cilake.operators import matrix as mx
from cilake.plans.registry import Source
from cilake.sources import kvfiles
from cilake.streaming import jobs as st
from cilake.streaming.batches import result


def test_matrix_joins_are_not_broadcast(spark, capsys):
    dims = spark.createDataFrame([(1, "os", 0, "l"), (1, "os", 1, "w"), (None, "os", 0, "l")], "job_id bigint, dim string, pos bigint, value string")
    rules = spark.createDataFrame([(1, 0, "os", "l"), (1, 0, "flag", "f")], "job_id bigint, rule_pos bigint, dim string, value string")
    product = mx.matrix_product(dims)
    frames = [product, mx.matrix_exclude(product, rules.filter("dim = 'os'"), dims), mx.matrix_include(product, rules, dims),
              mx.matrix_extra(dims.select("job_id"), product, rules, dims), mx.strategy_totals(product)]
    for df in frames:
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out
    assert sorted(map(tuple, frames[2].collect())) == [(1, 0, "flag", "f"), (1, 0, "os", "l"), (1, 1, "os", "w")]


def test_chunks_of_a_batch_are_made_once_and_whole(spark, tmp_path, monkeypatch):
    texts = {1: "é\n" * 70 + "x" * 200, 2: "", 3: None, 4: "y" * 64, 5: "\r\n\U0001f600" * 64 + "end"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    source = Source(spark, str(tmp_path / "in"))
    chunks = source.ad("CHUNK")
    assert sorted(map(tuple, chunks.collect())) == [
        (k, i, t[i * 64:i * 64 + 64]) for k, t in texts.items() if t for i in range((len(t) - 1) // 64 + 1)]
    chunks.withColumn("eof", F.lit(False)).write.parquet(str(tmp_path / "chunks"))
    labels, plain = [], st.written
    monkeypatch.setattr(st, "written", lambda df, label: labels.append(label) or plain(df, label))
    stream = spark.readStream.schema("stream bigint, seq bigint, chunk string, eof boolean").parquet(str(tmp_path / "chunks"))
    st.stream_framing(stream, str(tmp_path / "root"))
    assert labels == ["chunks"]
    got = {(r.stream, r.line_no): r.line for r in result(spark, str(tmp_path / "root"), "lines").collect()}
    assert got == {(k, i): line for k, t in texts.items() if t for i, line in enumerate(t.split("\n")[:-1])}


def test_appended_files_are_bounded(spark, tmp_path):
    n = 2 * kvfiles.FILE_PAIRS + 1
    pairs = spark.range(0, n, 1, 1).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("v\n"), "id").alias("value"))
    kvfiles.append_kv_rows(pairs, str(tmp_path / "kv"))
    assert len(list((tmp_path / "kv").glob("part-*"))) == 3
    files = spark.read.text(str(tmp_path / "kv"), wholetext=True).select(F.lit("output").alias("kind"), F.col("value").alias("content"))
    back = kvfiles.parse_kv_files(files)
    assert back.filter("error IS NULL").select("key", "value").exceptAll(pairs).isEmpty() and back.count() == n
