"""Streams over several micro-batches must equal the batch operators over everything."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cilake.operators import loglines as ll
from cilake.operators import writes as wr
from cilake.operators.envstate import final_env
from cilake.plans.catalog import QUERIES
from cilake.plans.registry import Source
from cilake.sources import framing
from cilake.sources.framing import frame_lines
from cilake.streaming import jobs as st
from cilake.streaming.batches import COMPACT, newest_whole, result, state_before


def as_stream(spark, df, order, parts=4):
    """Write `df` as several files in order and read one file per micro-batch."""
    import os
    import time

    path = tempfile.mkdtemp(prefix="run-")
    rows = [r for r in df.orderBy(order).collect()]
    step = len(rows) // parts + 1
    for i in range(parts):
        one = f"{path}/part{i}"
        spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.parquet(one)
        for f in os.listdir(one):
            os.utime(f"{one}/{f}", (time.time() + i * 60 - 600,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").parquet(path)


def root():
    return tempfile.mkdtemp(prefix="run-")


def log(spark):
    rnd = random.Random(1)
    pool = ["::echo::on", "::echo::off", "::add-mask::tok{}", "text tok{} end", "::group::g tok{}", "::set-output name=a::tok{}", "::echo::bad", "x"]
    rows = [(rnd.randrange(3), rnd.randrange(2), i, rnd.choice(pool).format(rnd.randrange(4))) for i in range(160)]
    return spark.createDataFrame(rows, "job_id bigint, step_idx bigint, seq bigint, line string")


def test_commands(spark):
    df, r = log(spark), root()
    st.stream_commands(as_stream(spark, df, "seq"), r)
    want = ll.classify_lines(ll.parse_commands(df)).select("seq", "command", "effect")
    got = spark.read.parquet(f"{r}/out").select("seq", "command", "effect")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_framing_over_batches(spark):
    rnd = random.Random(2)
    rows = [(s, i, "".join(rnd.choice("ab\n") for _ in range(rnd.randrange(0, 5))), False) for i in range(60) for s in range(3)]
    rows += [(1, 10**9, "", True)]
    df = spark.createDataFrame(rows, "stream bigint, seq bigint, chunk string, eof boolean")
    r = root()
    st.stream_framing(as_stream(spark, df, "seq"), r, block_rows=8)
    got = sorted(tuple(x) for x in result(spark, r, "lines").select("stream", "line_no", "line").collect())
    full = frame_lines(df.select("stream", "seq", "chunk"))
    rest = {x.stream: (x.next_line, x.rest) for x in state_before(spark, r, "rest", st.REST, 4).collect()}
    assert 1 not in rest  # the ended stream left no state
    want = [tuple(x) for x in full.collect() if x.stream == 1 or (x.line_no, x.line) != rest[x.stream]]
    assert got == sorted(want)


def test_state_is_compacted(spark):
    parts = COMPACT + 2
    rows = [(s, i, f"a{i}\nb", False) for i in range(parts) for s in range(2)] + [(9, 0, "x\ny", False), (9, 1, "", True)]
    df = spark.createDataFrame(rows, "stream bigint, seq bigint, chunk string, eof boolean")
    r = root()
    st.stream_framing(as_stream(spark, df, "seq", parts), r)
    import os

    batches = len(os.listdir(f"{r}/out/lines"))
    assert batches > COMPACT and os.path.isdir(f"{r}/whole/rest/batch={COMPACT - 1}")
    got = sorted(tuple(x) for x in result(spark, r, "lines").select("stream", "line_no", "line").collect())
    rest = {x.stream: (x.stream, x.next_line, x.rest) for x in state_before(spark, r, "rest", st.REST, batches).collect()}
    assert set(rest) == {0, 1}  # the ended stream left nothing
    full = sorted(tuple(x) for x in frame_lines(df.select("stream", "seq", "chunk")).collect())
    assert got == [x for x in full if x not in rest.values()]
    changed = spark.read.parquet(f"{r}/state/rest/batch={batches - 1}").count()
    assert changed <= 2  # a batch writes what it changed


def test_env(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), i // 9, i, rnd.choice(["env", "env", "output"]), f"K{rnd.randrange(4)}", f"v{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "job_id bigint, step_idx bigint, ord bigint, kind string, key string, value string")
    r = root()
    st.stream_env(as_stream(spark, df, "ord"), r)
    assert sorted(map(tuple, st.read_env(spark, r).collect())) == sorted(map(tuple, final_env(df).collect()))


def test_masking_over_batches(spark):
    df, r = log(spark), root()
    st.stream_masking(as_stream(spark, df, "seq"), r, block_rows=16)
    pick = lambda d: sorted((x.seq, x.sub, x.text) for x in d.collect())
    assert pick(result(spark, r, "console")) == pick(ll.console_view(df))


def test_fail_stop_over_batches(spark):
    df, r = log(spark), root()
    st.stream_fail_stop(as_stream(spark, df, "seq"), r)
    judged = st.judge(df)
    accepted, refused = st.split_at_error(judged, st.first_errors(judged))
    pick = lambda d: sorted(x.seq for x in d.collect())
    assert pick(result(spark, r, "accepted")) == pick(accepted)
    assert pick(result(spark, r, "refused")) == pick(refused)
    assert state_before(spark, r, "failed", st.FAILED, 4).select(F.count(F.lit(1))).first()[0] == st.first_errors(judged).count()


def gated_log(spark):
    rnd = random.Random(6)
    pool = ["::echo::on", "::set-env name=A::x{}", "::set-env name=ACTIONS_ALLOW_UNSECURE_COMMANDS::false", "::add-mask::x{}", "text x{}",
            "::set-output name=a::1", "::set-env name=ACTIONS_ALLOW_UNSECURE_COMMANDS::true"]
    rows = [(i % 4, i // 40, i, rnd.choice(pool).format(rnd.randrange(4))) for i in range(200)]
    initial = [(0, wr.GATE_KEY, "true"), (1, wr.GATE_KEY, "no"), (1, "K", "v")]
    files = [(2, 1, 10**9, "env", wr.GATE_KEY, "1"), (3, 0, 10**9, "env", wr.GATE_KEY, "true"), (3, 2, 10**9, "env", wr.GATE_KEY, "TRUE"), (3, 3, 10**9, "env", wr.GATE_KEY, "0")]
    return (spark.createDataFrame(rows, "job_id bigint, step_idx bigint, seq bigint, line string"),
            spark.createDataFrame(initial, "job_id bigint, key string, value string"),
            spark.createDataFrame(files, "job_id bigint, step_idx bigint, ord bigint, kind string, key string, value string"))


def test_gate_in_streams_as_in_batch(spark):
    df, initial, files = gated_log(spark)
    with_gate = wr.with_gate(df, wr.gate_of_steps(df, initial, files))
    states = {(r.job_id, r.step_idx, r.allowed) for r in with_gate.collect()}
    assert {(0, 4, True), (1, 4, False), (2, 1, False), (2, 2, True), (3, 0, False), (3, 4, False)} <= states
    r = root()
    st.stream_masking(as_stream(spark, df, "seq", 5), r, block_rows=16, initial=initial, files=files)
    pick = lambda d: sorted((x.seq, x.sub, x.text) for x in d.collect())
    assert pick(result(spark, r, "console")) == pick(ll.console_view(with_gate))
    r = root()
    st.stream_fail_stop(as_stream(spark, df, "seq", 5), r, initial=initial, files=files)
    judged = st.judge(with_gate)
    accepted, refused = st.split_at_error(judged, st.first_errors(judged))
    assert judged.filter("error = 'set-env is disabled'").count() > 10
    for name, want in (("accepted", accepted), ("refused", refused)):
        assert sorted(x.seq for x in result(spark, r, name).collect()) == sorted(x.seq for x in want.collect())


def test_closing_lines_are_parsed_out_of_a_batch_once(spark):
    df, initial, files = gated_log(spark)
    lines, closing = st.gated(df, spark.createDataFrame([], st.GATE.schema), initial, files, 16)
    found = closing.inputFiles()
    assert found and all("closing-" in f for f in found)
    assert set(found) <= set(lines.inputFiles())
    want = wr.closing_writes(wr.command_writes(df)).select(*closing.columns)
    assert sorted(closing.collect()) == sorted(want.collect()) and closing.count() > 10


def test_env_is_read_from_the_newest_whole(spark):
    rnd = random.Random(5)
    rows = [(i % 2, i, i, "env", f"K{rnd.randrange(6)}", f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "job_id bigint, step_idx bigint, ord bigint, kind string, key string, value string")
    r = root()
    st.stream_env(as_stream(spark, df, "ord", 7), r, compact=3)
    read = st.read_env(spark, r)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, final_env(df).collect()))
    batches = sorted({int(f.split("batch=")[1].split("/")[0]) for f in spark.read.parquet(f"{r}/out/env").inputFiles()})
    wholes = {int(f.split("batch=")[1].split("/")[0]) for f in spark.read.parquet(f"{r}/whole/env").inputFiles()}
    assert wholes == {b for b in batches if b % 3 == 0} and newest_whole(spark, f"{r}/whole/env") == max(wholes)
    # changes that the newest whole holds are not read again
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "batch#" in plan and f"> {max(wholes)})" in plan


TEXTS = {0: "a\nb", 1: "", 2: "c\n", 3: "\n\n" + "d" * 130, 4: None, 5: "e\n" * 40 + "f", 6: "g" * 64 + "\n" + "h" * 64}


@pytest.mark.parametrize("files", [0, 3])
def test_tables_of_one_file_and_of_a_folder_are_streamed_whole(spark, tmp_path, files):
    table = spark.createDataFrame([(k, t) for k, t in TEXTS.items()], "doc_id bigint, text string")
    path = tmp_path / "in" / "documents.parquet"
    table.repartition(files or 1).write.parquet(str(path))
    (tmp_path / "in" / "labels.parquet").mkdir()
    if not files:  # the table is the file itself
        one = next(path.glob("part-*"))
        path = tmp_path / "one"
        path.mkdir()
        (path / "documents.parquet").write_bytes(one.read_bytes())
    source = Source(spark, str(path if not files else path.parent))
    source.stream("documents", 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, table.collect()))
    split = {k: t.split("\n") for k, t in TEXTS.items() if t}
    lines = lambda n: sorted(map(tuple, QUERIES[n](spark, source.dir).collect()))
    assert lines("t2_stream_framing") == [(k, i, x) for k, t in split.items() for i, x in enumerate(t[:-1])]
    assert lines("t6_stream_close") == [(k, i, x) for k, t in split.items() for i, x in enumerate(t) if x or i < len(t) - 1]

def test_a_batch_is_framed_once_and_leaves_no_shuffle(spark, monkeypatch):
    labels, plain = [], framing.written
    monkeypatch.setattr(framing, "written", lambda df, label, *codec: labels.append(label) or plain(df, label, *codec))
    rows = [(s, i, x, eof) for s in (0, 1, None) for i, (x, eof) in enumerate([("a\nb", False), ("c\nd\ne", False), ("", s == 1)])]
    df = spark.createDataFrame(rows, "stream bigint, seq bigint, chunk string, eof boolean")
    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f.toString() for f in _each(kept.getAllBlocks()) if f.toString().startswith("shuffle_")}
    stream, r = as_stream(spark, df, "seq", 1), root()
    before = shuffles()
    st.stream_framing(stream, r)
    assert labels == ["framed"]
    assert not shuffles() - before
    key = lambda x: (x[0] is None, x)
    got = sorted(map(tuple, result(spark, r, "lines").select("stream", "line_no", "line").collect()), key=key)
    assert got == sorted([(s, i, x) for s in (0, 1, None) for i, x in enumerate(["a", "bc", "d"])] + [(1, 3, "e")], key=key)


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]
