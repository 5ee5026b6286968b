"""Registered queries: framing, log commands, console, masking, streams over logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cilake.functions import text as tx
from cilake.operators import envstate as es
from cilake.operators import loglines as ll
from cilake.operators import writes as wr
from cilake.plans.registry import Source, query
from cilake.session import shared_dir
from cilake.sources import framing, sinks
from cilake.streaming import jobs as st
from cilake.streaming.batches import result

_LINES = """
WITH c AS ({CHUNK}), whole AS (SELECT stream, string_agg(chunk, '' ORDER BY seq) AS text FROM c GROUP BY stream),
p AS (SELECT stream, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
  len(string_split(text, chr(10))) AS n FROM whole)
SELECT stream, CAST(line_no AS BIGINT) AS line_no, line FROM p WHERE NOT (line = '' AND line_no = n - 1)"""


@query("s1_frame_lines", _LINES)
def _(s: Source):
    return framing.frame_lines(s.ad("CHUNK"))


@query("s2_read_log_lines", "SELECT line FROM ({LOG})")
def _(s: Source):
    # log text files as another system would leave them, read back line by line
    path = shared_dir(s.spark, "logs")
    s.ad("LOG").select("line").write.text(path)
    return framing.read_log_lines(s.spark, path).select("line")


@query("l1_parse_commands", "SELECT job_id, seq, form, command, prop_text, data, raw FROM ({PARSED})")
def _(s: Source):
    return ll.parse_commands(s.ad("LOG")).select("job_id", "seq", "form", "command", "prop_text", "data", "raw")


@query("l2_v2_commands", "SELECT job_id, seq, command, data FROM ({PARSED}) WHERE form = 'v2'")
def _(s: Source):
    return ll.parse_commands(s.ad("LOG")).filter("form = 'v2'").select("job_id", "seq", "command", "data")


@query("l3_v1_commands", "SELECT job_id, seq, command, data FROM ({PARSED}) WHERE form = 'v1'")
def _(s: Source):
    return ll.parse_commands(s.ad("LOG")).filter("form = 'v1'").select("job_id", "seq", "command", "data")


@query("l4_command_props", """
WITH p AS (SELECT job_id, seq, form, unnest(string_split(prop_text, CASE form WHEN 'v2' THEN ',' ELSE ';' END)) AS p FROM ({PARSED}) WHERE form IS NOT NULL),
kv AS (SELECT job_id, seq, form, split_part(p, '=', 1) AS key, substr(p, instr(p, '=') + 1) AS value FROM p WHERE contains(p, '='))
SELECT job_id, seq, key, CASE form WHEN 'v2' THEN replace(replace(replace(replace(replace(value, '%0D', chr(13)), '%0A', chr(10)), '%3A', ':'), '%2C', ','), '%25', '%')
  ELSE replace(replace(replace(replace(replace(value, '%3B', ';'), '%0D', chr(13)), '%0A', chr(10)), '%5D', ']'), '%25', '%') END AS value
FROM kv WHERE value <> ''""")
def _(s: Source):
    return ll.command_props(ll.parse_commands(s.ad("LOG"))).select("job_id", "seq", "key", "value")


@query("l5_known_commands", """
SELECT job_id, seq, regexp_extract(line, '::([a-z-]+)', 1) AS command FROM ({LOG})
WHERE regexp_extract(line, '::([a-z-]+)', 1) IN ('set-env', 'set-output', 'save-state', 'add-mask', 'add-path', 'add-matcher', 'remove-matcher', 'debug', 'warning', 'error', 'notice', 'group', 'endgroup', 'echo')""")
def _(s: Source):
    name = F.regexp_extract("line", "::([a-z-]+)", 1)
    return s.ad("LOG").filter(ll.known_commands(name)).select("job_id", "seq", name.alias("command"))


_EFFECT = """CASE command WHEN 'set-env' THEN 'env' WHEN 'set-output' THEN 'output' WHEN 'save-state' THEN 'state' WHEN 'add-mask' THEN 'mask'
  WHEN 'add-path' THEN 'path' WHEN 'add-matcher' THEN 'matcher' WHEN 'remove-matcher' THEN 'matcher' WHEN 'debug' THEN 'debug' WHEN 'warning' THEN 'annotation'
  WHEN 'error' THEN 'annotation' WHEN 'notice' THEN 'annotation' WHEN 'group' THEN 'group' WHEN 'endgroup' THEN 'endgroup' WHEN 'echo' THEN 'echo' ELSE 'text' END"""


@query("l6_classify_lines", f"SELECT job_id, {_EFFECT} AS effect, count(*) AS n FROM ({{PARSED}}) GROUP BY ALL")
def _(s: Source):
    out = ll.classify_lines(ll.parse_commands(s.ad("LOG")))
    return out.groupBy("job_id", "effect").agg(F.count(F.lit(1)).alias("n"))


_ERROR = """CASE WHEN command = 'set-env' AND regexp_extract(prop_text, 'name=([^,]*)', 1) = '' THEN 'environment variable name cannot be empty'
  WHEN command = 'set-output' AND regexp_extract(prop_text, 'name=([^,]*)', 1) = '' THEN 'output variable name cannot be empty'
  WHEN command = 'add-path' AND data = '' THEN 'path cannot be empty'
  WHEN command = 'echo' AND upper(data) NOT IN ('ON', 'OFF') THEN 'echo command accepts only ''on'' or ''off''' END"""


@query("l7_command_errors", f"SELECT job_id, seq, error FROM (SELECT *, {_ERROR} AS error FROM ({{PARSED}})) WHERE error IS NOT NULL")
def _(s: Source):
    return ll.command_errors(s.ad("LOG")).select("job_id", "seq", "error")


# jobs whose set-env lines count: no line and no file of the log changes the gate
_OPEN = "(SELECT job_id FROM ({INITIAL}) WHERE key = 'ACTIONS_ALLOW_UNSECURE_COMMANDS')"


def _gated(s: Source):
    lines = s.ad("LOG")
    return wr.with_gate(lines, wr.gate_of_steps(lines, s.ad("INITIAL")))


@query("l7_gated_errors", f"""SELECT job_id, seq, CASE WHEN command = 'set-env' AND job_id NOT IN {_OPEN} THEN 'set-env is disabled' ELSE error END AS error
FROM (SELECT *, {_ERROR} AS error FROM ({{PARSED}})) WHERE error IS NOT NULL OR (command = 'set-env' AND job_id NOT IN {_OPEN})""")
def _(s: Source):
    return ll.command_errors(_gated(s)).select("job_id", "seq", "error")


# well-formed write commands
_SET = """(SELECT job_id, step_idx, seq, command, CASE WHEN command <> 'add-path' THEN regexp_extract(prop_text, 'name=([^,]*)', 1) END AS key, data AS value FROM ({PARSED})
  WHERE command IN ('set-env', 'set-output') AND regexp_extract(prop_text, 'name=([^,]*)', 1) <> '' OR command = 'add-path' AND data <> '')"""


@query("e_lines_to_writes", f"""
SELECT job_id, step_idx, seq AS ord, CASE command WHEN 'set-env' THEN 'env' WHEN 'set-output' THEN 'output' ELSE 'path' END AS kind, key, value FROM {_SET}
WHERE command <> 'set-env' OR job_id IN {_OPEN}""")
def _(s: Source):
    return wr.writes_of(s.ad("LOG"), s.ad("INITIAL"))


@query("e_lines_to_final_env", f"""
SELECT job_id, key, arg_max(value, seq) AS value FROM {_SET} WHERE command = 'set-env' AND job_id IN {_OPEN} GROUP BY job_id, key""")
def _(s: Source):
    return es.final_env(wr.writes_of(s.ad("LOG"), s.ad("INITIAL")))


@query("e_lines_and_files_to_env", f"""
WITH c AS (SELECT job_id, step_idx, seq AS ord, key, value FROM {_SET} WHERE command = 'set-env'),
w AS (SELECT job_id, step_idx, ord, value FROM ({{KV}}) WHERE kind = 'env' AND key = 'ACTIONS_ALLOW_UNSECURE_COMMANDS'),
g AS (SELECT c.job_id, c.step_idx, arg_max(w.value, struct_pack(a := w.step_idx, b := w.ord)) AS seen FROM (SELECT DISTINCT job_id, step_idx FROM c) c
  LEFT JOIN w ON w.job_id = c.job_id AND w.step_idx < c.step_idx GROUP BY ALL),
a AS (SELECT c.* FROM c JOIN g USING (job_id, step_idx) WHERE job_id IN {_OPEN} OR seen IN ('1', 't', 'T', 'TRUE', 'true', 'True')
  UNION ALL SELECT job_id, step_idx, ord + 1000000000, key, value FROM ({{KV}}) WHERE kind = 'env')
SELECT job_id, key, arg_max(value, struct_pack(a := step_idx, b := ord)) AS value FROM a GROUP BY job_id, key""")
def _(s: Source):
    # a step's files are read after its lines
    files = s.ad("KV").withColumn("ord", F.col("ord") + 1_000_000_000)
    return es.final_env(wr.writes_of(s.ad("LOG"), s.ad("INITIAL"), files))


@query("l8_debug_lines", """
SELECT job_id, seq, CAST(0 AS BIGINT) AS sub, concat('##[debug] ', raw) AS text FROM ({PARSED}) WHERE command = 'debug'""")
def _(s: Source):
    out = ll.debug_lines(s.ad("LOG"))
    return out.select("job_id", "seq", F.col("sub").cast("bigint").alias("sub"), "text")


_ECHO = """SELECT *, coalesce(last_value(CASE WHEN command = 'echo' AND upper(data) = 'ON' THEN true WHEN command = 'echo' AND upper(data) = 'OFF' THEN false END IGNORE NULLS)
  OVER (PARTITION BY job_id, step_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS echo FROM ({PARSED})"""
_HIDE = "(SELECT job_id, data AS mask, min(seq) AS mask_seq FROM ({PARSED}) WHERE command = 'add-mask' AND data <> '' GROUP BY ALL)"
# every mask of the job that occurs in the line and came earlier, the longest first
_MASKED = """SELECT l.job_id, l.seq, l.sub, CASE WHEN count(m.mask) = 0 THEN any_value(l.text) ELSE
  list_reduce(list_prepend(any_value(l.text), list(m.mask ORDER BY length(m.mask) DESC, m.mask)), lambda acc, x: replace(acc, x, '***')) END AS text
  FROM lines l LEFT JOIN masks m ON l.job_id = m.job_id AND m.mask_seq < l.seq AND contains(l.text, m.mask) GROUP BY l.job_id, l.seq, l.sub"""


# the whole console, masked
_CONSOLE = f"""
WITH e AS ({_ECHO}), lines AS (
  SELECT job_id, seq, CAST(0 AS BIGINT) AS sub, raw AS text FROM e WHERE echo AND command IN ('set-env', 'set-output', 'save-state', 'add-path', 'group', 'endgroup', 'echo')
  UNION ALL SELECT job_id, seq, 1, CASE WHEN command IS NULL THEN line WHEN command = 'group' THEN concat('##[group]', data) ELSE concat('##[endgroup]', data) END
  FROM e WHERE command IS NULL OR command IN ('group', 'endgroup')), masks AS {_HIDE}
{_MASKED}"""


@query("l9_console_view", _CONSOLE)
def _(s: Source):
    view = ll.console_view(s.ad("LOG"))
    return view.select("job_id", "seq", F.col("sub").cast("bigint").alias("sub"), "text")


@query("s11_write_console", f"SELECT concat(job_id, ' ', text) AS line FROM ({_CONSOLE})")
def _(s: Source):
    # the console goes out as text, each row behind its job, and is read back line by line
    path = shared_dir(s.spark, "console")
    view = ll.console_view(s.ad("LOG"))
    sinks.write_console(view.withColumn("text", F.concat_ws(" ", F.col("job_id").cast("string"), "text")), path)
    return framing.read_log_lines(s.spark, path).select("line")


_GATED_CONSOLE = f"""
WITH e AS ({_ECHO}), lines AS (
  SELECT job_id, seq, CAST(0 AS BIGINT) AS sub, raw AS text FROM e WHERE echo AND command IN ('set-env', 'set-output', 'save-state', 'add-path', 'group', 'endgroup', 'echo')
  AND (command <> 'set-env' OR job_id IN {_OPEN})
  UNION ALL SELECT job_id, seq, 1, CASE WHEN command IS NULL THEN line WHEN command = 'group' THEN concat('##[group]', data) ELSE concat('##[endgroup]', data) END
  FROM e WHERE command IS NULL OR command IN ('group', 'endgroup')), masks AS {_HIDE}
{_MASKED}"""


@query("l9_gated_view", _GATED_CONSOLE)
def _(s: Source):
    view = ll.console_view(_gated(s))
    return view.select("job_id", "seq", F.col("sub").cast("bigint").alias("sub"), "text")


@query("l10_annotations", """
SELECT job_id, seq, command AS level, data AS message, CASE WHEN form = 'v2' THEN regexp_extract(prop_text, 'file=([^,]*)', 1) END AS file,
  CASE WHEN form = 'v2' THEN regexp_extract(prop_text, 'line=([^,]*)', 1) END AS file_line,
  CASE WHEN form = 'v1' THEN regexp_extract(prop_text, 'code=([^;]*)', 1) END AS code
FROM ({PARSED}) WHERE command IN ('notice', 'warning', 'error')""")
def _(s: Source):
    return ll.annotations(s.ad("LOG")).select("job_id", "seq", "level", "message", "file", "file_line", "code")


@query("a11_annotation_counts", """
SELECT job_id, command AS level, count(*) AS n FROM ({PARSED}) WHERE command IN ('notice', 'warning', 'error') GROUP BY ALL""")
def _(s: Source):
    return ll.annotation_counts(s.ad("LOG"))


@query("w3_echo_state", f"SELECT job_id, seq, echo FROM ({_ECHO})")
def _(s: Source):
    return ll.echo_state(s.ad("LOG")).select("job_id", "seq", "echo")


@query("w5_log_groups", """
WITH b AS (SELECT job_id, seq, sum(CASE WHEN command = 'group' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) AS block_no,
  CASE WHEN command = 'group' THEN data END AS title FROM ({PARSED}))
SELECT job_id, CAST(block_no AS BIGINT) AS block_no, max(title) AS title, count(*) AS n_lines FROM b GROUP BY job_id, block_no""")
def _(s: Source):
    return ll.log_group_sizes(s.ad("LOG"))


@query("j7_mask_lines", f"""
WITH lines AS (SELECT job_id, seq, 0 AS sub, line AS text FROM ({{LOG}})), masks AS {_HIDE}
SELECT job_id, seq, text AS line FROM ({_MASKED})""")
def _(s: Source):
    log = s.ad("LOG")
    return ll.mask_lines(log, ll.masks_of(ll.parse_commands(log))).select("job_id", "seq", "line")


# ---- escaping over whole texts --------------------------------------------------------------

_DOC = "documents"
_TEXTS = "SELECT doc_id, {0} AS out FROM documents"


def _replaced(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, {a}, {b})"
    return column


_CR, _LF = "chr(13)", "chr(10)"
_DATA = [("'%0D'", _CR), ("'%0A'", _LF), ("'%25'", "'%'")]
_PROP = [("'%0D'", _CR), ("'%0A'", _LF), ("'%3A'", "':'"), ("'%2C'", "','"), ("'%25'", "'%'")]
_LEGACY = [("'%3B'", "';'"), ("'%0D'", _CR), ("'%0A'", _LF), ("'%5D'", "']'"), ("'%25'", "'%'")]
_CODED = "replace(replace(text, ' ', '%250D'), 'e', '%3A%2C%3B%5D')"


def _coded():
    return F.replace(F.replace("text", F.lit(" "), F.lit("%250D")), F.lit("e"), F.lit("%3A%2C%3B%5D"))


@query("f11_unescape_data", f"SELECT doc_id, {_replaced(_CODED, _DATA)} AS out FROM documents")
def _(s: Source):
    return s.table(_DOC).select("doc_id", tx.unescape_data(_coded()).alias("out"))


@query("f12_unescape_prop", f"SELECT doc_id, {_replaced(_CODED, _PROP)} AS out FROM documents")
def _(s: Source):
    return s.table(_DOC).select("doc_id", tx.unescape_prop(_coded()).alias("out"))


@query("f13_unescape_legacy", f"SELECT doc_id, {_replaced(_CODED, _LEGACY)} AS out FROM documents")
def _(s: Source):
    return s.table(_DOC).select("doc_id", tx.unescape_legacy(_coded()).alias("out"))


@query("f14_escape", f"""
SELECT doc_id, {_replaced('text', [(b, a) for a, b in reversed(_DATA)])} AS data, {_replaced('text', [(b, a) for a, b in reversed(_PROP)])} AS prop,
  {_replaced('text', [(b, a) for a, b in reversed(_LEGACY)])} AS legacy, true AS round_trip FROM documents""")
def _(s: Source):
    t = F.col("text")
    data, prop, legacy = (tx.escape(t, e) for e in (tx.DATA_ESCAPES, tx.PROPERTY_ESCAPES, tx.LEGACY_ESCAPES))
    ok = (tx.unescape_data(data) == t) & (tx.unescape_prop(prop) == t) & (tx.unescape_legacy(legacy) == t)
    return s.table(_DOC).select("doc_id", data.alias("data"), prop.alias("prop"), legacy.alias("legacy"), ok.alias("round_trip"))


@query("f15_trim_space", r"""
SELECT job_id, seq, regexp_replace(concat(chr(9), ' ', line, ' ', chr(160), chr(13)), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS out FROM ({LOG})""")
def _(s: Source):
    padded = F.concat(F.lit("\t "), "line", F.lit("  \r"))
    return s.ad("LOG").select("job_id", "seq", tx.trim_space(padded).alias("out"))


# ---- streams --------------------------------------------------------------------------------

def _log_stream(s: Source):
    from cilake.plans.adapters import SHAPES

    s.stream("events").createOrReplaceTempView("events")
    return s.spark.sql(SHAPES["LOG"])


@query("t1_stream_commands", f"SELECT job_id, seq, command, data, {_EFFECT} AS effect FROM ({{PARSED}})")
def _(s: Source):
    root = shared_dir(s.spark, "t1")
    st.stream_commands(_log_stream(s), root)
    return s.spark.read.parquet(f"{root}/out").select("job_id", "seq", "command", "data", "effect")


_OPEN_LINES = """
WITH c AS ({CHUNK}), whole AS (SELECT stream, string_agg(chunk, '' ORDER BY seq) AS text FROM c GROUP BY stream),
p AS (SELECT stream, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
  len(string_split(text, chr(10))) AS n FROM whole)
SELECT stream, CAST(line_no AS BIGINT) AS line_no, line FROM p WHERE line_no < n - 1"""


def _chunk_stream(s: Source, eof: bool):
    from cilake.plans.adapters import SPARK

    s.stream("documents").createOrReplaceTempView("documents")
    chunks = s.spark.sql(SPARK["CHUNK"])
    if not eof:
        return chunks.withColumn("eof", F.lit(False))
    s.stream("documents").createOrReplaceTempView("documents")
    ends = s.spark.sql("SELECT doc_id AS stream, 9223372036854775807L AS seq, '' AS chunk, true AS eof FROM documents WHERE length(text) > 0")
    return chunks.withColumn("eof", F.lit(False)).unionByName(ends)


@query("t2_stream_framing", _OPEN_LINES)
def _(s: Source):
    root = shared_dir(s.spark, "t2")
    st.stream_framing(_chunk_stream(s, eof=False), root)
    return result(s.spark, root, "lines").select("stream", "line_no", "line")


@query("t6_stream_close", _LINES)
def _(s: Source):
    root = shared_dir(s.spark, "t6")
    st.stream_framing(_chunk_stream(s, eof=True), root)
    return result(s.spark, root, "lines").select("stream", "line_no", "line")


@query("t3_stream_env", """
SELECT job_id, key, arg_max(value, struct_pack(a := step_idx, b := ord)) AS value FROM ({KV}) WHERE kind = 'env' GROUP BY job_id, key""")
def _(s: Source):
    from cilake.plans.adapters import SHAPES

    root = shared_dir(s.spark, "t3")
    s.stream("events").createOrReplaceTempView("events")
    st.stream_env(s.spark.sql(SHAPES["KV"]), root)
    return st.read_env(s.spark, root)


@query("t4_stream_masking", f"""
WITH e AS ({_ECHO}), lines AS (
  SELECT job_id, seq, CAST(0 AS BIGINT) AS sub, raw AS text FROM e WHERE echo AND command IN ('set-env', 'set-output', 'save-state', 'add-path', 'group', 'endgroup', 'echo')
  UNION ALL SELECT job_id, seq, 1, CASE WHEN command IS NULL THEN line WHEN command = 'group' THEN concat('##[group]', data) ELSE concat('##[endgroup]', data) END
  FROM e WHERE command IS NULL OR command IN ('group', 'endgroup')), masks AS {_HIDE}
{_MASKED}""")
def _(s: Source):
    root = shared_dir(s.spark, "t4")
    st.stream_masking(_log_stream(s), root)
    return result(s.spark, root, "console").select("job_id", "seq", F.col("sub").cast("bigint").alias("sub"), "text")


@query("t5_stream_fail_stop", f"""
WITH j AS (SELECT *, {_EFFECT} AS effect, {_ERROR} AS error FROM ({{PARSED}})),
f AS (SELECT job_id, step_idx, min(seq) AS error_seq FROM j WHERE error IS NOT NULL GROUP BY ALL)
SELECT job_id, seq, effect, CASE WHEN error_seq IS NULL OR seq < error_seq THEN 'accepted' ELSE 'refused' END AS outcome
FROM j LEFT JOIN f USING (job_id, step_idx) WHERE error_seq IS NULL OR seq <> error_seq""")
def _(s: Source):
    root = shared_dir(s.spark, "t5")
    st.stream_fail_stop(_log_stream(s), root)
    both = [result(s.spark, root, n).select("job_id", "seq", "effect", F.lit(n).alias("outcome")) for n in ("accepted", "refused")]
    return both[0].unionByName(both[1])


@query("t4_gated_masking", _GATED_CONSOLE)
def _(s: Source):
    root = shared_dir(s.spark, "t4")
    st.stream_masking(_log_stream(s), root, initial=s.ad("INITIAL"))
    return result(s.spark, root, "console").select("job_id", "seq", F.col("sub").cast("bigint").alias("sub"), "text")


@query("t5_gated_fail_stop", f"""
WITH j AS (SELECT *, {_EFFECT} AS effect, CASE WHEN command = 'set-env' AND job_id NOT IN {_OPEN} THEN 'set-env is disabled' ELSE {_ERROR} END AS error FROM ({{PARSED}})),
f AS (SELECT job_id, step_idx, min(seq) AS error_seq FROM j WHERE error IS NOT NULL GROUP BY ALL)
SELECT job_id, seq, effect, CASE WHEN error_seq IS NULL OR seq < error_seq THEN 'accepted' ELSE 'refused' END AS outcome
FROM j LEFT JOIN f USING (job_id, step_idx) WHERE error_seq IS NULL OR seq <> error_seq""")
def _(s: Source):
    root = shared_dir(s.spark, "t5")
    st.stream_fail_stop(_log_stream(s), root, initial=s.ad("INITIAL"))
    both = [result(s.spark, root, n).select("job_id", "seq", "effect", F.lit(n).alias("outcome")) for n in ("accepted", "refused")]
    return both[0].unionByName(both[1])
