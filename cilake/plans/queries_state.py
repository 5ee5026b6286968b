"""Registered queries: key/value files, job state, layers, matrices, files, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.functions import text as tx
from cilake.operators import envstate as es
from cilake.operators import files as fs
from cilake.operators import matrix as mx
from cilake.operators import records as rc
from cilake.operators.running import numbered, ordered_text
from cilake.plans.registry import Source, query
from cilake.session import shared_dir, written
from cilake.sources import framing, kvfiles

_BAD_FILES = "(SELECT DISTINCT job_id, step_idx, kind FROM ({KV}) WHERE kind = 'env' AND key = 'NODE_OPTIONS')"


@query("s3_parse_kv_files", f"""
WITH f AS ({{KVF}}), p AS (SELECT job_id, step_idx, kind, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS ord FROM f)
SELECT job_id, step_idx, kind, CAST(ord AS BIGINT) AS ord, split_part(l, '=', 1) AS key, substr(l, instr(l, '=') + 1) AS value, CAST(NULL AS VARCHAR) AS error
FROM p WHERE (job_id, step_idx, kind) NOT IN (SELECT (job_id, step_idx, kind) FROM {_BAD_FILES})
UNION ALL SELECT job_id, step_idx, kind, NULL, NULL, NULL, 'blocked name' FROM {_BAD_FILES}""")
def _(s: Source):
    return kvfiles.parse_kv_files(s.ad("KVF"))


@query("s3_parse_heredoc_files", """
SELECT doc_id, CAST(0 AS BIGINT) AS ord, 'TEXT' AS key, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), concat(chr(13), chr(10))) ELSE text END AS value, CAST(NULL AS VARCHAR) AS error FROM documents WHERE doc_id % 5 <> 4
UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0 END + length(text) - length(replace(text, chr(10), '')) + 3, 'LAST', 'x', NULL FROM documents WHERE doc_id % 5 <> 4
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'delimiter not found' FROM documents WHERE doc_id % 5 = 4""")
def _(s: Source):
    # whole document texts as heredoc values, some with CRLF line ends, some never closed
    nl = F.when(F.expr("doc_id % 4 = 0"), "\r\n").otherwise("\n")
    body = F.when(F.expr("doc_id % 4 = 0"), F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    close = F.when(F.expr("doc_id % 5 = 4"), "").otherwise("EOF_7f")
    content = F.concat(F.lit("TEXT<<EOF_7f"), nl, body, nl, close, nl, F.lit("LAST=x"))
    files = s.table("documents").select("doc_id", F.lit("output").alias("kind"), content.alias("content"))
    return kvfiles.parse_kv_files(files).drop("kind")


@query("s4_parse_path_files", """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, regexp_replace(l, '\\r$', '') AS entry FROM p WHERE regexp_replace(l, '\\r$', '') <> ''""")
def _(s: Source):
    return kvfiles.parse_path_files(s.table("documents").select("doc_id", "text"), "text")


@query("s5_read_summaries", "SELECT job_id, content AS summary FROM ({KVF}) WHERE kind = 'state' AND step_idx = 0")
def _(s: Source):
    # one summary file per job in a folder of its own, read back whole
    path = shared_dir(s.spark, "summaries")
    files = s.ad("KVF").filter("kind = 'state' AND step_idx = 0")
    files.select("job_id", F.col("content").alias("value")).write.partitionBy("job_id").text(path)
    out = framing.read_summaries(s.spark, f"{path}/job_id=*")
    return out.select(F.regexp_extract("file", r"job_id=(\d+)", 1).cast("bigint").alias("job_id"),
                      F.regexp_replace("summary", r"\n\z", "").alias("summary"))


@query("s10_parse_env_pairs", """
SELECT event_id, CASE WHEN contains(p, '=') THEN split_part(p, '=', 1) END AS key, CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) END AS value,
  NOT contains(p, '=') AS bad FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type ELSE concat(event_type, '=', props, '=', user_id) END AS p FROM events)""")
def _(s: Source):
    p = F.when(F.expr("event_id % 7 = 0"), F.col("event_type")).otherwise(
        F.concat("event_type", F.lit("="), "props", F.lit("="), F.col("user_id").cast("string")))
    read = kvfiles.parse_env_pairs(s.table("events").select("event_id", p.alias("p")), "p")
    return read.select("event_id", "key", "value", (~F.col("ok")).alias("bad"))


@query("s12_encode_kv_rows", """
SELECT job_id, step_idx, ord, concat('K', ord) AS key, CASE WHEN ord % 3 = 0 THEN concat(value, chr(10), 'line2') ELSE value END AS value FROM ({KV})""")
def _(s: Source):
    # append every pair to text files in the shared folder and read these back with the parser: the pairs must survive
    rows = s.ad("KV").select("job_id", "step_idx", "ord", F.concat(F.lit("K"), F.col("ord").cast("string")).alias("key"),
                             F.when(F.expr("ord % 3 = 0"), F.concat("value", F.lit("\nline2"))).otherwise(
                                 F.col("value")).alias("value"))
    folder = shared_dir(s.spark, "kv-files")
    named = F.concat_ws("/", "job_id", "step_idx", "ord", "key")
    kvfiles.append_kv_rows(rows.select(named.alias("key"), "value"), folder)
    files = s.spark.read.text(folder, wholetext=True).select(F.lit("output").alias("kind"), F.col("value").alias("content"))
    part = lambda i: F.get(F.split("key", "/"), i)
    return kvfiles.parse_kv_files(files).select(
        *[part(i).cast("bigint").alias(n) for i, n in enumerate(("job_id", "step_idx"))], part(2).cast("bigint").alias("ord"),
        part(3).alias("key"), "value")


@query("a1_final_env", """
SELECT job_id, key, arg_max(value, struct_pack(a := step_idx, b := ord)) AS value FROM ({KV}) WHERE kind = 'env' GROUP BY job_id, key""")
def _(s: Source):
    return es.final_env(s.ad("KV"))


@query("a2_step_outputs", "SELECT job_id, step_idx, key, arg_max(value, ord) AS value FROM ({KV}) WHERE kind = 'output' GROUP BY ALL")
def _(s: Source):
    return es.step_outputs(s.ad("KV"))


@query("a2_step_outputs_map", """
WITH o AS (SELECT job_id, step_idx, key, arg_max(value, ord) AS value FROM ({KV}) WHERE kind = 'output' GROUP BY ALL)
SELECT job_id, step_idx, count(*) AS n, string_agg(concat(key, '=', value), ',' ORDER BY key) AS entries FROM o GROUP BY ALL""")
def _(s: Source):
    maps = es.as_map(es.step_outputs(s.ad("KV")), ["job_id", "step_idx"], "outputs")
    entries = F.transform(F.array_sort(F.map_entries("outputs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("job_id", "step_idx", F.size("outputs").cast("bigint").alias("n"),
                       F.array_join(entries, ",").alias("entries"))


@query("a3_step_states", "SELECT job_id, step_idx, key, arg_max(value, ord) AS value FROM ({KV}) WHERE kind = 'state' GROUP BY ALL")
def _(s: Source):
    return es.step_states(s.ad("KV"))


@query("a4_step_summaries", """
SELECT job_id, step_idx, coalesce(arg_max(content, kind), '') AS summary FROM ({KVF}) GROUP BY job_id, step_idx""")
def _(s: Source):
    return es.step_summaries(s.ad("KVF").withColumnRenamed("kind", "ord"))


@query("p15_drop_blocked", f"""
SELECT job_id, step_idx, ord, kind, key, value FROM ({{KV}}) WHERE (job_id, step_idx, kind) NOT IN (SELECT (job_id, step_idx, kind) FROM {_BAD_FILES})
UNION ALL SELECT job_id, step_idx, NULL, kind, 'NODE_OPTIONS', NULL FROM {_BAD_FILES}""")
def _(s: Source):
    kept, failed = es.drop_blocked(s.ad("KV"), ["job_id", "step_idx", "kind"])
    return kept.unionByName(failed.withColumnRenamed("blocked_key", "key"), allowMissingColumns=True)


_SEEN = """
WITH w AS (SELECT job_id, step_idx, key, arg_max(value, ord) AS value FROM ({KV}) WHERE kind = 'env' GROUP BY ALL),
p AS (SELECT DISTINCT job_id, step_idx, key FROM ({KV}) WHERE kind IN ('env', 'output')),
m AS (SELECT job_id, step_idx, key, w.value, p.job_id IS NOT NULL AS asked FROM w FULL JOIN p USING (job_id, step_idx, key)),
s AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY job_id, key ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)
SELECT job_id, step_idx, key, coalesce(seen, i.value) AS value FROM s LEFT JOIN ({INITIAL}) i USING (job_id, key)
WHERE (job_id, step_idx, key) IN (SELECT (job_id, step_idx, key) FROM p)"""


@query("w6_env_asof_step", _SEEN)
def _(s: Source):
    kv = s.ad("KV")
    probes = kv.filter("kind IN ('env', 'output')")
    return es.env_asof_step(probes, kv, s.ad("INITIAL")).drop("initial")


@query("l11_unsecure_gate", """
WITH st AS (SELECT DISTINCT job_id, step_idx FROM ({KV})),
w AS (SELECT job_id, step_idx, arg_max(value, ord) AS value FROM ({KV}) WHERE kind = 'env' AND key = 'ACTIONS_ALLOW_UNSECURE_COMMANDS' GROUP BY ALL),
s AS (SELECT job_id, step_idx, last_value(w.value IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM st LEFT JOIN w USING (job_id, step_idx))
SELECT job_id, step_idx, coalesce(coalesce(seen, i.value) IN ('1', 't', 'T', 'TRUE', 'true', 'True'), false) OR coalesce(i.value IN ('1', 't', 'T', 'TRUE', 'true', 'True'), false) AS allowed
FROM s LEFT JOIN (SELECT * FROM ({INITIAL}) WHERE key = 'ACTIONS_ALLOW_UNSECURE_COMMANDS') i USING (job_id)""")
def _(s: Source):
    kv = s.ad("KV")
    return es.unsecure_gate(kv, kv, s.ad("INITIAL"))


@query("w4_path_list", """
WITH e AS (SELECT job_id, entry, max(ord) AS ord FROM ({PATH}) WHERE entry <> '' GROUP BY ALL)
SELECT job_id, concat(string_agg(entry, ':' ORDER BY ord DESC), ':/usr/bin:/bin') AS path FROM e GROUP BY job_id""")
def _(s: Source):
    return es.path_list(s.ad("PATH"))


@query("u1_overlay", "SELECT cust, key, arg_max(value, priority) AS value FROM ({LAYER}) GROUP BY ALL")
def _(s: Source):
    return es.overlay(s.ad("LAYER"), ["cust"])


@query("p10_contexts", """
SELECT cust, priority, key, value FROM ({LAYER}) l WHERE priority = (SELECT max(priority) FROM ({LAYER}) m WHERE m.cust = l.cust)""")
def _(s: Source):
    return es.contexts(s.ad("LAYER"), ["cust"])


@query("a6_agg_join", """
SELECT user_id, string_agg(event_type, '-' ORDER BY event_id) AS joined FROM events GROUP BY user_id""")
def _(s: Source):
    return ordered_text(s.table("events"), ["user_id"], "event_id", "event_type", "-", "joined")


# ---- matrices -------------------------------------------------------------------------------

# all combinations of a job in wide form with their mixed-radix number (dimensions by name)
_WIDE = """
d AS ({DIM}), j AS (SELECT job_id FROM ({MJOB}) WHERE job_id NOT IN (SELECT job_id FROM ({NODIM})) AND job_id IN (SELECT job_id FROM d)),
n AS (SELECT j.job_id, greatest(count(*) FILTER (dim = 'os'), 1) AS no, greatest(count(*) FILTER (dim = 'py'), 1) AS np, greatest(count(*) FILTER (dim = 'seg'), 1) AS ns FROM j JOIN d USING (job_id) GROUP BY j.job_id),
wide AS (SELECT n.job_id, CAST((coalesce(o.pos, 0) * np + coalesce(p.pos, 0)) * ns + coalesce(s.pos, 0) AS BIGINT) AS combo, o.value AS os, p.value AS py, s.value AS seg, CAST(no * np * ns AS BIGINT) AS total FROM n
  LEFT JOIN d o ON o.job_id = n.job_id AND o.dim = 'os' LEFT JOIN d p ON p.job_id = n.job_id AND p.dim = 'py' LEFT JOIN d s ON s.job_id = n.job_id AND s.dim = 'seg'),
product AS (SELECT job_id, combo, 'os' AS dim, os AS value FROM wide WHERE os IS NOT NULL UNION ALL SELECT job_id, combo, 'py', py FROM wide WHERE py IS NOT NULL
  UNION ALL SELECT job_id, combo, 'seg', seg FROM wide WHERE seg IS NOT NULL),
ex AS (SELECT * FROM ({EXCL}) e WHERE NOT EXISTS (SELECT 1 FROM ({EXCL}) b WHERE b.job_id = e.job_id AND b.rule_pos = e.rule_pos AND b.dim NOT IN ('os', 'py', 'seg'))),
hit AS (SELECT w.job_id, w.combo FROM wide w JOIN ex ON ex.job_id = w.job_id GROUP BY w.job_id, w.combo, ex.rule_pos
  HAVING bool_and(ex.value IS NOT DISTINCT FROM CASE ex.dim WHEN 'os' THEN w.os WHEN 'py' THEN w.py ELSE w.seg END)),
kept AS (SELECT * FROM product WHERE (job_id, combo) NOT IN (SELECT (job_id, combo) FROM hit))"""
# includes against the kept combinations
_MERGE = _WIDE + """,
inc AS ({INCL}), kw AS (SELECT * FROM wide WHERE (job_id, combo) NOT IN (SELECT (job_id, combo) FROM hit)),
agree AS (SELECT w.job_id, w.combo, i.rule_pos FROM kw w JOIN inc i ON i.job_id = w.job_id GROUP BY w.job_id, w.combo, i.rule_pos
  HAVING bool_and(CASE i.dim WHEN 'os' THEN w.os IS NULL OR w.os = i.value WHEN 'py' THEN w.py IS NULL OR w.py = i.value WHEN 'seg' THEN w.seg IS NULL OR w.seg = i.value ELSE true END)),
added AS (SELECT a.job_id, a.combo, i.dim, arg_max(i.value, i.rule_pos) AS value FROM agree a JOIN inc i USING (job_id, rule_pos)
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.job_id = i.job_id AND d.dim = i.dim) GROUP BY ALL),
extra AS (SELECT i.job_id, coalesce(t.total, 0) + i.rule_pos AS combo, i.dim, i.value FROM inc i
  LEFT JOIN (SELECT job_id, CAST(greatest(count(*) FILTER (dim = 'os'), 1) * greatest(count(*) FILTER (dim = 'py'), 1) * greatest(count(*) FILTER (dim = 'seg'), 1) AS BIGINT) AS total FROM d GROUP BY job_id) t USING (job_id)
  WHERE (i.job_id, i.rule_pos) NOT IN (SELECT (job_id, rule_pos) FROM agree)),
empty AS (SELECT m.job_id, coalesce(t.total, 0) AS combo, CAST(NULL AS VARCHAR) AS dim, CAST(NULL AS VARCHAR) AS value FROM ({MJOB}) m
  LEFT JOIN (SELECT job_id, CAST(greatest(count(*) FILTER (dim = 'os'), 1) * greatest(count(*) FILTER (dim = 'py'), 1) * greatest(count(*) FILTER (dim = 'seg'), 1) AS BIGINT) AS total FROM d GROUP BY job_id) t USING (job_id)
  WHERE m.job_id NOT IN (SELECT job_id FROM kept) AND m.job_id NOT IN (SELECT job_id FROM extra)),
badjob AS (SELECT DISTINCT job_id FROM ({EXCL}) WHERE dim = 'bad'),
full_ AS (SELECT * FROM (SELECT * FROM kept UNION ALL SELECT * FROM added UNION ALL SELECT * FROM extra UNION ALL SELECT * FROM empty) WHERE job_id NOT IN (SELECT job_id FROM badjob))"""


def _matrix(s: Source):
    return s.ad("MJOB"), s.ad("DIM"), s.ad("EXCL"), s.ad("INCL"), s.ad("NODIM")


def _kept(s: Source):
    _jobs, dims, excl, _incl, none = _matrix(s)
    product = written(mx.matrix_product(dims, none), "product")
    return written(mx.matrix_exclude(product, excl, dims), "kept")


@query("j1_matrix_product", f"WITH {_WIDE} SELECT job_id, combo, dim, value FROM product")
def _(s: Source):
    _jobs, dims, _excl, _incl, none = _matrix(s)
    return mx.matrix_product(dims, none)


@query("j2_matrix_exclude", f"WITH {_WIDE} SELECT job_id, combo, dim, value FROM kept")
def _(s: Source):
    return _kept(s)


@query("j3_check_exclude_keys", "SELECT job_id, rule_pos, dim AS exclude_key FROM ({EXCL}) WHERE dim = 'bad'")
def _(s: Source):
    return mx.check_exclude_keys(s.ad("DIM"), s.ad("EXCL"))


@query("j4_matrix_include", f"WITH {_MERGE} SELECT job_id, combo, dim, value FROM kept UNION ALL SELECT * FROM added")
def _(s: Source):
    return mx.matrix_include(_kept(s), s.ad("INCL"), s.ad("DIM"))


@query("j5_matrix_extra", f"WITH {_MERGE} SELECT * FROM extra UNION ALL SELECT * FROM empty")
def _(s: Source):
    jobs, dims, _excl, incl, _none = _matrix(s)
    return mx.matrix_extra(jobs, _kept(s), incl, dims)


@query("j6_expand_matrix", f"WITH {_MERGE} SELECT job_id, combo, dim, value FROM full_")
def _(s: Source):
    jobs, dims, excl, incl, none = _matrix(s)
    return mx.expand_matrix(jobs, dims, excl, incl, none)[0]


@query("u3_append_extra", f"WITH {_MERGE} SELECT job_id, count(DISTINCT combo) AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM extra) GROUP BY job_id")
def _(s: Source):
    jobs, dims, _excl, incl, _none = _matrix(s)
    kept = _kept(s)
    extra = mx.matrix_extra(jobs, kept, incl, dims).filter(F.col("dim").isNotNull())
    return kept.unionByName(extra).select("job_id", "combo").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query("w8_matrix_index", f"WITH {_MERGE} SELECT job_id, combo, row_number() OVER (PARTITION BY job_id ORDER BY combo) - 1 AS job_index FROM (SELECT DISTINCT job_id, combo FROM full_)")
def _(s: Source):
    jobs, dims, excl, incl, none = _matrix(s)
    return mx.matrix_index(written(mx.expand_matrix(jobs, dims, excl, incl, none)[0], "matrix"))


@query("a10_strategy_totals", f"WITH {_MERGE} SELECT job_id, combo, row_number() OVER (PARTITION BY job_id ORDER BY combo) - 1 AS job_index, count(*) OVER (PARTITION BY job_id) AS job_total FROM (SELECT DISTINCT job_id, combo FROM full_)")
def _(s: Source):
    jobs, dims, excl, incl, none = _matrix(s)
    return mx.strategy_totals(written(mx.expand_matrix(jobs, dims, excl, incl, none)[0], "matrix"))


_STRATEGY = """CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'many' WHEN 3 THEN 'true' WHEN 4 THEN 'F' ELSE '0' END"""


def _strategy(s: Source):
    return s.table("part").select("p_partkey", F.expr(_STRATEGY.replace("VARCHAR", "STRING")).alias("x"))


@query("o4_max_parallel", f"""
SELECT p_partkey, CASE WHEN x = '' THEN 4 ELSE coalesce(try_cast(x AS INTEGER), 0) END AS max_parallel FROM (SELECT p_partkey, {_STRATEGY} AS x FROM part)""")
def _(s: Source):
    return _strategy(s).select("p_partkey", dy.max_parallel(F.col("x")).alias("max_parallel"))


@query("f25_fail_fast", f"""
SELECT p_partkey, CASE WHEN x = '' THEN true ELSE x IN ('1', 't', 'T', 'TRUE', 'true', 'True') END AS fail_fast FROM (SELECT p_partkey, {_STRATEGY} AS x FROM part)""")
def _(s: Source):
    return _strategy(s).select("p_partkey", dy.fail_fast(F.col("x")).alias("fail_fast"))


@query("f24_parse_bool", f"""
SELECT p_partkey, CASE WHEN x IN ('1', 't', 'T', 'TRUE', 'true', 'True') THEN true WHEN x IN ('0', 'f', 'F', 'FALSE', 'false', 'False') THEN false END AS b FROM (SELECT p_partkey, {_STRATEGY} AS x FROM part)""")
def _(s: Source):
    return _strategy(s).select("p_partkey", dy.parse_bool(F.col("x")).alias("b"))


# ---- file sets ------------------------------------------------------------------------------

_PATTERNS = ["/en/**/*.txt", "de/src?/*", "!**/1*.txt", "f[r]/src1/*.md", "!de/src3/*"]
_PICKED = """(regexp_matches(path, '^en/(?:.*/)?[^/]*\\.txt$') OR regexp_matches(path, '^de/src[^/]/[^/]*$') OR regexp_matches(path, '^f[r]/src1/[^/]*\\.md$'))
  AND NOT (regexp_matches(path, '^(?:.*/)?1[^/]*\\.txt$') OR regexp_matches(path, '^de/src3/[^/]*$'))"""


@query("s6_select_files", f"SELECT path FROM ({{FILE}}) WHERE {_PICKED}")
def _(s: Source):
    return fs.select_files(s.ad("FILE"), _PATTERNS).select("path")


@query("s6_select_files_by_rules", f"SELECT set_id, path FROM ({{FILE}}) JOIN (SELECT DISTINCT source AS set_id FROM documents) ON true WHERE source = set_id AND regexp_matches(path, '^(?:.*/)?' || set_id || '/[^/]*\\.md$') AND NOT regexp_matches(path, '^en/.*$')")
def _(s: Source):
    # a pattern set per source: its own markdown files, nothing English
    sources = s.table("documents").select("source").distinct()
    patterns = sources.select(F.col("source").alias("set_id"), F.explode(F.array(
        F.concat(F.lit("**/"), "source", F.lit("/*.md")), F.lit("!en/**"))).alias("pattern"))
    files = s.ad("FILE").withColumn("set_id", F.col("source"))
    return fs.select_by_rules(files, patterns).select("set_id", "path")


@query("f16_glob_to_regex", """SELECT lang, count(*) AS n FROM ({FILE}) WHERE regexp_matches(path, '^(?:.*/)?src1[^/]/[^/]*\\.md$') GROUP BY lang""")
def _(s: Source):
    hit = F.col("path").rlike(tx.glob_to_regex("**/src1?/*.md"))
    return s.ad("FILE").filter(hit).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("a12_distinct_matches", f"SELECT DISTINCT path FROM ({{FILE}}) WHERE {_PICKED} OR regexp_matches(path, '^en/src1/[^/]*$')")
def _(s: Source):
    f = s.ad("FILE")
    twice = fs.select_files(f, _PATTERNS).select("path").unionByName(fs.select_files(f, ["en/src1/*"]).select("path"))
    return twice.distinct()


@query("u2_include_exclude", "SELECT path FROM ({FILE}) WHERE regexp_matches(path, '^en/.*$') AND NOT regexp_matches(path, '^en/src2/[^/]*$')")
def _(s: Source):
    f = s.ad("FILE")
    drop = fs.select_files(f, ["en/src2/*"]).select("path")
    return fs.select_files(f, ["en/**"]).select("path").join(drop, "path", "left_anti")


@query("a5_hash_files", """
SELECT lang, source, sha256(unhex(string_agg(sha256(content), '' ORDER BY path))) AS hash FROM ({FILE}) GROUP BY ALL""")
def _(s: Source):
    return fs.hash_files(s.ad("FILE"), ["lang", "source"])


@query("a5_hash_files_streamed", """
SELECT CASE WHEN lang <> 'de' THEN lang END AS lang, sha256(unhex(string_agg(sha256(content), '' ORDER BY path))) AS hash FROM ({FILE}) GROUP BY ALL""")
def _(s: Source):
    # large groups, one of them without a key
    return fs.hash_files(s.ad("FILE").withColumn("lang", F.when(F.col("lang") != "de", F.col("lang"))), ["lang"])


@query("a5_hash_or_empty", """
SELECT lang, source, coalesce(sha256(unhex(string_agg(sha256(content), '' ORDER BY path) FILTER (path LIKE '%.txt' AND source <> 'src1'))), '') AS hash FROM ({FILE}) GROUP BY ALL""")
def _(s: Source):
    f = s.ad("FILE")
    txt = fs.select_files(f, ["**/*.txt", "!*/src1/*"])
    return fs.hash_or_empty(f, fs.hash_files(txt, ["lang", "source"]), ["lang", "source"])


@query("f10_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s: Source):
    return s.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("o1_sort_by_path", "SELECT lang, path, row_number() OVER (PARTITION BY lang ORDER BY path) - 1 AS position FROM ({FILE})")
def _(s: Source):
    # byte order of the paths, as the position of each in its language
    return numbered(s.ad("FILE").select("lang", "path"), ["lang"], "path", "position", block_rows=100)


# ---- log records ----------------------------------------------------------------------------

_LEVEL = """CASE lower(substr(trim(level), 1, 1)) WHEN 't' THEN 'trace' WHEN 'd' THEN 'debug' WHEN 'w' THEN 'warn' WHEN 'e' THEN 'error' ELSE 'info' END"""


@query("f28_parse_level", f"SELECT run_id, msg, {_LEVEL} AS level FROM ({{REC}})")
def _(s: Source):
    return s.ad("REC").select("run_id", "msg", tx.parse_level(F.col("level")).alias("level"))


@query("p17_level_filter", f"SELECT run_id, msg FROM ({{REC}}) WHERE {_LEVEL} IN ('info', 'warn', 'error')")
def _(s: Source):
    return rc.level_filter(s.ad("REC"), "info").select("run_id", "msg")


@query("w7_elapsed", "SELECT run_id, msg, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id) AS elapsed_us FROM ({REC})")
def _(s: Source):
    return rc.elapsed(s.ad("REC")).select("run_id", "msg", "elapsed_us")


@query("f29_strip_prefixes", """
WITH a AS (SELECT run_id, msg, CASE WHEN starts_with(src, '/home/u/') THEN substr(src, 9) ELSE src END AS src FROM ({REC})),
b AS (SELECT run_id, msg, CASE WHEN starts_with(src, '/work/') THEN substr(src, 7) ELSE src END AS src FROM a)
SELECT run_id, msg, CASE WHEN starts_with(src, 'pkg/') THEN substr(src, 5) ELSE src END AS src FROM b""")
def _(s: Source):
    return s.ad("REC").select("run_id", "msg", tx.strip_prefixes(F.col("src"), ["/home/u/", "/work/", "pkg/"]).alias("src"))


@query("s13_write_records", """
SELECT concat('{"run_id":', run_id, ',"level":"', level, '","msg":"', msg, '"}') AS value FROM ({REC})
UNION ALL SELECT concat('run_id=', run_id, ' level=', level, ' msg=', msg) FROM ({REC})""")
def _(s: Source):
    path = shared_dir(s.spark, "records")
    rows = s.ad("REC").select("run_id", "level", "msg")
    for fmt in ("json", "text"):
        rc.write_records(rows, path, fmt)
    return s.spark.read.text(path)


@query("p16_safe_workdir", """
SELECT doc_id, CASE WHEN source = 'src1' THEN '/ws' WHEN source <> 'src2' THEN concat('/ws/', lang, '/', source) END AS folder, CASE WHEN source = 'src2' THEN 'absolute path' END AS error FROM documents""")
def _(s: Source):
    wd = F.when(F.col("source") == "src1", "").when(F.col("source") == "src2", "/tmp").otherwise(F.concat_ws("/", "lang", "source"))
    folder, error = tx.safe_workdir(wd, F.lit("/ws"))
    return s.table("documents").select("doc_id", folder.alias("folder"), error.alias("error"))
