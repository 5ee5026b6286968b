"""Registered queries: workflow and action documents, steps, jobs, document checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.operators import documents as dc
from cilake.operators import envstate as es
from cilake.operators import matrix as mx
from cilake.operators import quality as ql
from cilake.operators import steps as sp
from cilake.operators import strategy as sg
from cilake.operators import expressions as ex
from cilake.operators.binding import bind
from cilake.plans.registry import Source, query
from cilake.session import dealt, written
from cilake.sources import documents as sd


def _docs(s: Source):
    return bind(s.ad("DOC"), _v=dy.from_json_(F.col("doc"))).select("doc_id", F.col("_v").alias("doc"))


def _jobs(s: Source):
    return dc.jobs(_docs(s))


_O = "FROM orders"
_MAP = "o_orderkey % 3 = 2"


# ---- strategies -----------------------------------------------------------------------------

_STRATEGY_DOC = """concat('{"jobs":{"b":{"strategy":{', CASE WHEN o_custkey % 3 = 0 THEN '"fail-fast":false,' ELSE '' END, '"max-parallel":', o_custkey % 5,
  ',"matrix":{"os":["l","w"],"v":[1,"1",', o_orderkey % 3, '],"exclude":[{"os":"l","v":1}],"include":[{"os":"w","v":"1","x":true},{"v":9}]}}}}}')"""


def _strategy(s: Source):
    docs = bind(dealt(s.table("orders")).select(F.col("o_orderkey").alias("doc_id"), F.expr(_STRATEGY_DOC).alias("text")),
                doc=dy.from_json_(F.col("text"))).drop("text")
    return sg.strategy_rows(dc.jobs(docs), F.concat_ws("/", "doc_id", "job_id"))


@query("e_documents_to_matrix", """
WITH c AS (SELECT concat(o_orderkey, '/b') AS job_id, os, v, CASE v WHEN 0 THEN '1' WHEN 1 THEN '"1"' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS vv
  FROM orders, (VALUES (0), (1)) a(os), (VALUES (0), (1), (2)) b(v)),
k AS (SELECT job_id, CAST(os * 3 + v AS BIGINT) AS combo, CASE os WHEN 0 THEN '"l"' ELSE '"w"' END AS o, vv FROM c WHERE NOT (os = 0 AND vv = '1'))
SELECT job_id, combo, 'os' AS dim, o AS value FROM k UNION ALL SELECT job_id, combo, 'v', vv FROM k
UNION ALL SELECT concat(o_orderkey, '/b'), 4, 'x', 'true' FROM orders UNION ALL SELECT concat(o_orderkey, '/b'), 7, 'v', '9' FROM orders""")
def _(s: Source):
    g = sg.strategy_tables(written(_strategy(s), "strategy"))
    return mx.expand_matrix(g.jobs.select("job_id"), g.dims, g.excludes, g.includes, g.empty_dims)[0]


@query("e_documents_to_strategy", """
SELECT concat(o_orderkey, '/b') AS job_id, o_custkey % 3 <> 0 AS fail_fast, CAST(o_custkey % 5 AS INTEGER) AS max_parallel FROM orders""")
def _(s: Source):
    return sg.strategy_tables(_strategy(s)).jobs


# ---- loading --------------------------------------------------------------------------------

@query("s7_load_workflows", """
SELECT o_orderkey AS doc_id, concat('wf', o_orderkey) AS name, 'push,pull_request' AS events, concat('make ', o_custkey) AS run, CAST(NULL AS VARCHAR) AS error FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, concat('json', o_orderkey), 'push', NULL, NULL FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'bad YAML' FROM orders WHERE o_orderkey % 50 = 0""")
def _(s: Source):
    yaml = F.concat(F.lit("name: wf"), F.col("o_orderkey").cast("string"),
                    F.lit("\non: [push, pull_request]\njobs:\n  build:\n    runs-on: ubuntu\n    steps:\n      - run: make "),
                    F.col("o_custkey").cast("string"), F.lit("\n"))
    json = F.concat(F.lit('{"name":"json'), F.col("o_orderkey").cast("string"), F.lit('","on":"push"}'))
    text = F.when(F.expr("o_orderkey % 50 = 0"), "a: [1").when(F.expr("o_orderkey % 3 = 0"), json).otherwise(yaml)
    docs = sd.load_workflows(s.table("orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    events = F.array_join(dy.string_slice(dc.get(F.col("doc"), "on")), ",")
    return docs.select("doc_id", dc.get(F.col("doc"), "name", kind="string").alias("name"),
                       F.when(F.col("error").isNull(), events).alias("events"),
                       F.try_variant_get("doc", "$.jobs.build.steps[0].run", "string").alias("run"),
                       F.when(F.col("error").isNotNull(), "bad YAML").alias("error"))


@query("s8_load_actions", f"""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'node20' WHEN 2 THEN 'docker' ELSE 'composite' END AS "using",
  'always()' AS pre_if, CASE WHEN o_orderkey % 5 = 2 THEN 'failure()' ELSE 'always()' END AS post_if,
  CASE o_orderkey % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'node' WHEN 2 THEN 'docker' ELSE 'composite' END AS kind {_O}""")
def _(s: Source):
    return sd.load_actions(s.ad("ACTION"), "doc").select("doc_id", "using", "pre_if", "post_if", dc.action_kind(F.coalesce("using", F.lit(""))).alias("kind"))


@query("s9_load_contexts", """
SELECT o_orderkey AS id, 'github' AS name, CAST(NULL AS VARCHAR) AS error FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 25 = 0 THEN 'bogus' ELSE 'inputs' END, CASE WHEN o_custkey % 25 = 0 THEN 'unknown context bogus' WHEN o_custkey % 10 = 0 THEN 'invalid JSON in inputs' END FROM orders""")
def _(s: Source):
    parts = F.array(
        F.struct(F.lit("github").alias("name"), F.col("payload").alias("json")),
        F.struct(F.lit("env").alias("name"), F.lit("").alias("json")),
        F.struct(F.when(F.expr("cust % 25 = 0"), "bogus").otherwise("inputs").alias("name"),
                 F.when(F.expr("cust % 10 = 0"), '{"a":').otherwise('{"a":1}').alias("json")))
    rows = s.ad("PAYLOAD").withColumn("cust", F.regexp_extract("payload", r"CUSTOMER#(\d+)", 1).cast("bigint"))
    return sd.load_contexts(rows.select("id", F.inline(parts))).select("id", "name", "error")


# ---- document tables ------------------------------------------------------------------------

@query("m1_triggers", f"""
SELECT o_orderkey AS doc_id, 'push' AS event {_O} UNION ALL SELECT o_orderkey, 'pull_request' {_O} WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, 'workflow_dispatch' {_O} WHERE {_MAP} UNION ALL SELECT o_orderkey, 'workflow_call' {_O} WHERE {_MAP}""")
def _(s: Source):
    return dc.triggers(_docs(s))


@query("m2_trigger_config", f"""SELECT o_orderkey AS doc_id, '{{"branches":["main"]}}' AS config {_O} WHERE {_MAP}""")
def _(s: Source):
    return dc.trigger_config(_docs(s), "push")


@query("m3_dispatch_inputs", f"""
SELECT o_orderkey AS doc_id, 'env' AS input, CAST(NULL AS VARCHAR) AS description, true AS required, 'dev' AS default_value, 'choice' AS type, 'dev,prod' AS options {_O} WHERE {_MAP}
UNION ALL SELECT o_orderkey, 'dry', 'd', false, NULL, NULL, NULL {_O} WHERE {_MAP}""")
def _(s: Source):
    return dc.dispatch_inputs(_docs(s))


@query("m4_call_interface", f"""
SELECT o_orderkey AS doc_id, 'input' AS port, 'tag' AS name, true AS required, 'string' AS type, CAST(NULL AS VARCHAR) AS value,
  CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS default_value {_O} WHERE {_MAP}
UNION ALL SELECT o_orderkey, 'output', 'url', false, NULL, 'u', NULL, NULL {_O} WHERE {_MAP}""")
def _(s: Source):
    return dc.call_interface(_docs(s))


_USES = """CASE o_custkey % 4 WHEN 0 THEN './.github/workflows/t.yml' WHEN 1 THEN 'o/r/.github/workflows/t.yaml@v1' WHEN 2 THEN 'o/r' ELSE '' END"""


@query("m5_jobs", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, CASE WHEN o_custkey % 2 = 0 THEN 'Build it' ELSE 'build' END AS name, 'success()' AS condition, '' AS uses {_O}
UNION ALL SELECT o_orderkey, 'test', 'test', 'contains(github.ref, ''x'')', {_USES} {_O}""")
def _(s: Source):
    return _jobs(s).drop("job")


@query("a13_workflow_jobs", f"SELECT o_orderkey AS doc_id, 'build,test' AS job_ids {_O}")
def _(s: Source):
    return dc.workflow_jobs(_docs(s))


@query("m6_steps", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, CAST(0 AS BIGINT) AS pos, 's1' AS id, '' AS name, 'make' AS run, '' AS uses, '' AS shell {_O}
UNION ALL SELECT o_orderkey, 'build', 1, '', '', '', 'o/r@v4', '' {_O}""")
def _(s: Source):
    return dc.steps(_jobs(s)).drop("step")


@query("m7_needs_edges", f"""
SELECT o_orderkey AS doc_id, 'test' AS job_id, 'build' AS needs_job_id {_O} UNION ALL SELECT o_orderkey, 'test', 'lint' {_O} WHERE o_orderkey % 2 <> 0""")
def _(s: Source):
    return dc.needs_edges(_jobs(s))


_LABELS = [("0", 0, "ubuntu"), ("1", 0, "self-hosted"), ("1", 1, "x64"), ("2", 0, "gpu"), ("2", 1, "big")]


@query("m8_runner_labels", " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, 'build' AS job_id, CAST({p} AS BIGINT) AS pos, '{v}' AS label {_O} WHERE o_custkey % 3 = {c}" for c, p, v in _LABELS))
def _(s: Source):
    return dc.runner_labels(_jobs(s))


@query("f30_string_slice", f"""
SELECT o_orderkey AS doc_id, CASE o_custkey % 3 WHEN 0 THEN 'ubuntu' WHEN 1 THEN 'self-hosted,x64' ELSE '' END AS labels {_O}""")
def _(s: Source):
    on = F.try_variant_get("doc", "$.jobs.build['runs-on']", "variant")
    return _docs(s).select("doc_id", F.array_join(dy.string_slice(on), ",").alias("labels"))


@query("m9_containers", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, 'node:20' AS image, CAST(NULL AS VARCHAR) AS options, CAST(NULL AS VARCHAR) AS env, CAST(NULL AS VARCHAR) AS ports,
  CAST(NULL AS VARCHAR) AS volumes, CAST(NULL AS VARCHAR) AS credentials {_O} WHERE o_custkey % 4 = 0
UNION ALL SELECT o_orderkey, 'build', 'py:3', '-it', concat('{{"A":"1","N":"', o_custkey, '"}}'), '80:80,443', '/a:/b',
  concat('{{"password":"p","username":"u', o_custkey, '"}}') {_O} WHERE o_custkey % 4 = 1""")
def _(s: Source):
    found = dc.containers(_jobs(s))
    maps = {c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) for c in ("env", "credentials")}
    return found.withColumns({**maps, **{c: F.array_join(c, ",") for c in ("ports", "volumes")}})


@query("m10_job_secrets", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, true AS inherit, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS value {_O} WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, 'build', false, 'TOKEN', 't' {_O} WHERE o_custkey % 3 = 1 UNION ALL SELECT o_orderkey, 'build', false, 'KEY', 'k' {_O} WHERE o_custkey % 3 = 1""")
def _(s: Source):
    return dc.job_secrets(_jobs(s))


@query("m11_declared_env", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, CAST(NULL AS BIGINT) AS pos, 'A' AS key, '1' AS value {_O} WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'build', NULL, 'B', CAST(o_custkey AS VARCHAR) {_O} WHERE o_custkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'build', 0, 'INPUT_DRY', 'old' {_O} UNION ALL SELECT o_orderkey, 'build', 1, 'INPUT_NODE-VERSION', '18' {_O} UNION ALL SELECT o_orderkey, 'build', 1, 'C', 'c' {_O}""")
def _(s: Source):
    jobs = dc.declared_env(_jobs(s), "job").select("doc_id", "job_id", "key", "value")
    steps = dc.declared_env(dc.steps(_jobs(s)), "step").select("doc_id", "job_id", "pos", "key", "value")
    return steps.unionByName(jobs, allowMissingColumns=True)


@query("m12_step_input_env", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, CAST(0 AS BIGINT) AS pos, 'INPUT_DRY' AS key, 'old' AS value {_O} UNION ALL SELECT o_orderkey, 'build', 1, 'INPUT_NODE-VERSION', '20' {_O}
UNION ALL SELECT o_orderkey, 'build', 1, 'C', 'c' {_O} UNION ALL SELECT o_orderkey, 'build', 1, 'INPUT_DRY_RUN', 'yes' {_O}""")
def _(s: Source):
    return dc.step_input_env(dc.steps(_jobs(s))).select("doc_id", "job_id", "pos", "key", "value")


@query("m13_job_type", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, 'default' AS type {_O}
UNION ALL SELECT o_orderkey, 'test', CASE o_custkey % 4 WHEN 0 THEN 'local-reusable-workflow' WHEN 1 THEN 'remote-reusable-workflow' WHEN 2 THEN 'unknown' ELSE 'default' END {_O}""")
def _(s: Source):
    return _jobs(s).select("doc_id", "job_id", dc.job_type(F.col("uses")).alias("type"))


_RUN, _SUSES = "CASE WHEN l_suppkey % 3 = 0 THEN 'make' ELSE '' END", "l_partkey % 7"
_STEP_KEYS = "l_orderkey AS job_id, l_partkey * 10 + l_linenumber AS pos"


@query("m14_step_type", f"""
SELECT {_STEP_KEYS}, CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_partkey % 7 < 5 THEN 'invalid' ELSE 'run' END
  ELSE CASE l_partkey % 7 WHEN 0 THEN 'docker' WHEN 1 THEN 'local-reusable-workflow' WHEN 2 THEN 'remote-reusable-workflow' WHEN 3 THEN 'local-action' WHEN 4 THEN 'remote-action' ELSE 'invalid' END END AS type FROM lineitem""")
def _(s: Source):
    return s.ad("STEP").select("job_id", "pos", dc.step_type(F.col("run"), F.col("uses")).alias("type"))


@query("m15_step_label", "SELECT job_id, pos, CASE WHEN name <> '' THEN name WHEN uses <> '' THEN uses WHEN run <> '' THEN run ELSE '' END AS label FROM ({STEP})")
def _(s: Source):
    label = dc.step_label(F.col("name"), F.col("uses"), F.col("run"), F.lit(""))
    return s.ad("STEP").select("job_id", "pos", label.alias("label"))


@query("m16_shell_command", """
SELECT job_id, pos, CASE shell WHEN '' THEN 'bash -e {0}' WHEN 'bash' THEN CASE WHEN run = '' THEN 'bash -e {0}' ELSE 'bash --noprofile --norc -e -o pipefail {0}' END
  WHEN 'python' THEN 'python {0}' WHEN 'pwsh' THEN 'pwsh -command . ''{0}''' WHEN 'cmd' THEN 'cmd /D /E:ON /V:OFF /S /C "CALL "{0}""' ELSE shell END AS command FROM ({STEP})""")
def _(s: Source):
    return s.ad("STEP").select("job_id", "pos", dc.shell_command(F.col("shell"), F.col("run")).alias("command"))


@query("m17_action_kind", f"SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'node' WHEN 2 THEN 'docker' ELSE 'composite' END AS kind {_O}")
def _(s: Source):
    using = bind(s.ad("ACTION"), u=F.coalesce(F.get_json_object("doc", "$.runs.using"), F.lit("")))
    return using.select("doc_id", dc.action_kind(F.col("u")).alias("kind"))


@query("m18_action_ports", f"""
SELECT o_orderkey AS doc_id, 'input' AS port, 'tag' AS name, 't' AS description, o_custkey % 2 = 0 AS required,
  CASE o_custkey % 9 WHEN 1 THEN concat('$', '{{{{ github.ref }}}}') WHEN 2 THEN concat('$', '{{{{ secrets.x }}}}') ELSE 'v1' END AS default_value, CAST(NULL AS VARCHAR) AS value {_O}
UNION ALL SELECT o_orderkey, 'output', 'url', 'u', false, NULL, CASE o_custkey % 9 WHEN 3 THEN concat('$', '{{{{ contains(steps.a) }}}}') WHEN 4 THEN concat('$', '{{{{ nope(1) }}}}')
  ELSE concat('$', '{{{{ steps.s.outputs.url }}}}') END {_O}""")
def _(s: Source):
    docs = bind(s.ad("ACTION"), _v=dy.from_json_(F.col("doc"))).select("doc_id", F.col("_v").alias("doc"))
    return dc.action_ports(docs)


# ---- steps and jobs -------------------------------------------------------------------------

_TIES = ["l_suppkey", "l_quantity", "l_extendedprice"]
_IDX = "row_number() OVER (PARTITION BY job_id ORDER BY pos, l_suppkey, l_quantity, l_extendedprice) - 1"


@query("w1_step_ids", f"""
SELECT job_id, pos, step_idx, concat(step_idx, '_', coalesce(nullif(trim(regexp_replace(lower(CASE WHEN name = '' THEN '<unnamed>' ELSE name END), '[^a-z0-9._-]+', '-', 'g'), '-'), ''), 'unnamed')) AS step_id
FROM (SELECT *, {_IDX} AS step_idx FROM ({{STEP}}))""")
def _(s: Source):
    return sp.step_ids(s.ad("STEP"), ties=_TIES).select("job_id", "pos", "step_idx", "step_id")


@query("w2_executed_steps", """
SELECT job_id, pos, status FROM (SELECT *, max(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY pos, l_suppkey, l_quantity, l_extendedprice
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM ({STEP})) WHERE coalesce(f, 0) = 0""")
def _(s: Source):
    return sp.executed_steps(s.ad("STEP"), ties=_TIES).select("job_id", "pos", "status")


@query("a9_job_status", """
SELECT job_id, CASE WHEN bool_or(status = 'Failed') THEN 'Failed' ELSE 'Succeeded' END AS status,
  arg_min(concat(name, '@', pos), struct_pack(a := pos, b := l_suppkey, c := l_quantity, d := l_extendedprice)) FILTER (status = 'Failed') AS reason FROM ({STEP}) GROUP BY job_id""")
def _(s: Source):
    steps = s.ad("STEP").withColumn("reason", F.concat("name", F.lit("@"), F.col("pos").cast("string")))
    return sp.job_status(steps, ["pos", *_TIES], ["job_id"])


@query("a9_workflow_status", """
WITH j AS (SELECT job_id, bool_or(status = 'Failed') AS bad, arg_min(uses, struct_pack(a := pos, b := l_suppkey, c := l_quantity, d := l_extendedprice)) FILTER (status = 'Failed') AS reason FROM ({STEP}) GROUP BY job_id)
SELECT CAST(floor(job_id / 100) AS BIGINT) AS wf_id, CASE WHEN bool_or(bad) THEN 'Failed' ELSE 'Succeeded' END AS status, arg_min(reason, job_id) FILTER (bad) AS reason FROM j GROUP BY 1""")
def _(s: Source):
    jobs = sp.job_status(s.ad("STEP").withColumn("reason", F.col("uses")), ["pos", *_TIES], ["job_id"])
    jobs = jobs.withColumn("wf_id", F.floor(F.col("job_id") / 100).cast("bigint"))
    return sp.job_status(jobs, ["job_id"], ["wf_id"])


@query("j8_attach_needs", """
WITH e AS (SELECT o_orderkey AS doc_id, 'test' AS job_id, 'build' AS needs_job_id FROM orders UNION ALL SELECT o_orderkey, 'test', 'lint' FROM orders WHERE o_orderkey % 2 <> 0)
SELECT doc_id, e.job_id, needs_job_id, CASE WHEN needs_job_id = 'build' THEN CASE WHEN doc_id % 4 = 0 THEN 'failure' ELSE 'success' END END AS result,
  CASE WHEN needs_job_id = 'build' AND doc_id % 3 = 0 THEN 'v' END AS key, CASE WHEN needs_job_id = 'build' AND doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS value FROM e""")
def _(s: Source):
    jobs = _jobs(s)
    results = jobs.select("doc_id", "job_id", F.when(F.expr("doc_id % 4 = 0"), "failure").otherwise("success").alias("result"))
    outputs = jobs.filter("doc_id % 3 = 0 AND job_id = 'build'").select(
        "doc_id", "job_id", F.lit("v").alias("key"), F.col("doc_id").cast("string").alias("value"))
    return sp.attach_needs(dc.needs_edges(jobs), results, outputs, ["doc_id"])


@query("m19_step_results", f"""
WITH st AS (SELECT *, {_IDX} AS step_idx FROM ({{STEP}})), o AS (SELECT job_id, step_idx, key, arg_max(value, ord) AS value FROM ({{KV}}) WHERE kind = 'output' GROUP BY ALL)
SELECT job_id, step_idx, CASE WHEN status = 'Failed' THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN status = 'Failed' AND pos % 2 <> 0 THEN 'failure' ELSE 'success' END AS conclusion, key, value
FROM st LEFT JOIN o USING (job_id, step_idx)""")
def _(s: Source):
    steps = sp.step_ids(s.ad("STEP"), ties=_TIES).withColumn("continue_on_error", F.expr("pos % 2 = 0"))
    return sp.step_results(steps, es.step_outputs(s.ad("KV")))


# ---- document checks ------------------------------------------------------------------------

_C9, _R5 = "o_custkey % 9", "o_orderkey % 5"
_BAD_IF = f"{_R5} = 3 AND o_custkey % 4 = 0"
# every violation of the action documents: (condition, path, rule, message)
_EXPECTED = [
    (f"{_C9} = 2", "inputs.tag.default", "unknown_variable", "variable not open here: secrets"),
    (f"{_C9} = 3", "outputs.url.value", "call_arity", "too few arguments: contains"),
    (f"{_C9} = 4", "outputs.url.value", "unknown_function", "no such function: nope"),
    (f"{_C9} = 5", "outputs.url.colour", "unknown_property", "key not declared: colour"),
    (f"{_C9} = 6", "extra", "expr_not_allowed", "no expression may stand here"),
    (f"{_C9} = 7", "$" + "{{ insert }}", "insert_key", "insert may not stand here"),
    *[(f"{_R5} = 0", "runs", "wrong_container", "mapping wanted, found scalar")] * 4,
    (f"{_R5} = 2", "runs.args[1]", "wrong_container", "scalar wanted, found sequence"),
    *[(f"{_R5} = 2", f"runs.{k}", "unknown_property", f"key not declared: {k}")
      for k, n in (("image", 3), ("args", 3), ("post-if", 2), ("using", 1)) for _ in range(n)],
    *[(_BAD_IF, f"runs.{k}", "unknown_property", f"key not declared: {k}") for k in ("steps", "steps", "steps", "using")],
    *[(_BAD_IF, f"runs.steps[0].{k}", "unknown_property", f"key not declared: {k}") for k in ("run", "shell")],
    *[(_BAD_IF, "runs.steps[0].continue-on-error", "scalar_type", "boolean wanted, found string")] * 2,
]
_VIOLATIONS = "\nUNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, {repr(p)} AS path, '{r}' AS rule, '{m}' AS message FROM orders WHERE {c}"
    for c, p, r, m in _EXPECTED)


def _violations(s: Source):
    return ql.check_documents(s.ad("ACTION"), ql.ACTION_RULES)


def _rule_query(name: str, rules: list[str]):
    listed = ", ".join(f"'{r}'" for r in rules)

    @query(name, f"SELECT doc_id, path, message FROM ({_VIOLATIONS}) WHERE rule IN ({listed})")
    def _(s: Source):
        return _violations(s).filter(F.col("rule").isin(rules)).select("doc_id", "path", "message")


@query("v_check_documents", _VIOLATIONS)
def _(s: Source):
    return _violations(s)


_rule_query("v1_unknown_property", ["unknown_property"])
_rule_query("v2_wrong_container", ["wrong_container"])
_rule_query("v8_expr_not_allowed", ["expr_not_allowed"])
_rule_query("v9_call_arity", ["call_arity", "unknown_function"])
_rule_query("v10_unknown_variable", ["unknown_variable"])
_rule_query("v13_insert_key", ["insert_key"])

# the payload documents under rules of their own, for the scalar checks
_PAYLOAD_RULES = ql.RuleSet(
    root="payload",
    props={("payload", "Event"): "event", ("event", "Action"): "action", ("event", "number"): "number", ("event", "draft"): "null",
           ("event", "note"): "seven", ("event", "Labels"): "labels", ("event", "user"): "mapping", ("event", "none"): "mapping",
           ("event", "list"): "sequence", ("label", "name"): "string", ("label", "Name"): "string"},
    items={"labels": "label"}, allowed={"action": ["opened", "closed"]}, constant={"seven": "7"},
    scalars={"string": "string"})


def _payload_violations(s: Source):
    return ql.check_documents(s.ad("PAYLOAD"), _PAYLOAD_RULES, "payload")


@query("v3_allowed_values", "SELECT o_orderkey AS id, 'Event.Action' AS path, 'not among the allowed values: ' AS message FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def _(s: Source):
    return _payload_violations(s).filter("rule = 'allowed_values'").drop("rule")


@query("v4_constant", "SELECT o_orderkey AS id, 'Event.note' AS path, '7 wanted, found null' AS message FROM orders WHERE o_custkey % 5 = 0")
def _(s: Source):
    return _payload_violations(s).filter("rule = 'constant'").drop("rule")


@query("v5_scalar_type", "SELECT o_orderkey AS id, 'Event.draft' AS path, 'null wanted, found boolean' AS message FROM orders")
def _(s: Source):
    return _payload_violations(s).filter("rule = 'scalar_type'").drop("rule")


@query("v6_one_of", f"SELECT doc_id, count(*) AS n FROM ({_VIOLATIONS}) WHERE starts_with(path, 'runs') GROUP BY doc_id")
def _(s: Source):
    return _violations(s).filter(F.col("path").startswith("runs")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("v7_sequence_items", f"SELECT doc_id, path, rule FROM ({_VIOLATIONS}) WHERE contains(path, '[')")
def _(s: Source):
    return _violations(s).filter(F.contains("path", F.lit("["))).select("doc_id", "path", "rule")


def _nodes(s: Source):
    return ql.check_nodes(s.ad("ACTION"), ql.ACTION_RULES)


_STEP_OPEN, _IF_OPEN = ",".join(ql.ACTION_RULES.contexts["step-env"]), ",".join(ql.ACTION_RULES.contexts["step-if"])
# every node that contexts are open for, once for each alternative it is read by: (path, contexts, condition)
_CTX = [("inputs.tag.default", "github,strategy,matrix,job,runner,hashFiles(1,255)", "true"),
        ("outputs.url.value", "github,strategy,matrix,steps,inputs,job,runner,env", "true"),
        ("runs.args[0]", "inputs", f"{_R5} = 2"), ("runs.args[1]", "inputs", f"{_R5} = 2"),
        *[(f"runs.steps[0].{k}", _STEP_OPEN, f"{_R5} IN (3, 4)") for k in ("run", "shell")],
        *[("runs.steps[0].if", _IF_OPEN, f"{_R5} = 3"), ("runs.steps[0].continue-on-error", _STEP_OPEN, f"{_R5} = 3")] * 2,
        *[(f"runs.steps[1].{k}", _STEP_OPEN, f"{_R5} = 3") for k in ("with", "with.k")]]


@query("v11_context_inheritance", " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, '{p}' AS path, '{c}' AS contexts FROM orders WHERE {w}" for p, c, w in _CTX))
def _(s: Source):
    return _nodes(s).filter(F.size("ctx") > 0).select("doc_id", "path", F.array_join("ctx", ",").alias("contexts"))


_DECLARED = re.compile(r"([a-zA-Z]+)\((\d+),(\d+)\)")


@query("v12_declared_arity", " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, '{p}' AS path, '{fn}' AS fn, CAST({lo} AS BIGINT) AS min_args, CAST({hi} AS BIGINT) AS max_args FROM orders WHERE {w}"
    for p, c, w in _CTX for fn, lo, hi in _DECLARED.findall(c)))
def _(s: Source):
    return ql.declared_arity(_nodes(s).select("doc_id", "path", "ctx"))


@query("v15_expr_skips_checks", f"""
SELECT o_orderkey AS doc_id, 'outputs.url.value' AS path FROM orders WHERE {_C9} <> 99 UNION ALL SELECT o_orderkey, 'inputs.tag.default' FROM orders WHERE {_C9} IN (1, 2)
UNION ALL SELECT o_orderkey, 'extra' FROM orders WHERE {_C9} = 6 UNION ALL SELECT o_orderkey, 'runs.steps[0].if' FROM orders WHERE {_R5} = 3 UNION ALL SELECT o_orderkey, 'runs.steps[1].with.k' FROM orders WHERE {_R5} = 3""")
def _(s: Source):
    # values left to the expression checks alone
    def held(d, kind, value, alternative):
        return (kind == "string") & F.contains(value, F.lit(ex.OPEN)) & d.isNotNull()

    return ql.check_nodes(s.ad("ACTION"), ql.ACTION_RULES, wanted=held).select("doc_id", "path").distinct()


@query("v16_quality_report", f"""
WITH v AS ({_VIOLATIONS}), g AS (SELECT doc_id, count(*) AS n, arg_min(message, struct_pack(a := path, b := message)) AS m FROM v GROUP BY doc_id)
SELECT o_orderkey AS doc_id, n IS NULL AS valid, coalesce(n, 0) AS n_violations, m AS first_message FROM orders LEFT JOIN g ON doc_id = o_orderkey""")
def _(s: Source):
    found = written(_violations(s), "violations")
    return ql.quality_report(s.ad("ACTION"), found, ["doc_id"])


@query("a7_collect_violations", f"SELECT doc_id, count(*) AS n, string_agg(concat(path, ': ', message), '; ' ORDER BY concat(path, ': ', message)) AS messages FROM ({_VIOLATIONS}) GROUP BY doc_id")
def _(s: Source):
    return ql.collect_violations(_violations(s), ["doc_id"])


@query("a8_first_error", f"SELECT doc_id, arg_min(message, struct_pack(a := path, b := message)) AS message FROM ({_VIOLATIONS}) GROUP BY doc_id")
def _(s: Source):
    return sp.first_error(_violations(s), ["doc_id"], ["path", "message"])


# Keys of a job.
_JOB_KEYS = ["name", "needs", "runs-on", "env", "if", "steps", "timeout-minutes", "services", "strategy", "container", "defaults",
             "outputs", "uses", "with", "secrets"]


@query("j12_lint_properties", f"""
SELECT o_orderkey AS doc_id, 'build' AS job_id, 'colour' AS key, 'key not declared' AS type {_O} WHERE o_custkey % 7 = 0
UNION ALL SELECT o_orderkey, 'build', unnest(['name', 'runs-on', 'env', 'steps']), 'job value' {_O} UNION ALL SELECT o_orderkey, 'test', unnest(['needs', 'if', 'uses']), 'job value' {_O}
UNION ALL SELECT o_orderkey, 'build', 'container', 'job value' {_O} WHERE o_custkey % 4 IN (0, 1) UNION ALL SELECT o_orderkey, 'build', 'secrets', 'job value' {_O} WHERE o_custkey % 3 IN (0, 1)
UNION ALL SELECT o_orderkey, 'build', 'A', 'string' {_O} WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'build', 'B', 'string' {_O} WHERE o_custkey % 5 <> 0""")
def _(s: Source):
    jobs = _jobs(s)
    keys = F.transform(F.map_keys(F.col("job").try_cast("map<string,variant>")), lambda k: F.struct(
        F.lit("job").alias("definition"), k.alias("key")))
    env = F.transform(F.map_keys(dc.get(F.col("job"), "env").try_cast("map<string,variant>")), lambda k: F.struct(
        F.lit("env").alias("definition"), k.alias("key")))
    none = F.filter(keys, lambda x: F.lit(False))
    nodes = jobs.select("doc_id", "job_id", F.inline(F.concat(keys, F.coalesce(env, none))))
    allowed = s.spark.createDataFrame([("job", k, "job value") for k in _JOB_KEYS], "definition string, key string, type string")
    loose = s.spark.createDataFrame([("env", "string")], "definition string, loose_type string")
    return ex.lint_properties(nodes, allowed, loose).select("doc_id", "job_id", "key", "type")

