"""Shapes of CI telemetry derived from the driver tables.

Each text runs unchanged in Spark and DuckDB unless it is listed per dialect. They are plain
projections: `event_id` orders the lines of a job, so no window is needed to number them.
"""

from __future__ import annotations

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_STEP = "CAST(floor(event_id / 2000) AS BIGINT)"

# Matrices, one job per customer (every eleventh has none): (position, dimension, value, condition).
_DIM = [
    (0, "os", "'linux'", "true"), (1, "os", "'mac'", "true"), (2, "os", "'win'", "c_custkey % 2 = 0"),
    (0, "py", "'3.12'", "true"), (1, "py", "'3.13'", "c_custkey % 3 <> 0"),
    (0, "seg", "c_mktsegment", "c_custkey % 7 <> 0"), (1, "seg", "'ANY'", "c_custkey % 7 > 3"),
]
_EXCL = [
    (0, "os", "'mac'", "c_custkey % 3 = 0"), (0, "py", "'3.12'", "c_custkey % 3 = 0"),
    (1, "os", "'win'", "c_custkey % 4 = 0"), (2, "bad", "'x'", "c_custkey % 40 = 0"),
]
_INCL = [
    (0, "os", "'linux'", "c_custkey % 2 = 0"), (0, "flag", "concat('f', c_custkey)", "c_custkey % 2 = 0"),
    (1, "os", "'linux'", "c_custkey % 4 = 0"), (1, "py", "'3.13'", "c_custkey % 4 = 0"),
    (1, "flag", "'late'", "c_custkey % 4 = 0"), (2, "os", "'bsd'", "c_custkey % 5 = 0"),
    (2, "flag", "'own'", "c_custkey % 5 = 0"), (3, "extra", "'all'", "c_custkey % 6 = 0"),
]


def _union(order: str, rows) -> str:
    """Matrix rows as a UNION ALL (DuckDB)."""
    return "\nUNION ALL ".join(
        f"SELECT c_custkey AS job_id, CAST({pos} AS BIGINT) AS {order}, '{dim}' AS dim, {value} AS value "
        f"FROM customer WHERE c_custkey % 11 <> 0 AND {cond}" for pos, dim, value, cond in rows)


def _one_scan(order: str, rows) -> str:
    """The same rows unfolded from one scan (Spark)."""
    cells = ",\n".join(
        f"IF({cond}, named_struct('pos', {pos}L, 'dim', '{dim}', 'value', {value}), NULL)" for pos, dim, value, cond in rows)
    return (f"SELECT c_custkey AS job_id, r.pos AS {order}, r.dim, r.value FROM (SELECT * FROM customer WHERE c_custkey % 11 <> 0)\n"
            f"LATERAL VIEW explode(filter(array({cells}), x -> x IS NOT NULL)) t AS r")


SHAPES: dict[str, str] = {
    # log lines with every command family
    "LOG": f"""
WITH e AS (SELECT user_id, event_id, event_type, {_K} AS k FROM events)
SELECT user_id AS job_id, {_STEP} AS step_idx, event_id AS seq,
  CASE WHEN event_type = 'error' THEN concat('::error file=f', k, '.py,line=', event_id % 100, '::boom%0A', event_id, '%25')
       WHEN event_type = 'view' AND k % 9 = 0 THEN concat('::debug::view ', k)
       WHEN event_type = 'view' THEN concat('::group::view ', k)
       WHEN event_type = 'click' AND k % 2 = 0 THEN '::endgroup::'
       WHEN event_type = 'click' AND k % 15 = 1 THEN concat('::set-env name=::', event_id)
       WHEN event_type = 'click' THEN concat('::set-env name=E', k % 5, '::', event_id)
       WHEN event_type = 'purchase' AND k % 3 = 0 THEN concat('::add-mask::tok', k)
       WHEN event_type = 'purchase' AND k % 3 = 1 THEN concat('>> ##[warning code=', k, ';]w%3B', event_id)
       WHEN event_type = 'purchase' AND k % 21 = 2 THEN concat('::add-path::', CASE WHEN k % 2 = 0 THEN '' ELSE '/opt' END)
       WHEN event_type = 'purchase' THEN concat('::set-output name=o', k % 10, ',tag=a%2Cb,::v', event_id)
       WHEN k % 4 = 0 THEN '::echo::on'
       WHEN k % 4 = 1 THEN '::echo::off'
       WHEN k % 20 = 2 THEN '::echo::maybe'
       WHEN k % 4 = 2 THEN concat('::unknown-cmd::', k)
       ELSE concat('  text tok', k * 3 % 100, ' from ', event_id) END AS line
FROM e""",
    # key/value writes by kind, job, step, order
    "KV": f"""
WITH e AS (SELECT user_id, event_id, event_type, {_K} AS k FROM events)
SELECT user_id AS job_id, {_STEP} AS step_idx, event_id AS ord,
  CASE event_type WHEN 'view' THEN 'env' WHEN 'click' THEN 'output' WHEN 'error' THEN 'state' WHEN 'signup' THEN 'path' ELSE 'env' END AS kind,
  CASE WHEN k = 99 THEN 'NODE_OPTIONS' WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'ACTIONS_ALLOW_UNSECURE_COMMANDS'
       ELSE concat('K', k % 10) END AS key,
  CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '0' ELSE 'yes' END
       ELSE concat('v', event_id) END AS value
FROM e""",
    # env before the first step
    "INITIAL": """
SELECT c_custkey AS job_id, 'K1' AS key, concat('seg ', c_mktsegment) AS value FROM customer
UNION ALL SELECT c_custkey, 'ACTIONS_ALLOW_UNSECURE_COMMANDS', 'T' FROM customer WHERE c_custkey % 10 = 0""",
    # PATH entries with repeats and blanks
    "PATH": f"""
SELECT user_id AS job_id, event_id AS ord,
  CASE WHEN {_K} % 11 = 0 THEN '' ELSE concat('/opt/t', {_K} % 7) END AS entry
FROM events WHERE event_type = 'signup'""",
    # steps of a job with status; `pos` orders them, the other columns break ties
    "STEP": """
SELECT l_orderkey AS job_id, l_partkey * 10 + l_linenumber AS pos, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat(' Build ', l_returnflag, '/', l_linestatus, ' (#', l_partkey % 7, ')! ') END AS name,
  CASE WHEN l_suppkey % 3 = 0 THEN 'make' ELSE '' END AS run,
  CASE l_partkey % 7 WHEN 0 THEN 'docker://alpine:3' WHEN 1 THEN './.github/workflows/a.yml' WHEN 2 THEN 'o/r/.github/workflows/a.yaml@v1'
       WHEN 3 THEN './actions/x' WHEN 4 THEN 'o/r@v4' ELSE '' END AS uses,
  CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN 'bash' WHEN 2 THEN 'python' WHEN 3 THEN 'cmd' WHEN 4 THEN 'pwsh' ELSE 'zsh {0}' END AS shell,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 4 = 0 THEN 'Failed' ELSE 'Succeeded' END AS status
FROM lineitem""",
    # matrices, one job per customer: dimensions, an empty dimension, excludes, includes
    "MJOB": "SELECT c_custkey AS job_id FROM customer",
    "DIM": _union("pos", _DIM),
    "NODIM": "SELECT c_custkey AS job_id FROM customer WHERE c_custkey % 50 = 0",
    "EXCL": _union("rule_pos", _EXCL),
    "INCL": _union("rule_pos", _INCL),
    # files with paths
    "FILE": """
SELECT lang, source, concat(lang, '/', source, '/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END) AS path, text AS content FROM documents""",
    # nested event payload as JSON text
    "PAYLOAD": """
SELECT o_orderkey AS id, concat('{"Event":{"Action":"', CASE o_orderstatus WHEN 'O' THEN 'opened' WHEN 'F' THEN 'closed' ELSE '' END,
  '","number":', o_orderkey, ',"draft":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END,
  ',"Labels":[{"Name":"', o_orderpriority, '"},{"name":"Bug"}],"user":{"login":"CUSTOMER#', o_custkey, '","id":', o_custkey,
  '},"note":', CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE '"7"' END, CASE WHEN o_custkey % 3 = 0 THEN ',"none":{},"list":[]' ELSE '' END, '}}') AS payload
FROM orders""",
    # predicates as data
    "RULE": """
SELECT * FROM (VALUES (1, 'event.action', '==', 'opened'), (1, 'event.draft', '==', '1'), (2, 'event.number', '>', '500'),
  (3, 'event.note', '==', '0'), (4, 'event.note', '!=', 'abc'), (5, 'event.user.login', 'contains', 'CUSTOMER'), (5, 'event.number', '<=', '1000'),
  (6, 'event.gone', '==', ''), (7, 'event.gone', '==', '1')) AS t(rule_id, path, op, literal)""",
    # templates and their contexts
    "TPL": """
SELECT CAST(n_nationkey AS BIGINT) AS tpl_id, concat('Hi ', '$', '{{ customer.name }} of ', n_name, ', seg ', '$', '{{customer.segment}}', CASE WHEN n_nationkey % 2 = 0 THEN concat(' cost $', '$', '{{ raw }}') ELSE concat(' ', '$', '{{ customer.missing }}.') END) AS template
FROM nation""",
    "CTX": """
SELECT c_custkey AS ctx_id, CAST(c_nationkey AS BIGINT) AS tpl_id, 'customer.name' AS path, c_name AS value FROM customer
UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT), 'customer.segment', c_mktsegment FROM customer""",
    # declared env of workflows, and the env around them
    "WFENV": """
SELECT c_custkey AS wf_id, 'GREETING' AS key, concat('hi ', '$', '{{ env.NAME }}!') AS value FROM customer
UNION ALL SELECT c_custkey, 'SEG', concat('<', '$', '{{env.seg}}', '$', '{{ env.none }}>') FROM customer WHERE c_custkey % 2 = 0""",
    "GLOBALENV": """
SELECT c_custkey AS wf_id, 'NAME' AS key, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'SEG', c_mktsegment FROM customer""",
    # configuration layers, higher priority wins
    "LAYER": """
SELECT c_custkey AS cust, 0 AS priority, 'TZ' AS key, concat('r', c_nationkey % 5) AS value FROM customer
UNION ALL SELECT c_custkey, 1, CASE WHEN c_nationkey % 2 = 0 THEN 'TZ' ELSE 'NODE' END, concat('n', c_nationkey) FROM customer
UNION ALL SELECT c_custkey, 2, 'SEG', c_mktsegment FROM customer WHERE c_custkey % 3 = 0""",
    # log records
    "REC": """
SELECT user_id AS run_id, ts, CASE event_type WHEN 'error' THEN 'ERR' WHEN 'view' THEN ' debug' WHEN 'click' THEN 'Warning' WHEN 'signup' THEN '' ELSE 'trace' END AS level,
  concat(event_type, '=', event_id) AS msg, concat(CASE WHEN event_id % 2 = 0 THEN '/home/u/' ELSE '/work/' END, 'pkg/f', event_id % 9, '.py') AS src
FROM events""",
    # workflow documents in every polymorphic shape
    "DOC": """
SELECT o_orderkey AS doc_id, concat('{"name":"wf', o_orderkey, '","on":',
  CASE o_orderkey % 3 WHEN 0 THEN '"push"' WHEN 1 THEN '["push","pull_request"]' ELSE '{"push":{"branches":["main"]},"workflow_dispatch":{"inputs":{"env":{"required":true,"type":"choice","default":"dev","options":["dev","prod"]},"dry":{"description":"d"}}},"workflow_call":{"inputs":{"tag":{"type":"string","required":true}},"outputs":{"url":{"value":"u"}}}}' END,
  ',"jobs":{"build":{"name":"', CASE WHEN o_custkey % 2 = 0 THEN 'Build it' ELSE '' END, '","runs-on":', CASE o_custkey % 3 WHEN 0 THEN '"ubuntu"' WHEN 1 THEN '["self-hosted","x64"]' ELSE '{"group":"big","labels":["gpu"]}' END,
  CASE WHEN o_custkey % 7 = 0 THEN ',"colour":"red"' ELSE '' END,
  CASE o_custkey % 4 WHEN 0 THEN ',"container":"node:20"' WHEN 1 THEN concat(',"container":{"image":"py:3","options":"-it","env":{"A":"1","N":', o_custkey, '},"ports":["80:80",443],"volumes":["/a:/b"],"credentials":{"username":"u', o_custkey, '","password":"p"}}') ELSE '' END,
  CASE o_custkey % 3 WHEN 0 THEN ',"secrets":"inherit"' WHEN 1 THEN ',"secrets":{"TOKEN":"t","KEY":"k"}' ELSE '' END,
  ',"env":', CASE WHEN o_custkey % 5 = 0 THEN '"none"' ELSE concat('{"A":"1","B":', o_custkey, '}') END,
  ',"steps":[{"id":"s1","run":"make","env":{"INPUT_DRY":"old"}},{"uses":"o/r@v4","env":{"INPUT_NODE-VERSION":"18","C":"c"},"with":{"node-version":"20","dry run":"yes"}}]},"test":{"needs":',
  CASE WHEN o_orderkey % 2 = 0 THEN '"build"' ELSE '["build","lint"]' END, ',"if":"contains(github.ref, ''x'')","uses":"',
  CASE o_custkey % 4 WHEN 0 THEN './.github/workflows/t.yml' WHEN 1 THEN 'o/r/.github/workflows/t.yaml@v1' WHEN 2 THEN 'o/r' ELSE '' END, '"}}}') AS doc
FROM orders""",
    # action documents with one kind of flaw each
    "ACTION": """
SELECT o_orderkey AS doc_id, concat('{"name":"a', o_orderkey, '","description":"d","author":"x","inputs":{"tag":{"description":"t","required":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"default":"',
  CASE o_custkey % 9 WHEN 1 THEN concat('$', '{{ github.ref }}') WHEN 2 THEN concat('$', '{{ secrets.x }}') ELSE 'v1' END, '"}}',
  ',"outputs":{"url":{"description":"u","value":"', CASE o_custkey % 9 WHEN 3 THEN concat('$', '{{ contains(steps.a) }}') WHEN 4 THEN concat('$', '{{ nope(1) }}') ELSE concat('$', '{{ steps.s.outputs.url }}') END, '"',
  CASE WHEN o_custkey % 9 = 5 THEN ',"colour":"red"' ELSE '' END, '}}',
  CASE WHEN o_custkey % 9 = 6 THEN concat(',"extra":"', '$', '{{ github.sha }}"') WHEN o_custkey % 9 = 7 THEN concat(',"', '$', '{{ insert }}":"x"') ELSE '' END,
  ',"runs":', CASE WHEN o_orderkey % 5 = 0 THEN '"node20"'
    WHEN o_orderkey % 5 = 1 THEN '{"using":"Node20","main":"index.js"}'
    WHEN o_orderkey % 5 = 2 THEN '{"using":"docker","image":"Dockerfile","args":["-v",["nested"]],"post-if":"failure()"}'
    WHEN o_orderkey % 5 = 3 THEN concat('{"using":"composite","steps":[{"run":"make","shell":"bash","if":"', '$', '{{ always() }}","continue-on-error":', CASE WHEN o_custkey % 4 = 0 THEN '"maybe"' ELSE 'true' END, '},{"uses":"o/r@v4","with":{"k":"', '$', '{{ hashFiles(1, 2) }}"}}]}')
    ELSE '{"using":"composite","steps":[{"run":"make","shell":"bash"}]}' END, '}') AS doc
FROM orders""",
    # expressions with every kind of flaw
    "EXPR": """
SELECT o_orderkey AS id, concat('run ', '$', '{{ ', CASE o_custkey % 6 WHEN 0 THEN 'contains(github.ref, ''a,b(c'')' WHEN 1 THEN 'startsWith(github.ref)'
   WHEN 2 THEN 'format(''{0}-{1}'', join(steps.a.outputs, ''-''), toJSON(matrix), 1)' WHEN 3 THEN 'secretz.token == true && nope(1)'
   WHEN 4 THEN 'toJson(github, 2)' ELSE '''just text''' END, ' }} and ', '$', '{{ env.HOME }}') AS text FROM orders""",
}

SPARK: dict[str, str] = {
    # text cut into 64-character chunks, in one pass over the text
    "CHUNK": """
SELECT doc_id AS stream, CAST(i AS BIGINT) AS seq, chunk
FROM documents LATERAL VIEW posexplode(regexp_extract_all(text, '(?s).{1,64}', 0)) t AS i, chunk WHERE length(text) > 0""",
    # key/value files of each step
    "KVF": f"""
SELECT job_id, step_idx, kind, listagg(concat(key, '=', value), '\\n') WITHIN GROUP (ORDER BY ord) AS content
FROM ({SHAPES["KV"]}) GROUP BY job_id, step_idx, kind""",
    "DIM": _one_scan("pos", _DIM),
    "EXCL": _one_scan("rule_pos", _EXCL),
    "INCL": _one_scan("rule_pos", _INCL),
}

DUCK: dict[str, str] = {
    "CHUNK": """
SELECT doc_id AS stream, i AS seq, substring(text, i * 64 + 1, 64) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 64 + 1)) AS i FROM documents WHERE length(text) > 0)""",
    "KVF": f"""
SELECT job_id, step_idx, kind, string_agg(concat(key, '=', value), chr(10) ORDER BY ord) AS content
FROM ({SHAPES["KV"]}) GROUP BY job_id, step_idx, kind""",
    # log lines split into their command parts
    "PARSED": r"""
WITH log AS ({LOG}), t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM log),
f AS (SELECT *, CASE WHEN starts_with(t, '::') THEN CASE WHEN regexp_matches(t, '(?s)^::.*?::') THEN 'v2' END
  WHEN contains(t, '##[') THEN CASE WHEN contains(substr(t, instr(t, '##[')), ']') THEN 'v1' END END AS f0 FROM t),
h AS (SELECT *, CASE f0 WHEN 'v2' THEN regexp_extract(t, '(?s)^::(.*?)::(.*)$', 1) WHEN 'v1' THEN regexp_extract(t, '(?s)##\[([^\]]*)\](.*)$', 1) END AS header FROM f),
c AS (SELECT *, split_part(header, ' ', 1) AS nm, CASE WHEN split_part(header, ' ', 1) IN ('set-env', 'set-output', 'save-state', 'add-mask', 'add-path', 'add-matcher', 'remove-matcher', 'debug', 'warning', 'error', 'notice', 'group', 'endgroup', 'echo') THEN f0 END AS form FROM h)
SELECT job_id, step_idx, seq, line, form, CASE WHEN form IS NOT NULL THEN nm END AS command,
  CASE WHEN form IS NOT NULL THEN CASE WHEN contains(header, ' ') THEN ltrim(substr(header, instr(header, ' ') + 1)) ELSE '' END END AS prop_text,
  CASE form WHEN 'v2' THEN replace(replace(replace(regexp_extract(t, '(?s)^::(.*?)::(.*)$', 2), '%0D', chr(13)), '%0A', chr(10)), '%25', '%')
    WHEN 'v1' THEN replace(replace(replace(replace(replace(regexp_extract(t, '(?s)##\[([^\]]*)\](.*)$', 2), '%3B', ';'), '%0D', chr(13)), '%0A', chr(10)), '%5D', ']'), '%25', '%') END AS data,
  CASE WHEN form IS NOT NULL THEN line END AS raw FROM c""",
}


def fill(sql: str) -> str:
    """Replace {NAME} by the text of a shape (the DuckDB form where there are two)."""
    names = sorted({**SHAPES, **DUCK}, key=len, reverse=True)
    for _ in range(4):
        for n in names:
            if "{" + n + "}" in sql:
                sql = sql.replace("{" + n + "}", (DUCK.get(n) or SHAPES[n]).strip())
    return sql
