"""Registered queries: dynamic values, predicates, templates, expressions, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.functions import sqlfuncs
from cilake.functions import text as tx
from cilake.operators import expressions as ex
from cilake.operators import predicates as pr
from cilake.operators import templates as tp
from cilake.operators.binding import bind
from cilake.plans.registry import Source, query


def _payload(s: Source, *paths: str):
    """Payloads with `v` (lower-cased keys) and one VARIANT column per path, each read once."""
    rows = bind(s.ad("PAYLOAD"), v=dy.load_dynamic(F.col("payload"))).drop("payload")
    return bind(rows, **{p.rpartition(".")[2]: dy.path(F.col("v"), p) for p in paths}) if paths else rows


def _dyn(s: Source, *paths: str):
    """As `_payload`, with each value taken apart once (read with `_d`)."""
    names = [p.rpartition(".")[2] for p in paths]
    return dy.bind_values(_payload(s, *paths), **{f"d_{n}": F.col(n) for n in names})


def _d(name: str) -> dy.Dyn:
    return dy.Dyn.bound(F.col(f"d_{name}"))


_FIELDS = ["event.action", "event.draft", "event.number", "event.note", "event.none", "event.list", "event.gone"]
_O = "FROM orders"


@query("p1_truthy", f"""
SELECT o_orderkey AS id, o_orderstatus IN ('O', 'F') AS action, o_custkey % 2 = 0 AS draft, o_orderkey <> 0 AS number, o_custkey % 5 <> 0 AS note,
  o_custkey % 3 = 0 AS none, o_custkey % 3 = 0 AS list, false AS gone {_O}""")
def _(s: Source):
    names = [p.split(".")[1] for p in _FIELDS]
    return _dyn(s, *_FIELDS).select("id", *[dy.truthy(_d(n)).alias(n) for n in names])


@query("p2_not", f"SELECT o_orderkey AS id, o_custkey % 2 <> 0 AS not_draft, o_custkey % 5 = 0 AS not_note, true AS not_gone {_O}")
def _(s: Source):
    names = ["draft", "note", "gone"]
    return _dyn(s, *[f"event.{n}" for n in names]).select("id", *[dy.not_(_d(n)).alias(f"not_{n}") for n in names])


@query("p3_loose_eq_ne", f"""
SELECT o_orderkey AS id, o_custkey % 5 <> 0 AS note_is_7, o_custkey % 5 = 0 AS note_is_0, o_custkey % 5 <> 0 AS note_ne_abc, o_custkey % 2 = 0 AS draft_is_1,
  o_orderkey = 500 AS number_is_500, o_orderstatus = 'O' AS action_opened, false AS action_case, true AS none_is_none, false AS event_is_event, false AS event_ne_event, false AS list_is_text {_O}""")
def _(s: Source):
    p = _dyn(s, *_FIELDS, "event")
    return p.select(
        "id", dy.loose_eq(_d("note"), 7).alias("note_is_7"), dy.loose_eq(_d("note"), 0).alias("note_is_0"),
        dy.loose_ne(_d("note"), "abc").alias("note_ne_abc"), dy.loose_eq(_d("draft"), 1).alias("draft_is_1"),
        dy.loose_eq(_d("number"), "500").alias("number_is_500"), dy.loose_eq(_d("action"), "opened").alias("action_opened"),
        dy.loose_eq(_d("action"), "OPENED").alias("action_case"), dy.loose_eq(_d("none"), _d("none")).alias("none_is_none"),
        dy.loose_eq(_d("event"), _d("event")).alias("event_is_event"), dy.loose_ne(_d("event"), _d("event")).alias("event_ne_event"),
        dy.loose_eq(_d("list"), "x").alias("list_is_text"))


@query("p4_loose_order", f"""
SELECT o_orderkey AS id, o_orderkey < 1000 AS lt, o_orderkey >= 500 AS ge, true AS note_le_7, false AS draft_lt_true, o_custkey % 2 <> 0 AS draft_gt_true,
  o_orderstatus IN ('O', 'F') AS action_gt_c, false AS action_lt_one {_O}""")
def _(s: Source):
    return _dyn(s, *_FIELDS).select(
        "id", dy.loose_lt(_d("number"), "1000").alias("lt"), dy.loose_ge(_d("number"), 500).alias("ge"),
        dy.loose_le(_d("note"), 7).alias("note_le_7"), dy.loose_lt(_d("draft"), True).alias("draft_lt_true"),
        dy.loose_gt(_d("draft"), True).alias("draft_gt_true"), dy.loose_gt(_d("action"), "c").alias("action_gt_c"),
        dy.loose_lt(_d("action"), -1).alias("action_lt_one"))


_ACTION = """CASE o_orderstatus WHEN 'O' THEN '"opened"' WHEN 'F' THEN '"closed"' ELSE '""' END"""


@query("p5_and", f"SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN {_ACTION} ELSE 'false' END AS out {_O}")
def _(s: Source):
    p = _payload(s, "event.draft", "event.action")
    return p.select("id", dy.to_json_(dy.and_(F.col("draft"), F.col("action"))).alias("out"))


@query("p6_or", f"""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '"7"' END AS out {_O}""")
def _(s: Source):
    p = bind(_payload(s), note=dy.path(F.col("v"), "event.note"), uid=dy.path(F.col("v"), "event.user.id"))
    return p.select("id", dy.to_json_(dy.or_(F.col("note"), F.col("uid"))).alias("out"))


@query("p7_path", f"""
SELECT o_orderkey AS id, o_orderpriority AS first_label, CAST(NULL AS VARCHAR) AS tenth_label, concat('CUSTOMER#', o_custkey) AS login,
  CAST(NULL AS VARCHAR) AS exact_miss, CAST(NULL AS VARCHAR) AS below_scalar, CASE o_orderstatus WHEN 'O' THEN 'o' WHEN 'F' THEN 'c' END AS first_char {_O}""")
def _(s: Source):
    at = lambda p: dy.path(F.col("v"), p, "string")
    return _payload(s).select(
        "id", at("event.labels[0].name").alias("first_label"), at("event.labels[9].name").alias("tenth_label"),
        at("EVENT.User.login").alias("login"), at("event['Action']").alias("exact_miss"),
        at("event.number.x").alias("below_scalar"), at("event.action[0]").alias("first_char"))


@query("p8_star", f"SELECT o_orderkey AS id, concat(o_orderpriority, '|Bug') AS names, CAST(2 AS BIGINT) AS n {_O}")
def _(s: Source):
    names = dy.star(dy.path(F.col("v"), "event.labels"), "name")
    return _payload(s).select("id", F.array_join(names, "|").alias("names"), F.size(names).cast("bigint").alias("n"))


_LEAVES = [("event.action", "string", "CASE o_orderstatus WHEN 'O' THEN 'opened' WHEN 'F' THEN 'closed' ELSE '' END", "true"),
           ("event.number", "number", "CAST(o_orderkey AS VARCHAR)", "true"),
           ("event.draft", "boolean", "CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END", "true"),
           ("event.labels[0].name", "string", "o_orderpriority", "true"), ("event.labels[1].name", "string", "'Bug'", "true"),
           ("event.user.login", "string", "concat('CUSTOMER#', o_custkey)", "true"), ("event.user.id", "number", "CAST(o_custkey AS VARCHAR)", "true"),
           ("event.note", "null", "'null'", "o_custkey % 5 = 0"), ("event.note", "string", "'7'", "o_custkey % 5 <> 0")]


@query("p9_lower_keys", "\nUNION ALL ".join(
    f"SELECT o_orderkey AS id, '{p}' AS path, '{k}' AS kind, {v} AS value FROM orders WHERE {c}" for p, k, v, c in _LEAVES))
def _(s: Source):
    return pr.lowered_leaves(s.ad("PAYLOAD"), "payload")


@query("p11_match_rules", """
SELECT o_orderkey AS id, r AS rule_id FROM orders, (VALUES (1), (2), (3), (4), (5), (6), (7)) t(r)
WHERE CASE r WHEN 1 THEN o_orderstatus = 'O' AND o_custkey % 2 = 0 WHEN 2 THEN o_orderkey > 500 WHEN 3 THEN o_custkey % 5 = 0 WHEN 4 THEN o_custkey % 5 <> 0
  WHEN 5 THEN o_orderkey <= 1000 WHEN 6 THEN true ELSE false END""")
def _(s: Source):
    return pr.match_rules(s.ad("PAYLOAD"), s.ad("RULE"))


@query("f27_kind_of", f"""
SELECT o_orderkey AS id, 'string' AS action, 'boolean' AS draft, 'number' AS number, CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE 'string' END AS note,
  CASE WHEN o_custkey % 3 = 0 THEN 'object' ELSE 'undefined' END AS none, CASE WHEN o_custkey % 3 = 0 THEN 'array' ELSE 'undefined' END AS list, 'undefined' AS gone {_O}""")
def _(s: Source):
    names = [p.split(".")[1] for p in _FIELDS]
    return _payload(s, *_FIELDS).select("id", *[dy.kind_of(F.col(n)).alias(n) for n in names])


@query("f1_contains", """
SELECT o_orderkey, contains(lower(o_orderpriority), 'urg') AS urgent, contains(CAST(o_custkey AS VARCHAR), '12') AS has_12 FROM orders""")
def _(s: Source):
    return s.table("orders").select(
        "o_orderkey", dy.contains_(dy.Dyn.string(F.col("o_orderpriority")), "UrG").alias("urgent"),
        dy.contains_(dy.Dyn.number(F.col("o_custkey")), 12).alias("has_12"))


@query("f2_array_contains", f"SELECT o_orderkey AS id, true AS bug, lower(o_orderpriority) = '1-urgent' AS urgent, false AS part {_O}")
def _(s: Source):
    names = dy.star(dy.path(F.col("v"), "event.labels"), "name", "variant")
    p = bind(_payload(s), names=names)
    has = lambda x: dy.array_contains_(F.col("names"), x)
    return p.select("id", has("BUG").alias("bug"), has("1-urgENT").alias("urgent"), has("Bu").alias("part"))


@query("f3_starts_with", "SELECT o_orderkey, starts_with(lower(o_orderpriority), '1-u') AS hit, starts_with(CAST(o_orderkey AS VARCHAR), '12') AS num FROM orders")
def _(s: Source):
    return s.table("orders").select("o_orderkey", dy.starts_with(dy.Dyn.string(F.col("o_orderpriority")), "1-U").alias("hit"),
                                    dy.starts_with(dy.Dyn.number(F.col("o_orderkey")), "12").alias("num"))


@query("f4_ends_with", "SELECT o_orderkey FROM orders WHERE ends_with(lower(o_orderpriority), 'ium')")
def _(s: Source):
    return s.table("orders").filter(dy.ends_with(dy.Dyn.string(F.col("o_orderpriority")), "IUM")).select("o_orderkey")


@query("f5_format", """
SELECT o_orderkey, concat('{ ', o_orderpriority, ' } is {0} of ', o_orderkey, '/', o_orderpriority) AS out, CAST(NULL AS VARCHAR) AS bad_index, CAST(NULL AS VARCHAR) AS unclosed,
  CASE o_custkey % 3 WHEN 0 THEN concat('a', o_orderkey) WHEN 1 THEN NULL ELSE 'plain' END AS by_row FROM orders""")
def _(s: Source):
    o = s.table("orders")
    args = [F.col("o_orderpriority"), F.col("o_orderkey").cast("string")]
    t = F.when(F.expr("o_custkey % 3 = 0"), "a{1}").when(F.expr("o_custkey % 3 = 1"), "a{x}").otherwise("plain")
    return o.select("o_orderkey", dy.format_("{{ {0} }} is {{0}} of {1}/{0}", *args).alias("out"),
                    dy.format_("{2}", *args).alias("bad_index"), dy.format_("x {0", *args).alias("unclosed"),
                    dy.format_(t, *args).alias("by_row"))


@query("f6_join", f"SELECT o_orderkey AS id, concat(o_orderpriority, '-Bug') AS names, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE '7' END AS scalar, CAST(NULL AS VARCHAR) AS objects {_O}")
def _(s: Source):
    p = _payload(s, "event.labels", "event.note")
    names = F.transform(F.col("labels").try_cast("array<variant>"), lambda e: dy.path(e, "name"))
    return bind(p, names=names.cast("variant")).select(
        "id", dy.join_(F.col("names"), "-").alias("names"), dy.join_(F.col("note")).alias("scalar"),
        dy.join_(F.col("labels")).alias("objects"))


_TEXT = """CASE WHEN abs({0}) >= 1e15 AND abs({0}) < 1e16 THEN regexp_replace(regexp_replace(concat(substr(CAST(CAST({0} AS BIGINT) AS VARCHAR), 1, 1), '.', substr(CAST(CAST({0} AS BIGINT) AS VARCHAR), 2), 'e+15'), '0+e', 'e'), '\\.e', 'e')
  ELSE regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '') END"""


@query("f7_str", f"""
SELECT l_orderkey, l_linenumber, {_TEXT.format('l_extendedprice')} AS price, {_TEXT.format('(l_discount / 1024)')} AS small, {_TEXT.format('(l_quantity * 4096e11)')} AS big FROM lineitem""")
def _(s: Source):
    t = lambda c: dy.str_(dy.Dyn.number(c))
    return s.table("lineitem").select("l_orderkey", "l_linenumber", t(F.col("l_extendedprice")).alias("price"),
                                      t(F.col("l_discount") / 1024).alias("small"), t(F.col("l_quantity") * 4096e11).alias("big"))


@query("f8_to_json", f"""
SELECT o_orderkey AS id, concat('{{"event":{{"action":', {_ACTION}, ',"draft":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"labels":[{{"name":"', o_orderpriority, '"}},{{"name":"Bug"}}]',
  CASE WHEN o_custkey % 3 = 0 THEN ',"list":[],"none":{{}}' ELSE '' END, ',"note":', CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE '"7"' END,
  ',"number":', o_orderkey, ',"user":{{"id":', o_custkey, ',"login":"CUSTOMER#', o_custkey, '"}}}}}}') AS json {_O}""")
def _(s: Source):
    return _payload(s).select("id", dy.to_json_(F.col("v")).alias("json"))


@query("f9_from_json", """
SELECT event_id, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 4 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events""")
def _(s: Source):
    text = F.when(F.expr("event_id % 4 = 0"), F.concat("props", F.lit("x"))).otherwise(F.col("props"))
    e = bind(s.table("events").select("event_id", text.alias("t")), v=dy.from_json_(F.col("t")))
    return e.select("event_id", F.col("v").isNotNull().alias("ok"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


_NUM = """CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN concat(p_size, '.25') WHEN 2 THEN concat(' ', p_size) WHEN 3 THEN concat(p_size, 'd') WHEN 4 THEN '0x10'
  WHEN 5 THEN concat('-', p_size, 'e2') WHEN 6 THEN p_name WHEN 7 THEN '.5' ELSE '-Infinity' END"""


@query("f21_coerce_number", f"""
SELECT p_partkey, CASE WHEN x = '' THEN 0.0 WHEN lower(x) = '-infinity' THEN CAST('-inf' AS DOUBLE) WHEN regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(x AS DOUBLE) END AS n
FROM (SELECT p_partkey, {_NUM} AS x FROM part)""")
def _(s: Source):
    return s.table("part").select("p_partkey", F.expr(_NUM).alias("x")).select("p_partkey", dy.coerce_number(F.col("x")).alias("n"))


@query("f17_slug", """
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(concat('!', p_name, ' (', p_type, ')_#', CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand END)), '[^a-z0-9._-]+', '-', 'g'), '-'), ''), 'unnamed') AS slug FROM part""")
def _(s: Source):
    t = F.concat(F.lit("!"), "p_name", F.lit(" ("), "p_type", F.lit(")_#"), F.when(F.expr("p_size % 9 = 0"), "").otherwise(F.col("p_brand")))
    return s.table("part").select("p_partkey", tx.slug(t).alias("slug"))


@query("f18_input_env_name", "SELECT p_partkey, concat('INPUT_', regexp_replace(upper(concat(p_type, '-', p_brand, '.x')), '[^A-Z0-9-]', '_', 'g')) AS name FROM part")
def _(s: Source):
    return s.table("part").select("p_partkey", tx.input_env_name(F.concat("p_type", F.lit("-"), "p_brand", F.lit(".x"))).alias("name"))


# ---- templates ------------------------------------------------------------------------------

_RENDERED = """concat('Hi ', c_name, ' of ', n_name, ', seg ', c_mktsegment, CASE WHEN n_nationkey % 2 = 0 THEN concat(' cost $', '$', '{{ raw }}') ELSE ' .' END)"""


@query("p12_render_templates", f"""
SELECT c_custkey AS ctx_id, CAST(c_nationkey AS BIGINT) AS tpl_id, CASE WHEN n_nationkey % 5 <> 0 THEN concat({_RENDERED}, ' it''s ', c_name, ' 7') END AS text,
  CASE WHEN n_nationkey % 5 = 0 THEN 'no value: format(''x'', a.b)' END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(s: Source):
    # quoted texts and bracketed names are values too; a call is not
    more = F.concat(F.lit(" $" + "{{ 'it''s' }} $" + "{{ Customer['NAME'] }} $" + "{{7}}"),
                    F.when(F.expr("tpl_id % 5 = 0"), " $" + "{{ format('x', a.b) }}").otherwise(""))
    return tp.render_templates(s.ad("TPL").withColumn("template", F.concat("template", more)), s.ad("CTX"))


@query("j9_lookup_context", """
SELECT n.n_nationkey AS tpl_id, p.path, c.ctx_id, c.value FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation) n, (VALUES ('customer.name'), ('customer.segment'), ('customer.missing')) p(path)
LEFT JOIN ({CTX}) c ON c.tpl_id = n.n_nationkey AND c.path = p.path WHERE p.path <> 'customer.missing' OR n.n_nationkey % 2 <> 0""")
def _(s: Source):
    refs = s.ad("TPL").select("tpl_id", F.explode(tp.tokens(F.col("template")).getField("path")).alias("path")).filter(
        F.col("path").isNotNull()).distinct()
    return tp.lookup_context(refs, s.ad("CTX")).select("tpl_id", "path", "ctx_id", "value")


@query("p13_evaluate_env", """
SELECT c_custkey AS wf_id, 'NAME' AS key, c_name AS value, CAST(NULL AS VARCHAR) AS error FROM customer
UNION ALL SELECT c_custkey, 'GREETING', CASE WHEN c_custkey % 7 <> 0 THEN concat('hi ', c_name, '!') END, CASE WHEN c_custkey % 7 = 0 THEN 'no value: a == b' END FROM customer
UNION ALL SELECT c_custkey, 'SEG', CASE WHEN c_custkey % 2 = 0 THEN concat('<', c_mktsegment, '>') ELSE c_mktsegment END, NULL FROM customer""")
def _(s: Source):
    broken = (F.col("key") == "GREETING") & F.expr("wf_id % 7 = 0")
    declared = s.ad("WFENV").withColumn("value", F.when(broken, "$" + "{{ a == b }}").otherwise(F.col("value")))
    return tp.evaluate_env(declared, s.ad("GLOBALENV"))


# ---- expressions ----------------------------------------------------------------------------

# what each kind of expression refers to: (selector, kind, name, argument count)
_REFS = [(0, "call", "contains", 2), (0, "variable", "github", None), (1, "call", "startsWith", 1), (1, "variable", "github", None),
         (2, "call", "format", 4), (2, "call", "join", 2), (2, "call", "toJSON", 1), (2, "variable", "steps", None), (2, "variable", "matrix", None),
         (3, "variable", "secretz", None), (3, "call", "nope", 1), (4, "call", "toJson", 2), (4, "variable", "github", None)]
_REF_SQL = "\nUNION ALL ".join(
    [f"SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS body_pos, '{k}' AS kind, '{n}' AS name, CAST({'NULL' if a is None else a} AS INTEGER) AS n_args FROM orders WHERE o_custkey % 6 = {c}"
     for c, k, n, a in _REFS] + ["SELECT o_orderkey, 1, 'variable', 'env', NULL FROM orders"])


@query("p14_extract_refs", _REF_SQL)
def _(s: Source):
    return ex.extract_refs(s.ad("EXPR"), "text").drop("body")


@query("j10_lint_calls", f"""
SELECT id, name, CASE WHEN lower(name) = 'nope' THEN 'no such function' WHEN lower(name) = 'startswith' THEN 'too few arguments' ELSE 'too many arguments' END AS problem
FROM ({_REF_SQL}) WHERE kind = 'call' AND (lower(name) IN ('nope', 'startswith') OR (name = 'toJson' AND n_args = 2))""")
def _(s: Source):
    return ex.lint_calls(ex.extract_refs(s.ad("EXPR"), "text"), ex.arity_table(s.spark)).select("id", "name", "problem")


@query("j11_lint_variables", f"SELECT id, body_pos, name FROM ({_REF_SQL}) WHERE kind = 'variable' AND name NOT IN ('github', 'env', 'matrix')")
def _(s: Source):
    return ex.lint_variables(ex.extract_refs(s.ad("EXPR"), "text"), ["GitHub", "env", "matrix"]).select("id", "body_pos", "name")


# ---- SQL functions --------------------------------------------------------------------------

@query("x1_register_functions", """
SELECT o_orderkey, contains(lower(o_orderpriority), 'urg') AS has_urg, starts_with(lower(o_orderpriority), '2') AS high, ends_with(lower(o_orderpriority), 'w') AS low,
  CASE WHEN o_orderstatus = 'F' THEN false END AS b, CAST(o_custkey AS DOUBLE) AS n, concat('INPUT_', regexp_replace(upper(o_orderpriority), '[^A-Z0-9-]', '_', 'g')) AS env_name,
  trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug, upper(o_orderstatus) AS added FROM orders""")
def _(s: Source):
    sqlfuncs.register_functions(s.spark, {"ci_upper": ("s STRING", "STRING", "upper(s)")})
    s.table("orders").createOrReplaceTempView("orders")
    return s.spark.sql("""
        SELECT o_orderkey, CI_Contains(o_orderpriority, 'URG') AS has_urg, ci_starts_with(o_orderpriority, '2') AS high,
          ci_ends_with(o_orderpriority, 'W') AS low, ci_parse_bool(o_orderstatus) AS b, ci_number(CAST(o_custkey AS STRING)) AS n,
          ci_input_env_name(o_orderpriority) AS env_name, ci_slug(o_orderpriority) AS slug, ci_upper(o_orderstatus) AS added
        FROM orders""")
