"""Loading, path rows, rules as data, document checks, expressions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.operators import expressions as ex
from cilake.operators import predicates as pr
from cilake.operators import quality as ql
from cilake.sources import documents as sd

D = "$"


def test_yaml(spark):
    docs = [(1, "on: push\nenabled: true\nwhen: 2024-01-01\nother: yes\n"), (2, "a: [1"), (3, '{"on": ["x"]}')]
    read = sd.load_workflows(spark.createDataFrame(docs, "id int, text string"))
    good, bad = read.filter("error is null"), read.filter("error is not null")
    got = {r.id: r.j for r in good.select("id", F.to_json("doc").alias("j")).collect()}
    assert got == {1: '{"enabled":true,"on":"push","other":"yes","when":"2024-01-01"}', 3: '{"on":["x"]}'}
    assert [r.id for r in bad.collect()] == [2]


def test_paths_and_depth(spark):
    df = spark.createDataFrame([(1, '{"A":[{"b":null},2],"c":{}}')], "id int, doc string")
    got = {r.path: (r.kind, r.value) for r in pr.explode_paths(df).collect()}
    assert got == {"": ("object", '{"A":[{"b":null},2],"c":{}}'), "a": ("array", '[{"b":null},2]'), "a[0]": ("object", '{"b":null}'),
                   "a[0].b": ("null", "null"), "a[1]": ("number", "2"), "c": ("object", "{}")}


def test_deep_documents(spark):
    deep = '{"a":[' * 100 + '"]}\\"[["' + "]}" * 100
    got = pr.explode_paths(spark.createDataFrame([(1, deep), (2, "[]"), (3, "7")], "id int, doc string"))
    assert {r.id: (r.n, r.m) for r in got.groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("m")).collect()} == {
        1: (201, 200), 2: (1, 0), 3: (1, 0)}
    assert check(spark, '{"extra":%s}' % deep) == []


def test_rules(spark):
    docs = spark.createDataFrame([(1, '{"A":"x","n":5}'), (2, '{"n":"5"}')], "id bigint, payload string")
    rules = spark.createDataFrame([(1, "a", "==", "x"), (1, "n", ">", "4"), (2, "a", "==", ""), (3, "n", "==", "5"), (4, "a", "!=", "x"), (5, "zz", "<=", "0")],
                                  "rule_id int, path string, op string, literal string")
    got = sorted((r.id, r.rule_id) for r in pr.match_rules(docs, rules).collect())
    assert got == [(1, 1), (1, 3), (1, 5), (2, 2), (2, 3), (2, 5)]


def holds(op, value, literal):
    """One condition in plain Python; `value` is ... where the path is missing."""
    number = lambda t: 0.0 if t == "" else float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", t) else None
    text = "" if value in (..., None) else str(value).lower() if isinstance(value, bool) else str(value)
    if op in ("contains", "startswith", "endswith"):
        a, b = text.lower(), literal.lower()
        return {"contains": b in a, "startswith": a.startswith(b), "endswith": a.endswith(b)}[op]
    if isinstance(value, str):
        a, b = value.encode(), literal.encode()
    else:
        a, b = 0.0 if value in (..., None) else float(value), number(literal)
        if b is None:
            return False
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def test_rules_against_all_pairs(spark):
    rnd = random.Random(11)
    some = lambda: rnd.choice([None, True, False, 0, -1, 2.5, rnd.randrange(600), "", "Ab", "xAbcd", "abcdE9", "7", "é"])
    docs = {i: {k: some() for k in "abc" if rnd.random() < 0.8} for i in range(60)}
    literal = lambda: rnd.choice(["", "0", "1", "ab", "Ab", "abcd", "bcde", "cde9", "é", "z", "2.50", str(rnd.randrange(600))])
    ops = ["==", "!=", "<", "<=", ">", ">=", "contains", "startswith", "endswith"]
    rules = [(r, rnd.choice("abc"), rnd.choice(ops), literal()) for r in range(900) for _ in range(rnd.choice([1, 1, 2, 3]))]
    want = {(i, r) for i, d in docs.items() for r in range(900)
            if all(holds(op, d.get(p, ...), x) for q, p, op, x in rules if q == r)}
    ddf = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()], "id bigint, payload string")
    rdf = spark.createDataFrame(rules, "rule_id int, path string, op string, literal string")
    got = [(r.id, r.rule_id) for r in pr.match_rules(ddf, rdf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pr.match_rules(ddf.limit(0), rdf).count() == 0 and pr.match_rules(ddf, rdf.limit(0)).count() == 0


def test_expressions(spark):
    text = f"a {D}{{{{ format('{{0}} }}}} (', join(x.y, ','), (b || c)) }}}} {D}{{{{ 'lit' }}}}"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    refs = {(r.body_pos, r.kind, r.name, r.n_args) for r in ex.extract_refs(df, "text").collect()}
    assert refs == {(0, "call", "format", 3), (0, "call", "join", 2), (0, "variable", "x", None), (0, "variable", "b", None), (0, "variable", "c", None)}
    problems = ex.lint_calls(ex.extract_refs(spark.createDataFrame([(1, f"{D}{{{{ contains(a) || Nope() || JOIN(1,2,3) }}}}")], "id int, text string"), "text"),
                             ex.arity_table(spark))
    assert {(r.name, r.problem) for r in problems.collect()} == {
        ("contains", "too few arguments"), ("Nope", "no such function"), ("JOIN", "too many arguments")}


def check(spark, doc, **kw):
    df = spark.createDataFrame([(1, doc)], "id int, doc string")
    return sorted((r.path, r.rule) for r in ql.check_documents(df, ql.ACTION_RULES, **kw).collect())


def test_action_checks(spark):
    fine = '{"name":"n","runs":{"using":"composite","steps":[{"run":"x","shell":"bash"},{"uses":"a/b@v1","with":{"k":"%s"}}]}}' % (D + "{{ hashFiles('a') }}")
    assert check(spark, fine) == []
    assert check(spark, fine, missing_required=True) == []
    lost = '{"runs":{"using":"composite","steps":[{"run":"x"}]}}'
    assert check(spark, lost) == []
    assert ("runs.steps[0]", "missing_required") in check(spark, lost, missing_required=True)
    assert check(spark, '{"inputs":["x"],"runs":{"plugin":"p"}}') == [("inputs", "wrong_container")]
    assert check(spark, '{"inputs":{"a":{"default":"%s"}}}' % (D + "{{ job.id }}")) == []
    assert check(spark, '{"note":"%s"}' % (D + "{{ 'text' }}")) == []
    assert check(spark, '{"note":{"deep":["%s"]}}' % (D + "{{ github.x }}")) == [("note.deep[0]", "expr_not_allowed")]
    assert check(spark, '{"note":"%s"}' % (D + "{{ github.x")) == [("note", "unclosed_expr")]
    assert check(spark, '{"outputs":{"o":{"%s":1}}}' % (D + "{{ insert }}")) == [("outputs.o." + D + "{{ insert }}", "insert_key")]


def test_rules_from_a_document(spark):
    text = """{"definitions": {
        "top": {"mapping": {"properties": {"mode": {"type": "mode", "required": true}, "list": "list", "n": "count", "either": "either"},
                            "loose-key-type": "string", "loose-value-type": "any"}},
        "mode": {"allowed-values": ["on", "off"]}, "list": {"sequence": {"item-type": "name"}}, "name": {"context": ["env", "f(1,MAX)"], "string": {}},
        "count": {"number": {}}, "either": {"one-of": ["fixed", "bare"]}, "fixed": {"string": {"constant": "x"}}, "bare": {"mapping": {}}}}"""
    rules = ql.RuleSet.from_document(text, "top")
    assert rules.required == [("top", "mode")] and rules.constant == {"fixed": "x"} and "bare" in rules.mappings

    def broken(doc, **kw):
        df = spark.createDataFrame([(1, doc)], "id int, doc string")
        return sorted((r.path, r.rule) for r in ql.check_documents(df, rules, **kw).collect())

    fine = '{"mode":"on","list":["a","%s"],"n":3,"either":"x","more":[1]}' % (D + "{{ f(env.A, 2) }}")
    assert broken(fine, missing_required=True) == []
    assert broken('{"mode":"up","list":[["a"],"%s"],"n":"3","either":{"a":1}}' % (D + "{{ secrets.A }}")) == [
        ("either", "wrong_container"), ("either.a", "unknown_property"), ("list[0]", "wrong_container"), ("list[1]", "unknown_variable"),
        ("mode", "allowed_values"), ("n", "scalar_type")]
    assert broken('{"mode":"off","either":"y"}') == [("either", "constant"), ("either", "wrong_container")]
    assert broken("{}", missing_required=True) == [("", "missing_required")]
    with pytest.raises(ValueError, match="nowhere"):
        ql.RuleSet.from_document('{"definitions": {"top": {"sequence": {"item-type": "nowhere"}}}}', "top")


def test_context_documents(spark):
    rows = [(1, "github", "{}"), (1, "env", ""), (1, "vars", "{"), (1, "what", "{}")]
    read = sd.load_contexts(spark.createDataFrame(rows, "id int, name string, json string"))
    ok, bad = read.filter("error is null"), read.filter("error is not null")
    assert [r.name for r in ok.collect()] == ["github"]
    assert sorted(r.error for r in bad.collect()) == ["invalid JSON in vars", "unknown context what"]


def test_string_slice(spark):
    df = spark.createDataFrame([("[1,\"a\"]",), ("\"x\"",), ("{}",), ("null",)], "t string")
    got = [r.x for r in df.select(dy.string_slice(F.try_parse_json("t")).alias("x")).collect()]
    assert got == [["1", "a"], ["x"], [], []]


def test_costly_documents_are_dealt_over_the_tasks_of_a_cluster(spark, tmp_path, monkeypatch):
    from cilake import session
    from cilake.plans.registry import Source

    rows = [(k, 10 + k, "O", "1-URGENT") for k in range(40)]
    names = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(session, "in_one_process", lambda s: False)
    source = Source(spark, str(tmp_path))
    assert source.table("orders").rdd.getNumPartitions() == 1
    for shape in ("ACTION", "PAYLOAD"):
        got = source.ad(shape)
        assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert got.count() == 40
    nodes = ql.check_nodes(source.ad("ACTION"), ql.ACTION_RULES).filter("doc_id = 3 AND path = 'runs.steps[0].if'")
    assert [(r.ctx, len(r.choices)) for r in nodes.select("ctx", "choices").sort("choices").collect()][0] == (
        ql.ACTION_RULES.contexts["step-if"], 2)


def test_kinds_build_nothing_of_what_lies_below(spark):
    texts = {"{}": "object", '{"a":[1]}': "object", "[]": "array", '["x",{},[],null,1.5,true]': "array", "[null]": "array", "null": "null",
             "1": "number", "1e400": "number", "true": "boolean", '"x"': "string", '"{}"': "string", '"[]"': "string", "bad": "undefined"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.try_parse_json("t").alias("v"))
    assert {r.t: r.k for r in df.select("t", dy.kind_of(F.col("v")).alias("k")).collect()} == texts
    # casts to containers of VARIANTs write every level below anew
    assert "variant" not in str(dy.kind_of(F.col("v"))._jc.toString()).lower().replace("schema_of_variant", "")


def test_errors_of_nodes_are_compiled_and_computed_once(spark, capsys):
    docs = spark.createDataFrame([(1, '{"extra":"%s"}' % (D + "{{ github.sha }}"))], "id int, doc string")
    ql.check_documents(docs, ql.ACTION_RULES).explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    lines = [x for x in plan.splitlines() if "key not declared: " in x]
    assert len(lines) == 1 and "Project" in lines[0]


def test_levels_unfold_alike_as_rows_and_by_the_fold(spark):
    hold, deep = D + "{{ github.sha }}", '{"a":' * 9 + '[{},[],[[1,null]]]' + "}" * 9
    texts = ['{"runs":"%s","x":%s}' % (hold, deep), '{"runs":{"using":"c","steps":[{"run":"x","if":"%s"},{"uses":"o/r","with":{"k":"v"}},"%s"]}}' % (hold, hold),
             '{"inputs":{"tag":{"default":"%s","required":true}},"%s":{"x":[1]},"runs":[]}' % (hold, D + "{{ insert }}"), "5", "null", "[]", "{}", "bad", None]
    docs = spark.createDataFrame([(k % 7 or None, "p", t) for k, t in enumerate(texts)], "id int, pos string, doc string")

    def nodes(levels, held):
        return sorted(map(repr, ql.check_nodes(docs, ql.ACTION_RULES, "doc", held, levels).collect()))

    folded = nodes(0, False)
    assert len(folded) > 50 and any("depth=13" in r for r in folded)
    assert nodes(1, False) == folded and nodes(4, False) == folded
    assert nodes(4, True) == nodes(0, True) != folded


def test_sound_nodes_are_left_out_early_and_one_sort_judges_alternatives(spark, capsys):
    hold = D + "{{ github.sha }}"
    texts = ['{"runs":"%s","x":{"a":{"b":[1,"%s"]}}}' % (hold, hold), '{"runs":{"using":"c","steps":[{"run":"x","if":"%s"},{"uses":"o/r","with":{"k":"v"}},7]}}' % hold,
             '{"inputs":{"tag":{"default":"%s (","deep":%s}},"runs":{"steps":[{"run":"x"}],"image":[]}}' % (D + "{{ nope(a, (b)) }}", '{"a":' * 9 + '"%s"' % hold + "}" * 9),
             '{"outputs":{"url":{"value":"%s"}},"%s":1}' % (D + "{{ STEPS.a || ma", D + "{{ insert }}"), "5", "null", "bad", None]
    docs = spark.createDataFrame([(k % 4 or None, t) for k, t in enumerate(texts)], "id int, doc string")
    for held in (False, True):
        for levels in (0, 2, 6):
            def cut(*node):
                return F.coalesce(ql._doubtful(ql.ACTION_RULES, held)(*node), F.lit(False))

            every = ql.check_nodes(docs, ql.ACTION_RULES, "doc", held, levels)
            some = ql.check_nodes(docs, ql.ACTION_RULES, "doc", held, levels, cut)
            full = every.withColumn("e", F.explode(ql.node_errors(ql.ACTION_RULES))).count()
            kept = some.withColumn("e", F.explode(ql.node_errors(ql.ACTION_RULES))).count()
            assert kept == full > 15 and some.count() == every.filter(cut(*(F.col(c) for c in ql._JUDGED))).count() < every.count()
    ql.check_documents(docs, ql.ACTION_RULES).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 4
