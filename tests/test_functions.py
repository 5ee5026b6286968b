"""Loose values, casts and text helpers on literal rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.functions import text as tx
from cilake.operators import documents as dc


def one(spark, column, **cells):
    df = spark.range(1)
    for k, v in cells.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def lit(x):
    """A JSON text as a VARIANT value; None is undefined."""
    return dy.Dyn.variant(F.try_parse_json(F.lit(x)) if x is not None else F.lit(None).cast("variant"))


COMPARE = [
    # left, right, compare
    ('""', "0", 0), ("null", "0", 0), (None, "null", 0), ("true", "1", 0), ('"1"', "1", 0), ('"abc"', "1", None),
    ('"a"', '"b"', -1), ('"A"', '"a"', -1), ("true", "false", 1), ("false", "true", 1), ("true", "true", 0),
    ("[]", "[]", 0), ("[1]", "[1]", None), ("{}", "{}", 0), ('{"a":1}', '{"a":1}', None), ("[]", "0", None),
    ("2", "10", -1), ('"2"', '"10"', 1), ('"1d"', "1", None), ('" 1"', "1", None), ('"NaN"', "1", None), ('"-inf"', "0", -1),
]


def test_compare(spark):
    cols = [dy.compare(lit(a), lit(b)).alias(f"c{i}") for i, (a, b, _) in enumerate(COMPARE)]
    got = list(spark.range(1).select(*cols).first())
    assert got == [c for _, _, c in COMPARE]
    ne = [dy.loose_ne(lit(a), lit(b)).alias(f"c{i}") for i, (a, b, _) in enumerate(COMPARE)]
    assert list(spark.range(1).select(*ne).first()) == [c is not None and c != 0 for _, _, c in COMPARE]


def test_literals_compare_as_variants_do(spark):
    values = ['""', '"abc"', '"7"', "7", "0", "true", "false", "null", None, "[]", "{}", '{"a":1}']
    literals = {"7": 7, "0": 0, '"abc"': "abc", '"7"': "7", "true": True, "null": None}
    cols, same = [], []
    for v in values:
        for text, py in literals.items():
            cols.append(dy.compare(lit(v), py).alias(f"a{len(cols)}"))
            same.append(dy.compare(lit(v), lit(text)).alias(f"b{len(same)}"))
    assert list(spark.range(1).select(*cols).first()) == list(spark.range(1).select(*same).first())


def test_truthy_and_logic(spark):
    values = ["true", "false", "0", "0.5", '""', '"x"', "[]", "{}", "null", None]
    got = list(spark.range(1).select(*[dy.truthy(lit(v)).alias(f"c{i}") for i, v in enumerate(values)]).first())
    assert got == [True, False, False, True, False, True, True, True, False, False]
    v = lambda x: F.try_parse_json(F.lit(x))
    assert one(spark, F.to_json(dy.and_(v("0"), v('"b"')))) == "0"
    assert one(spark, F.to_json(dy.or_(v('""'), v('"b"')))) == '"b"'


FLOATS = [(42.0, "42"), (1e15, "1e+15"), (-2.5e16, "-2.5e+16"), (12345678.9, "12345678.9"), (0.0001, "0.0001"), (0.00001234, "1.234e-05"),
          (0.0, "0"), (1e100, "1e+100"), (999999999999999.0, "999999999999999"), (-3.0, "-3"), (1e-300, "1e-300")]


def test_float_text(spark):
    df = spark.createDataFrame([(f,) for f, _ in FLOATS], "f double")
    assert [r.x for r in df.select(dy.float_text(F.col("f")).alias("x")).collect()] == [t for _, t in FLOATS]


def test_contains_join_format(spark):
    assert one(spark, dy.contains_("Hello world", "LLO")) is True
    assert one(spark, dy.contains_("hello", None)) is True
    assert one(spark, dy.starts_with(12345, "123")) is True
    assert one(spark, dy.ends_with("result: true", True)) is True
    arr = lambda t: F.try_parse_json(F.lit(t)).cast("array<variant>")
    assert one(spark, dy.array_contains_(arr('["late","on time"]'), "LATE")) is True
    assert one(spark, dy.array_contains_(arr('["bugs"]'), "bug")) is False
    v = lambda t: F.try_parse_json(F.lit(t))
    assert one(spark, dy.join_(v('["text",42,true,null]'), "-")) == "text-42-true-"
    assert one(spark, dy.join_(v('"hello"'))) == "hello"
    assert one(spark, dy.join_(v("[]"))) == ""
    assert one(spark, dy.join_(v("[[1]]"))) is None
    fmt = lambda t, *a: one(spark, dy.format_(t, *[F.lit(x) for x in a]))
    assert fmt("{{ {0} at {1}, {2}. }}", "Train", "nine", "Gate 4") == "{ Train at nine, Gate 4. }"
    assert fmt("{1}{0}{1}", "{1}", "b") == "b{1}b"
    assert [fmt(t, "a") for t in ("hello {1}", "{}", "{x}", "{ 0 }", "open {0")] == [None] * 5
    assert fmt("a } b", "x") == "a } b"


def test_json(spark):
    assert one(spark, dy.to_json_(F.try_parse_json(F.lit('{"b":1,"a":[null,"x"]}')))) == '{"a":[null,"x"],"b":1}'
    for text, ok in [("{invalid}", False), ("42", True), ('"s"', True), ("", False), ("1 2", False), ("1,2", False), ("1],[2", False),
                     ('{"a":1}x', False), (" [1] ", True)]:
        assert one(spark, dy.from_json_(F.lit(text)).isNotNull()) is ok, text
    low = one(spark, dy.lower_keys(F.lit('{"A":{"Bc":"KEEP: \\"Me\\"","D":["X",{"E":1}]}}')))
    assert json.loads(low) == {"a": {"bc": 'KEEP: "Me"', "d": ["X", {"e": 1}]}}


def test_path_and_star(spark):
    v = dy.load_dynamic(F.lit('{"A":{"Names":[{"N":"x"},{"N":"y"},{}],"t":"éab"}}'))
    assert one(spark, dy.path(v, "a.names[1].n", "string")) == "y"
    assert one(spark, dy.path(v, "a.T[0]", "string")) == "é"
    assert one(spark, dy.path(v, "a.t[9]", "string")) is None
    assert one(spark, dy.path(v, "a['Names']", "string")) is None
    assert one(spark, dy.star(dy.path(v, "a.names"), "n")) == ["x", "y", None]
    obj = F.try_parse_json(F.lit('{"b":{"n":2},"a":{"n":1}}'))
    assert one(spark, dy.star(obj, "n")) == ["1", "2"]


def test_flags(spark):
    for text, want in [("", True), (None, True), ("T", True), ("0", False), ("yes", False)]:
        assert one(spark, dy.fail_fast(F.lit(text).cast("string"))) is want
    for text, want in [("", 4), ("7", 7), ("x", 0), ("1.5", 0), ("-2", -2)]:
        assert one(spark, dy.max_parallel(F.lit(text))) == want


def test_escapes_round_trip(spark):
    texts = ["100%", "a\r\nb", "%0A", "x:y,z;[q]", "%250D", "%"]
    for table in (tx.DATA_ESCAPES, tx.PROPERTY_ESCAPES, tx.LEGACY_ESCAPES):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        assert [r.x for r in df.select(tx.unescape(tx.escape(F.col("t"), table), table).alias("x")).collect()] == texts
    assert one(spark, tx.unescape_data(F.lit("%250D"))) == "%0D"


def test_text_helpers(spark):
    slugs = {"Expose It!": "expose-it", "--a//b--": "a-b", "<unnamed>": "unnamed", "": "unnamed", "v1.2_x": "v1.2_x", "!!!": "unnamed"}
    for t, want in slugs.items():
        assert one(spark, tx.slug(F.lit(t))) == want
    assert one(spark, tx.input_env_name(F.lit("node-version x"))) == "INPUT_NODE-VERSION_X"
    assert one(spark, tx.trim_space(F.lit("\u00a0\t a b \r\n"))) == "a b"
    for t, want in [("WARNING", "warn"), ("", "info"), ("zzz", "info"), (" Err", "error"), ("trace", "trace"), ("D", "debug")]:
        assert one(spark, tx.parse_level(F.lit(t))) == want
    folder, error = tx.safe_workdir(F.col("w"), F.lit("/ws"))
    df = spark.createDataFrame([("",), ("/tmp",), ("a/b",)], "w string").select(folder.alias("f"), error.alias("e"))
    assert [tuple(r) for r in df.collect()] == [("/ws", None), (None, "absolute path"), ("/ws/a/b", None)]


@pytest.mark.parametrize("glob,path,hit", [
    ("*.csv", "y.csv", True), ("*.csv", "in/y.csv", False), ("**/*.sql", "top.sql", True), ("**/*.sql", "jobs/daily/load.sql", True),
    ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a+b(1).x", "a+b(1).x", True), ("[ab].c", "b.c", True),
    ("[^ab].c", "b.c", False), ("**/[a]", "[a]", True), ("a.c", "abc", False)])
def test_globs(glob, path, hit):
    assert bool(re.match(tx.glob_to_regex(glob), path)) is hit


def test_classifications(spark):
    step = lambda run, uses: one(spark, dc.step_type(F.lit(run), F.lit(uses)))
    assert [step("x", "y"), step("", ""), step("x", ""), step("", "docker://a"), step("", "./.github/workflows/a.yml"),
            step("", "o/r/.github/workflows/a.yaml@v1"), step("", "./act"), step("", "o/r@v1")] == [
        "invalid", "invalid", "run", "docker", "local-reusable-workflow", "remote-reusable-workflow", "local-action", "remote-action"]
    job = lambda uses: one(spark, dc.job_type(F.lit(uses)))
    assert [job(""), job("./w.yml"), job("org/repo/w.yml@v1"), job("org/repo/w.yml"), job("o/w.yml@v1")] == [
        "default", "local-reusable-workflow", "remote-reusable-workflow", "unknown", "unknown"]
    assert one(spark, dc.shell_command(F.lit("bash"), F.lit(""))) == "bash -e {0}"
    assert one(spark, dc.action_kind(F.lit("NODE20"))) == "node"


def test_sql_number_agrees_with_the_column_form(spark):
    from cilake.functions import sqlfuncs
    sqlfuncs.register_functions(spark)
    texts = ["", "0", "-1.5e3", ".5", "Infinity", "-inf", "+INF", "inf1", "nan", "0x1p4", " 1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.expr("ci_number(t)").alias("a"), dy.coerce_number(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows), rows
    assert {r.t: r.a for r in rows}["-inf"] == float("-inf")
