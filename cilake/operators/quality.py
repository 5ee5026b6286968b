"""Document checks against declared rules, as violation rows.

A rule set names definitions: mappings (known keys, loose type), sequences, one-of, scalars, and
the contexts an expression may use below them. Documents are unfolded level by level; every node
carries the definition its parent gave it, the contexts collected on the way down and the
one-of choices taken, so the whole walk is one narrow pass without a join. Only the verdict of
one-of nodes needs rows of the same document together: one shuffle by document.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain as _flat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.operators import expressions as ex
from cilake.operators.binding import bind
from cilake.operators.predicates import unfold_levels

BUILT_IN = ["sequence", "mapping", "number", "boolean", "string", "null"]
SKIP = "-"
FLAT_LEVELS = 6
_JUDGED = ("def", "kind", "value", "alternative")
ARITY_RE = r"^([a-zA-Z0-9_]+)\(([0-9]+),([0-9]+|MAX)\)$"


@dataclass(frozen=True)
class RuleSet:
    """Definitions by kind. `props` is (definition, key) -> type; the rest is by definition."""

    root: str
    props: dict[tuple[str, str], str] = field(default_factory=dict)
    loose: dict[str, str] = field(default_factory=dict)
    items: dict[str, str] = field(default_factory=dict)
    one_of: dict[str, list[str]] = field(default_factory=dict)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    constant: dict[str, str] = field(default_factory=dict)
    scalars: dict[str, str] = field(default_factory=dict)  # definition -> string, number, boolean, null
    contexts: dict[str, list[str]] = field(default_factory=dict)
    required: list[tuple[str, str]] = field(default_factory=list)
    keyed: set[str] = field(default_factory=set)  # mappings that have neither known keys nor a loose type

    @classmethod
    def from_document(cls, text: str, root: str) -> RuleSet:
        """Read a JSON document of definitions: mapping, sequence, one-of, allowed-values or scalar, and their contexts.

        A definition that is referred to must be there or built in.
        """
        out = cls(root)
        given = json.loads(text)["definitions"]
        for name, body in given.items():
            mapping = body.get("mapping")
            if mapping is not None:
                if not mapping.get("properties") and not mapping.get("loose-value-type"):
                    out.keyed.add(name)
                for key, kind in mapping.get("properties", {}).items():
                    out.props[name, key] = kind if isinstance(kind, str) else kind["type"]
                    if not isinstance(kind, str) and kind.get("required"):
                        out.required.append((name, key))
                if mapping.get("loose-value-type"):
                    out.loose[name] = mapping["loose-value-type"]
            if "sequence" in body:
                out.items[name] = body["sequence"]["item-type"]
            for part, table in (("one-of", out.one_of), ("allowed-values", out.allowed), ("context", out.contexts)):
                if body.get(part):
                    table[name] = list(body[part])
            for scalar in ("string", "number", "boolean", "null"):
                if scalar in body:
                    out.scalars[name] = scalar
            if (body.get("string") or {}).get("constant"):
                out.constant[name] = body["string"]["constant"]
        named = {*out.props.values(), *out.loose.values(), *out.items.values(), *(a for alts in out.one_of.values() for a in alts), root}
        if lost := sorted(named - set(given) - {"any", *BUILT_IN}):
            raise ValueError(f"definitions not given: {', '.join(lost)}")
        return out

    @property
    def mappings(self) -> list[str]:
        return sorted({d for d, _ in self.props} | set(self.loose) | self.keyed | {"mapping"})

    @property
    def sequences(self) -> list[str]:
        return sorted(set(self.items) | {"sequence"})


def _table(table: dict[str, str]) -> Column | None:
    """A table as one literal map; built once where several steps read it, as each literal is a call to the JVM."""
    return F.create_map(*[F.lit(x) for x in _flat.from_iterable(table.items())]) if table else None


def _lookup(table: dict[str, str] | Column | None, key: Column) -> Column:
    table = _table(table) if isinstance(table, dict) else table
    return F.lit(None).cast("string") if table is None else F.try_element_at(table, key)


class _Tables:
    """The rules of a walk as literal maps: known keys, loose types, item types, and the numbers of definitions that open contexts."""

    def __init__(self, rules: RuleSet):
        self.props = _table({f"{a}/{b}": t for (a, b), t in rules.props.items()})
        self.loose, self.items = _table(rules.loose), _table(rules.items)
        own = sorted(rules.contexts.items())
        self.numbers = _table({d: f"{i}," for i, (d, _) in enumerate(own)})
        self.listed = F.create_map(*_flat.from_iterable(
            (F.lit(str(i)), F.array(*[F.lit(x) for x in c])) for i, (_, c) in enumerate(own))) if own else None
        self.forms = _forms(rules)

    def child(self, d: Column, key: Column) -> Column:
        """Definition of what lies below a key of a map, or of a list where the key is NULL."""
        known = _lookup(self.props, F.concat(d, F.lit("/"), key))
        return (F.when(key.isNull(), F.when(d.isin("any", "sequence"), "any").otherwise(_lookup(self.items, d)))
                .when(F.contains(key, F.lit(ex.OPEN)), SKIP).when(d.isin("any", "mapping"), "any")
                .otherwise(F.coalesce(known, _lookup(self.loose, d))))

    def opening(self, d: Column) -> Column:
        return F.coalesce(_lookup(self.numbers, d), F.lit(""))

    def contexts(self, numbers: Column) -> Column:
        """Contexts that definitions open, by their numbers; those of a single one are looked up, several are joined."""
        empty = F.array().cast("array<string>")
        if self.listed is None:
            return empty
        bare = F.rtrim(numbers, F.lit(","))
        several = F.flatten(F.transform(F.split(bare, ","), lambda i: F.try_element_at(self.listed, i)))
        return F.when(numbers == "", empty).otherwise(F.coalesce(F.try_element_at(self.listed, bare), several))


def check_nodes(docs: DataFrame, rules: RuleSet, doc: str = "doc", container_json: bool = False,
                flat_levels: int = FLAT_LEVELS, wanted: Callable[..., Column] | None = None) -> DataFrame:
    """Every node with the definition it is checked against: one row per node and one-of choice.

    `(…, depth, path, key, kind, value, parent, def, ctx, choices)`; `ctx` are the contexts allowed
    there, `choices` the (node, alternative) pairs on the way; `value` of a list or map is NULL
    unless `container_json`. The first `flat_levels` levels unfold as rows, deeper ones by a fold inside the row.
    `wanted(def_, kind, value, alternative)` tells the nodes to return; the others are left out as soon as they have
    unfolded, and not carried through the levels below.
    """
    keep = [c for c in docs.columns if c != doc]
    none = F.lit(None).cast("string")
    # nodes are copied at every level, so what they inherit is kept as the numbers of definitions and listed at the end
    tables = _Tables(rules)

    def opened(n):
        """Numbers of the definitions that open contexts at a node: those above, then its own."""
        return F.concat(n["ctx"], tables.opening(n["def"]))

    def node(depth, path, key, parent, v, name, ctx, choices, alternative, kind):
        cells = {"depth": depth, "path": path, "key": key, "parent": parent, "v": v, "def": name, "ctx": ctx, "choices": choices,
                 "alternative": F.lit(alternative), "kind": kind}
        return F.struct(*[x.alias(c) for c, x in cells.items()])

    def text_of(n):
        return _scalar_text(n["kind"], n["v"])

    def child(n, path, key, v, name):
        return node(n["depth"] + 1, path, key, n["def"], v, name, opened(n), n["choices"], False, dy.kind_of(v))

    def children(n):
        d = n["def"]
        is_any = d == "any"
        items = F.transform(F.when(n["kind"] == "array", n["v"].try_cast("array<variant>")), lambda v, i: child(
            n, F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), none, v, tables.child(d, none)))
        keys = F.transform(F.map_entries(F.when(n["kind"] == "object", n["v"].try_cast("map<string,variant>"))), lambda e: child(
            n, F.when(n["path"] == "", e["key"]).otherwise(F.concat(n["path"], F.lit("."), e["key"])),
            e["key"], e["value"], tables.child(d, e["key"])))
        nothing = F.filter(F.array(n), lambda x: F.lit(False))
        return F.coalesce(F.when(is_any | d.isin(rules.sequences), items),
                          F.when(is_any | d.isin(rules.mappings), keys), nothing)

    def alternatives(n):
        names = F.try_element_at(F.create_map(*_flat.from_iterable(
            (F.lit(d), F.array(*[F.lit(x) for x in alts])) for d, alts in rules.one_of.items())), n["def"])
        return F.transform(names, lambda a: node(
            n["depth"], n["path"], n["key"], n["parent"], n["v"], a, opened(n),
            F.concat(n["choices"], F.array(F.concat(n["path"], F.lit("\u0001"), a))), True, n["kind"]))

    def options(n):
        """The node, or at a one-of a node for each alternative."""
        if not rules.one_of:
            return F.array(n)
        held = (n["kind"] == "string") & F.coalesce(F.contains(text_of(n), F.lit(ex.OPEN)), F.lit(False))
        return F.when(n["def"].isin(list(rules.one_of)) & ~held, alternatives(n)).otherwise(F.array(n))

    def expanded(nodes):
        return F.flatten(F.transform(nodes, options)) if rules.one_of else nodes

    def leaf(n):
        value = F.coalesce(text_of(n), F.to_json(n["v"])) if container_json else text_of(n)
        return F.struct(*[n[c].alias(c) for c in ("depth", "path", "key", "kind")], value.alias("value"),
                        *[n[c].alias(c) for c in ("parent", "def")], tables.contexts(opened(n)).alias("ctx"),
                        *[n[c].alias(c) for c in ("choices", "alternative")])

    cells = {"depth": "int", "path": "string", "key": "string", "parent": "string", "v": "variant", "def": "string",
             "ctx": "string", "choices": "array<string>", "alternative": "boolean", "kind": "string"}
    start = {"depth": F.lit(0), "path": F.lit(""), "key": none, "parent": none, "v": F.col("_v"), "def": F.lit(rules.root),
             "ctx": F.lit(""), "choices": F.array(), "alternative": F.lit(False), "kind": dy.kind_of(F.col("_v"))}
    rows = bind(docs, _v=dy.from_json_(F.col(doc))).drop(doc).filter(F.col("_v").isNotNull())
    rows = rows.withColumns({f"_{c}": start[c].cast(t) for c, t in cells.items()} | {"_open": F.lit(True)})
    rows = _with_value(rows, container_json)
    for _ in range(flat_levels):
        rows = _with_value(_closed(rows, rules, tables, wanted), container_json)
    # only what lies deeper still is open, and counted and folded here
    here = F.struct(*[F.col(f"_{c}").alias(c) for c in cells]).cast(
        "struct<" + ",".join(f"{c}:{t}" for c, t in cells.items()) + ">")  # any field may be NULL below
    below = unfold_levels(expanded(F.array(here)), dy.nesting(F.to_json("_v")), lambda n: expanded(children(n)), leaf)
    rows = rows.select(*[c for c in rows.columns if c != "_v"], F.explode_outer(F.when(F.col("_open"), below)).alias("_below"))
    out = {c: F.col(f"_{c}") for c in ("depth", "path", "key", "kind", "value", "parent", "def", "ctx", "choices", "alternative")}
    out["ctx"] = tables.contexts(F.col("_ctx"))
    rows = rows.select(*keep, *[F.when(F.col("_open"), F.col(f"_below.{c}")).otherwise(x).alias(c) for c, x in out.items()])
    return rows.filter(wanted(*(F.col(c) for c in _JUDGED))) if wanted else rows


def _scalar_text(kind: Column, v: Column) -> Column:
    return F.when(kind == "null", "null").when(~kind.isin("array", "object"), F.try_variant_get(v, "$", "string"))


def _with_value(rows: DataFrame, container_json: bool) -> DataFrame:
    """`rows` of a walk with `_value` of the open ones; closed ones keep theirs."""
    text = _scalar_text(F.col("_kind"), F.col("_v"))
    text = F.coalesce(text, F.to_json("_v")) if container_json else text
    kept = F.col("_value") if "_value" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("_value", F.when(F.col("_open"), text).otherwise(kept))


def _forms(rules: RuleSet) -> Column:
    """What becomes of a node, by its definition and whether it is a list, a map or a scalar: (def, chosen, below) rows.

    One row for each alternative of a one-of, each of them once more with `below` if it unfolds; nothing for what stays as it is.
    """
    lists, maps = {"any", *rules.sequences}, {"any", *rules.mappings}
    forms = {}
    for d in sorted({*lists, *maps, *rules.one_of}):
        for kind, unfolding in (("array", lists), ("object", maps), ("scalar", set())):
            names = rules.one_of.get(d, [d])
            forms[f"{d}/{kind}"] = F.array(*[
                F.struct(F.lit(x).alias("def"), F.lit(d in rules.one_of).alias("chosen"), F.lit(below).alias("below"))
                for x in names for below in ([False, True] if x in unfolding else [False])])
    return F.create_map(*_flat.from_iterable((F.lit(k), v) for k, v in forms.items()))


def _closed(rows: DataFrame, rules: RuleSet, tables: _Tables, wanted: Callable[..., Column] | None) -> DataFrame:
    """Close the open rows of a walk, each as its node or its alternatives, and add their children as open rows.

    What becomes of a node is looked up. No lambda is involved, so Spark compiles the step. `_ctx` of an open row are the
    definitions above, of a closed one its own too.
    """
    is_open, d, kind, path, v = (F.col(f"_{c}") for c in ("open", "def", "kind", "path", "v"))
    held = d.isin(list(rules.one_of)) & (kind == "string") & F.contains("_value", F.lit(ex.OPEN))
    form = F.try_element_at(tables.forms, F.concat(d, F.lit("/"), F.when(kind.isin("array", "object"), kind).otherwise("scalar")))
    rows = rows.select("*", F.explode_outer(F.when(is_open & ~F.coalesce(held, F.lit(False)), form)).alias("_form"))

    name, chosen = F.coalesce("_form.def", d), F.coalesce("_form.chosen", F.lit(False))
    rows = rows.withColumns({
        "_def": name, "_alternative": chosen | F.col("_alternative"), "_unfolds": F.coalesce("_form.below", F.lit(False)),
        "_ctx": F.when(is_open, F.concat("_ctx", F.when(chosen, tables.opening(d)).otherwise(""), tables.opening(name))).otherwise(F.col("_ctx")),
        "_choices": F.when(chosen, F.concat("_choices", F.array(F.concat(path, F.lit("\u0001"), name)))).otherwise(
            F.col("_choices"))}).drop("_form")

    if wanted:
        rows = rows.filter(F.col("_unfolds") | wanted(*(F.col(f"_{c}") for c in _JUDGED)))
    unfolds, (pos, key, item) = F.col("_unfolds"), (F.col(f"_found.{c}") for c in ("pos", "key", "value"))
    found = rows.sparkSession.tvf.variant_explode_outer(F.when(unfolds, v).outer())
    columns = [c for c in rows.columns if c != "_unfolds"]
    rows = rows.alias("_rows").lateralJoin(found.alias("_found")).filter(~unfolds | pos.isNotNull())
    below = {
        "_depth": F.col("_depth") + 1, "_key": key, "_parent": d, "_v": item, "_kind": dy.kind_of(item),
        "_path": F.when(key.isNull(), F.concat(path, F.lit("["), pos.cast("string"), F.lit("]"))).when(path == "", key).otherwise(
            F.concat(path, F.lit("."), key)),
        "_def": tables.child(d, key),
        "_alternative": F.lit(False), "_open": F.lit(True)}
    closed = {"_v": F.lit(None).cast("variant"), "_open": F.lit(False)}
    return rows.select(*[
        F.when(unfolds, below[c]).otherwise(closed.get(c, F.col(f"_rows.{c}"))).alias(c) if c in below else F.col(f"_rows.{c}")
        for c in columns])


def expression_errors(text: Column, ctx: Column) -> Column:
    """Array of (rule, message) for the expressions of one text under the contexts allowed there."""
    err = lambda rule, msg: F.struct(F.lit(rule).alias("rule"), msg.alias("message"))
    known = _table({n.lower(): f"{lo},{hi}" for n, lo, hi in ex.ARITY})

    def arity(name):
        """'min,max' of a function by its lower-case name, NULL when unknown."""
        own = F.get(F.filter(ctx, lambda c: (F.lower(F.substring_index(c, "(", 1)) == name) & c.rlike(ARITY_RE)), 0)
        base = _lookup(known, name)
        most = F.regexp_replace(F.regexp_extract(own, ARITY_RE, 3), "^MAX$", "2147483647")
        return F.coalesce(base, F.concat(F.regexp_extract(own, ARITY_RE, 2), F.lit(","), most))

    def call_error(c):
        def judged(span):
            lo, hi = F.substring_index(span, ",", 1).cast("int"), F.substring_index(span, ",", -1).cast("int")
            return (F.when(span.isNull(), err("unknown_function", F.concat(F.lit("no such function: "), c["name"])))
                    .when(c["n_args"] < lo, err("call_arity", F.concat(F.lit("too few arguments: "), c["name"])))
                    .when(c["n_args"] > hi, err("call_arity", F.concat(F.lit("too many arguments: "), c["name"]))))

        return dy.let(arity(F.lower(c["name"])), judged)

    def body_errors(b):
        names = F.transform(ctx, lambda c: F.lower(c))
        wrong_calls = F.filter(F.transform(ex.calls(b), call_error), lambda e: e.isNotNull())
        wrong_vars = F.transform(
            # most are spelled as the context is; only the others need all names in lower case
            F.filter(ex.variables(b), lambda v: ~(F.array_contains(ctx, v) | F.array_contains(names, F.lower(v)))),
            lambda v: err("unknown_variable", F.concat(F.lit("variable not open here: "), v)))
        none = F.filter(F.array(err("", F.lit(""))), lambda x: F.lit(False))
        return F.when(F.size(ctx) > 0, F.concat(wrong_calls, wrong_vars)).when(ex.is_literal(b), none).otherwise(
            F.array(err("expr_not_allowed", F.lit("no expression may stand here"))))

    never = F.array(err("unclosed_expr", F.lit("expression never closes")))
    found = F.flatten(F.transform(ex.bodies(text), body_errors))
    return F.concat(found, F.when(ex.unclosed(text), never).otherwise(F.filter(never, lambda e: F.lit(False))))


def node_errors(rules: RuleSet) -> Column:
    """Array of (rule, message) for a row of `check_nodes`; a value holding an expression is only
    checked as an expression."""
    d, kind, value, ctx, key = (F.col(c) for c in ("def", "kind", "value", "ctx", "key"))
    err = lambda rule, msg: F.array(F.struct(F.lit(rule).alias("rule"), msg.alias("message")))
    none = F.filter(err("", F.lit("")), lambda x: F.lit(False))
    expr = (kind == "string") & F.contains(value, F.lit(ex.OPEN))
    container = kind.isin("array", "object")
    scalar = F.when(kind == "array", "sequence").when(kind == "object", "mapping").otherwise("scalar")
    wanted = _lookup({**rules.scalars, "number": "number", "boolean": "boolean", "null": "null"}, d)
    allowed = _lookup({k: "\u0001" + "\u0001".join(v) + "\u0001" for k, v in rules.allowed.items()}, d)
    constant = _lookup(rules.constant, d)
    key_expr = F.coalesce(F.contains(key, F.lit(ex.OPEN)), F.lit(False))
    insert = key.rlike(r"\$\{\{\s*insert\s*\}\}")
    got = lambda want: F.concat(F.lit(f"{want} wanted, found "), scalar)
    return (
        F.when((d == SKIP) & insert, F.when(F.size(ctx) == 0, err("insert_key", F.lit("insert may not stand here")))
               .otherwise(none))
        .when((d == SKIP) & key_expr, expression_errors(key, ctx))
        .when(d.isNull(), err("unknown_property", F.concat(F.lit("key not declared: "), key)))
        .when(expr, expression_errors(value, ctx))
        .when(d.isin(rules.mappings), F.when(kind == "object", none).otherwise(err("wrong_container", got("mapping"))))
        .when(d.isin(rules.sequences), F.when(kind == "array", none).otherwise(err("wrong_container", got("sequence"))))
        .when(d.isin(["any", *rules.one_of]), none)
        .when(container, err("wrong_container", got("scalar")))
        .when(constant.isNotNull(), F.when(value == constant, none).otherwise(err(
            "constant", F.concat(constant, F.lit(" wanted, found "), value))))
        .when(allowed.isNotNull(), F.when(F.contains(allowed, F.concat(F.lit("\u0001"), value, F.lit("\u0001"))), none)
              .otherwise(err("allowed_values", F.concat(F.lit("not among the allowed values: "), value))))
        .when(wanted.isNotNull() & (wanted != "string") & (kind != wanted),
              err("scalar_type", F.concat(wanted, F.lit(" wanted, found "), kind)))
        .otherwise(none)
    )


def _doubtful(rules: RuleSet, missing_required: bool) -> Callable[..., Column]:
    """Nodes that may have an error, and all alternatives; compiled and cheap, so that the rest is not carried to `node_errors`."""
    judged = {*rules.constant, *rules.allowed, "number", "boolean", "null",
              *(k for k, wanted in rules.scalars.items() if wanted != "string")}
    needing = {k for k, _ in rules.required} if missing_required else set()

    def test(d, kind, value, alternative):
        fits = (F.when(d.isin(rules.mappings), kind == "object").when(d.isin(rules.sequences), kind == "array")
                .when(d.isin(["any", *rules.one_of]), True).otherwise(~kind.isin("array", "object") & ~d.isin(sorted(judged))))
        held = (kind == "string") & F.contains(value, F.lit(ex.OPEN))
        return alternative | ~F.coalesce(fits & ~held & ~d.isin(SKIP, *sorted(needing)), F.lit(False))

    return test


def check_documents(docs: DataFrame, rules: RuleSet, doc: str = "doc", *, missing_required: bool = False) -> DataFrame:
    """Violations `(…, path, rule, message)`. A one-of node is fine when one alternative is; else the
    errors of all its alternatives are listed."""
    keep = [c for c in docs.columns if c != doc]
    # a plain column, not bound: a generator would interpret what a projection compiles
    nodes = check_nodes(docs, rules, doc, missing_required, wanted=_doubtful(rules, missing_required))
    nodes = nodes.withColumn("_errors", node_errors(rules))
    if missing_required and rules.required:
        need = _lookup(_required(rules), F.col("def"))
        have = F.coalesce(F.map_keys(F.try_parse_json("value").try_cast("map<string,variant>")),
                          F.array().cast("array<string>"))
        lost = F.filter(F.split(need, "\u0001"), lambda k: ~F.array_contains(have, k))
        extra = F.transform(lost, lambda k: F.struct(F.lit("missing_required").alias("rule"), F.concat(
            F.lit("key required: "), k).alias("message")))
        nodes = nodes.withColumn("_errors", F.concat("_errors", F.coalesce(F.when(
            (F.col("kind") == "object") & need.isNotNull(), extra), F.filter("_errors", lambda x: F.lit(False)))))
    # alternatives stay as rows without an error, so that a clean one is seen; the others go after the outer generator, as a filter
    # on the errors themselves would be pushed below the projection and compute them twice
    rows = nodes.select(*keep, "path", "choices", "alternative", F.explode_outer("_errors").alias("_e")).filter(
        F.col("_e").isNotNull() | F.col("alternative")).drop("alternative")
    rows = rows.repartition(*keep).withColumn("_bad", F.when(F.col("_e").isNotNull(), 1).otherwise(0))
    deepest = _choice_depth(rules)
    choice = {f"_c{d}": F.get("choices", d - 1) for d in range(1, deepest + 1)}
    node = {f"_at{d}": F.substring_index(choice[f"_c{d}"], "\u0001", 1) for d in range(1, deepest + 1)}
    rows = rows.withColumns(choice | node).drop("choices")
    # each window's partition begins with that of the next one, so a single sort serves all
    within = lambda depth: [*keep, *(c for d in range(1, depth + 1) for c in (f"_at{d}", f"_c{d}"))]
    for depth in range(deepest, 0, -1):
        rows = rows.withColumn("_n", F.sum("_bad").over(Window.partitionBy(*within(depth))))
        rows = rows.withColumn("_least", F.min("_n").over(Window.partitionBy(*within(depth - 1), f"_at{depth}")))
        fine = F.col(f"_c{depth}").isNotNull() & (F.col("_least") == 0)
        # below a satisfied node nothing counts; the rows of outer alternatives stay visible
        rows = rows.withColumn("_bad", F.when(fine, 0).otherwise(F.col("_bad")))
    return rows.filter("_bad = 1").select(*keep, "path", "_e.rule", "_e.message")


def _required(rules: RuleSet) -> dict[str, str]:
    out: dict[str, list[str]] = {}
    for d, k in rules.required:
        out.setdefault(d, []).append(k)
    return {d: "\u0001".join(ks) for d, ks in out.items()}


def _choice_depth(rules: RuleSet) -> int:
    """How many one-of nodes can nest."""
    def below(name, seen):
        if name in seen:
            return 0
        seen = seen | {name}
        kids = ([t for (d, _), t in rules.props.items() if d == name] + [rules.loose.get(name), rules.items.get(name)]
                + rules.one_of.get(name, []))
        return (name in rules.one_of) + max([below(k, seen) for k in kids if k] or [0])

    return below(rules.root, frozenset())


def collect_violations(violations: DataFrame, keys: list[str]) -> DataFrame:
    """All messages of a document together, in order."""
    return violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "message"))), "; ").alias("messages"))


def quality_report(docs: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: valid, number of violations, first message by path."""
    found = violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("message", F.struct("path", "message")).alias("first_message"))
    return docs.select(*keys).join(found, keys, "left").select(
        *keys, F.col("n").isNull().alias("valid"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_violations"),
        "first_message")


def declared_arity(nodes: DataFrame) -> DataFrame:
    """Functions that the contexts of a node declare: `(…, fn, min_args, max_args)`."""
    keep = [c for c in nodes.columns if c != "ctx"]
    c = nodes.select(*keep, F.explode("ctx").alias("_c")).filter(F.col("_c").rlike(ARITY_RE))
    num = lambda i: F.regexp_replace(F.regexp_extract("_c", ARITY_RE, i), "^MAX$", "2147483647").cast("bigint")
    return c.select(*keep, F.regexp_extract("_c", ARITY_RE, 1).alias("fn"), num(2).alias("min_args"), num(3).alias("max_args"))


# Contexts of composite steps, and of their conditions.
_STEP_CTX = ["github", "inputs", "strategy", "matrix", "steps", "job", "runner", "env", "hashFiles(1,255)"]
_IF_CTX = ["github", "inputs", "strategy", "matrix", "steps", "job", "runner", "env", "always(0,0)", "failure(0,0)",
           "cancelled(0,0)", "success(0,0)", "hashFiles(1,255)"]

# The keys of action documents, by definition, with the type of each.
_ACTION_KEYS = {
    "action-root": {
        "name": "string",
        "description": "string",
        "inputs": "inputs",
        "runs": "runs",
        "outputs": "outputs",
    },
    "input": {
        "default": "input-default-context",
    },
    "output-definition": {
        "description": "string",
        "value": "output-value",
    },
    "container-runs": {
        "using": "non-empty-string",
        "image": "non-empty-string",
        "entrypoint": "non-empty-string",
        "args": "container-runs-args",
        "env": "container-runs-env",
        "pre-entrypoint": "non-empty-string",
        "pre-if": "non-empty-string",
        "post-entrypoint": "non-empty-string",
        "post-if": "non-empty-string",
    },
    "node-runs": {
        "using": "non-empty-string",
        "main": "non-empty-string",
        "pre": "non-empty-string",
        "pre-if": "non-empty-string",
        "post": "non-empty-string",
        "post-if": "non-empty-string",
    },
    "plugin-runs": {
        "plugin": "non-empty-string",
    },
    "composite-runs": {
        "using": "non-empty-string",
        "steps": "composite-steps",
    },
    "run-step": {
        "name": "string-steps-context",
        "id": "non-empty-string",
        "if": "step-if",
        "run": "string-steps-context",
        "env": "step-env",
        "continue-on-error": "boolean-steps-context",
        "working-directory": "string-steps-context",
        "shell": "string-steps-context",
    },
    "uses-step": {
        "name": "string-steps-context",
        "id": "non-empty-string",
        "if": "step-if",
        "uses": "non-empty-string",
        "continue-on-error": "boolean-steps-context",
        "with": "step-with",
        "env": "step-env",
    },
}

ACTION_RULES = RuleSet(
    root="action-root",
    props={(definition, key): kind for definition, keys in _ACTION_KEYS.items() for key, kind in keys.items()},
    loose={"action-root": "any", "inputs": "input", "input": "any", "outputs": "output-definition",
           "container-runs-env": "string", "step-env": "string", "step-with": "string"},
    items={"container-runs-args": "container-runs-context", "composite-steps": "composite-step"},
    one_of={"runs": ["container-runs", "node-runs", "plugin-runs", "composite-runs"],
            "composite-step": ["run-step", "uses-step"]},
    scalars={"string": "string", "non-empty-string": "string", "container-runs-context": "string",
             "output-value": "string", "input-default-context": "string", "string-steps-context": "string",
             "step-if": "string", "boolean-steps-context": "boolean"},
    contexts={
        "container-runs-env": ["inputs"], "container-runs-context": ["inputs"],
        "output-value": ["github", "strategy", "matrix", "steps", "inputs", "job", "runner", "env"],
        "input-default-context": ["github", "strategy", "matrix", "job", "runner", "hashFiles(1,255)"],
        "string-steps-context": _STEP_CTX, "boolean-steps-context": _STEP_CTX, "step-env": _STEP_CTX,
        "step-with": _STEP_CTX, "step-if": _IF_CTX,
    },
    required=[("run-step", "run"), ("run-step", "shell"), ("uses-step", "uses")],
)
