"""Documents as path rows, and rules as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.functions import dynamic as dy
from cilake.operators.binding import bind
from cilake.operators.grams import distinct_grams, lead_gram
from cilake.operators.running import block_of, numbered
from cilake.session import written


def explode_paths(docs: DataFrame, doc: str = "doc", *, lower: bool = True, container_json: bool = True) -> DataFrame:
    """JSON text to one row per node: `(…, depth, path, parent_path, key, pos, kind, value)`.

    The root has path ''. `value` is the scalar as text (for arrays and objects
    their JSON, or NULL without `container_json`). One narrow pass, a native fold
    inside each document's row over as many levels as that document has.
    """
    keep = [c for c in docs.columns if c != doc]
    none = F.lit(None)

    def leaf(n: Column) -> Column:
        scalar = F.when(n["kind"] == "null", "null").when(
            ~n["kind"].isin("array", "object"), F.try_variant_get(n["v"], "$", "string"))
        text = F.coalesce(scalar, F.to_json(n["v"])) if container_json else scalar
        return F.struct(*[n[c].alias(c) for c in ("depth", "path", "parent_path", "key", "pos", "kind")], text.alias("value"))

    rows = parsed(docs, doc)
    root = F.struct(F.lit(0).alias("depth"), F.lit("").alias("path"), none.cast("string").alias("parent_path"),
                    none.cast("string").alias("key"), none.cast("int").alias("pos"), F.col("_v").alias("v"),
                    dy.kind_of(F.col("_v")).alias("kind"))
    nodes = unfold_levels(F.array(root), F.col("_levels"), lambda n: _children(n, lower), leaf)
    return rows.select(*keep, F.inline(nodes))


def parsed(docs: DataFrame, doc: str) -> DataFrame:
    """`docs` with the text as `_v` and its number of levels as `_levels`, read once; without the rows that hold no JSON value."""
    return bind(docs, _v=dy.from_json_(F.col(doc)), _levels=dy.nesting(F.col(doc))).filter(F.col("_v").isNotNull())


def unfold_levels(start: Column, levels: Column, below, finish) -> Column:
    """Unfold a tree inside one row, level by level; `finish(node)` gives the rows to emit.

    `below(node)` returns the nodes of the next level. Only the nodes of the current level are looked at in a step; the
    others are carried along as they are. `levels` is how many levels lie below the start, row by row. A lambda's
    result is copied whole with all that it holds, so nodes should be small and no lambda returns the carried ones.
    """
    def step(acc: Column, _level: Column) -> Column:
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.struct(
            F.flatten(F.transform(acc["front"], below)).alias("front"), F.concat(acc["done"], acc["front"]).alias("done")))

    zero = F.struct(start.alias("front"), F.filter(start, lambda x: F.lit(False)).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), levels), zero, step, lambda acc: F.transform(acc["done"], finish))


def _children(n: Column, lower: bool) -> Column:
    def child(key, pos, v, path):
        return F.struct(
            (n["depth"] + 1).alias("depth"), path.alias("path"), n["path"].alias("parent_path"), key.alias("key"),
            pos.alias("pos"), v.alias("v"), dy.kind_of(v).alias("kind"))

    none = F.lit(None).cast("string")
    name = (lambda k: F.lower(k)) if lower else (lambda k: k)
    items = F.transform(F.when(n["kind"] == "array", n["v"].try_cast("array<variant>")), lambda v, i: child(
        none, i, v, F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]"))))
    fields = F.transform(F.map_entries(F.when(n["kind"] == "object", n["v"].try_cast("map<string,variant>"))), lambda e: child(
        name(e["key"]), F.lit(None).cast("int"), e["value"],
        F.when(n["path"] == "", name(e["key"])).otherwise(F.concat(n["path"], F.lit("."), name(e["key"])))))
    return F.coalesce(items, fields, F.filter(F.array(n), lambda x: F.lit(False)))


def lowered_leaves(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Scalars of each document by lower-cased path."""
    return explode_paths(docs, doc, container_json=False).filter(~F.col("kind").isin("array", "object")).select(
        *[c for c in docs.columns if c != doc], "path", "kind", "value")


def verdict(op: Column, left: dy.Dyn, right: dy.Dyn, text: Column | None = None) -> Column:
    """Outcome of one condition: ==, !=, <, <=, >, >=, contains, startswith, endswith; `text` is the left side's lower-cased text."""
    cmp = dy.compare(left, right)
    text = F.lower(dy.str_(left)) if text is None else text
    low = F.lower(dy.str_(right))
    out = (
        F.when(op == "==", cmp == 0).when(op == "!=", cmp != 0).when(op == "<", cmp < 0).when(op == "<=", cmp <= 0)
        .when(op == ">", cmp > 0).when(op == ">=", cmp >= 0).when(op == "contains", F.contains(text, low))
        .when(op == "startswith", F.startswith(text, low)).when(op == "endswith", F.endswith(text, low))
    )
    return F.coalesce(out, F.lit(False))


GRAM = 4  # letters by which text conditions are found
PIECES = 256  # intervals that the order conditions of a path are dealt to


def _canonical(num: Column) -> Column:
    """One text for equal numbers; -0 is 0."""
    return F.concat(F.lit("n"), (num + F.lit(0.0)).cast("string"))


def _bounds(conds: DataFrame) -> DataFrame:
    """(path, _numbers, _texts): ascending bounds among the literals of a path, at most PIECES of each, about equally
    many literals apart."""
    parts = F.array(F.struct(F.lit("number").alias("k"), F.col("_num").alias("n"), F.lit(None).cast("string").alias("t")),
                    F.struct(F.lit("text").alias("k"), F.lit(None).cast("double").alias("n"), F.col("literal").alias("t")))
    some = conds.select("path", F.inline(parts)).filter("n IS NOT NULL OR t IS NOT NULL").distinct()
    some = some.select("path", "k", F.struct("n", "t").alias("_v"))
    sizes = some.groupBy("path", "k").agg(F.ceil(F.count("*") / F.lit(PIECES)).alias("_step"))
    kept = numbered(some, ["path", "k"], "_v", "_at").join(sizes, ["path", "k"]).filter(F.col("_at") % F.col("_step") == 0)
    of = lambda kind, x: F.sort_array(F.collect_list(F.when(F.col("k") == kind, F.col("_v")[x])))
    return kept.groupBy("path").agg(of("number", "n").alias("_numbers"), of("text", "t").alias("_texts"))


def _pieces(op: Column, value: Column, bounds: Column) -> Column:
    """Numbers of the intervals in which values can lie that hold `op` against `value`."""
    own = block_of(value, bounds)
    low, high = F.lit(0), F.size(bounds)
    spans = F.when(op.isin("<", "<="), F.sequence(low, own)).otherwise(F.sequence(own, high))
    return F.when(value.isNotNull() & bounds.isNotNull(), spans)


def _found_by(c: DataFrame) -> Column:
    """Keys under which the nodes that can hold a leading condition are found."""
    sort, text, num, low = F.col("_sort"), F.col("literal"), F.col("_num"), F.lower("literal")
    n = F.least(F.length(low), F.lit(GRAM))
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x.cast("string")))
    order = F.concat(
        F.coalesce(tagged("o", _pieces(F.col("op"), num, F.col("_numbers"))), F.array().cast("array<string>")),
        F.coalesce(tagged("q", _pieces(F.col("op"), text, F.col("_texts"))), F.array().cast("array<string>")))
    keys = (
        F.when(sort == "==", F.array(F.concat(F.lit("s"), text), _canonical(num)))
        .when(sort == "startswith", F.array(F.concat(F.lit("p"), F.left(low, n))))
        .when(sort == "endswith", F.array(F.concat(F.lit("e"), F.right(low, n))))
        .when(sort == "contains", F.array(F.concat(F.lit("c"), lead_gram(low, n))))
        .when(sort == "order", order)
        .otherwise(F.array(F.lit("*")))
    )
    return F.array_compact(keys)


def _looks_up(left: dy.Dyn) -> Column:
    """Keys of a node, of the sorts of condition that lead on its path."""
    sorts = F.col("_sorts")
    text = F.col("_text")
    none = F.array().cast("array<string>")
    wants = lambda sort, keys: F.when(F.array_contains(sorts, sort), keys).otherwise(none)
    each = lambda sort, tag, cut: F.transform(
        F.filter("_lengths", lambda x: x["sort"] == sort), lambda x: F.concat(F.lit(tag), cut(x["n"])))
    number = F.when(left.kind != "string", left.coerced)
    grams = F.flatten(F.transform(
        F.filter("_lengths", lambda x: x["sort"] == "contains"), lambda x: distinct_grams(text, x["n"])))
    keys = F.concat(
        wants("==", F.array(F.when(left.kind == "string", F.concat(F.lit("s"), left.text)).otherwise(_canonical(number)))),
        wants("startswith", each("startswith", "p", lambda n: F.left(text, n))),
        wants("endswith", each("endswith", "e", lambda n: F.right(text, n))),
        wants("contains", F.transform(grams, lambda g: F.concat(F.lit("c"), g))),
        wants("order", F.array(
            F.when(number.isNotNull() & F.col("_numbers").isNotNull(), F.concat(F.lit("o"), block_of(number, F.col("_numbers")).cast("string"))),
            F.when((left.kind == "string") & F.col("_texts").isNotNull(), F.concat(F.lit("q"), block_of(left.text, F.col("_texts")).cast("string"))))),
        wants("*", F.array(F.lit("*"))),
    )
    return F.array_distinct(F.array_compact(keys))


def match_rules(docs: DataFrame, rules: DataFrame, id_col: str = "id", doc: str = "payload") -> DataFrame:
    """`(id, rule_id)` for every rule whose conditions all hold.

    Conditions are rows `(rule_id, path, op, literal)`; literals are strings. A missing path compares as undefined; where
    keys of a document differ only in case, a condition needs one of the nodes.

    Each rule is led by the condition that fewest nodes can hold: equality before prefix, suffix and substring, these before
    order, and inequality last. Leading conditions are found by key: equality by the canonical literal, text by up to
    four letters (for substrings the gram with the smallest hash), order by intervals cut at the literals of the path. So a node
    meets the conditions that can hold, not all on its path; the other conditions of a rule are judged only for
    the documents that its lead found. A rule that undefined values satisfy has no lead and is judged for every document.
    """
    lit = dy.Dyn.string(F.col("literal"))
    conds = rules.select("rule_id", F.lower("path").alias("path"), "op", "literal").distinct()
    gone = dy.Dyn(F.lit("undefined"), *[F.lit(None).cast(t) for t in ("string", "double", "boolean", "boolean")],
                  F.lit(0.0), "undefined")
    sort = (F.when(F.col("literal").isNull(), "*").when(F.col("op").isin("<", "<=", ">", ">="), "order")
            .when(F.col("op").isin("==", "startswith", "endswith", "contains"), F.col("op")).otherwise("*"))
    price = F.element_at(F.create_map(*[F.lit(x) for pair in zip(("==", "startswith", "endswith", "contains", "order", "*"), range(6))
                                        for x in pair]), F.col("_sort"))
    conds = conds.withColumns({"_absent": verdict(F.col("op"), gone, lit), "_num": dy.coerce_number(F.col("literal")), "_sort": sort})
    conds = written(conds, "conditions")
    # the lead: the cheapest condition that needs a present node
    best = conds.filter(~F.col("_absent")).groupBy("rule_id").agg(
        F.min_by(F.struct("path", "op", "literal", "_num", "_sort"), F.struct(price, -F.length("literal"), "path", "op", "literal")).alias("_c"))
    leads = best.select("rule_id", "_c.*")
    ordered = leads.filter("_sort = 'order'")
    leads = leads.join(_bounds(ordered), "path", "left")
    leads = written(leads, "leads")
    anchored = conds.groupBy("rule_id").agg(F.bool_and("_absent").alias("_all")).filter("_all").select("rule_id")
    anchors = anchored.select("rule_id", F.lit("").alias("path"), F.lit("root").alias("op"), F.lit("").alias("literal"), F.lit("root").alias("_key"))
    indexed = leads.select("rule_id", "path", "op", "literal", F.explode(_found_by(leads)).alias("_key")).unionByName(anchors)
    length = F.struct(F.col("_sort").alias("sort"), F.least(F.length(F.lower("literal")), F.lit(GRAM)).alias("n"))
    paths = leads.groupBy("path").agg(
        F.collect_set("_sort").alias("_sorts"), F.collect_set(length).alias("_lengths"),
        F.first("_numbers", True).alias("_numbers"), F.first("_texts", True).alias("_texts"))

    asked = conds.select("path").unionByName(anchors.select("path")).distinct()
    nodes = explode_paths(docs.select(id_col, doc), doc, container_json=False).select(id_col, "path", "kind", "value")
    nodes = bind(nodes.join(asked, "path", "left_semi"), _left=dy.Dyn.leaf(F.col("kind"), F.col("value")).struct())
    left = dy.Dyn.bound(F.col("_left"))
    seen = written(nodes.select(id_col, "path", "kind", "_left", F.lower(dy.str_(left)).alias("_text")), "nodes")
    known = seen.join(paths, "path", "left")
    keyed = known.select(id_col, "path", "_left", "_text", F.explode(F.concat(
        F.when(F.col("path") == "", F.array(F.lit("root"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_sorts").isNotNull() & ~F.col("kind").isin("array", "object"), _looks_up(left)).otherwise(
            F.array().cast("array<string>")))).alias("_key"))
    met = keyed.join(indexed, ["path", "_key"])
    found = met.filter((F.col("op") == "root") | verdict(F.col("op"), left, lit, F.col("_text"))).select(id_col, "rule_id")
    # the conditions beside the lead, of the documents it found
    rest = conds.join(leads.select("rule_id", "path", "op", "literal"), ["rule_id", "path", "op", "literal"], "left_anti")
    found = written(found.distinct(), "found")
    single = found.join(rest.select("rule_id").distinct(), "rule_id", "left_anti")
    open_ = found.join(rest, "rule_id").join(
        seen.select(id_col, "path", "_left", "_text"), [id_col, "path"], "left")
    ok = F.when(F.col("_left").isNull(), F.col("_absent")).otherwise(verdict(F.col("op"), left, lit, F.col("_text")))
    each = open_.groupBy(id_col, "path", "rule_id", "op", "literal").agg(F.bool_or(ok).alias("_ok"))
    both = each.groupBy(id_col, "rule_id").agg(F.bool_and("_ok").alias("_ok")).filter("_ok").select(id_col, "rule_id")
    return single.select(id_col, "rule_id").unionByName(both)
