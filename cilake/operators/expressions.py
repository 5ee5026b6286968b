"""Expressions inside text: bodies, called functions with their argument counts, root variables, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BODY = r"(?s)\$\{\{((?:[^'}]++|'[^']*+'|\}(?!\}))*+)\}\}"
_STRING = r"'[^']*+'"
_INNER_CALL = r"([A-Za-z_][\w-]*+)?\s*\(([^()]*+)\)"
_ROOT = r"(?<![\w.\-\]])([A-Za-z_][\w-]*+)(?!\s*\()"
OPEN = "$" + "{{"

# Functions every context knows, with the least and most arguments.
ARITY = [
    ("contains", 2, 2), ("endsWith", 2, 2), ("format", 1, 255), ("join", 1, 2),
    ("startsWith", 2, 2), ("toJson", 1, 1), ("fromJson", 1, 1),
]


def bodies(text: Column) -> Column:
    """All `${{ }}` bodies of a text."""
    return F.regexp_extract_all(text, F.lit(_BODY), F.lit(1))


def unclosed(text: Column) -> Column:
    """Does an expression open that never closes?"""
    return F.contains(F.regexp_replace(text, _BODY, ""), F.lit(OPEN))


def _bare(body: Column) -> Column:
    """Without string literals, so quoted commas and names do not count."""
    return F.regexp_replace(body, _STRING, "''")


def is_literal(body: Column) -> Column:
    """A single string or number."""
    return F.trim(body).rlike(r"^('(?:[^']|'')*'|-?[0-9][0-9a-fA-FxX.]*(?:[eE][+-]?[0-9]+)?)$")


def variables(body: Column) -> Column:
    """Distinct root variables: names neither called nor below a dot."""
    return F.array_distinct(F.filter(
        F.regexp_extract_all(_bare(body), F.lit(_ROOT), F.lit(1)), lambda n: ~n.isin("null", "true", "false")))


def calls(body: Column) -> Column:
    """Array of (name, n_args): innermost calls are read and folded away until no bracket is left.

    The number of rounds is the number of opening brackets, so any nesting is covered; a text without one is not read.
    """
    start = F.struct(_bare(body).alias("t"), F.expr("cast(array() as array<struct<name:string,n_args:int>>)").alias("c"))
    rounds = F.sequence(F.lit(1), F.length(body) - F.length(F.replace(body, F.lit("("), F.lit(""))))

    def site(call: Column) -> Column:
        args = F.regexp_extract(call, _INNER_CALL, 2)
        commas = F.length(args) - F.length(F.replace(args, F.lit(","), F.lit("")))
        return F.struct(F.regexp_extract(call, _INNER_CALL, 1).alias("name"),
                        F.when(F.trim(args) == "", 0).otherwise(commas + 1).alias("n_args"))

    def peel(s: Column, _: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s["t"], F.lit(_INNER_CALL), F.lit(0)), site)
        return F.struct(F.regexp_replace(s["t"], _INNER_CALL, "''").alias("t"), F.concat(s["c"], found).alias("c"))

    # a bracket without a name is plain grouping
    found = F.filter(F.aggregate(rounds, start, peel)["c"], lambda c: c["name"] != "")
    none = F.expr("cast(array() as array<struct<name:string,n_args:int>>)")
    return F.when(~F.contains(body, F.lit("(")), none).otherwise(found)


def extract_refs(rows: DataFrame, text: str) -> DataFrame:
    """One row per thing referenced: `(…, body_pos, body, kind, name, n_args)`, kind call or variable."""
    keep = [c for c in rows.columns if c != text]
    b = rows.select(*keep, F.posexplode(bodies(F.col(text))).alias("body_pos", "body"))
    refs = F.concat(
        F.transform(calls(F.col("body")), lambda c: F.struct(
            F.lit("call").alias("kind"), c["name"].alias("name"), c["n_args"].alias("n_args"))),
        F.transform(variables(F.col("body")), lambda v: F.struct(
            F.lit("variable").alias("kind"), v.alias("name"), F.lit(None).cast("int").alias("n_args"))),
    )
    return b.withColumn("body_pos", F.col("body_pos").cast("bigint")).select(*keep, "body_pos", "body", F.inline(refs))


def arity_table(spark) -> DataFrame:
    """The known functions as rows; a fixed handful, so joins with it are broadcast by its size."""
    return spark.createDataFrame(ARITY, "fn string, min_args int, max_args int")


def lint_calls(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls that are unknown or have too few or too many parameters; names ignore case."""
    fns = functions.select(F.lower("fn").alias("_fn"), "min_args", "max_args")
    joined = refs.filter(F.col("kind") == "call").withColumn("_fn", F.lower("name")).join(fns, "_fn", "left")
    problem = (
        F.when(F.col("min_args").isNull(), "no such function")
        .when(F.col("n_args") < F.col("min_args"), "too few arguments")
        .when(F.col("n_args") > F.col("max_args"), "too many arguments")
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_fn", "min_args", "max_args")


def lint_variables(refs: DataFrame, allowed: list[str]) -> DataFrame:
    """Root variables outside the allowed contexts; names ignore case."""
    low = [a.lower() for a in allowed]
    return refs.filter((F.col("kind") == "variable") & ~F.lower("name").isin(low))


def lint_properties(nodes: DataFrame, allowed: DataFrame, loose: DataFrame) -> DataFrame:
    """Type of each key `(…, definition, key)`: its own, the loose one, or unknown."""
    return nodes.join(allowed, ["definition", "key"], "left").join(loose, "definition", "left").withColumn(
        "type", F.coalesce("type", "loose_type", F.lit("key not declared"))).drop("loose_type")
