"""Bulk rendering of `${{ path }}` templates against context rows.

Templates are rows `(tpl_id, template)`; contexts are rows `(ctx_id, tpl_id, path, value)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A doubled dollar protects what follows; a token is a placeholder, protected text, or other text.
_TOKEN = r"(?s)\$\$|\$\{\{.*?\}\}|\$|[^$]+"
_REF = r"(?s)^\$\{\{\s*(.*?)\s*\}\}$"
# What a placeholder may hold: a path of names, ['names'] and [numbers], a quoted text, a number, true, false or null.
_PATH = r"^[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*|\[\s*(?:'[^'\]]*'|\d+)\s*\])*$"
_TEXT = r"(?s)^'(?:[^']|'')*'$"
_PLAIN = r"^(?:true|false|null|-?\d+(?:\.\d+)?)$"


def tokens(template: Column) -> Column:
    """Array of (literal, path, error): exactly one of the three is set; `$$` stays as it is.

    Paths are lower-cased and bracketed names become dotted ones.
    """
    raw = F.regexp_extract_all(template, F.lit(_TOKEN), F.lit(0))

    def token(t: Column) -> Column:
        is_ref = t.startswith("$" + "{{") & t.endswith("}}")
        body = F.regexp_extract(t, _REF, 1)
        text = F.replace(F.substring(body, 2, F.length(body) - 2), F.lit("''"), F.lit("'"))
        dotted = F.regexp_replace(F.regexp_replace(F.lower(body), r"\[\s*'([^']*)'\s*\]", ".$1"), r"\[\s*(\d+)\s*\]", "[$1]")
        literal = (F.when(~is_ref, t).when(body.rlike(_TEXT), text)
                   .when(body == "null", "").when(body.rlike(_PLAIN), body))
        path = F.when(is_ref & ~body.rlike(_PLAIN) & body.rlike(_PATH), dotted)
        return F.struct(literal.alias("literal"), path.alias("path"),
                        F.when(literal.isNull() & path.isNull(), F.concat(F.lit("no value: "), body)).alias("error"))

    return F.transform(raw, token)


def lookup_context(refs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Variables to context values: `(tpl_id, path)` references meet contexts by equality."""
    low = contexts.withColumn("path", F.lower("path"))
    return refs.join(low, ["tpl_id", "path"], "left")


def render_templates(templates: DataFrame, contexts: DataFrame) -> DataFrame:
    """`(ctx_id, tpl_id, text, error)`: each context rendered with its template; unresolved paths give ''.

    A placeholder that is no value (a call, a comparison) is the row's error, and its text is NULL.

    Contexts are first cut to the paths their template names, then folded to one small list per
    context, and meet their template once.
    """
    parsed = templates.select("tpl_id", tokens(F.col("template")).alias("_tokens"))
    refs = parsed.select("tpl_id", F.explode("_tokens.path").alias("path")).filter(
        F.col("path").isNotNull()).distinct()
    low = contexts.withColumn("path", F.lower("path"))
    named = low.join(refs.withColumn("_used", F.lit(True)), ["tpl_id", "path"], "left")
    entry = F.when(F.col("_used"), F.struct("path", "value"))
    folded = named.groupBy("ctx_id", "tpl_id").agg(F.array_sort(F.collect_set(entry)).alias("_vals"))
    value = lambda p: F.get(F.filter("_vals", lambda x: x["path"] == p), 0)["value"]
    fill = lambda t: F.coalesce(t["literal"], value(t["path"]), F.lit(""))
    error = F.get(F.filter(F.transform("_tokens", lambda t: t["error"]), lambda e: e.isNotNull()), 0)
    return folded.join(parsed, "tpl_id").select(
        "ctx_id", "tpl_id", F.when(error.isNull(), F.array_join(F.transform("_tokens", fill), "")).alias("text"), error.alias("error"))


def evaluate_env(declared: DataFrame, global_env: DataFrame) -> DataFrame:
    """Env of a workflow: declared values are templates over the *global* env (`env.NAME`); an
    evaluated entry overrides the global one. Rows `(wf_id, key, value)` on both sides and out; `error` tells why
    a value is NULL."""
    entries = declared.withColumn("tpl_id", F.concat_ws("\u0001", F.col("wf_id").cast("string"), "key"))
    names = entries.select("wf_id", "tpl_id", F.explode(tokens(F.col("value")).getField("path")).alias("path"))
    low_env = global_env.select("wf_id", F.concat(F.lit("env."), F.lower("key")).alias("path"),
                                F.col("value").alias("_v"))
    ctx = names.join(low_env, ["wf_id", "path"], "left").select(
        F.col("tpl_id").alias("ctx_id"), "tpl_id", F.coalesce("path", F.lit("")).alias("path"), F.col("_v").alias("value")
    )
    text = render_templates(entries.select("tpl_id", F.col("value").alias("template")), ctx)
    done = entries.join(text.select("tpl_id", "text", "error"), "tpl_id", "left").select(
        "wf_id", "key", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("value"), "error")
    both = global_env.select("wf_id", "key", "value", F.lit(None).cast("string").alias("error"), F.lit(0).alias("_p")).unionByName(
        done.withColumn("_p", F.lit(1)))
    last = both.groupBy("wf_id", "key").agg(F.max_by(F.struct("value", "error"), "_p").alias("_v"))
    return last.select("wf_id", "key", "_v.value", "_v.error")
