"""YAML or JSON documents to VARIANT, action defaults, named context documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.functions.dynamic import from_json_
from cilake.operators.binding import bind
from cilake.operators.documents import get


def _loader():
    import yaml

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    loader = type("WorkflowLoader", (base,), {})
    # only true/false are booleans (`on:` is a plain key), and dates stay text
    drop = ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")
    loader.yaml_implicit_resolvers = {
        k: [(tag, rx) for tag, rx in v if tag not in drop] for k, v in base.yaml_implicit_resolvers.items()
    }
    import re

    loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"),
                                 list("tTfF"))
    return yaml, loader


def _yaml_to_json(texts: pa.Array) -> pa.Array:
    yaml, loader = _loader()

    def one(text):
        try:
            return None if text is None else json.dumps(yaml.load(text, Loader=loader)), None  # noqa: S506 - a safe loader
        except (yaml.YAMLError, TypeError, ValueError) as e:
            return None, str(getattr(e, "problem", e))

    out = [one(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["json", "error"])


def load_documents(texts: DataFrame, text: str = "text") -> DataFrame:
    """`(…, doc, error)`: documents as VARIANT, or the problem. One scan; only texts that are not JSON take the YAML hop."""
    keep = [c for c in texts.columns if c != text]
    parsed = bind(texts, _json=from_json_(F.col(text)))
    hopped = parsed.withColumn("_yaml", F.arrow_udf(_yaml_to_json, "struct<json:string,error:string>")(F.when(F.col("_json").isNull(), F.col(text))))
    return hopped.select(*keep, F.coalesce("_json", F.try_parse_json(F.col("_yaml.json"))).alias("doc"), F.col("_yaml.error").alias("error"))


def load_workflows(texts: DataFrame, text: str = "text") -> DataFrame:
    return load_documents(texts, text)


def load_actions(texts: DataFrame, text: str = "text") -> DataFrame:
    """Actions with `using` lower-cased and pre/post conditions defaulting to always(); unreadable texts keep their error."""
    docs = load_documents(texts, text)
    runs = get(F.col("doc"), "runs")
    good = F.col("error").isNull()
    cond = lambda n: F.when(good, F.coalesce(F.nullif(get(runs, n, kind="string"), F.lit("")), F.lit("always()")))
    return docs.withColumns({"using": F.lower(get(runs, "using", kind="string")), "pre_if": cond("pre-if"), "post_if": cond("post-if")})


# The named context documents.
CONTEXT_NAMES = ["github", "env", "inputs", "secrets", "vars", "runner"]


def load_contexts(rows: DataFrame) -> DataFrame:
    """`(…, name, doc, error)` of rows `(…, name, json)`: empty text is skipped, bad JSON names its part."""
    used = bind(rows.filter(F.coalesce("json", F.lit("")) != ""), doc=from_json_(F.col("json")))
    bad = F.when(~F.col("name").isin(CONTEXT_NAMES), F.concat(F.lit("unknown context "), "name")).when(
        F.col("doc").isNull(), F.concat(F.lit("invalid JSON in "), "name"))
    return used.withColumn("error", bad).withColumn("doc", F.when(F.col("error").isNull(), F.col("doc"))).drop("json")
