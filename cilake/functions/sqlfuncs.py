"""The scalar functions as SQL functions, inlined by Catalyst; names ignore case; open for additions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cilake.functions import dynamic as dy

_TRUE = "'1','t','T','TRUE','true','True'"
_FALSE = "'0','f','F','FALSE','false','False'"
_NUMBER = r"^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"

_INFINITY = dy.INFINITY_RE.replace("\\", "\\\\")

# name -> (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "ci_contains": ("s STRING, x STRING", "BOOLEAN", "contains(lower(s), lower(x))"),
    "ci_starts_with": ("s STRING, x STRING", "BOOLEAN", "startswith(lower(s), lower(x))"),
    "ci_ends_with": ("s STRING, x STRING", "BOOLEAN", "endswith(lower(s), lower(x))"),
    "ci_join": ("xs ARRAY<STRING>, sep STRING", "STRING", "array_join(xs, sep, '')"),
    "ci_parse_bool": ("s STRING", "BOOLEAN", f"CASE WHEN s IN ({_TRUE}) THEN true WHEN s IN ({_FALSE}) THEN false END"),
    "ci_number": ("s STRING", "DOUBLE", f"CASE WHEN s = '' THEN 0D WHEN s RLIKE '{_NUMBER}' THEN try_cast(s AS DOUBLE) WHEN lower(s) RLIKE '{_INFINITY}' "
                  "THEN CASE WHEN startswith(s, '-') THEN double('-Infinity') ELSE double('Infinity') END END"),
    "ci_truthy": ("s STRING", "BOOLEAN", "coalesce(s, '') <> ''"),
    "ci_unescape_data": ("s STRING", "STRING",
                         r"replace(replace(replace(s, '%0D', '\r'), '%0A', '\n'), '%25', '%')"),
    "ci_escape_data": ("s STRING", "STRING",
                       r"replace(replace(replace(s, '%', '%25'), '\n', '%0A'), '\r', '%0D')"),
    "ci_input_env_name": ("s STRING", "STRING", "concat('INPUT_', regexp_replace(upper(s), '[^A-Z0-9-]', '_'))"),
    "ci_slug": ("s STRING", "STRING", r"coalesce(nullif(trim(BOTH '-' FROM regexp_replace(lower(s), '[^a-z0-9\\p{Nd}._-]+', '-')), ''), 'unnamed')"),
}


def register_functions(spark: SparkSession, more: dict[str, tuple[str, str, str]] | None = None) -> list[str]:
    """Create the functions in the session; `more` adds or replaces entries."""
    for name, (params, result, body) in {**FUNCTIONS, **(more or {})}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return sorted({**FUNCTIONS, **(more or {})})
