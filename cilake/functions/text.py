"""Text helpers as native columns: escaping, slugs, globs, levels."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escape tables, in the order unescaping applies them ('%' last).
DATA_ESCAPES = [("%0D", "\r"), ("%0A", "\n"), ("%25", "%")]
PROPERTY_ESCAPES = [("%0D", "\r"), ("%0A", "\n"), ("%3A", ":"), ("%2C", ","), ("%25", "%")]
LEGACY_ESCAPES = [("%3B", ";"), ("%0D", "\r"), ("%0A", "\n"), ("%5D", "]"), ("%25", "%")]


def unescape(c: Column, table: list[tuple[str, str]]) -> Column:
    for code, char in table:
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def escape(c: Column, table: list[tuple[str, str]]) -> Column:
    """Inverse of `unescape`: '%' goes first, so unescape(escape(x)) = x."""
    for code, char in reversed(table):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape_data(c: Column) -> Column:
    return unescape(c, DATA_ESCAPES)


def unescape_prop(c: Column) -> Column:
    return unescape(c, PROPERTY_ESCAPES)


def unescape_legacy(c: Column) -> Column:
    return unescape(c, LEGACY_ESCAPES)


def trim_space(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slug(c: Column) -> Column:
    """Lower case; runs of other characters become one dash; no dash at the ends; never empty."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9\p{Nd}._-]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("unnamed"))


def input_env_name(c: Column) -> Column:
    return F.concat(F.lit("INPUT_"), F.regexp_replace(F.upper(c), r"[^A-Z0-9-]", "_"))


def glob_to_regex(glob: str) -> str:
    """Anchored regex of a glob.

    With `**` the pattern is a recursive one (`**/` any folders, `**` anything); without it a
    plain one, where `[...]` is a character class and a backslash quotes.
    """
    recursive = "**" in glob
    tokens = r"\*\*/|\*\*|\*|\?|." if recursive else r"\[\^?\]?[^\]]*\]|\\.|\*|\?|."
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def piece(tok: str) -> str:
        if tok in known:
            return known[tok]
        if not recursive and len(tok) > 1:
            return tok if tok[0] == "[" else re.escape(tok[1])
        return re.escape(tok)

    return "^" + "".join(piece(t) for t in re.findall(tokens, glob, re.S)) + "$"


def glob_column(glob: Column) -> Column:
    """`glob_to_regex(normal_glob(…))` for patterns in a column (without `.` and `..` folders)."""
    plain = F.regexp_replace(glob, "^/", "")
    recursive = F.contains(plain, F.lit("**"))
    parts = F.when(recursive, F.regexp_extract_all(plain, F.lit(r"(?s)\*\*/|\*\*|\*|\?|."), F.lit(0))).otherwise(
        F.regexp_extract_all(F.regexp_replace(plain, "/+", "/"), F.lit(r"(?s)\[\^?\]?[^\]]*\]|\\.|\*|\?|."), F.lit(0)))
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_/ -])", r"\\$1")
    pieces = F.transform(parts, lambda t: F.when(t == "**/", "(?:.*/)?").when(t == "**", ".*").when(t == "*", "[^/]*")
                         .when(t == "?", "[^/]").when(F.length(t) < 2, quoted(t)).when(t.startswith("["), t)
                         .otherwise(quoted(F.substring(t, 2, 1))))
    return F.concat(F.lit("^"), F.array_join(pieces, ""), F.lit("$"))


def normal_glob(glob: str) -> str:
    glob = glob.removeprefix("/")
    return glob if "**" in glob else posixpath.normpath(glob)


def parse_level(c: Column) -> Column:
    """Log level by first letter; empty or unknown is info."""
    first = F.substring(F.lower(trim_space(c)), 1, 1)
    return (
        F.when(first == "t", "trace").when(first == "d", "debug").when(first == "w", "warn")
        .when(first == "e", "error").otherwise("info")
    )


# Order of the levels.
LEVELS = ["trace", "debug", "info", "warn", "error"]


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")


def strip_prefixes(c: Column, prefixes: list[str]) -> Column:
    """Cut each prefix in turn where the text starts with it."""
    for p in prefixes:
        c = F.when(c.startswith(p), F.substring(c, len(p) + 1, 2147483647)).otherwise(c)
    return c


def safe_workdir(c: Column, workspace: Column) -> tuple[Column, Column]:
    """(folder, error): empty means the workspace, absolute is refused, else below it."""
    absolute = c.startswith("/")
    folder = (
        F.when(F.coalesce(c, F.lit("")) == "", workspace)
        .when(~absolute, F.concat_ws("/", F.rtrim(workspace, F.lit("/")), c))
    )
    return folder, F.when(absolute, "absolute path")
