"""Key/value files (`KEY=value`, `KEY<<DELIM … DELIM`), path files, `K=V` pairs, and their writer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.operators.binding import bind
from cilake.operators.envstate import is_blocked

_PAIR = "struct<key:string,value:string,ord:bigint>"


def _simple(text: Column, kind: Column) -> Column:
    """Files without heredocs: every line judged by itself, in one pass."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(
        F.regexp_replace(x, r"\r$", "").alias("t"), i.cast("bigint").alias("i")))
    used = F.filter(lines, lambda x: x["t"] != "")
    key = lambda x: F.substring_index(x["t"], "=", 1)
    errors = F.filter(
        F.transform(used, lambda x: F.when(F.instr(x["t"], "=") == 0, "invalid format")
                    .when(x["t"].startswith("="), "name must not be empty")
                    .when(is_blocked(kind, key(x)), "blocked name")),
        lambda e: e.isNotNull(),
    )
    pairs = F.transform(used, lambda x: F.struct(
        key(x).alias("key"), F.substring(x["t"], F.instr(x["t"], "=") + 1, F.length(x["t"])).alias("value"),
        x["i"].alias("ord")))
    return F.struct(F.get(errors, 0).alias("error"), pairs.alias("pairs"))


def _read_heredocs(text: str) -> tuple[str | None, list[tuple[str, str, int]]]:
    """(first problem, (key, value, line number)) of a file, line by line, in linear time."""
    lines = text.split("\n")
    ends = ["\n"] * (len(lines) - 1) + [""]
    for k in range(len(lines) - 1):  # the carriage return belongs to the line break; an unterminated last line keeps it
        if lines[k].endswith("\r"):
            lines[k], ends[k] = lines[k][:-1], "\r\n"
    pairs, k = [], 0
    while k < len(lines):
        line, first = lines[k], k
        k += 1
        if not line:
            continue
        equals, doc = line.find("="), line.find("<<")
        if doc >= 0 and (equals < 0 or doc < equals):
            key, delimiter = line[:doc], line[doc + 2 :]
            if not key or not delimiter:
                return "name and delimiter must not be empty", pairs
            try:
                last = lines.index(delimiter, k)
            except ValueError:
                return "delimiter not found", pairs
            # the last break is never part of the value
            value = "".join(x + e for x, e in zip(lines[k:last], [*ends[k : last - 1], ""], strict=True)) if last > k else ""
            pairs.append((key, value, first))
            k = last + 1
        elif equals < 0:
            return "invalid format", pairs
        elif equals == 0:
            return "name must not be empty", pairs
        else:
            pairs.append((line[:equals], line[equals + 1 :], first))
    return None, pairs


def _heredocs(texts: pa.Array) -> pa.Array:
    found = [(None, None) if t is None else _read_heredocs(t) for t in (x.as_py() for x in texts)]
    kind = pa.struct([("key", pa.string()), ("value", pa.string()), ("ord", pa.int64())])
    rows = [None if p is None else [dict(zip(("key", "value", "ord"), x, strict=True)) for x in p] for _, p in found]
    return pa.StructArray.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array(rows, pa.list_(kind))], ["error", "pairs"])


def parse_kv_files(files: DataFrame, content: str = "content", kind: str = "kind") -> DataFrame:
    """Key/value files: `(…, error, key, value, ord)`, from one scan.

    Pairs are in file order; one bad line rejects its whole file, which then is one row with its first problem and no
    pair. Files without heredocs are read natively; heredocs need a pass over the lines in order, so
    their texts alone take an Arrow hop.
    """
    keep = [c for c in files.columns if c != content]
    text, k = F.col(content), F.col(kind)
    holds = F.contains(text, F.lit("<<"))
    heredocs = F.arrow_udf(_heredocs, f"struct<error:string,pairs:array<{_PAIR}>>")
    read = bind(files.withColumn("_doc", heredocs(F.when(holds, text))), _plain=_simple(F.when(~holds, text), k))
    # a blocked name counts where it stands: before any later problem of the file
    blocked = F.exists("_doc.pairs", lambda p: is_blocked(k, p["key"]))
    error = F.when(holds, F.when(blocked, "blocked name").otherwise(F.col("_doc.error"))).otherwise(F.col("_plain.error"))
    pairs = F.when(holds, F.col("_doc.pairs")).otherwise(F.col("_plain.pairs"))
    judged = read.select(*keep, error.alias("error"), pairs.alias("_pairs"))
    out = judged.select(*keep, "error", F.inline_outer(F.when(F.col("error").isNull(), F.col("_pairs"))))
    return out.filter(F.col("error").isNotNull() | F.col("key").isNotNull())


def parse_path_files(files: DataFrame, content: str = "content") -> DataFrame:
    """One path per line; empty lines skipped, order kept in `ord`."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(F.split(content, "\n", -1)).alias("ord", "_e")).select(
        *keep, F.col("ord").cast("bigint").alias("ord"), F.regexp_replace("_e", r"\r$", "").alias("entry")
    ).filter(F.length("entry") > 0)


def parse_env_pairs(rows: DataFrame, pair: str) -> DataFrame:
    """`(…, key, value, ok)` of `K=V` texts, split at the first `=`; without one `ok` is false and both are NULL."""
    has = F.coalesce(F.instr(pair, "=") > 0, F.lit(False))
    return rows.withColumns({
        "key": F.when(has, F.substring_index(pair, "=", 1)),
        "value": F.when(has, F.substring(F.col(pair), F.instr(pair, "=") + 1, F.length(pair))), "ok": has})


def encode_kv(key: Column, value: Column) -> Column:
    """Heredoc text of one pair; the delimiter follows from the pair, so re-running gives the same text."""
    delim = F.concat(F.lit("EOF_"), F.hex(F.xxhash64(key, value)))
    return F.concat(key, F.lit("<<"), delim, F.lit("\n"), value, F.lit("\n"), delim, F.lit("\n"))


def encode_kv_rows(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("text", encode_kv(F.col("key"), F.col("value")))


FILE_PAIRS = 10_000


def append_kv_rows(pairs: DataFrame, path: str) -> None:
    """Append heredoc text; each entry ends with exactly one line break.

    A file is read back as one value, so its size must not grow with the table.
    """
    text = encode_kv_rows(pairs).select(F.regexp_replace("text", r"\n$", "").alias("value"))
    text.write.mode("append").option("maxRecordsPerFile", FILE_PAIRS).text(path)
