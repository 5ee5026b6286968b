"""File sets: glob selection and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.functions.text import glob_column, glob_to_regex, normal_glob


def matches(path: Column, patterns: list[str]) -> Column:
    """Does a path relative to the root match the patterns? Excludes (`!`) win whatever the order."""
    sides = {True: [], False: []}
    for p in patterns:
        sides[p.startswith("!")].append(glob_to_regex(normal_glob(p.removeprefix("!"))))
    hit = lambda rs: path.rlike("|".join(f"(?:{r})" for r in rs)) if rs else F.lit(False)
    return hit(sides[False]) & ~hit(sides[True])


def select_files(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Files chosen by the patterns: a filter, so contents of other files are never shuffled."""
    return files.filter(matches(F.col(path), patterns))


SUFFIX = 8  # letters of a pattern's literal end by which its paths are found


def _folders(path: Column) -> Column:
    """'' and every folder above a path, with its closing '/'."""
    depth = F.size(F.split(path, "/")) - 1
    above = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i > 0, F.concat(
        F.call_function("substring_index", path, F.lit("/"), i), F.lit("/"))).otherwise(""))
    return F.array_distinct(above)


def select_by_rules(files: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """As `select_files`, but every path set has its own patterns: rows `(set_id, pattern)`.

    A pattern is found by the folder and the end that it spells out (`src/lib/` and `_test.go` of `src/lib/**/*_test.go`), by
    equality with the folders above a path and the ends of it; only what meets is matched. So a path does not see all patterns
    of its set. A file needs an include among its patterns and no exclude. Contents take no part in the first join.
    """
    plain = F.regexp_replace("pattern", "^!?/?", "")
    single = F.when(F.contains(plain, F.lit("**")), plain).otherwise(F.regexp_replace(plain, "/+", "/"))
    rules = patterns.select(
        "set_id", F.col("pattern").startswith("!").alias("_off"), glob_column(F.regexp_replace("pattern", "^!", "")).alias("_rx"),
        F.regexp_extract(single, r"^([^*?\[\\]*/)", 1).alias("_folder"),
        F.right(F.regexp_extract(single, r"([^*?\[\]\\/]*)$", 1), F.lit(SUFFIX)).alias("_end")).distinct()
    ends = rules.groupBy("set_id").agg(F.collect_set(F.length("_end")).alias("_lengths"))
    names = files.select("set_id", F.col(path).alias("_path")).distinct().join(ends, "set_id")
    keyed = names.select("set_id", "_path", F.explode(_folders(F.col("_path"))).alias("_folder"), "_lengths").select(
        "set_id", "_path", "_folder", F.explode(F.transform("_lengths", lambda n: F.right(F.col("_path"), n))).alias("_end"))
    met = keyed.join(rules, ["set_id", "_folder", "_end"]).filter(F.rlike("_path", F.col("_rx")))
    chosen = met.groupBy(F.col("set_id").alias("_set"), "_path").agg(F.bool_or("_off").alias("_out")).filter(~F.col("_out"))
    return files.join(chosen, (files["set_id"] == chosen["_set"]) & (files[path] == chosen["_path"]), "left_semi")


def _chain(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Digests over rows sorted by (group, path): one open hash, constant memory. Columns: _key, _digest, then `by`."""
    current, state, head = None, None, None
    for batch in batches:
        keys, digests = batch.column("_key").to_pylist(), batch.column("_digest")
        starts = {k for k in range(len(keys)) if keys[k] != (keys[k - 1] if k else current)}
        done, heads = [], []
        for a, b in pairwise(sorted({0, *starts, len(keys)})):
            if a in starts:
                if state is not None:
                    done.append(state.hexdigest())
                    heads.append(head)
                current, state, head = keys[a], hashlib.sha256(), batch.select(by).slice(a, 1)
            state.update(b"".join(digests[a:b].to_pylist()))
        yield from _hashed(heads, done, by)
    yield from _hashed([head] if state else [], [state.hexdigest()] if state else [], by)


def _hashed(heads: list[pa.RecordBatch], done: list[str], by: list[str]) -> Iterator[pa.RecordBatch]:
    for head, digest in zip(heads, done, strict=True):
        yield pa.RecordBatch.from_arrays([*head.columns, pa.array([digest])], names=[*by, "hash"])


def hash_files(files: DataFrame, by: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """SHA-256 over the raw SHA-256 digests of each group's files, in byte order of path.

    Contents are hashed where they lie, so only 32-byte digests are shuffled. The digest of a group is sequential by
    definition: its sorted digests stream through one open hash in constant memory. NULL and NaN keys are groups.
    """
    key = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"})
    digests = files.select(key.alias("_key"), F.unhex(F.sha2(F.col(content).cast("binary"), 256)).alias("_digest"),
                           F.col(path).alias("_path"), *by)
    ordered = digests.repartition("_key").sortWithinPartitions("_key", "_path", "_digest").drop("_path")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.select(*by).schema)
    return ordered.mapInArrow(lambda it: _chain(it, by), f"{fields}, hash string")


def hash_or_empty(groups: DataFrame, hashes: DataFrame, by: list[str]) -> DataFrame:
    """'' for groups without any matching file."""
    every = groups.select(*by, F.lit("").alias("hash"))
    return every.unionByName(hashes).groupBy(*by).agg(F.max("hash").alias("hash"))
