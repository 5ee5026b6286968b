"""URL filter: prefix rules by host and path, then a Bloom filter cascade for long lists.

The cascade tells listed from unlisted keys exactly, over a known universe of keys, without a join: level 0 is a
Bloom filter of the listed keys; level 1 holds the unlisted keys that level 0 takes for listed; level 2 the
listed keys that level 1 takes for unlisted; and so on until a level lets nothing wrong through. A key's verdict is
given by the first level that does not hold it. Sizes shrink by half a level, so levels grow with the logarithm.

Building and asking are DataFrame functions only. Bits are set by hash positions, `bit_or` per 64-bit word with
map-side combine, and kept in tables; a query reads a level as a scalar subquery, a literal on the executors. That
literal has a proven bound: the size of level 0 is known from a count before anything is built (each later level
holds fewer keys). Above `MAX_BITS` the listed keys are joined instead, a plain equi-join.

Defined cases: a null url, or one without `://`, has empty host and path; no rule fits it, and it is not listed. A url
in upper case keeps its path as it is. Repeated urls get the same verdict. Without listed keys nothing is blocked by
the list; an empty table gives an empty result. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import fresh
from cilake.session import written

MAX_BITS = 128_000_000
WORD = 64
_LOW40 = (1 << 40) - 1

#: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls. Rules are few; long lists go to the cascade."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """Bit positions of a key in a level."""
    one = F.xxhash64(key, F.lit(2 * level)).bitwiseAND(F.lit(_LOW40))
    two = F.xxhash64(key, F.lit(2 * level + 1)).bitwiseAND(F.lit(_LOW40))
    return [F.pmod(one + two * F.lit(j), F.lit(bits)) for j in range(hashes)]


def level_size(keys: int, others: int, level: int) -> tuple[int, int]:
    """(hash functions, bits): level 0 lets about as many others through as there are keys, further levels half."""
    hashes = max(1, round(math.log2(max(2.0, others / keys / math.sqrt(0.5))))) if level == 0 else 1
    return hashes, max(WORD, -(-math.ceil(keys * hashes / math.log(2)) // WORD) * WORD)


def level_words(keys: DataFrame, key: str, level: int, hashes: int, bits: int) -> DataFrame:
    """One row: the level's bits as array<bigint>."""
    set_ = keys.select(F.explode(F.array(*positions(F.col(key), level, hashes, bits))).alias("p")).select(
        F.floor(F.col("p") / F.lit(WORD)).alias("word"), F.expr(f"shiftleft(1L, CAST(p % {WORD} AS INT))").alias("b"))
    zeros = keys.sparkSession.range(bits // WORD).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("b"))
    words = set_.union(zeros).groupBy("word").agg(F.bit_or("b").alias("b"))
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "b")))["b"].alias("words"))


class Cascade:
    """Levels of a built cascade; `listed(key)` is exact for every key of the universe it was built over."""

    def __init__(self):
        self.levels: list[tuple[int, int, DataFrame]] = []

    def holds(self, key: Column, level: int) -> Column:
        hashes, bits, words = self.levels[level]
        table = words.scalar()
        found = F.lit(True)
        for p in positions(key, level, hashes, bits):
            word = F.element_at(table, (F.floor(p / F.lit(WORD)) + 1).cast("int"))
            found = found & (F.getbit(word, (p % WORD).cast("int")) == 1)
        return found

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self.holds(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(keys: DataFrame, key: str = "key", listed: str = "listed") -> Cascade | None:
    """A cascade over distinct keys with a boolean `listed`; None if its first level would pass `MAX_BITS`."""
    cascade = Cascade()
    alive = written(keys.select(F.col(key).alias("key"), F.col(listed).alias("inside")), "keys")
    n, others = alive.agg(F.count_if("inside"), F.count_if(~F.col("inside"))).first()
    while n:
        hashes, bits = level_size(n, others, len(cascade.levels))
        if bits > MAX_BITS:
            return None
        words = written(level_words(alive.filter("inside"), "key", len(cascade.levels), hashes, bits), "level")
        cascade.levels.append((hashes, bits, words))
        through = cascade.holds(F.col("key"), len(cascade.levels) - 1)
        alive = written(alive.filter(F.col("inside") | through).withColumn("inside", ~F.col("inside")), "keys")
        n, others = alive.agg(F.count_if("inside"), F.count_if(~F.col("inside"))).first()
    return cascade


def judge(pages: DataFrame, listed: Column, url: str = "url", rules=RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `listed` is a condition on a row of `pages`: its key (host and path) is then on the block list, for
    every row with that key. The universe is all keys of `pages`.
    """
    key, mark = fresh(pages, "_key", "_listed")
    host, path = url_parts(F.col(url))
    keys = pages.select(F.concat(host, path).alias("key"), (F.coalesce(listed, F.lit(False)) & (host != "")).alias("listed"))
    keys = written(keys.groupBy("key").agg(F.bool_or("listed").alias("listed")), "universe")
    cascade = build_cascade(keys)
    out = pages.withColumns({"host": host, "path": path})
    if cascade is None:
        block = keys.filter("listed").select(F.col("key").alias(key), F.lit(True).alias(mark))
        out = out.join(block, F.concat("host", "path") == F.col(key), "left")
        found = F.coalesce(F.col(mark), F.lit(False))
    else:
        found = cascade.listed(F.concat("host", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(found, "block").otherwise("allow"))}).drop(key, mark)
