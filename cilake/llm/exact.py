"""Exact dedup against history: a minimal perfect hash over the distinct digests of earlier documents.

Texts are equal when their A-Z-lower-cased forms are; the SHA-256 of that form is the digest. Of equal texts the row with
the largest doc_id stays, whether it is old or new.
  1. Every row becomes a narrow one: id, locator, digest. The locator (id, row number in the written table) tells rows apart even
     where ids repeat. Texts are read and hashed once and never move.
  2. Rows are pre-aggregated to distinct digests with their best locator and count, map-side, so a hot text is one row a task.
  3. History: digests are dealt by hash to segments of about `segment_keys`. For each segment a minimal perfect hash is
     built: levels of bit arrays, each of which places the keys that meet no other key in it; a key's slot is the number
     of bits before its own. Slots hold the full 32-byte digest and the winner's locator and count.
  4. New digests go to their segment, where the hash gives one slot to look at. Only if all 32 bytes agree is it a
     repeat and joins the slot's group; a nonmember is a group of its own.
  5. Verdicts of groups of two or more meet the rows again. The at most 1,000 digests that hold a thousandth of all rows or
     more are broadcast, the rest is a plain join, so a hot text does not sit in one task.

Segments hold distinct digests only, so they are even whatever the texts are, and one segment (about 6 MB) is what a task holds
at a time. All steps are tables and shuffles: a lost executor only reruns its tasks.

Defined cases: a null text counts as empty. A null doc_id loses against any other; a group without ids has a null keep_id
and still keeps one row. Of rows with equal text and id exactly one stays, the one with the larger hash of the original text.
Empty tables, on either side, are fine. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import join_groups
from cilake.session import written

SEGMENT_KEYS = 65_536
LOAD = 2  # bits of a level for each key it tries to place
MAX_LEVELS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HELD = ["digest", "locator", "winner"]
NEW = ["keep_id", "group_size", "kept", "text_sha256"]


def level_hash(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 32-byte digests (n x 4 words), another one for each level."""
    x = words[:, level % 4] + words[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of each of the distinct digests (0 to n - 1, each once)."""
    levels, slots, left, used = [], np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    while len(left):
        if len(levels) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = LOAD * len(left)
        at = (level_hash(words[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        slots[left[placed]] = used + np.cumsum(alone)[at[placed]] - 1
        used += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def look_up(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot that may hold each digest; -1 if no level has a bit for it."""
    slots, left, used = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = (level_hash(words[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = used + np.cumsum(bits)[at[hit]] - 1
        used += int(bits.sum())
        left = left[~hit]
    return slots


def digest_words(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)


def marked(docs: DataFrame, side: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the text, with digest and locator, as a written table; `side` (0 or 1) keeps locators of two tables apart."""
    value = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(value, UPPER, LOWER), 256))
    row = F.monotonically_increasing_id() * 2 + side
    place = F.struct(F.col(doc_id).alias("id"), F.xxhash64(value).alias("text_hash"), row.alias("row"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in (*HELD, *NEW)]
    return written(docs.select(*rest, digest.alias("digest"), place.alias("locator")), "digests")


def distinct_digests(rows: DataFrame, n_segments: int) -> DataFrame:
    """digest, locator (of the winner), n and the digest's segment."""
    out = rows.groupBy("digest").agg(F.max("locator").alias("locator"), F.count("*").alias("n"))
    return out.withColumn("segment", F.pmod(F.xxhash64("digest"), F.lit(n_segments)).cast("int"))


def index(distinct: DataFrame) -> DataFrame:
    """The hash with its slots, one row a segment, of distinct digests with locator, n and segment."""
    kind = distinct.schema["locator"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        levels, slots = build(digest_words(table["digest"]))
        held = table.take(pa.array(np.argsort(slots)))  # slot order
        ends = pa.array([0, len(held)], pa.int32())
        column = lambda name: pa.ListArray.from_arrays(ends, held[name].combine_chunks())
        return pa.table({
            "segment": held["segment"].slice(0, 1), "sizes": pa.array([[len(b) for b in levels]]),
            "levels": pa.array([[np.packbits(b).tobytes() for b in levels]]),
            "digests": pa.array([b"".join(held["digest"].to_pylist())]), "locators": column("locator"), "counts": column("n")})

    return distinct.groupBy("segment").applyInArrow(
        one, f"segment int, sizes array<bigint>, levels array<binary>, digests binary, locators array<{kind}>, counts array<bigint>")


def levels_of(segments: pa.Table) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
            for row in segments.select(["sizes", "levels"]).to_pylist() for size, bits in zip(row["sizes"], row["levels"], strict=True)]


def merged(probes: DataFrame, held: DataFrame) -> DataFrame:
    """One row for every distinct digest of either side: digest, slot (null: not in the index), locator and n of both sides."""
    kind = probes.schema["locator"].dataType.simpleString()

    def one(new: pa.Table, old: pa.Table) -> pa.Table:
        words = digest_words(new["digest"])
        full = digest_words(old["digests"])
        slots = look_up(words, levels_of(old))
        asked = np.nonzero(slots >= 0)[0]
        slots[asked[(full[slots[asked]] != words[asked]).any(axis=1)]] = -1  # the slot of another digest
        met = np.full(len(full), -1)  # the probe that is in each slot
        met[slots[slots >= 0]] = np.nonzero(slots >= 0)[0]
        alone = np.nonzero(slots < 0)[0]
        index_of = lambda x: pa.array(x, mask=x < 0)
        probe = index_of(np.concatenate([met, alone]))
        slot = index_of(np.concatenate([np.arange(len(full)), np.full(len(alone), -1)]))
        packed = b"".join(old["digests"].to_pylist())
        digests = [packed[k : k + 32] for k in range(0, len(packed), 32)] + new["digest"].take(pa.array(alone)).to_pylist()
        of_old = lambda name: old[name].combine_chunks().flatten().take(slot)
        return pa.table({"digest": pa.array(digests, pa.binary()), "slot": slot, "old": of_old("locators"), "n_old": of_old("counts"),
                         "new": new["locator"].combine_chunks().take(probe), "n_new": new["n"].combine_chunks().take(probe)})

    return probes.groupBy("segment").cogroup(held.groupBy("segment")).applyInArrow(
        one, f"digest binary, slot bigint, old {kind}, n_old bigint, new {kind}, n_new bigint")


def dedup(docs: DataFrame, history: DataFrame, doc_id: str = "doc_id", text: str = "text",
          segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """The rows of both tables (of the same columns) without their texts, with keep_id, group_size, kept and text_sha256."""
    new, old = marked(docs, 0, doc_id, text), marked(history, 1, doc_id, text)
    n_new, n_old = new.count(), old.count()
    n_segments = max(1, math.ceil(max(n_new, n_old) / segment_keys))
    both = merged(distinct_digests(new, n_segments), index(distinct_digests(old, n_segments)))
    count = F.coalesce("n_old", F.lit(0)) + F.coalesce("n_new", F.lit(0))
    groups = both.select("digest", F.greatest("old", "new").alias("winner"), count.cast("bigint").alias("group_size"))
    groups = written(groups.filter("group_size > 1"), "groups")
    met = join_groups(new.unionByName(old), groups, "digest", "group_size", n_new + n_old)
    winner = F.coalesce("winner", "locator")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in (*HELD, *NEW)]
    return met.select(*rest, winner["id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                      (winner == F.col("locator")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
