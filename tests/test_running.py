"""Block-split running aggregates against plain loops, with a hot group and tiny blocks."""

import random

from pyspark.sql import functions as F

from cilake.operators.running import Run, block_bounds, block_of, join_same, last_per_key, numbered, ordered_text, running


def rows(seed=7, n=400):
    rnd = random.Random(seed)
    return [(1 if i % 3 else rnd.randrange(2, 6), i, rnd.choice([None, rnd.randrange(9)])) for i in rnd.sample(range(5000), n)]


def brute(data, inclusive):
    out = {}
    for g in {r[0] for r in data}:
        total = last = top = None
        for _, o, v in sorted((r for r in data if r[0] == g), key=lambda r: r[1]):
            before = (total, last, top)
            if v is not None:
                total, last, top = (total or 0) + v, v, v if top is None else max(top, v)
            out[(g, o)] = (total, last, top) if inclusive else before
    return out


def test_running_matches_a_loop(spark):
    data = rows()
    df = spark.createDataFrame(data, "g int, o bigint, v bigint")
    for inclusive in (True, False):
        for block in (1, 7, 100, 65536):
            runs = [Run("s", "sum", F.col("v")), Run("l", "last", F.col("v")), Run("m", "max", F.col("v"))]
            got = {(r.g, r.o): (r.s, r.l, r.m) for r in running(df, ["g"], "o", runs, inclusive=inclusive, block_rows=block).collect()}
            assert got == brute(data, inclusive), (inclusive, block)


def test_blocks_of_any_order(spark):
    rnd = random.Random(3)
    sparse = [(None if i % 2 else 5, None, 10**12 * rnd.randrange(10**5) + i, i) for i in range(3000)]  # NULL keys, far apart
    tied = [(7, "x", 1, i) for i in range(2000)]  # all equal but for the tie column
    flat = [(8, "y", 1, 3) for _ in range(500)]  # fully tied
    df = spark.createDataFrame(sparse + tied + flat, "g int, h string, o bigint, t bigint")
    got = numbered(df, ["g", "h"], "o", "n", ties=["t"], block_rows=100).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.g, r.h), []).append((r.n, r.o, r.t))
    assert len(got) == 5500
    for g in groups.values():
        g.sort()
        assert [x[0] for x in g] == list(range(len(g))) and [x[1:] for x in g] == sorted(x[1:] for x in g)
    rank = F.struct("o", "t")
    bounds = block_bounds(df, ["g", "h"], rank, 100)
    blocks = join_same(df, bounds, ["g", "h"]).select("g", block_of(rank, F.col("_bounds")).alias("b"))
    sizes = {(r.g, r.b): r["count"] for r in blocks.groupBy("g", "b").count().collect()}
    assert len(sizes) <= 4 + 5500 // 100 and max(n for (g, _), n in sizes.items() if g != 8) < 300
    assert block_bounds(df, ["g", "h"], rank, 10_000) is None


def test_numbered_and_text(spark):
    data = rows()
    df = spark.createDataFrame(data, "g int, o bigint, v bigint")
    got = {(r.g, r.o): r.n for r in numbered(df, ["g"], "o", "n", block_rows=50).collect()}
    for g in {r[0] for r in data}:
        for i, o in enumerate(sorted(r[1] for r in data if r[0] == g)):
            assert got[(g, o)] == i
    text = {r.g: r.t for r in ordered_text(df.withColumn("x", F.col("o").cast("string")), ["g"], "o", "x", ",", "t", block_rows=50).collect()}
    for g in text:
        assert text[g] == ",".join(str(o) for o in sorted(r[1] for r in data if r[0] == g))


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 2, 1, "y"), ("a", 1, 9, "z"), ("b", 1, 1, "w")], "k string, s int, o int, value string")
    assert {r.k: r.value for r in last_per_key(df, ["k"], ["s", "o"]).collect()} == {"a": "y", "b": "w"}
