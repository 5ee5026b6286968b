"""Running aggregates that split a hot group.

`Window.partitionBy(job).orderBy(seq)` sends a whole job to one task; with one job holding a
third of all rows that task never ends. Here groups of more than `block_rows` rows are cut into blocks of
about equal row counts, at boundaries taken from a sample of the group's own order values, whatever
their distribution. The running value is
    value within the block  +  carry of all earlier blocks.
Rows are shuffled once, by (group, block). The carry comes from the last row of each block, so only
block summaries meet in one task. Without a group above `block_rows` it is one plain window. The result is exact;
NULL is a group like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cilake.functions.dynamic import let
from cilake.session import written

BLOCK_ROWS = 65_536
MAX_BLOCKS = 4096  # of one group; beyond it blocks grow
SAMPLES = 16  # order values sampled for each block
BLOCK = "_block"


@dataclass(frozen=True)
class Run:
    """One running column: `how` is sum, max, min or last (last non-null value)."""

    name: str
    how: str
    value: Column


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def _prefix(how: str, value: Column, window) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _COMBINE[how](value).over(window)


def _merge(how: str, carry: Column, local: Column) -> Column:
    if how == "last":
        return F.coalesce(local, carry)
    if how == "sum":
        return F.when(carry.isNull() & local.isNull(), None).otherwise(
            F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    return F.greatest(carry, local) if how == "max" else F.least(carry, local)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of the keys, which appear once."""
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def block_bounds(df: DataFrame, keys: list[str], rank: Column, block_rows: int) -> DataFrame | None:
    """(keys…, _bounds): the ascending first ranks of the blocks after the first, of groups above `block_rows`.

    A table of at most one row per `block_rows` rows; None if no group is that large.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
    sizes = sizes.withColumn("_blocks", F.least(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(MAX_BLOCKS)).cast("int"))
    large = written(sizes, "large-groups")
    if large.isEmpty():
        return None
    ranks = df.select(*keys, rank.alias("_rank"))
    step = F.greatest(F.floor(F.col("_n") / (F.col("_blocks") * F.lit(SAMPLES))), F.lit(1))
    some = join_same(ranks, large, keys).filter(F.pmod(F.xxhash64("_rank"), step) == 0)
    cut = lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_blocks")).cast("int"))
    bounds = some.groupBy(*keys, "_blocks").agg(F.sort_array(F.collect_set("_rank")).alias("_s")).select(
        *keys, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_blocks") - 1), cut)).alias("_bounds"))
    return written(bounds, "bounds")


def block_of(rank: Column, bounds: Column) -> Column:
    """How many bounds are at most `rank`, by binary search; 0 without bounds."""
    rounds = F.sequence(F.lit(1), F.lit(MAX_BLOCKS.bit_length()))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).otherwise(let(middle, lambda m: F.when(
            F.get(bounds, m) <= rank, F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), m.alias("hi")))))

    found = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), halve, lambda s: s["lo"])
    return F.when(bounds.isNull(), 0).otherwise(found).cast("int")


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    runs: list[Run],
    *,
    inclusive: bool,
    ties: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running columns over each group in order of a non-null column.

    `inclusive` counts the row itself, otherwise only earlier rows (NULL where there are none).
    `ties` breaks equal `order` values; rows that tie fully are ordered arbitrarily and stay in one block.
    """
    ties = ties or []
    end = 0 if inclusive else -1
    rank = F.struct(F.col(order), *[F.col(t) for t in ties])
    bounds = block_bounds(df, keys, rank, block_rows)
    if bounds is None:
        whole = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[_prefix(r.how, r.value, whole).alias(r.name) for r in runs])
    placed = join_same(df, bounds, keys, "left").withColumn(BLOCK, block_of(rank, F.col("_bounds"))).drop("_bounds")
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order, *ties)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, end)
    local = written(placed.select(
        "*", *[_prefix(r.how, r.value, before).alias(f"_local_{r.name}") for r in runs],
        *[_prefix(r.how, r.value, so_far).alias(f"_upto_{r.name}") for r in runs],
        F.lead(F.lit(1)).over(inside).isNull().alias("_last")), "blocks")
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = local.filter("_last").select(
        *keys, BLOCK, *[_prefix(r.how, F.col(f"_upto_{r.name}"), earlier).alias(f"_carry_{r.name}") for r in runs])
    return join_same(local, carry, [*keys, BLOCK]).select(
        *df.columns,
        *[_merge(r.how, F.col(f"_carry_{r.name}"), F.col(f"_local_{r.name}")).alias(r.name) for r in runs])


def numbered(df: DataFrame, keys: list[str], order: str, name: str, *, ties: list[str] | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of each row in its group."""
    out = running(df, keys, order, [Run(name, "sum", F.lit(1).cast("bigint"))], inclusive=True, ties=ties,
                  block_rows=block_rows)
    return out.withColumn(name, F.col(name) - 1)


def last_per_key(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Last write per key wins: one aggregate with map-side combine, so a hot key stays small."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, sep: str, name: str, *,
                 ties: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Concatenate a group's texts in order, first inside blocks and then over the blocks.

    No task sorts a whole group; the result of a group still has to fit one text value.
    """
    lit_sep = "'" + sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    rows = df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block_rows)).cast("bigint"))
    by = ", ".join([f"`{order}`", *[f"`{t}`" for t in (ties or [])]])
    # listagg orders by its own argument or by one key at a time: order by a struct.
    rows = rows.withColumn("_rank", F.expr(f"struct({by})"))
    parts = rows.groupBy(*keys, BLOCK).agg(
        F.expr(f"listagg(`{text}`, {lit_sep}) within group (order by _rank)").alias("_part")
    )
    return parts.groupBy(*keys).agg(F.expr(f"listagg(_part, {lit_sep}) within group (order by {BLOCK})").alias(name))
