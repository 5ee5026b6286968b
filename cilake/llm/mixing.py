"""Mixing sources to target weights.

Words per source are aggregated; the wanted total is shared among the sources by weight, no source
above `most` times its own size (the excess is shared again); a source's rate is target / size. Each
document is then emitted floor(rate) times, plus one more copy with probability equal to the fraction.
The draw is a hash of seed and doc_id, so it needs no state, and reruns agree.

All steps are DataFrame functions. The per-source table is small next to the documents but not
assumed to fit anywhere: it is ranked by a range sort and levelled by a few distributed rounds. A hot
source costs nothing special: its size is summed map-side, and its documents only look up one rate.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows
(same doc_id) get the same draw and thus the same number of copies; a null doc_id draws as the text 'null'.
Sources without words get target 0 and none of their documents. An empty table gives an empty result.
Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cilake.llm.common import fresh
from cilake.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20240


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def ranked(sources: DataFrame, by: str, rank: str) -> DataFrame:
    """Add the 0-based position in the order of `by`, nulls last, without one task seeing all rows."""
    spot, part, first = fresh(sources, "_spot", "_part", "_first")
    rows = written(sources.orderBy(F.col(by).asc_nulls_last()).withColumn(spot, F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn(part, F.shiftright(spot, 33))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per source
    firsts = rows.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(first))
    return rows.join(firsts, part).withColumn(
        rank, F.col(first) + F.col(spot).bitwiseAND(F.lit((1 << 33) - 1))).drop(spot, part, first)


def level_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size) with `target`: min(most * size, level * weight), summing to share * sizes.

    Each round sets the level from the sources not yet at their cap; sources that the level lifts over their
    cap join the capped ones. The capped set only grows, so the rounds end; few are needed in practice.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(ranked(sources, "source", "_rank").withColumn("_weight", weight), "levels")
    cap = F.col("source_size") * F.lit(most)
    level, capped = 0.0, -1
    while True:
        over = (F.col("_weight") * F.lit(level) > cap) if capped >= 0 else F.lit(False)
        total, full, open_weight, n = table.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("_weight"))),
            F.count(F.when(over, 1))).first()
        if not total or n == capped:
            break
        capped = n
        if not open_weight:
            break
        level = (share * total - most * (full or 0)) / open_weight
    target = F.least(cap, F.lit(level) * F.col("_weight"))
    return table.select("source", "source_size", target.alias("target"))


def rates(docs: DataFrame, text: str = "text", source: str = "source", **law) -> DataFrame:
    """Per source: source_size, target."""
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("_size"))
    return level_targets(sizes.groupBy("source").agg(F.sum("_size").alias("source_size")), **law)


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
             seed: int = SEED, **law) -> DataFrame:
    """`docs` with size, source_size, target and `copies`, the number of times the mix emits the row.

    The rate table is joined by source with a null-safe key; Spark broadcasts it where its measured size
    allows and otherwise splits the skewed join partitions.
    """
    new = ["size", "source_size", "target", "copies"]
    (key,) = fresh(docs, "_source")
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new],
                       word_count(F.col(text)).alias("size"))
    table = rates(docs, text, source, **law).withColumnRenamed("source", key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(F.col(doc_id), seed) < rate - F.floor(rate)
    return base.join(table, F.col(source).eqNullSafe(F.col(key)), "left").drop(key).withColumn(
        "copies", F.floor(rate) + extra.cast("bigint"))


def mix(docs: DataFrame, **law) -> DataFrame:
    """The mixed documents themselves: each row `copies` times, with the columns of `docs`."""
    (doc,) = fresh(docs, "_doc")
    plan = mix_plan(docs.withColumn(doc, F.struct("*")), **law).filter(F.col("copies") > 0)
    return plan.select(doc, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(f"{doc}.*")
