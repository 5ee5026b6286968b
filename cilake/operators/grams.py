"""Short substrings by which longer texts are found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_grams(text: Column, n: Column) -> Column:
    """Distinct substrings of `n` letters; of none, the empty text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    some = F.transform(F.when(n == 0, F.array(F.lit(1))).otherwise(places), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.filter(some, lambda g: F.length(g) == n))


def lead_gram(text: Column, n: Column) -> Column:
    """The one of them with the smallest hash."""
    return F.array_min(F.transform(distinct_grams(text, n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
