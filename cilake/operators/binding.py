"""Compute shared expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns that later expressions and filters read without being expanded into their definition.

    Catalyst substitutes a projected expression wherever it is used and pushes filters below it;
    for long parsing chains that multiplies the work (and the generated code) at every step.
    Unfolding a one-element array keeps each value computed once, in the same narrow pass.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))
