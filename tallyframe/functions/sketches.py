"""Counts of different values by sketches that can be stored and merged later, where an exact count would be too dear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import quoted

#: Binary logarithm of a sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** REGISTERS).
REGISTERS = 14


def standard_error(registers: int = REGISTERS) -> float:
    return 1.04 / 2 ** (registers / 2)


def distinct_sketches(df: DataFrame, variables: Sequence[str], **by: Column) -> DataFrame:
    """(variable, by..., sketch): a sketch of the non-null values of each variable in each group, made in one pass.

    A sketch takes at most 2 ** REGISTERS bytes, whatever it has seen; values count as text."""
    items = F.array(*[F.struct(F.lit(v).alias("variable"), quoted(v).cast("string").alias("value")) for v in variables])
    long = df.select(*[c.alias(n) for n, c in by.items()], F.inline(items)).filter("value is not null")
    return long.groupBy("variable", *by).agg(F.hll_sketch_agg("value", F.lit(REGISTERS)).alias("sketch"))


def merged_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """(variable, by..., estimate) of sketches merged over all other groups."""
    return sketches.groupBy("variable", *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
