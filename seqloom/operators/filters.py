"""Row criteria that combine with AND in one pass, with counts per step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_of, at_least, col


@dataclass(frozen=True)
class Criterion:
    label: str
    test: Callable[[], Column]


def min_threshold(column: str, least: float) -> Criterion:
    return Criterion(f"{column} >= {least}", lambda: at_least(col(column), least))


def max_threshold(column: str, most: float) -> Criterion:
    return Criterion(f"{column} <= {most}", lambda: (col(column) <= most) & ~F.isnan(col(column).cast("double")))


def min_length(column: str, least: int) -> Criterion:
    return Criterion(f"length({column}) >= {least}", lambda: F.length(col(column)) >= least)


def non_negative(column: str) -> Criterion:
    return min_threshold(column, 0)


def custom(condition: Column, label: str) -> Criterion:
    return Criterion(label, lambda: condition)


def apply(df: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Rows that meet all criteria; a null result does not."""
    return df.where(all_of([F.coalesce(c.test(), F.lit(False)) for c in criteria]))


def account(df: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """(step, label, total, kept) of each step, counted in one pass."""
    tests = [F.coalesce(c.test(), F.lit(False)) for c in criteria]
    counts = df.agg(*[F.count_if(all_of(tests[:i])).alias(f"_{i}") for i in range(len(tests) + 1)])
    steps = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(c.label).alias("label"), F.col(f"_{i}").alias("total"), F.col(f"_{i + 1}").alias("kept")) for i, c in enumerate(criteria)])
    return counts.select(F.inline(steps))
