"""Counts for the terminal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_table(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of values, most first, then by value."""
    return df.groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *columns)


def bars(counts: list[tuple[str, float]], width: int = 40) -> str:
    """A line a value, with a bar in proportion to the largest."""
    top = max((n for _, n in counts), default=0)
    pad = max((len(str(k)) for k, _ in counts), default=0)
    return "\n".join(f"{str(k):>{pad}} {'#' * round(width * n / top) if top > 0 else ''} {n:g}" for k, n in counts)
