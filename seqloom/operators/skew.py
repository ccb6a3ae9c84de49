"""Per-key results when a few keys own much of the table.

Multi-level tree aggregation: every input chunk is combined locally, and the
partial states of a key are merged in rounds of `fan_in`, grouped by key and
chunk number. However many partials a key has, no task receives more than
`fan_in` of them a round, so a key with a third of all rows costs no more than
any other. The number of rounds is the logarithm of the number of chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workdir import materialize

#: how a partial state merges with another of the same key
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_START = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: list[str | Column], states: dict[str, tuple[str, Column]], chunks: int = 4096, fan_in: int = 16) -> DataFrame:
    """One row per combination of `keys` with the states named in `states`,
    each a (kind, expression) with a kind of `MERGE`.

    A chunk is an input partition (modulo `chunks`, the bound that fixes the
    number of rounds in advance). Null keys form a group of their own, null
    values are skipped as in SQL; an empty table gives an empty result.
    """
    unknown = {kind for kind, _ in states.values()} - set(MERGE)
    if unknown:
        raise ValueError(f"no mergeable state: {sorted(unknown)}")
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    source = df.select(*named, *[e.alias(f"_v_{name}") for name, (_, e) in states.items()])
    columns = source.columns[: len(named)]
    by = [F.col(f"`{c}`") for c in columns]
    chunk = F.pmod(F.spark_partition_id(), F.lit(chunks)).alias("_chunk")
    merged = source.groupBy(*by, chunk).agg(*[_START[kind](f"_v_{name}").alias(name) for name, (kind, _) in states.items()])
    for _ in range(max(1, math.ceil(math.log(chunks, fan_in)))):
        upper = F.floor(F.col("_chunk") / fan_in).alias("_chunk")
        merged = merged.groupBy(*by, upper).agg(*[MERGE[kind](name).alias(name) for name, (kind, _) in states.items()])
    return merged.drop("_chunk")


def per_key(df: DataFrame, key: str, text: str | None = None, name: str | None = None, count: str | None = None) -> DataFrame:
    """(key_value, rows, reads, n_text, sum_length, min_length, max_length,
    total): results of every non-null key.

    `reads` are distinct non-null values of `name` (rows if there is none),
    lengths are those of the non-null `text`, `total` sums `count` with null as
    0. Distinct names are found by grouping on (key, name), which spreads a
    heavy key over all tasks.
    """
    zero = F.lit(None).cast("long")
    rows = df.select(
        F.col(key).alias("key_value"),
        (F.col(name) if name else F.lit(None).cast("string")).alias("_name"),
        (F.length(text).cast("long") if text else zero).alias("_length"),
        (F.col(count).cast("long") if count else zero).alias("_count"),
    ).where("key_value IS NOT NULL")
    one = F.lit(1)
    base = rows.groupBy("key_value", "_name") if name else None
    if base is not None:
        rows = base.agg(F.count("*").alias("_rows"), F.count("_length").alias("_n"), F.sum("_length").alias("_sum"), F.min("_length").alias("_min"), F.max("_length").alias("_max"), F.sum("_count").alias("_total"))
        read = F.when(F.col("_name").isNotNull(), 1).otherwise(0)
    else:
        rows = rows.select("key_value", one.alias("_rows"), F.when(F.col("_length").isNotNull(), 1).otherwise(0).alias("_n"), F.col("_length").alias("_sum"), F.col("_length").alias("_min"), F.col("_length").alias("_max"), F.col("_count").alias("_total"))
        read = one
    states = {
        "rows": ("sum", F.col("_rows")), "reads": ("sum", read), "n_text": ("sum", F.col("_n")), "sum_length": ("sum", F.col("_sum")),
        "min_length": ("min", F.col("_min")), "max_length": ("max", F.col("_max")), "total": ("sum", F.coalesce("_total", F.lit(0))),
    }
    out = tree_aggregate(rows, ["key_value"], states)
    return out.select("key_value", *[F.col(c).cast("long").alias(c) for c in states])


def heavy_keys(results: DataFrame, min_share: float) -> DataFrame:
    """Rows of `per_key` with at least `min_share` of all rows that have a
    key: at most 1 / min_share of them. Adds `share`."""
    results = materialize(results, "perkey")
    total = results.agg(F.sum("rows")).first()[0] or 0
    return results.where(F.col("rows") >= min_share * total).withColumn("share", F.col("rows") / F.lit(float(max(total, 1))))
