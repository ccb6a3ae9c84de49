"""Items that occur together, counted as a blocked Gram matrix.

Baskets are cut into record blocks and items into item blocks. A task holds
one record block as a sparse 0/1 matrix and adds, for each pair of item
blocks, the product of one block's transpose with the other; Spark sums the
products over the record blocks, combining them before the shuffle. Counts
come with the items' marginals and lift = n_ab * N / (n_a * n_b).

A basket with very many items costs one row of the matrix, never a list of its
pairs. Items below the support that a pair needs are dropped first, which
changes no result (n_ab <= n_a); the items left are at most the mean basket
size divided by `min_share`, so their numbering is bounded whatever the data.

Null baskets and null or empty items (after trimming) are left out, repeated
rows count once, ties need no rule as all qualifying pairs come out. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gram import gram
from ..workdir import materialize

RECORD_ROWS = 1 << 19  # incidences a record block holds, about


def baskets(df: DataFrame, basket: str | Column, items: list[str | Column]) -> DataFrame:
    """Distinct (basket, item) of the trimmed, non-empty values of `items`."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    listed = F.array(*[F.trim(as_col(c)) for c in items])
    rows = df.select(as_col(basket).alias("basket"), F.explode(listed).alias("item"))
    return rows.where("basket IS NOT NULL AND item <> ''").distinct()


def item_pairs(pairs: DataFrame, min_count: int, min_share: float, min_lift: float, across: Column | None = None) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift) of the item pairs, item_a <
    item_b, with n_ab >= min_count, n_ab >= min_share * N and lift >= min_lift.
    `pairs` has distinct (basket, item); `across` is a condition on item_a and
    item_b. min_share must be positive: it bounds the number of items."""
    if min_share <= 0:
        raise ValueError("min_share must be positive")
    spark = pairs.sparkSession
    pairs = materialize(pairs, "baskets")
    n = pairs.agg(F.count_distinct("basket")).first()[0]
    floor = max(float(min_count), min_share * n)
    single = pairs.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= floor)
    named = sorted((r["item"], r["n_item"]) for r in single.toLocalIterator())
    schema = "pos int, item string, n_item long"
    items = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(named)], schema)
    incidences = sum(c for _, c in named)
    blocks = max(1, -(-incidences // RECORD_ROWS))
    n_items = len(named)

    def products(rows: pa.Table) -> pa.Table:
        baskets_ = rows["basket"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out = list(gram(baskets_.astype(np.int64), rows["pos"].to_numpy().astype(np.int64), n_items))
        a, b, c = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "n_ab": pa.array(c, pa.int64())})

    placed = pairs.join(F.broadcast(items.select("pos", "item")), "item").select("basket", "pos")
    counted = placed.withColumn("block", F.pmod(F.xxhash64("basket"), F.lit(blocks))).groupBy("block").applyInArrow(products, "a int, b int, n_ab long")
    summed = counted.groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    side = lambda x: items.select(F.col("pos").alias(x), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"))
    named_pairs = summed.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b")
    observed, chance = F.col("n_ab") * F.lit(n), F.col("n_a") * F.col("n_b")
    kept = named_pairs.where((F.col("n_ab") >= floor) & (observed >= min_lift * chance))
    if across is not None:
        kept = kept.where(across)
    return kept.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), (observed / chance).alias("lift"))
