"""The N best items of every group, ranked in two salted stages.

A group's items are hashed into subgroups; each subgroup is ranked and keeps
N, and only those survivors are ranked for the group. A group with a third of
all rows is thus sorted by many tasks, and the last one sees at most
N * `salts` of its rows.

An item's score is its highest value; ties go to the smaller item (code
point), so the result is one and the same for any partitioning. Rows with a
null group, item or score are left out; repeated rows count once. A group with
fewer than N items gives all of them, an empty table nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_items(df: DataFrame, group: str, item: str, score: str, n: int, salts: int = 32) -> DataFrame:
    """(group_key, item, score, rank), rank from 1 to n."""
    rows = df.select(F.col(group).alias("group_key"), F.col(item).alias("item"), F.col(score).alias("score"))
    best = rows.where("group_key IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL").groupBy("group_key", "item").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("item")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    first = Window.partitionBy("group_key", "salt").orderBy(*order)
    survivors = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).drop("salt", "rank")
    last = Window.partitionBy("group_key").orderBy(*order)
    return survivors.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)
