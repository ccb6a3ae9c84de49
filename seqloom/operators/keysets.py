"""Sets of named sequences: union, intersection, difference, merge and diff.
The sequence is the key; of several names the first by order stays."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """(key, value), one row a key: the value of the smallest `order` (of the
    smallest value without one). Null keys are left out."""
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(order or value).alias("_o")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.min_by("value", F.struct("_o", "value")).alias("value"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rows, values, kept): keys that several rows have, how many different
    values they bring, and the one that `keyed` keeps."""
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("value").alias("values"), F.min("value").alias("kept")).where("rows > 1")


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets have the same keys with the same values."""
    both = a.select("key", "value", F.lit(1).alias("_s")).unionByName(b.select("key", "value", F.lit(-1).alias("_s")))
    return both.groupBy("key", "value").agg(F.sum("_s").alias("n")).where("n <> 0").isEmpty()


def has(a: DataFrame, key: str) -> bool:
    return not a.where(F.col("key") == key).isEmpty()


def get(a: DataFrame, key: str) -> str | None:
    """The key's value; null without one."""
    found = a.where(F.col("key") == key).first()
    return found and found["value"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of both; the left value where both have one."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    return both.groupBy("key").agg(F.min_by("value", "_s").alias("value"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_anti")


def diff(sets: dict[str, DataFrame]) -> DataFrame:
    """(file_a, file_b, op, n) of every pair of sets: sizes of union,
    intersection and both differences."""
    names, out = list(sets), []
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            both = sets[x].select("key", F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionByName(sets[y].select("key", F.lit(0).alias("_x"), F.lit(1).alias("_y")))
            seen = both.groupBy("key").agg(F.max("_x").alias("x"), F.max("_y").alias("y"))
            n = seen.agg(F.count("*").alias("u"), F.count_if(F.col("x") + F.col("y") == 2).alias("i"), F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("x") == 0).alias("b"))
            ops = F.array(*[F.struct(F.lit(o).alias("op"), F.col(c).alias("n")) for o, c in (("union", "u"), ("intersection", "i"), ("left_only", "a"), ("right_only", "b"))])
            out.append(n.select(F.lit(x).alias("file_a"), F.lit(y).alias("file_b"), F.inline(ops)))
    return reduce(DataFrame.unionByName, out)


def diff_names(sets: dict[str, DataFrame]) -> DataFrame:
    """(file_a, file_b, op, name) of every pair of sets: the names that only
    the left, and only the right one has."""
    names, out = list(sets), []
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            for op, a, b in (("left_only", sets[x], sets[y]), ("right_only", sets[y], sets[x])):
                out.append(difference(a, b).select(F.lit(x).alias("file_a"), F.lit(y).alias("file_b"), F.lit(op).alias("op"), F.col("value").alias("name")))
    return reduce(DataFrame.unionByName, out)


def _merge_input(df: DataFrame, name: str, seq: str, order: str, cleanup: str | None, description: str | None, prefix: bool) -> DataFrame:
    full = F.col(name)
    if description:
        rest = F.coalesce(F.col(description), F.lit(""))
        full = F.when((rest == "") | (rest == full), full).otherwise(F.concat(full, F.lit(" "), rest))
    if cleanup:
        full = F.when(full.rlike(cleanup), F.trim(F.regexp_replace(full, cleanup, ""))).otherwise(full)
    if prefix:
        full = F.concat(F.regexp_replace(F.regexp_extract(F.col(order), r"([^/]+)$", 1), r"\.[^.]*$", ""), F.lit("_"), full)
    return df.select(full.alias("name"), F.col(seq).alias("seq"), F.col(order).alias("_o")).where("seq IS NOT NULL")


def merge(df: DataFrame, name: str, seq: str, order: str, prefer: str = "first", cleanup: str | None = None, description: str | None = None, prefix: bool = False) -> DataFrame:
    """(name, seq): one record a sequence, its first or last name by `order`
    (the file). The name is followed by the description, if one is named and
    differs from it; `cleanup` is a pattern removed from names; with `prefix` the
    file's name without its folder and last extension leads. Null sequences are
    left out."""
    if prefer not in ("first", "last"):
        raise ValueError("prefer must be first or last")
    pick = F.min_by if prefer == "first" else F.max_by
    rows = _merge_input(df, name, seq, order, cleanup, description, prefix)
    return rows.groupBy("seq").agg(pick("name", F.struct("_o", "name")).alias("name")).select("name", "seq")


def merge_report(df: DataFrame, name: str, seq: str, order: str, cleanup: str | None = None, description: str | None = None, prefix: bool = False) -> DataFrame:
    """(seq, n, names): sequences with several records, and their names with
    files in order ("name (from file)", joined by "; ")."""
    rows = _merge_input(df, name, seq, order, cleanup, description, prefix)
    entry = F.format_string("%s (from %s)", F.coalesce("name", F.lit("")), F.coalesce("_o", F.lit("")))
    out = rows.groupBy("seq").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_o", "name", entry.alias("e")))).alias("_l")).where("n > 1")
    return out.select("seq", "n", F.array_join(F.transform("_l", lambda x: x["e"]), "; ").alias("names"))


def export(df: DataFrame, name: str, seq: str | list[str], description: str | None = None, case: str | None = None, name_filter: str | None = None, description_filter: str | None = None, min_cases: int = 1, cleanup: str | None = None, unique_sequences: bool = False, sort: bool = False) -> DataFrame:
    """(header, seq), one record a (name, sequence); several sequence columns
    are concatenated (null as empty, but not all of them).

    Rows pass the filters (patterns found anywhere; null fails), then (name,
    sequence) pairs need `min_cases` distinct cases; with `unique_sequences` the
    smallest name of a sequence stays. The header is the name without what
    `cleanup` matches, trimmed, then without what `name_filter` matches, if that
    still does. The smallest description follows: of a `description_filter` with a
    group only what the group captures, of one without a group nothing. Without
    `sort` the order is undefined."""
    columns = [seq] if isinstance(seq, str) else seq
    text = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    some = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    rows = df.where(some).select(F.col(name).alias("name"), text.alias("seq"), (F.col(description) if description else F.lit(None).cast("string")).alias("description"), (F.col(case) if case else F.lit("")).alias("case"))
    rows = rows.where("name IS NOT NULL")
    for c, p in (("name", name_filter), ("description", description_filter)):
        if p:
            rows = rows.where(F.coalesce(F.col(c).rlike(p), F.lit(False)))
    kept = rows.groupBy("name", "seq").agg(F.count_distinct("case").alias("cases"), F.min("description").alias("description")).where(F.col("cases") >= min_cases)
    if unique_sequences:
        kept = kept.groupBy("seq").agg(F.min_by(F.struct("name", "description"), "name").alias("_k")).select("seq", "_k.*")
    head = F.when(F.col("name").rlike(cleanup), F.trim(F.regexp_replace("name", cleanup, ""))).otherwise(F.col("name")) if cleanup else F.col("name")
    if name_filter:
        head = F.when(head.rlike(name_filter), F.rtrim(F.regexp_replace(head, name_filter, ""))).otherwise(head)
    rest = F.nullif(F.col("description"), F.lit(""))
    if description_filter:
        groups = re.compile(description_filter).groups
        rest = F.nullif(F.regexp_extract("description", description_filter, 1), F.lit("")) if groups else F.lit(None).cast("string")
    out = kept.select(F.concat_ws(" ", head, rest).alias("header"), "seq", "name")
    return (out.orderBy("name", "seq") if sort else out).select("header", "seq")
