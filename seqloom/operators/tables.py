"""Relational utilities over any table: select, filter, transform, aggregate,
distinct, sort, join, collect and exclude. Where the outcome depends on row
order (first value of a group), an explicit order column decides."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from .dictionary import contains

_COMPARE = {"<": operator.lt, "<=": operator.le, ">=": operator.ge, ">": operator.gt}


def _require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    _require(df, columns)
    return df.select(*[col(c) for c in columns])


def filter_rows(df: DataFrame, column: str, pattern: str | None = None, compare: str | None = None, threshold: float | None = None) -> DataFrame:
    """Rows whose value matches `pattern` anywhere, or compares with
    `threshold`. Nulls and NaN never pass. A text column is compared as numbers
    and must hold nothing else: a row that can't be read raises."""
    _require(df, [column])
    if (pattern is None) == (compare is None):
        raise ValueError("give either a pattern or a comparison")
    value = col(column)
    if pattern is not None:
        return df.where(F.coalesce(value.cast("string").rlike(pattern), F.lit(False)))
    if compare not in _COMPARE or threshold is None:
        raise ValueError(f"a comparison needs one of {', '.join(_COMPARE)} and a threshold")
    if df.schema[column].dataType.typeName() in ("string", "varchar", "char"):
        parsed = value.try_cast("double")
        value = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"no number in {column}: "), F.coalesce(value, F.lit("null")))).cast("double")).otherwise(parsed)
    return df.where(_COMPARE[compare](value, F.lit(threshold)) & ~F.isnan(value.cast("double")))


def transform(df: DataFrame, column: str, pattern: str, replacement: str, new_column: str | None = None) -> DataFrame:
    r"""Where the value matches, it becomes `replacement` with \1, \2 ... filled
    in; `new_column` gets all captures in a row ('' without a match). Null stays."""
    _require(df, [column])
    groups = re.compile(pattern).groups
    value = col(column).cast("string")
    group = lambda i: F.coalesce(F.regexp_extract(value, pattern, i), F.lit(""))
    parts = [F.lit(p) if i % 2 == 0 else group(int(p)) for i, p in enumerate(re.split(r"\\(\d+)", replacement))]
    if any(int(p) > groups for p in re.findall(r"\\(\d+)", replacement)):
        raise ValueError("the replacement names a group that the pattern lacks")
    matched = value.rlike(pattern)
    if new_column:
        captures = F.concat(F.lit(""), *[group(i + 1) for i in range(groups)])
        df = df.withColumn(new_column, F.when(matched, captures).when(value.isNull(), F.lit(None)).otherwise(F.lit("")))
    return df.withColumn(column, F.when(matched, F.concat(*parts)).otherwise(value))


def aggregate(df: DataFrame, groups: list[str], keep: list[str] = (), order: str | None = None, count_column: str = "count") -> DataFrame:
    """Rows per group, with the value of each kept column in the group's first
    row by `order` (its null, if it is null)."""
    _require(df, [*groups, *keep])
    if count_column in groups or count_column in keep:
        raise ValueError(f"{count_column} is a column already")
    if keep and order is None:
        raise ValueError("kept columns need an order")
    first = [F.min_by(col(c), col(order)).alias(c) for c in keep]
    return df.groupBy(*[col(c) for c in groups]).agg(F.count("*").alias(count_column), *first)


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    return select(df, columns).distinct()


def sort(df: DataFrame, columns: list[str], reverse: bool = False) -> DataFrame:
    """Nulls last, or first when reversed."""
    _require(df, columns)
    return df.orderBy(*[col(c).desc_nulls_first() if reverse else col(c).asc_nulls_last() for c in columns])


def join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str] | None = None, how: str = "left", left_select: list[str] | None = None, right_select: list[str] | None = None, left_prefix: str = "", right_prefix: str = "") -> DataFrame:
    """Left or outer equi-join. Keys keep their left names; other columns may
    be selected and prefixed; a name that occurs twice gets _1, _2 ... Null
    keys match nothing (an outer join keeps their rows)."""
    right_keys = right_keys or left_keys
    if how not in ("left", "outer") or len(left_keys) != len(right_keys):
        raise ValueError("how must be left or outer, with as many keys on both sides")
    _require(left, [*left_keys, *(left_select or [])])
    _require(right, [*right_keys, *(right_select or [])])
    rest = lambda df, keys, chosen: [c for c in (chosen if chosen is not None else df.columns) if c not in keys]
    lc, rc = rest(left, left_keys, left_select), rest(right, right_keys, right_select)
    l = left.select(*[col(k).alias(f"_lk{i}") for i, k in enumerate(left_keys)], *[col(c).alias(f"_l{i}") for i, c in enumerate(lc)])
    r = right.select(*[col(k).alias(f"_rk{i}") for i, k in enumerate(right_keys)], *[col(c).alias(f"_r{i}") for i, c in enumerate(rc)])
    on = reduce(lambda a, b: a & b, [F.col(f"_lk{i}") == F.col(f"_rk{i}") for i in range(len(left_keys))])
    joined = l.join(r, on, "full_outer" if how == "outer" else "left")
    pick = lambda p: f"{p}_" if p else ""
    names = [*left_keys, *[pick(left_prefix) + c for c in lc], *[pick(right_prefix) + c for c in rc]]
    final: list[str] = []
    for n in names:
        unique_, i = n, 0
        while unique_ in final:
            i += 1
            unique_ = f"{n}_{i}"
        final.append(unique_)
    values = [F.coalesce(f"_lk{i}", f"_rk{i}") for i in range(len(left_keys))] + [F.col(f"_l{i}") for i in range(len(lc))] + [F.col(f"_r{i}") for i in range(len(rc))]
    return joined.select(*[v.alias(n) for v, n in zip(values, final)])


def collect(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of equal columns in one, with the name of each as `file`."""
    first = next(iter(tables.values())).columns
    for name, df in tables.items():
        if df.columns != first:
            raise ValueError(f"{name} has other columns: {df.columns}")
    return reduce(DataFrame.unionByName, [df.withColumn("file", F.lit(n)) for n, df in tables.items()])


def exclude(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose value neither contains nor is part of a known one. Both
    directions are dictionary joins over distinct values; null values stay, an
    empty one is part of every known value."""
    k = known.select(col(known_column).alias("_known")).where("_known IS NOT NULL").distinct()
    values = df.select(col(column).alias("_v")).where("_v IS NOT NULL").distinct()
    hit = contains(values, "_v", k.where("_known <> ''"), "_known").select("_v").unionByName(contains(k, "_known", values.where("_v <> ''"), "_v").select("_v"))
    if not k.isEmpty():
        hit = hit.unionByName(values.where("_v = ''"))
    if not k.where("_known = ''").isEmpty():  # part of every value
        hit = values
    return df.join(hit.distinct(), col(column) == F.col("_v"), "left_anti")
