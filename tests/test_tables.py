import math

import pytest
from pyspark.sql import functions as F

from seqloom.functions.exprs import cigar_leading_skip, cigar_span, fdiv, gene_type, hamming, reverse_complement, sequence_hash, slice1, unique_name
from seqloom.operators import filters, keysets, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_joins(spark):
    l = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, val int")
    r = spark.createDataFrame([("b", 10), ("c", 20), ("d", 30)], "key string, score int")
    assert rows(tables.join(l, r, ["key"], how="outer")) == [("a", 1, None), ("b", 2, 10), ("c", 3, 20), ("d", None, 30)]
    assert rows(tables.join(l, r, ["key"])) == [("a", 1, None), ("b", 2, 10), ("c", 3, 20)]
    twice = tables.join(l, l, ["key"])
    assert twice.columns == ["key", "val", "val_1"]
    null = spark.createDataFrame([(None, 5)], "key string, val int")
    assert rows(tables.join(null, null, ["key"])) == [(None, 5, None)]


def test_filter_select_sort(spark):
    df = spark.createDataFrame([("alpha", 10.0), ("beta", 5.0), ("gamma", float("nan")), (None, None)], "name string, val double")
    assert [r[0] for r in tables.filter_rows(df, "name", pattern="^al").collect()] == ["alpha"]
    assert [r[0] for r in tables.filter_rows(df, "val", compare=">=", threshold=10).collect()] == ["alpha"]
    assert [r[0] for r in tables.sort(df, ["name"]).collect()] == ["alpha", "beta", "gamma", None]
    assert [r[0] for r in tables.sort(df, ["name"], True).collect()] == [None, "gamma", "beta", "alpha"]
    for bad in ({"column": "no", "pattern": "x"}, {"column": "val"}, {"column": "val", "pattern": "x", "compare": "<"}, {"column": "val", "compare": "<"}):
        with pytest.raises(ValueError):
            tables.filter_rows(df, **bad)
    with pytest.raises(Exception, match="no number"):
        tables.filter_rows(df, "name", compare=">", threshold=1).collect()


def test_transform_aggregate_exclude(spark):
    df = spark.createDataFrame([("ABC_123",), ("DEF_456",), ("x",), (None,)], "id string")
    out = tables.transform(df, "id", "(.*)_(.*)", r"\1-\2", "new")
    assert rows(out) == sorted([("ABC-123", "ABC123"), ("DEF-456", "DEF456"), ("x", ""), (None, None)], key=str)
    g = spark.createDataFrame([("V", "A", 2, "y"), ("V", "A", 1, None), ("D", "B", 3, "z")], "gene string, case string, o int, k string")
    assert rows(tables.aggregate(g, ["gene", "case"], ["k"], "o")) == [("D", "B", 1, "z"), ("V", "A", 2, None)]
    known = spark.createDataFrame([("ATCG",)], "seq string")
    s = spark.createDataFrame([("A*01", "ATCG"), ("B*01", "GCTA"), ("C*01", "TATCGT"), ("D*01", "TC")], "name string, seq string")
    assert rows(tables.exclude(s, "seq", known, "seq")) == [("B*01", "GCTA")]


def test_filters(spark):
    df = spark.createDataFrame([(10, 1.0), (5, 0.5), (2, 0.2), (8, float("nan")), (1, float("inf"))], "count int, ratio double")
    chain = [filters.min_threshold("count", 2), filters.min_threshold("ratio", 0.3)]
    assert filters.apply(df, chain).count() == 2
    assert [(r.total, r.kept) for r in filters.account(df, chain).collect()] == [(5, 4), (4, 2)]
    assert filters.apply(df, [filters.min_threshold("ratio", 0.05)]).count() == 4


def test_keysets(spark):
    a = keysets.keyed(spark.createDataFrame([("k1", "v1"), ("k2", "v2"), ("k2", "v9"), (None, "v")], "s string, n string"), "s", "n")
    b = keysets.keyed(spark.createDataFrame([("k2", "w2"), ("k3", "w3")], "s string, n string"), "s", "n")
    assert rows(keysets.union(a, b)) == [("k1", "v1"), ("k2", "v2"), ("k3", "w3")]
    assert rows(keysets.intersect(a, b)) == [("k2", "v2")]
    assert rows(keysets.difference(a, b)) == [("k1", "v1")]
    assert {r.op: r.n for r in keysets.diff({"a": a, "b": b}).collect()} == {"union": 3, "intersection": 1, "left_only": 1, "right_only": 1}
    m = spark.createDataFrame([("A*01", "AT", 1), ("Z*01", "AT", 2), ("B*01", "GC", 3)], "name string, seq string, o int")
    assert rows(keysets.merge(m, "name", "seq", "o", "first", "[*]")) == [("A01", "AT"), ("B01", "GC")]
    assert rows(keysets.merge(m, "name", "seq", "o", "last")) == [("B*01", "GC"), ("Z*01", "AT")]


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, sequence_hash(lit(s))) for s in ("ATCG", "GCTA", "ATCGATCG")] == ["S1663", "S3280", "S4727"]
    assert one(spark, unique_name(lit("IGHV1-2*02_S1234"), lit("ATCG"))) == "IGHV1-2*02_S1663"
    assert one(spark, cigar_span(lit("5M2D3I4M"))) == 11 and one(spark, cigar_leading_skip(lit("12N5M"))) == 12
    assert one(spark, reverse_complement(lit("AACGT"))) == "ACGTT" and one(spark, reverse_complement(lit("AXT"))) == "AXT"
    assert one(spark, hamming(lit("ACGT"), lit("ACCA"))) == 2 and one(spark, hamming(lit("A"), lit("AC"))) == -1
    assert one(spark, slice1(lit("ACGT"), lit(2), lit(3))) == "CG" and one(spark, slice1(lit("ACGT"), lit(3), lit(2))) == ""
    assert one(spark, fdiv(lit(1), lit(0))) == math.inf and math.isnan(one(spark, fdiv(lit(0), lit(0))))
    assert one(spark, gene_type(lit("IGHD1"))) == "D"
