"""Complete results per case and per database allele, and the heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, per_key
from ..workdir import table

HEAVY_SHARE = 0.04


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case: rows, distinct reads and sequence lengths."""
    out = per_key(table(spark, sf_dir, "demultiplex"), "case", text="genomic_sequence", name="name")
    return out.select(F.col("key_value").alias("case_name"), "rows", "reads", "n_text", "sum_length", "min_length", "max_length")


def db_name_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per database allele: rows, sequence lengths and the total of count."""
    out = per_key(table(spark, sf_dir, "heptamer"), "db_name", text="sequence", count="count")
    return out.select("key_value", "rows", "n_text", "sum_length", "min_length", "max_length", "total")


def heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, key_value, rows, share) of the keys with at least
    `HEAVY_SHARE` of their table's rows."""
    parts = []
    for t, key in (("demultiplex", "case"), ("heptamer", "db_name")):
        found = heavy_keys(per_key(table(spark, sf_dir, t), key), HEAVY_SHARE)
        parts.append(found.select(F.lit(f"{t}.{key}").alias("field_name"), "key_value", "rows", "share"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy(spark, sf_dir).select("field_name", "key_value")


QUERIES = {"p4_found": p4_found, "p4_heavy": heavy, "p4_case": case_results, "p4_db_name": db_name_results}

_HEAVY = """WITH k AS (
  SELECT 'demultiplex.case' AS field_name, "case" AS key_value, count(*) AS rows FROM demultiplex WHERE "case" IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'heptamer.db_name', db_name, count(*) FROM heptamer WHERE db_name IS NOT NULL GROUP BY 2),
 s AS (SELECT *, sum(rows) OVER (PARTITION BY field_name) AS n FROM k)"""
SQL = {
    "p4_found": f"{_HEAVY} SELECT field_name, key_value FROM s WHERE rows >= 0.04 * n",
    "p4_heavy": f"{_HEAVY} SELECT field_name, key_value, rows, rows::DOUBLE / n AS share FROM s WHERE rows >= 0.04 * n",
    "p4_case": """SELECT "case" AS case_name, count(*) AS rows, count(DISTINCT name) AS reads, count(genomic_sequence) AS n_text,
      CAST(sum(length(genomic_sequence)) AS BIGINT) AS sum_length, min(length(genomic_sequence)) AS min_length, max(length(genomic_sequence)) AS max_length
      FROM demultiplex WHERE "case" IS NOT NULL GROUP BY 1""",
    "p4_db_name": """SELECT db_name AS key_value, count(*) AS rows, count(sequence) AS n_text, CAST(sum(length(sequence)) AS BIGINT) AS sum_length,
      min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, CAST(sum(coalesce("count", 0)) AS BIGINT) AS total
      FROM heptamer WHERE db_name IS NOT NULL GROUP BY 1""",
}
