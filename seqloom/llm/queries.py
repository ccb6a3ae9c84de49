"""The queries of this subpackage: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import table
from .item_pairs import baskets, item_pairs
from .leaks import leaked
from .mixing import SEED, draws, mixture, shares, thresholds
from .near_duplicates import Settings, near_duplicate_classes, near_duplicate_pairs
from .shared_spans import shared_lengths
from .term_counts import count_terms, mark_terms
from .top_items import top_items
from .truncation import truncated, truncation_rates, truncation_report

SEQUENCES = Settings(k=12, similarity=0.5, anchor_k=18)
HEADERS = Settings(k=4, similarity=0.5, anchor_k=8, sample=64, max_bucket=24)
#: table, key, value, settings
COMPARED = [("demultiplex", "name", "genomic_sequence", SEQUENCES), ("fasta", "name", "seq", SEQUENCES), ("blast", "sseqid", "sseqid", HEADERS)]


def _compared(spark: SparkSession, sf_dir: str, operator: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """The operator's results for all tables."""
    return reduce(DataFrame.unionByName, [operator(table(spark, sf_dir, t), *x).select(F.lit(t).alias("tbl"), *columns) for t, *x in COMPARED])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, near_duplicate_pairs, "key_a", "key_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, near_duplicate_classes, "key", "class_id", "copies", "links")


def _allele_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = baskets(table(spark, sf_dir, "haplotype"), "case", ["allele_1", "allele_2"])
    gene = lambda c: F.split_part(F.col(c), F.lit("*"), F.lit(1))
    return item_pairs(sets, min_count=5, min_share=0.01, min_lift=3.0, across=gene("item_a") != gene("item_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allele_pairs(spark, sf_dir).select(F.col("item_a").alias("allele_a"), F.col("item_b").alias("allele_b"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allele_pairs(spark, sf_dir).withColumnsRenamed({"item_a": "allele_a", "item_b": "allele_b"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(table(spark, sf_dir, "haplotype"), "case", "gene", "count_1", 3).select(F.col("group_key").alias("case_name"), F.col("item").alias("gene"))


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(table(spark, sf_dir, "haplotype"), "case", "gene", "count_1", 3).select(F.col("group_key").alias("case_name"), F.col("item").alias("gene"), "score", F.col("rank").cast("long").alias("rank"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t, v: table(spark, sf_dir, t).select(F.col("name").alias("rec_key"), F.col(v).alias("text"))
    return shared_lengths({"demultiplex": side("demultiplex", "genomic_sequence"), "fasta": side("fasta", "seq")}, 150)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select("tbl", "rec_key")


def p5_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select("tbl", "rec_key", "shared_length", "n_chars")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "heptamer").distinct()
    term = lambda c: F.upper(F.trim(F.col(c)))
    return mark_terms(count_terms(rows, {"sequence": term("sequence"), "heptamer": term("heptamer")}, F.col("count")), 0.05, 3, 20)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).where("mark <> 'kept'").select(F.col("field").alias("field_name"), "term", "mark")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select(F.col("field").alias("field_name"), "term", "records", "total", "mark")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each affected post with the items that leaked into it."""
    items = F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",")
    return p7_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), items.alias("items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies that Poisson draws of mean 1.3, cut at a source's
    max_repeats, give every post of a target source (0 included)."""
    known = table(spark, sf_dir, "mix_targets").select(F.trim("source").alias("source"), "max_repeats").distinct()
    cuts = [(r["source"], thresholds(1.3, int(r["max_repeats"]))) for r in known.collect()]  # one row a source
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("_key"))
    named = docs.join(F.broadcast(known.select("source", F.lower("source").alias("_key"))), "_key")
    return draws(named.select("doc_id", "source"), cuts, SEED).withColumn("copies", F.col("copies").cast("long"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(table(spark, sf_dir, "documents"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_pairs, p3_found, p3_top, p5_found, p5_lengths, p6_found, p6_counts, p7_found, p7_report, p8_mix, p8_shares, p8_draws, p9_found, p9_rates, p9_report)
}
