"""Alleles across donors: co-occurrence statistics, clusters, haplotypes."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fdiv, gene_type
from ..functions.gram import gram
from ..workdir import materialize


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) by Stirling's series, shifted to 16 and above."""
    x = np.asarray(n, np.float64) + 1
    shift, low = np.zeros_like(x), x < 16
    while low.any():
        shift[low] -= np.log(x[low])
        x = np.where(low, x + 1, x)
        low = x < 16
    inverse = 1 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def upper_tail(k: np.ndarray, successes: np.ndarray, failures: np.ndarray, draws: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """P(X >= k) of hypergeometric variables, row by row; terms are summed in
    blocks of about `block`."""
    k, successes, failures, draws = (np.asarray(x, np.int64) for x in (k, successes, failures, draws))
    lo, hi = np.maximum(np.maximum(k, draws - failures), 0), np.minimum(successes, draws)
    terms = np.maximum(hi - lo + 1, 0)
    choose = lambda n, r: _log_factorial(n) - _log_factorial(r) - _log_factorial(n - r)
    whole = choose(successes + failures, np.minimum(draws, successes + failures))
    out = np.zeros(len(k))
    ends = np.cumsum(terms)
    begin = 0
    while begin < len(k):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + block, side="right")))
        at = np.repeat(np.arange(begin, stop), terms[begin:stop])
        first = np.repeat(np.cumsum(terms[begin:stop]) - terms[begin:stop], terms[begin:stop])
        i = lo[at] + np.arange(len(at)) - first
        log_p = choose(successes[at], i) + choose(failures[at], draws[at] - i) - whole[at]
        out[begin:stop] = np.bincount(at - begin, np.exp(log_p), minlength=stop - begin)
        begin = stop
    return np.minimum(out, 1.0)


def edges(calls: DataFrame, donor: str, alleles: str | list[str], min_donors: int = 1, min_support: int = 1, min_jaccard: float = 0.0, corrected: bool = False) -> DataFrame:
    """(allele_a, allele_b, n_a, n_b, n_shared, jaccard, rho, p_enrich,
    q_enrich) of allele pairs that share donors, allele_a < allele_b.

    `alleles` names the columns of a row's alleles (trimmed; null and empty ones
    are none). Alleles with fewer than `min_donors` rows are left out first, and
    those in fewer than `min_support` donors can be in no pair. Pair counts are
    sums of Gram products over donor blocks, so a donor with very many
    alleles is no list of pairs. The tail's population is N successes and n_a
    failures (`corrected`: n_a and N - n_a). q is Benjamini-Hochberg over the
    pairs that pass."""
    listed = F.array(*[F.trim(F.col(f"`{c}`")) for c in ([alleles] if isinstance(alleles, str) else alleles)])
    rows = calls.select(F.col(f"`{donor}`").alias("donor"), F.explode(listed).alias("allele")).where("donor IS NOT NULL AND allele <> ''")
    kept = rows.groupBy("allele").agg(F.count("*").alias("c")).where(F.col("c") >= min_donors).select("allele")
    sets = materialize(rows.join(kept, "allele", "left_semi").distinct(), "sets")
    n = sets.agg(F.count_distinct("donor")).first()[0]
    counts = materialize(sets.groupBy("allele").agg(F.count("*").alias("n_allele")).where(F.col("n_allele") >= min_support), "alleles")
    block = 1 << 12
    # dense numbers without a global sort: rank within a hash block, block by block
    sized = counts.withColumn("_b", F.pmod(F.xxhash64("allele"), F.lit(64)))
    sizes = {r["_b"]: r["count"] for r in sized.groupBy("_b").count().collect()}
    starts, at = {}, 0
    for b in sorted(sizes):
        starts[b], at = at, at + sizes[b]
    n_items = at
    if not n_items:
        starts = {0: 0}
    first = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in (int(kv[0]), int(kv[1]))]), F.col("_b").cast("int"))
    items = materialize(sized.withColumn("pos", (first + F.row_number().over(Window.partitionBy("_b").orderBy("allele")) - 1).cast("int")).select("allele", "n_allele", "pos"), "numbered")

    def products(part: pa.Table) -> pa.Table:
        d = part["donor"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out = list(gram(d.astype(np.int64), part["pos"].to_numpy().astype(np.int64), n_items))
        a, b, c = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "n": pa.array(c, pa.int64())})

    blocks = max(1, n // block)
    placed = sets.join(items, "allele").select("donor", "pos", F.pmod(F.xxhash64("donor"), F.lit(blocks)).alias("block"))
    shared = placed.groupBy("block").applyInArrow(products, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n_shared"))
    side = lambda x: items.select(F.col("pos").alias(x), F.col("allele").alias(f"_{x}"), F.col("n_allele").alias(f"_n{x}"))
    pairs = shared.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("_a") > F.col("_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(pick("_a", "_b").alias("allele_a"), pick("_b", "_a").alias("allele_b"), pick("_na", "_nb").alias("n_a"), pick("_nb", "_na").alias("n_b"), "n_shared")
    d = lambda c: F.col(c).cast("double")
    spread = d("n_a") * (n - d("n_a")) * d("n_b") * (n - d("n_b"))
    pairs = pairs.withColumn("jaccard", d("n_shared") / (d("n_a") + d("n_b") - d("n_shared"))).withColumn("rho", F.when(spread <= 0, F.lit(0.0)).otherwise(fdiv(n * d("n_shared") - d("n_a") * d("n_b"), F.sqrt(spread))))
    pairs = pairs.where((F.col("n_shared") >= min_support) & (F.col("jaccard") >= min_jaccard))

    @F.pandas_udf("double")
    def tail(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        every = np.full(len(k), n)
        return pd.Series(upper_tail(k, a if corrected else every, n - a if corrected else a, b), dtype="float64")

    pairs = materialize(pairs, "pairs")
    counted = materialize(pairs.select("n_shared", "n_a", "n_b").distinct().withColumn("p_enrich", tail("n_shared", "n_a", "n_b")), "tails")
    return bh(pairs.join(counted, ["n_shared", "n_a", "n_b"]).select(*pairs.columns, "p_enrich"), "p_enrich", "q_enrich")


def bh(df: DataFrame, p: str, q: str) -> DataFrame:
    """Benjamini-Hochberg: q = min over larger p of p * m / rank, at most 1.
    Distinct p values with their counts are range-partitioned; each block runs
    its own sums, and only the blocks' totals (one row a block) meet in one
    place. Null p has null q."""
    values = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_c"))
    blocks = materialize(values.repartitionByRange(p).withColumn("_b", F.spark_partition_id()), "pvalues")
    sizes = {r["_b"]: r["n"] for r in blocks.groupBy("_b").agg(F.sum("_c").alias("n")).collect()}
    before, m = {}, 0
    for b in sorted(sizes):
        before[b], m = m, m + sizes[b]
    upto = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum("_c").over(upto) + _by_block(before)
    ranked = materialize(blocks.select(p, "_b", (F.col(p) * F.lit(m) / rank).alias("_q")), "ranked")
    lows = {r["_b"]: r["q"] for r in ranked.groupBy("_b").agg(F.min("_q").alias("q")).collect()}
    after, least = {}, 1.0
    for b in sorted(lows, reverse=True):
        after[b], least = least, min(least, lows[b])
    rest = Window.partitionBy("_b").orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    adjusted = ranked.select(p, F.least(F.min("_q").over(rest), _by_block(after)).alias(q))
    return df.join(adjusted, p, "left").select(*df.columns, q)


def _by_block(values: dict) -> Column:
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("_b"))


def components(links: DataFrame, a: str, b: str, min_size: int = 1) -> DataFrame:
    """(group_id, allele) of connected components, group_id the smallest
    member. Labels fall to the smallest neighbour's, and jump to their label's
    label, so rounds grow with the logarithm of a component's width; each round
    is cut by a written table."""
    both = materialize(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "links")
    labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("_n")), "y").groupBy("x").agg(F.min("_n").alias("_n"))
        low = labels.join(seen, "x").select("x", F.least("label", "_n").alias("_l"), F.col("label").alias("_old"))
        jumped = low.join(labels.select(F.col("x").alias("_l"), F.col("label").alias("_j")), "_l", "left").select("x", F.least("_l", "_j").alias("label"), "_old")
        nxt = materialize(jumped, "labels")
        labels = nxt.select("x", "label")
        if nxt.where("label <> _old").isEmpty():
            break
    big = labels.groupBy("label").count().where(F.col("count") >= min_size).select("label")
    return labels.join(big, "label", "left_semi").select(F.col("label").alias("group_id"), F.col("x").alias("allele"))


# The parts of a recombination signal that extend a sequence, before and after it, by gene type
_PRE = {"J": ("nonamer", "spacer", "heptamer"), "D": ("pre_nonamer", "pre_spacer", "pre_heptamer")}
_POST = {"V": ("heptamer", "spacer", "nonamer"), "D": ("post_heptamer", "post_spacer", "post_nonamer")}


def extended_sequence(columns: list[str], gene: Column, sequence: Column) -> Column:
    """The sequence between its flanks: prefix and suffix where `columns` has
    them, else the parts of the signal that belong to the gene's type. Missing
    parts are empty; a gene of no type has no flanks."""
    part = lambda names: F.concat(F.lit(""), *[F.coalesce(F.col(c), F.lit("")) for c in names if c in columns])

    def side(plain: str, signals: dict[str, tuple[str, ...]]) -> Column:
        if plain in columns:
            return F.coalesce(F.col(plain), F.lit(""))
        return reduce(lambda rest, kind: F.when(gene_type(gene) == kind, part(signals[kind])).otherwise(rest), signals, F.lit(""))

    known = gene_type(gene).isNotNull()
    return F.concat(F.when(known, side("prefix", _PRE)).otherwise(""), F.coalesce(sequence, F.lit("")), F.when(known, side("suffix", _POST)).otherwise(""))


def haplotype_input(found: DataFrame) -> DataFrame:
    """(case, gene, db_name, sequence, count) of an exact search's result: its
    extended sequences, and full_count where there is one."""
    count = "full_count" if "full_count" in found.columns else "count"
    return found.select("case", "gene", "db_name", extended_sequence(found.columns, F.col("gene"), F.col("sequence")).alias("sequence"), F.col(count).alias("count"))


def novel_flags(calls: DataFrame, novel: DataFrame) -> DataFrame:
    """`calls` with novel_1 and novel_2: whether the alleles, without the rank
    after their last underscore, are among `novel` (name)."""
    for i in (1, 2):
        names = novel.select(F.col("name").alias("_novel")).where("_novel IS NOT NULL").distinct().withColumn(f"novel_{i}", F.lit(True))
        base = F.regexp_replace(f"allele_{i}", r"_\d+$", "")
        calls = calls.join(names, base == F.col("_novel"), "left").drop("_novel").withColumn(f"novel_{i}", F.coalesce(f"novel_{i}", F.lit(False)))
    return calls


def genotype_summary(calls: DataFrame) -> DataFrame:
    """(genotype, n, percent) of all calls, percent to one digit."""
    counts = calls.groupBy("genotype").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.join(F.broadcast(whole), F.lit(True)).select("genotype", "n", F.bround(F.lit(100.0) * F.col("n") / F.col("_all"), 1).alias("percent"))


def haplotypes(counts: DataFrame, min_count: int = 5, min_ratio: float = 0.1) -> DataFrame:
    """Diploid calls per (case, gene) from (case, gene, db_name, sequence,
    count). Sequences of an allele are numbered over the cohort by total count
    (then sequence): label = name_number. One allele at `min_ratio` of the top
    or more is homozygous, two heterozygous, more a duplication; count_2, freq_2
    and ratio always describe the runner-up. Ties go to the smaller label."""
    rows = counts.where(F.col("count") >= min_count).groupBy("case", "gene", "db_name", "sequence").agg(F.sum("count").alias("count"))
    total = rows.groupBy("db_name", "sequence").agg(F.sum("count").alias("t"))
    label = F.concat("db_name", F.lit("_"), F.row_number().over(Window.partitionBy("db_name").orderBy(F.desc("t"), "sequence")))
    rows = rows.join(total.select("db_name", "sequence", label.alias("label")), ["db_name", "sequence"])
    group = Window.partitionBy("case", "gene")
    ranked = rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("count"), "label"))).withColumn("share", F.col("count") / F.max("count").over(group))
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    strong = F.col("share") >= min_ratio
    others = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "label")))), lambda x: x["label"]), ",")
    calls = ranked.groupBy("case", "gene").agg(
        F.count_if(strong).alias("n"), at("label", 1).alias("allele_1"), at("label", 2).alias("_2"), at("count", 1).alias("count_1"), F.coalesce(at("count", 2), F.lit(0)).alias("count_2"),
        F.sum("count").alias("total_count"), others(F.col("rank") >= 3).alias("_all"), others((F.col("rank") >= 3) & strong).alias("_strong"),
    )
    genotype = F.when(F.col("n") <= 1, "homozygous").when(F.col("n") == 2, "heterozygous").otherwise("duplication")
    share = lambda x, y: F.bround(F.col(x) / F.col(y), 3)
    return calls.select(
        "case", "gene", genotype.alias("genotype"), "allele_1", F.when(F.col("n") >= 2, F.col("_2")).otherwise("").alias("allele_2"), "count_1", "count_2",
        share("count_1", "total_count").alias("freq_1"), share("count_2", "total_count").alias("freq_2"), share("count_2", "count_1").alias("ratio"), "total_count",
        F.when(F.col("n") > 2, F.col("_strong")).otherwise(F.col("_all")).alias("other_alleles"),
    )
