"""Hidden semi-Markov scan of reads for D genes between their signals.

The layout is nonamer, spacer, heptamer, gene, heptamer, spacer, nonamer. The
six fixed parts are scored by position weights, the gene by its base
composition and a distribution of lengths. Every start and gene length is
scored at once: fixed parts as sums of shifted columns, genes as differences of
a running sum.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import gene_of, unique_name
from ..operators import filters
from .exact import nearest

# The parts around the gene and their lengths
BEFORE = (("pre_nonamer", 9), ("pre_spacer", 12), ("pre_heptamer", 7))
AFTER = (("post_heptamer", 7), ("post_spacer", 12), ("post_nonamer", 9))
LEFT = sum(n for _, n in BEFORE)
RIGHT = sum(n for _, n in AFTER)
PSEUDOCOUNT, LENGTH_PSEUDOCOUNT = 0.01, 0.1


@dataclass(frozen=True)
class Model:
    before: np.ndarray  # LEFT x 4 log probabilities
    after: np.ndarray  # RIGHT x 4
    base: np.ndarray  # 4
    shortest: int
    length: np.ndarray  # log probability of each length from `shortest` on


def train(parts: DataFrame, gene: str = "sequence", shortest: int = 0, longest: int = 0, normal: tuple[float, float] | None = None) -> Model:
    """From rows with the six flank columns and the gene. Rows whose flanks are
    cut short, or with a null part, are left out; only counts by position, base
    and length reach the driver. At least one whole row is needed. Gene lengths
    go from `shortest` to `longest` (0: as seen) with their observed shares, or
    as a normal distribution of the given mean and deviation."""
    whole = [F.length(c) == n for c, n in (*BEFORE, *AFTER)]
    rows = parts.where(f"{gene} <> ''")
    for w in whole:
        rows = rows.where(w)
    sides = F.concat(*[c for c, _ in BEFORE]), F.concat(*[c for c, _ in AFTER])
    letters = lambda side, c: rows.select(F.lit(side).alias("side"), F.posexplode(F.split(F.upper(c), "")).alias("pos", "base"))
    counts = letters(0, sides[0]).unionByName(letters(1, sides[1])).unionByName(letters(2, F.col(gene)).withColumn("pos", F.lit(0))).where(F.col("base").isin(*"ACGT")).groupBy("side", "pos", "base").count().collect()
    tables = [np.full((LEFT, 4), PSEUDOCOUNT), np.full((RIGHT, 4), PSEUDOCOUNT), np.full((1, 4), PSEUDOCOUNT)]
    for r in counts:
        tables[r["side"]][r["pos"], "ACGT".index(r["base"])] += r["count"]
    logs = [np.log(t / t.sum(axis=1, keepdims=True)) for t in tables]
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.length(gene).alias("n")).count().collect()}
    if not lengths:
        raise ValueError("no row has all parts at full length")
    lo, hi = shortest or min(lengths), longest or max(lengths)
    return Model(logs[0], logs[1], logs[2][0], lo, empirical_lengths(lengths, lo, hi) if normal is None else normal_lengths(lo, hi, *normal))


def empirical_lengths(counts: dict[int, int], lo: int, hi: int) -> np.ndarray:
    """Log probability of each length from lo to hi, with the pseudocount."""
    seen = np.array([counts.get(n, 0) for n in range(lo, hi + 1)], float) + LENGTH_PSEUDOCOUNT
    return np.log(seen / seen.sum())


def normal_lengths(lo: int, hi: int, mean: float, deviation: float) -> np.ndarray:
    """The same from a normal distribution cut to lo..hi."""
    if not (0 < deviation < math.inf and lo <= hi):
        raise ValueError("the deviation must be positive, and lo at most hi")
    below = lambda x: 0.5 * (1 + math.erf((min(max(x, lo), hi) - mean) / (deviation * math.sqrt(2))))
    whole = max(below(hi) - below(lo), sys.float_info.min)
    p = np.array([max((below(n + 0.5) - below(n - 0.5)) / whole, sys.float_info.epsilon) for n in range(lo, hi + 1)])
    return np.log(p / p.sum())


_INDEX = np.full(128, 4, np.int64)
_INDEX[[ord(c) for c in "ACGT"]] = range(4)


def scan(model: Model, read: str) -> tuple[int, int, float] | None:
    """(start of the gene, 0-based; its length; posterior) of the best layout,
    the earliest start and shortest gene among equals; None if none fits."""
    hit = scan_path(model, read)
    return hit and (hit[0], hit[1], float(np.exp(hit[2] - hit[3])))


def scan_path(model: Model, read: str) -> tuple[int, int, float, float] | None:
    """(start, length, log probability of the best layout, of all layouts)."""
    codes = _INDEX[np.minimum(np.frombuffer(read.encode("utf-32-le"), np.uint32), 127)] if read else np.empty(0, np.int64)
    n, sizes = len(codes), len(model.length)
    starts = n - LEFT - model.shortest - RIGHT + 1
    if starts <= 0:
        return None
    bad = np.full((max(LEFT, RIGHT), 1), -np.inf)
    slide = lambda w: sum(np.hstack([w, bad[: len(w)]])[i][codes[i : n - len(w) + 1 + i]] for i in range(len(w)))
    left, right = slide(model.before), slide(model.after)
    unknown = np.concatenate(([0], np.cumsum(codes == 4)))
    running = np.concatenate(([0.0], np.cumsum(np.append(model.base, 0.0)[codes])))
    s = np.arange(starts)[:, None]
    begin = s + LEFT
    end = begin + model.shortest + np.arange(sizes)[None, :]
    fits = end + RIGHT <= n
    at = np.where(fits, end, begin)
    score = left[s] + running[at] - running[begin] + model.length[None, :] + right[np.minimum(at, n - RIGHT)]
    score = np.where(fits & (unknown[at] == unknown[begin]), score, -np.inf)
    best = int(score.argmax())
    top = score.flat[best]
    if not np.isfinite(top):
        return None
    total = top + np.log(np.exp(score - top).sum())
    return int(best // sizes + LEFT), int(model.shortest + best % sizes), float(top), float(total)


def _part_score(weights: np.ndarray, part: str) -> float:
    """Log probability of a part; -inf with a letter besides A, C, G and T."""
    codes = ["ACGT".find(c) for c in part]
    return float(sum(weights[i, c] for i, c in enumerate(codes))) if min(codes) >= 0 else -math.inf


_PARTS = [*(n for n, _ in BEFORE), *(n for n, _ in AFTER)]
_SCANNED = "sequence string, d_start long, d_sequence string, posterior double, " + ", ".join(f"{n} string" for n in _PARTS) + ", heptamer_logp_pre double, heptamer_logp_post double, log_path_prob double, log_total_prob double"


def scan_reads(model: Model, reads: DataFrame, sequence: str = "genomic_sequence", min_posterior: float = 0.0) -> DataFrame:
    """(sequence, d_start, d_sequence, posterior, the six parts around the gene,
    log probabilities of both heptamers, of the layout and of all layouts) of
    each distinct non-empty read with a layout; d_start counts from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for read in batch.column(0).to_pylist():
                hit = scan_path(model, read.upper())
                posterior = math.exp(hit[2] - hit[3]) if hit else 0.0
                if hit and posterior >= min_posterior:
                    start, n, top, total = hit
                    parts, at = [], start - LEFT
                    for _, size in BEFORE:
                        parts.append(read[at : at + size])
                        at += size
                    at = start + n
                    for _, size in AFTER:
                        parts.append(read[at : at + size])
                        at += size
                    heptamers = _part_score(model.before[LEFT - 7 :], parts[2].upper()), _part_score(model.after[:7], parts[3].upper())
                    rows.append((read, start + 1, read[start : start + n], posterior, *parts, *heptamers, top, total))
            columns = list(zip(*rows)) or [()] * (8 + len(_PARTS))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), *[pa.string()] * 6, *[pa.float64()] * 4]
            names = ["sequence", "d_start", "d_sequence", "posterior", *_PARTS, "heptamer_logp_pre", "heptamer_logp_post", "log_path_prob", "log_total_prob"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    distinct = reads.select(F.col(sequence).alias("sequence")).where("sequence <> ''").distinct()
    return distinct.mapInArrow(run, _SCANNED)


def training_rows(known: DataFrame, min_ratio: float = 0.2, top: int = 2) -> DataFrame:
    """(case, gene, db_name, sequence, case_count, case_ratio, the six parts):
    the alleles of an exact search (`known`) to train on. Counts add up per
    case; alleles under `min_ratio` of the gene's largest are left out, then the
    `top` distinct sequences by count stay (ties by sequence), with every
    distinct set of parts they were seen with. Rows with a null part are left out."""
    by = ["case", "gene"]
    sums = known.groupBy(*by, "sequence", "db_name").agg(F.sum("count").alias("case_count"))
    sums = sums.withColumn("case_ratio", F.col("case_count") / F.max("case_count").over(Window.partitionBy(*by))).where(F.col("case_ratio") >= min_ratio)
    best = sums.withColumn("_best", F.max("case_count").over(Window.partitionBy(*by, "sequence")))
    ranked = best.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("_best"), "sequence"))).where(F.col("_rank") <= top)
    parts = known.select("db_name", "sequence", *_PARTS).distinct()
    return ranked.drop("_best", "_rank").join(parts, ["db_name", "sequence"]).na.drop(subset=_PARTS).select(*by, "db_name", "sequence", "case_count", "case_ratio", *_PARTS)


def annotated(segments: DataFrame, alleles: DataFrame, column: str = "d_sequence") -> DataFrame:
    """`segments` with isin_db, db_name (the last allele by name with this
    sequence, else "Novel"), nearest_db and nearest_db_dist."""
    known = alleles.where("seq IS NOT NULL").groupBy(F.col("seq").alias("_seq")).agg(F.max("name").alias("db_name"))
    near = nearest(segments, column, alleles).select(F.col("value").alias("_value"), F.col("nearest").alias("nearest_db"), F.col("distance").alias("nearest_db_dist"))
    joined = segments.join(known, F.col(column) == F.col("_seq"), "left").withColumn("isin_db", F.col("_seq").isNotNull()).drop("_seq")
    joined = joined.withColumn("db_name", F.coalesce("db_name", F.lit("Novel")))
    return joined.join(near, F.col(column) == F.col("_value"), "left").drop("_value")


def collapsed(rows: DataFrame, order: str, first: list[str], column: str = "d_sequence") -> DataFrame:
    """One row per (well, case, sequence) of `annotated` reads: their count, the
    values in `first` of the first by `order`, isin_db if any has it, the least
    distance; named by the allele if it is known, else by the nearest allele's
    name and a hash; with gene and ratio to the gene's largest count."""
    kept = F.min_by(F.struct(*first, "db_name", "nearest_db"), F.struct(order, *first)).alias("_f")
    groups = rows.groupBy("well", "case", F.col(column).alias("sequence")).agg(F.count("*").alias("count"), kept, F.bool_or("isin_db").alias("isin_db"), F.min("nearest_db_dist").alias("nearest_db_dist"))
    out = groups.select("well", "case", "sequence", "count", "_f.*", "isin_db", "nearest_db_dist")
    base = F.coalesce("nearest_db", "db_name")
    out = out.withColumn("allele_name", F.when((F.col("nearest_db_dist") == 0) | F.col("isin_db"), base).otherwise(unique_name(base, "sequence")))
    out = out.withColumn("gene", F.coalesce(gene_of("nearest_db"), F.lit("")))
    return out.withColumn("ratio", F.col("count") / F.max("count").over(Window.partitionBy("well", "case", "gene")))


def discovered(reads: DataFrame, alleles: DataFrame, model: Model, min_posterior: float = 0.7, min_count: int = 10, min_ratio: float = 0.2, min_pre: float = 0.0, min_post: float = 0.0) -> DataFrame:
    """D alleles in `reads` (well, case, genomic_sequence): scanned, annotated,
    collapsed and filtered, with the probabilities of both heptamers."""
    found = scan_reads(model, reads, min_posterior=min_posterior)
    own = reads.select("well", "case", F.col("genomic_sequence").alias("sequence")).where("sequence <> ''")
    rows = own.join(annotated(found, alleles), "sequence").withColumnRenamed("sequence", "_read")
    scores = ["posterior", *_PARTS, "heptamer_logp_pre", "heptamer_logp_post", "log_path_prob", "log_total_prob"]
    out = collapsed(rows, "_read", scores)
    chance = lambda c: F.when(F.col(c) > -math.inf, F.exp(c)).otherwise(F.lit(0.0))
    out = out.withColumn("heptamer_prob_pre", chance("heptamer_logp_pre")).withColumn("heptamer_prob_post", chance("heptamer_logp_post"))
    criteria = [filters.min_threshold("count", min_count), filters.min_threshold("ratio", min_ratio)]
    criteria += [filters.min_threshold(c, least) for c, least in (("heptamer_prob_pre", min_pre), ("heptamer_prob_post", min_post)) if least > 0]
    return filters.apply(out, criteria)
