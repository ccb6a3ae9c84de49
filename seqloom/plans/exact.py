"""Exact allele search in reads: matches, flanks, counts, ratios, frequencies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import at_least, fdiv, gene_of, slice1
from ..operators.dictionary import contains

# Recombination signal layout, as (name, first, last) offsets.
# 'before' counts back from the match's start, 'after' forward from its end.
_AFTER = {"V": [("heptamer", 1, 7), ("spacer", 8, 30), ("nonamer", 31, 39)], "D": [("post_heptamer", 1, 7), ("post_spacer", 8, 19), ("post_nonamer", 20, 28)]}
_BEFORE = {"J": [("nonamer", 39, 31), ("spacer", 30, 8), ("heptamer", 7, 1)], "D": [("pre_nonamer", 28, 20), ("pre_spacer", 19, 8), ("pre_heptamer", 7, 1)]}


def flanks(gene: str, read: Column, start: Column, end: Column, affix: int = 13, extension: int | Column | None = None) -> dict[str, Column]:
    """Flank columns of a match at start..end (1-based). With `extension`, a
    plain stretch of that length replaces the signal parts. Near the 5' end the
    clamped parts of J and D are the read's first character."""
    n = F.length(read)
    before = lambda size: slice1(read, F.greatest(F.lit(1), start - size), start - 1)
    after = lambda size: slice1(read, end + 1, F.least(end + size, n))
    if extension is not None:
        sizes = {"V": (affix, extension), "J": (extension, affix), "D": (extension, extension)}[gene]
        return {"prefix": before(sizes[0]), "suffix": after(sizes[1])}
    out: dict[str, Column] = {}
    if gene == "V":
        out["prefix"] = before(affix)
    for name, a, b in _BEFORE.get(gene, []):
        last = start - b if b == 1 else F.greatest(F.lit(1), start - b)
        out[name] = slice1(read, F.greatest(F.lit(1), start - a), last)
    for name, a, b in _AFTER.get(gene, []):
        out[name] = slice1(read, end + a, F.least(end + b, n))
    if gene == "J":
        out["suffix"] = after(affix)
    return out


def matches(reads: DataFrame, alleles: DataFrame, gene: str, affix: int = 13, extension: int | None = None, keep: tuple[str, ...] | None = None, border: int = 0, extensions: DataFrame | None = None) -> DataFrame:
    """One row per read and allele it contains: well, case, db_name, sequence
    and flanks (those named in `keep`, else all), with their lengths in
    extension mode.

    With `extension` and a `border` above 0, matches whose flank reaches the
    border are left out; `extensions` (gene, extension) gives the length per
    gene instead (`calibrated_extensions`), a gene not in it has none."""
    pairs = contains(reads.select("well", "case", "genomic_sequence"), "genomic_sequence", alleles.select(F.col("name").alias("db_name"), F.col("seq").alias("sequence")), "sequence")
    read, start, end = F.col("genomic_sequence"), F.col("start"), F.col("start") + F.length("sequence") - 1
    size = extension
    if extension is not None and extensions is not None:
        own = extensions.select(F.col("gene").alias("_gene"), F.col("extension").cast("int").alias("_extension"))
        pairs = pairs.join(own, gene_of("db_name") == F.col("_gene"), "left").withColumn("_extension", F.coalesce("_extension", F.lit(0)))
        size = F.col("_extension")
    if extension is not None and border > 0:
        pairs = pairs.where(~near_border(gene, read, start, end, size, border, calibrated=extensions is not None))
    parts = flanks(gene, read, start, end, affix, size)
    if extension is not None:
        parts |= {f"{k}_len": F.length(v).cast("long") for k, v in parts.items()}
    return pairs.select("well", "case", "db_name", "sequence", *[c.alias(n) for n, c in parts.items() if keep is None or n in keep])


def reference_ratio(found: DataFrame, reference: str) -> DataFrame:
    """Adds `ref_ratio` and `ref_gene_ratio`: an allele's count, and its gene's
    in the case, to the largest count of an allele of `reference` in the same
    well and case (1 where there is none)."""
    case = Window.partitionBy("well", "case")
    ref = F.coalesce(F.max(F.when(F.col("db_name").startswith(reference), F.col("count"))).over(case), F.lit(1))
    genes = F.sum("count").over(Window.partitionBy("well", "case", "gene"))
    return found.withColumn("ref_gene_count", genes.cast("long")).withColumn("ref_ratio", fdiv(F.col("count"), ref)).withColumn("ref_gene_ratio", fdiv(F.col("ref_gene_count"), ref))


def resolve_subjects(hits: DataFrame, subject: str, alleles: DataFrame) -> DataFrame:
    """(subject, db_name) of each distinct subject: the allele of that name, else
    of the name without a trailing _S and digits; null if neither is known."""
    names = alleles.select(F.col("name").alias("db_name")).distinct()
    own = hits.select(F.col(subject).alias("subject")).where("subject IS NOT NULL").distinct()
    stripped = F.regexp_replace("subject", r"_S\d+$", "")
    exact_ = names.select(F.col("db_name").alias("_a"))
    rows = own.join(exact_, F.col("subject") == F.col("_a"), "left").join(names.withColumnRenamed("db_name", "_b"), stripped == F.col("_b"), "left")
    return rows.select("subject", F.coalesce("_a", "_b").alias("db_name"))


def near_border(gene: str, read: Column, start: Column, end: Column, extension: int | Column, border: int, calibrated: bool = False) -> Column:
    """Whether the flank of `extension` reaches the outer `border` characters of
    the read: at its end for V, at its start for J, either for D. A calibrated
    length counts even where the flank is empty."""
    n = F.length(read)
    right, left = F.least(end + extension, n), F.greatest(F.lit(1), start - extension)
    some = F.lit(calibrated)
    at_end = (some | (end + 1 <= right)) & (right >= F.greatest(F.lit(1), n - border + 1))
    at_start = (some | (left <= start - 1)) & (left <= F.least(F.lit(border), n))
    return {"V": at_end, "J": at_start, "D": at_end | at_start}[gene]


def border_statistics(reads: DataFrame, alleles: DataFrame, gene: str, extension: int, border: int) -> DataFrame:
    """(case, gene, matched_total, accepted_total, rejected_border,
    rejected_ratio) of the matches of each case and gene."""
    pairs = contains(reads.select("case", "genomic_sequence"), "genomic_sequence", alleles.select(F.col("name").alias("db_name"), F.col("seq").alias("sequence")), "sequence")
    rejected = near_border(gene, F.col("genomic_sequence"), F.col("start"), F.col("start") + F.length("sequence") - 1, extension, border)
    counts = pairs.select("case", gene_of("db_name").alias("gene"), rejected.alias("_r")).groupBy("case", "gene").agg(F.count("*").alias("matched_total"), F.count_if(~F.col("_r")).alias("accepted_total"), F.count_if("_r").alias("rejected_border"))
    return counts.withColumn("rejected_ratio", F.col("rejected_border") / F.col("matched_total"))


def border_by_gene(statistics: DataFrame) -> DataFrame:
    """(gene, mean_rejected_ratio, matched_total, rejected_border, num_donors)."""
    return statistics.groupBy("gene").agg(F.avg("rejected_ratio").alias("mean_rejected_ratio"), F.sum("matched_total").alias("matched_total"), F.sum("rejected_border").alias("rejected_border"), F.count("*").alias("num_donors"))


def calibrated_extensions(reads: DataFrame, alleles: DataFrame, gene: str, extension: int, border: int, quantile: float) -> DataFrame:
    """(gene, extension): per gene the length that a share `quantile` of its
    matches allows without reaching the border; V looks right, J left, D has the
    lesser of both sides."""
    pairs = contains(reads.select("genomic_sequence"), "genomic_sequence", alleles.select(F.col("name").alias("db_name"), F.col("seq").alias("sequence")), "sequence")
    n, end = F.length("genomic_sequence"), F.col("start") + F.length("sequence") - 1
    right, left = F.greatest(F.lit(1), n - border + 1) - 1 - end, F.col("start") - 1 - F.least(F.lit(border), n)
    room = {"V": right, "J": left, "D": F.least(right, left)}[gene]
    allowed = F.least(F.lit(extension), F.greatest(F.lit(0), room)).cast("long")
    rows = pairs.select(gene_of("db_name").alias("gene"), allowed.alias("a"))
    return rows.groupBy("gene").agg(F.expr(f"percentile_disc({1 - quantile!r}) WITHIN GROUP (ORDER BY a)").cast("long").alias("extension"))


def exact_search(found: DataFrame, min_count: int = 10, min_ratio: float = 0.01, top: int = 10, exempt: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """Counts of `matches`: full_count per distinct row, count per allele; both
    also as ratios to the maximum of (well, case, gene), taken before any
    filter. `exempt` alleles or genes (names, or a table with them as `name`)
    need no ratio. The `top` flank variants of an allele stay, ties by flank.
    All windows share one partitioning by (well, case, gene)."""
    columns = found.columns
    flank_columns = [c for c in columns if c not in ("well", "case", "db_name", "sequence")]
    rows = found.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("full_count")).withColumn("gene", gene_of("db_name")).repartition("well", "case", "gene")
    gene, allele = ["well", "case", "gene"], ["well", "case", "gene", "db_name", "sequence"]
    rows = rows.withColumn("count", F.sum("full_count").over(Window.partitionBy(*allele)))
    top_of = lambda c: F.max(c).over(Window.partitionBy(*gene))
    rows = rows.withColumn("full_ratio", F.col("full_count") / top_of("full_count")).withColumn("ratio", F.col("count") / top_of("count"))
    least = F.lit(min_ratio)
    if isinstance(exempt, DataFrame):
        names = exempt.select(F.col("name").alias("_name")).where("_name IS NOT NULL").distinct()
        rows = _looked_up(rows, names.withColumn("_free", F.lit(1.0)), "_free").withColumn("_least", F.when(F.col("_free").isNotNull(), F.lit(0.0)).otherwise(least)).drop("_free")
        least = F.col("_least")
    elif exempt:
        least = F.when(F.col("db_name").isin(*exempt) | F.col("gene").isin(*exempt), F.lit(0.0)).otherwise(least)
    kept = rows.where((F.col("full_count") >= min_count) & (F.col("full_ratio") >= least) & (F.col("count") >= min_count) & (F.col("ratio") >= least))
    rank = Window.partitionBy(*allele).orderBy(F.desc("full_count"), *[F.asc(c) for c in flank_columns])
    kept = kept.withColumn("flank_index", F.row_number().over(rank).cast("long")).where(F.col("flank_index") <= top)
    return kept.select("well", "case", "gene", "db_name", "count", "full_count", "ratio", "full_ratio", "flank_index", "sequence", *flank_columns)


def _looked_up(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """`rows` (db_name, gene) with the value of `values` (_name, column): the
    allele's, else its gene's, else null."""
    side = lambda key, c: values.select(F.col("_name").alias(key), F.col(column).alias(c))
    joined = rows.join(side("_an", "_av"), F.col("db_name") == F.col("_an"), "left").join(side("_gn", "_gv"), F.col("gene") == F.col("_gn"), "left")
    return joined.withColumn(column, F.coalesce("_av", "_gv")).drop("_an", "_av", "_gn", "_gv")


def above_thresholds(rows: DataFrame, thresholds: DataFrame, value: str) -> DataFrame:
    """Rows whose `value` reaches their threshold: that of the allele in
    `thresholds` (name, ratio), else of the gene, else 0. NaN never passes."""
    own = thresholds.select(F.col("name").alias("_name"), F.col("ratio").alias("_t")).where("_name IS NOT NULL")
    return _looked_up(rows, own, "_t").where((F.col(value) >= F.coalesce("_t", F.lit(0.0))) & ~F.isnan(value)).drop("_t")


def flag_known(rows: DataFrame, sequences: DataFrame, column: str = "sequence", flag: str = "isin_db") -> DataFrame:
    """`rows` with whether their sequence is one of `sequences` (seq)."""
    known = sequences.select(F.col("seq").alias("_seq")).where("_seq IS NOT NULL").distinct().withColumn(flag, F.lit(True))
    return rows.join(known, F.col(column) == F.col("_seq"), "left").drop("_seq").withColumn(flag, F.coalesce(flag, F.lit(False)))


def frequencies(found: DataFrame, locus: str, min_allele_ratio: float = 0.0, min_gene_ratio: float = 0.0) -> DataFrame:
    """Adds gene and case totals, frequencies, and ratios to the medians over
    cases. Totals and medians look at genes of `locus` only; rows of other genes
    drop out, as their ratio is 0/0."""
    inside = F.col("gene").startswith(locus)
    local = F.when(inside, F.col("count"))
    total = lambda *by: F.coalesce(F.sum(local).over(Window.partitionBy(*by)), F.lit(0)).cast("long")
    rows = found.withColumn("gene_count", total("well", "case", "gene")).withColumn("case_count", total("well", "case"))
    for key, c, m in (("db_name", "count", "_am"), ("gene", "gene_count", "_gm")):
        middle = rows.where(inside).groupBy(F.col(key).alias("_k")).agg(F.median(F.col(c).cast("double")).alias(m))
        rows = rows.join(middle, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(m, F.coalesce(m, F.lit(0.0)))
    rows = rows.withColumn("allele_case_freq", fdiv(F.col("count"), F.col("case_count"))).withColumn("gene_case_freq", fdiv(F.col("gene_count"), F.col("case_count")))
    rows = rows.withColumn("allele_median_ratio", fdiv(F.col("count"), F.col("_am"))).withColumn("gene_median_ratio", fdiv(F.col("gene_count"), F.col("_gm")))
    rows = rows.withColumn("allele_freq", fdiv(F.col("count"), F.sum("count").over(Window.partitionBy("well", "case", "gene"))))
    return rows.where(at_least(F.col("allele_median_ratio"), min_allele_ratio) & at_least(F.col("gene_median_ratio"), min_gene_ratio)).drop("_am", "_gm")


def demultiplex(reads: DataFrame, indices: DataFrame, sequence: str = "genomic_sequence", min_length: int = 0, array: str | None = None, case_filter: str | None = None) -> DataFrame:
    """(name, well, case) of the reads that start with a forward and end with
    the same row's reverse index; the first such row wins. `indices` has (well,
    forward_index, reverse_index, case).

    Literal barcodes of one length each are an equi-join on both ends. Barcodes
    that are patterns, and any with an `array` index (two bases, the array, 24
    bases, then the barcode), are few: they are tried by one pass over the
    reads. `case_filter` keeps cases that a pattern matches from their start. A
    null read or barcode matches nothing."""
    rows = indices.where("forward_index IS NOT NULL AND reverse_index IS NOT NULL")
    literal = F.lit(array is None) & F.col("forward_index").rlike("^[A-Za-z]+$") & F.col("reverse_index").rlike("^[A-Za-z]+$")
    patterns = sorted(map(tuple, rows.where(~literal).select("well", "forward_index", "reverse_index").collect()))  # index files hold a row a well
    rows = rows.where(literal)
    lengths = [tuple(r) for r in rows.select(F.length("forward_index"), F.length("reverse_index")).distinct().collect()]  # barcode lengths: a handful
    parts = []
    for f, r in lengths:
        ends = reads.where(F.length(sequence) >= max(f, r, min_length)).select("name", F.left(F.col(sequence), F.lit(f)).alias("forward_index"), F.right(F.col(sequence), F.lit(r)).alias("reverse_index"))
        parts.append(ends.join(rows, ["forward_index", "reverse_index"]).select("name", "well"))
    if patterns:
        parts.append(reads.where(F.length(sequence) >= min_length).select("name", F.col(sequence).alias("read")).mapInArrow(_tried(patterns, array), "name string, well long"))
    if not parts:
        return reads.select("name").join(indices.select("well", "case"), F.lit(False))
    first = reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.min("well").alias("well"))
    out = first.join(indices.select("well", "case"), "well").select("name", "well", "case")
    return out if case_filter is None else out.where(F.coalesce(F.col("case").rlike(f"^(?:{case_filter})"), F.lit(False)))


def _tried(patterns: list[tuple[int, str, str]], array: str | None):
    """For reads (name, read): the first well whose patterns both fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = f".{{2}}(?:{array}).{{24}}" if array else ""
        any_start = re.compile(f"{lead}(?:{'|'.join(f'(?:{f})' for _, f, _ in patterns)})", re.DOTALL)
        own = [(w, re.compile(f"{lead}(?:{f})", re.DOTALL), re.compile(f"(?:{r})\\Z")) for w, f, r in patterns]
        for batch in batches:
            names, wells = [], []
            for name, read in zip(batch.column("name").to_pylist(), batch.column("read").to_pylist()):
                if any_start.match(read):
                    well = next((w for w, f, r in own if f.match(read) and r.search(read)), None)
                    if well is not None:
                        names.append(name)
                        wells.append(well)
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "well": pa.array(wells, pa.int64())})

    return run


def demultiplex_stats(reads: DataFrame, sequence: str = "genomic_sequence") -> DataFrame:
    """(well, count, mean_length, std_length), lengths rounded half to even;
    the deviation of a single read is null."""
    n = F.length(sequence)
    return reads.groupBy("well").agg(F.count("*").alias("count"), F.bround(F.avg(n), 1).alias("mean_length"), F.bround(F.stddev_samp(n), 1).alias("std_length"))


def within(motifs: list[str], distance: int) -> str:
    """A pattern of the texts that differ from one of the motifs in exactly or
    fewer than `distance` places: those places may hold any letter."""
    words = {"".join("." if i in places else re.escape(c) for i, c in enumerate(m)) for m in motifs for places in combinations(range(len(m)), min(distance, len(m)))}
    return f"(?s){'|'.join(sorted(words))}"


def heptamer_search(reads: DataFrame, alleles: DataFrame, motifs: list[str] | dict[str, list[str]], max_distance: int = 1, begin: int = 0, end: int = 0) -> DataFrame:
    """(db_name, full_match, trimmed_match, db_length, full_length, sequence,
    heptamer) of every read that contains the trimmed allele: the nearest motif
    after it, earlier windows first among equals; the last window is not looked
    at. Without one, heptamer is ''. `motifs` are those of all alleles, or by
    the beginning of their names; alleles that begin otherwise are left out then."""
    by = motifs if isinstance(motifs, dict) else {"": motifs}
    size = len(next(iter(by.values()))[0])
    mine = reduce(lambda a, b: a | b, [F.col("name").startswith(x) for x in by])
    trimmed = alleles.where(mine).select(F.col("name").alias("db_name"), F.col("seq").alias("full_match"), F.substring(F.col("seq"), F.lit(begin + 1), F.length("seq") - begin - end).alias("trimmed_match"), F.length("seq").cast("long").alias("db_length"))
    found = contains(reads.select("genomic_sequence"), "genomic_sequence", trimmed, "trimmed_match")
    rows = found.withColumn("suffix", F.substring(F.col("genomic_sequence"), F.col("start") + F.length("trimmed_match"), F.length("genomic_sequence")))
    seen = F.left(F.col("suffix"), F.greatest(F.length("suffix") - 1, F.lit(0)))
    first = lambda own: F.coalesce(*[F.nullif(F.regexp_instr(seen, F.lit(within(own, d))), F.lit(0)) for d in range(max_distance + 1)])
    k = reduce(lambda rest, x: F.when(F.col("db_name").startswith(x), first(by[x])).otherwise(rest), by, F.lit(None).cast("int"))
    rows = rows.withColumn("k", k)
    extra = F.when(F.col("k").isNull(), "").otherwise(F.substring(F.col("suffix"), F.lit(1), F.col("k") - 1))
    motif = F.when(F.col("k").isNull(), "").otherwise(F.substring(F.col("suffix"), F.col("k"), F.lit(size)))
    return rows.select("db_name", "full_match", "trimmed_match", "db_length", (F.length("trimmed_match") + F.length(extra)).cast("long").alias("full_length"), F.concat("trimmed_match", extra).alias("sequence"), motif.alias("heptamer"))


def heptamer_summary(found: DataFrame, min_count: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """(db_name, sequence, heptamer, count, ratio to the allele's maximum)."""
    rows = found.groupBy("db_name", "sequence", "heptamer").agg(F.count("*").alias("count"))
    rows = rows.withColumn("ratio", F.col("count") / F.max("count").over(Window.partitionBy("db_name")))
    return rows.where((F.col("count") >= min_count) & (F.col("ratio") >= min_ratio))


GRAM = 6


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def nearest(values: DataFrame, value: str, alleles: DataFrame, most: int = 100_000) -> DataFrame:
    """(value, nearest, distance): for each distinct value the allele (name,
    seq) with the smallest Levenshtein distance, by name among equals.

    An edit touches at most GRAM substrings of that length, so a value and an
    allele are at least 1/GRAM of the distinct ones apart that one has and the
    other lacks. The allele with the least bound is measured first; then only
    those whose bound doesn't exceed that distance. The alleles are handed to
    the tasks in blocks of at most `most`, all values against each block."""
    own = values.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct()
    named = alleles.where("name IS NOT NULL AND seq IS NOT NULL").groupBy("seq").agg(F.min("name").alias("name"))
    blocks = max(1, -(-named.count() // most))
    best = None
    for b in range(blocks):
        block = named.where(F.pmod(F.xxhash64("seq"), F.lit(blocks)) == b).select("name", "seq").orderBy("name").collect()  # `most` rows, about
        part = _nearest_of(own, [tuple(r) for r in block])
        best = part if best is None else best.unionByName(part)
    return best.groupBy("value").agg(F.min(F.struct("d", "name")).alias("m")).select("value", F.col("m.name").alias("nearest"), F.col("m.d").cast("long").alias("distance"))


def _nearest_of(values: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    index: dict[str, list[int]] = {}
    for i, (_, seq) in enumerate(block):
        for g in _grams(seq):
            index.setdefault(g, []).append(i)
    lists = {g: np.array(x, np.int64) for g, x in index.items()}
    sizes = np.array([len(s) for _, s in block], np.int64)
    grams = np.array([len(_grams(s)) for _, s in block], np.int64)

    def bounds(text: str) -> np.ndarray:
        mine = _grams(text)
        shared = np.zeros(len(block), np.int64)
        for g in mine:
            if g in lists:
                shared[lists[g]] += 1
        # distinct grams that one side lacks on the other: an edit adds or removes GRAM of them at most
        lacking = np.maximum(len(mine), grams) - shared
        return np.maximum(np.abs(sizes - len(text)), -(-lacking // GRAM))

    def emit(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        v, at = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_pydict({"value": pa.array(v, pa.string()), "name": pa.array([block[i][0] for i in at], pa.string()), "seq": pa.array([block[i][1] for i in at], pa.string())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit([(v, int(bounds(v).argmin())) for v in batch.column("value").to_pylist()] if block else [])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, d in zip(batch.column("value").to_pylist(), batch.column("d").to_pylist()):
                yield emit([(v, int(i)) for i in np.flatnonzero(bounds(v) <= d)])

    schema = "value string, name string, seq string"
    measured = values.mapInArrow(first, schema).select("value", F.levenshtein("value", "seq").alias("d"))
    return measured.mapInArrow(rest, schema).select("value", "name", F.levenshtein("value", "seq").alias("d"))


def profile(motifs: DataFrame, motif: str, pseudocount: float = 1e-4) -> DataFrame:
    """(pos, base, p): position weights over A, C, G and T, with the
    pseudocount added to every cell before columns are normalised."""
    letters = motifs.select(F.posexplode(F.split(F.upper(F.col(motif)), "")).alias("pos", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    counts = letters.groupBy("pos").pivot("base", ["A", "C", "G", "T"]).count().fillna(0)
    long = counts.select("pos", F.explode(F.create_map(*[x for b in "ACGT" for x in (F.lit(b), F.col(b).cast("double") + pseudocount)])).alias("base", "n"))
    return long.select(F.col("pos").cast("long").alias("pos"), "base", (F.col("n") / F.sum("n").over(Window.partitionBy("pos"))).alias("p"))


def motif_probability(motifs: DataFrame, motif: str, weights: DataFrame) -> DataFrame:
    """(motif, probability) of each distinct non-empty value: the product of its
    letters' weights in `weights` (pos, base, p); letters besides A, C, G and T
    don't count, one with a gap has probability 0. Longer motifs than the
    profile are left out."""
    own = motifs.select(F.col(motif).alias("motif")).where("motif <> ''").distinct()
    size = weights.agg(F.max("pos")).first()[0]
    letters = own.where(F.length("motif") <= F.lit((size if size is not None else -1) + 1)).select("motif", F.posexplode(F.split(F.upper("motif"), "")).alias("pos", "base"))
    known = letters.join(weights.select(F.col("pos").cast("int").alias("pos"), "base", "p"), ["pos", "base"], "left")
    total = F.exp(F.coalesce(F.sum(F.ln("p")), F.lit(0.0)))
    return known.groupBy("motif").agg(F.when(F.max(F.col("base") == "-"), F.lit(0.0)).otherwise(total).alias("probability"))
