"""Older ways to find alleles: by substitutions, frequent flanks, fragments of
their own, and profiles of their ends."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import gene_of, kmers, unique_name
from ..operators.aligner import codes
from ..operators.dictionary import contains
from ..workdir import materialize
from . import exact, trimming

# Fixed value: the tag of a read's end: random bases around GT, 22 bases, 9 bases
UMI = r"([ACGT]{3}GT[ACGT]{3})([ACGT]{22})([ACGT]{9})$"

#: where the dot of a pattern ends
LINE = re.compile("[\n\r\u0085\u2028\u2029]")


def unambiguous(reads: DataFrame, column: str = "genomic_sequence") -> DataFrame:
    """Rows with a non-empty text of A, C, G and T only."""
    return reads.where(F.col(column).rlike("^[ACGT]+$"))


def umi(read: str | Column) -> list[Column]:
    """The three parts of a read's tag; empty without one."""
    read = F.col(read) if isinstance(read, str) else read
    return [F.coalesce(F.regexp_extract(read, UMI, i), F.lit("")) for i in (1, 2, 3)]


def halves(text: str | Column) -> tuple[Column, Column]:
    """Both halves of a text, the second longer by one if they aren't equal."""
    text = F.col(text) if isinstance(text, str) else text
    half = F.floor(F.length(text) / 2).cast("int")
    return F.left(text, half), F.substring(text, half + 1, F.length(text))


@F.pandas_udf(T.StringType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest stretch two texts have in common, the one that ends first in
    the first text among equals; null if either is."""

    def one(x: str | None, y: str | None) -> str | None:
        if x is None or y is None:
            return None
        if not x or not y:
            return ""
        other = _points(y)
        run, best, end = np.zeros(len(y) + 1, np.int64), 0, 0
        for i, c in enumerate(x):
            run[1:] = np.where(other == ord(c), run[:-1] + 1, 0)
            top = int(run.max())
            if top > best:
                best, end = top, i + 1
        return x[end - best : end]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def hamming_matches(reads: DataFrame, alleles: DataFrame, max_distance: int = 2, check_bounds: bool = True, with_umi: bool = False, column: str = "genomic_sequence") -> DataFrame:
    """(well, case, read, closest_name, distance, start, stop, prefix, middle,
    suffix, db_sequence, barcode) of reads without N: the window that differs
    from an allele in the fewest places, `max_distance` at most; ties by name,
    then position. With `check_bounds` seven bases must lie on either side.

    An allele cut into max_distance + 1 pieces has one of them unchanged in
    every such window, so pieces are found exactly and windows verified."""
    known = alleles.where("seq <> '' AND name IS NOT NULL").select("name", "seq").distinct()
    n = max_distance + 1
    piece = lambda i: F.substring("seq", F.floor(F.length("seq") * i / n).cast("int") + 1, (F.floor(F.length("seq") * (i + 1) / n) - F.floor(F.length("seq") * i / n)).cast("int"))
    cut = known.select(F.explode(F.array(*[F.struct(piece(i).alias("piece"), F.floor(F.length("seq") * i / n).cast("int").alias("offset"), "name", "seq") for i in range(n)])).alias("p"))
    rows = [tuple(r) for r in cut.select("p.piece", "p.offset", "p.name", "p.seq").orderBy("name", "seq", "offset").collect()]  # a reference dictionary
    own: dict[str, list[tuple[int, str, str]]] = {}
    for p, offset, name, seq in rows:
        own.setdefault(p, []).append((offset, name, seq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p, owners in own.items():
            if p:
                automaton.add_word(p, (len(p), owners))
        if len(automaton):
            automaton.make_automaton()
        coded: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for read in batch.column(0).to_pylist():
                mine, best = _points(read), None
                tried = set()
                for end, (size, owners) in automaton.iter(read) if len(automaton) else ():
                    for offset, name, seq in owners:
                        start = end - size + 1 - offset
                        if start < 0 or start + len(seq) > len(read) or (start, name, seq) in tried:
                            continue
                        tried.add((start, name, seq))
                        c = coded.setdefault(seq, _points(seq))
                        d = int((mine[start : start + len(seq)] != c).sum())
                        if d <= max_distance and (best is None or (d, name, start, seq) < best):
                            best = (d, name, start, seq)
                if best is None:
                    continue
                d, name, start, seq = best
                stop = start + len(seq)
                if check_bounds and not (len(read) > stop + 7 and start > 7 - 1):
                    continue
                left, right = (read[start - 7 : start], read[stop : stop + 7]) if check_bounds else ("", "")
                out.append((read, name, d, start + 1, stop, left, read[start:stop], right, seq))
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["read", "closest_name", "distance", "start", "stop", "prefix", "middle", "suffix", "db_sequence"])

    clean = reads.where((F.col(column) != "") & ~F.col(column).contains("N")).select("well", "case", F.col(column).alias("read"))
    found = clean.select("read").distinct().mapInArrow(run, "read string, closest_name string, distance long, start long, stop long, prefix string, middle string, suffix string, db_sequence string")
    tag = umi("read")[0] if with_umi else F.lit("")
    return clean.join(found, "read").withColumn("barcode", tag)


def hamming_summary(found: DataFrame, alleles: DataFrame, cluster_ratio: float = 0.25, min_count: int = 10) -> DataFrame:
    """(well, case, gene, prefix, middle, suffix, closest_name, count,
    unique_umi, allele_name): clusters of `hamming_matches` with more than
    `cluster_ratio` of the largest of their gene, well and case, and `min_count`
    or more. Known sequences have their allele's name (the last by name)."""
    by = ["well", "case", "gene", "prefix", "middle", "suffix"]
    rows = found.withColumn("gene", gene_of("closest_name"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("count"), F.count_distinct("barcode").alias("unique_umi"), F.collect_set("closest_name").alias("_names"))
    groups = groups.select(*by, "count", "unique_umi", F.explode("_names").alias("closest_name"))
    groups = groups.withColumn("_top", F.max("count").over(Window.partitionBy("well", "case", "gene"))).where((F.col("count") > F.col("_top") * cluster_ratio) & (F.col("count") >= min_count)).drop("_top")
    known = alleles.where("seq IS NOT NULL").groupBy(F.col("seq").alias("middle")).agg(F.max("name").alias("_known"))
    new = F.concat(unique_name("closest_name", "middle"), F.lit(" Novel"))
    return groups.join(known, "middle", "left").withColumn("allele_name", F.coalesce("_known", new)).drop("_known").select(*by, "closest_name", "count", "unique_umi", "allele_name")


def frequent_flanks(reads: DataFrame, alleles: DataFrame, min_length: int = 16, min_count: int = 100, min_wells: int = 1, before: int = 7, after: int = 7) -> DataFrame:
    """(side, flank, wells): the flanks (up to `before` and `after` bases) of
    alleles of `min_length` or more in the reads that contain them, seen
    `min_count` times in a well and case, and how often that is so (over alleles,
    wells and cases)."""
    own = alleles.where(F.length("seq") >= min_length).select(F.col("name").alias("db_name"), "seq").distinct()
    pairs = contains(reads.select("well", "case", "genomic_sequence"), "genomic_sequence", own, "seq")
    first = F.greatest(F.lit(1), F.col("start") - before)
    end = F.col("start") + F.length("seq")
    sides = F.array(F.struct(F.lit("prefix").alias("side"), F.substring("genomic_sequence", first, F.col("start") - first).alias("flank")), F.struct(F.lit("suffix").alias("side"), F.substring("genomic_sequence", end, F.lit(after)).alias("flank")))
    rows = pairs.select("db_name", "well", "case", F.explode(sides).alias("f")).groupBy("db_name", "well", "case", "f.side", "f.flank").agg(F.count("*").alias("count"))
    return rows.where(F.col("count") >= min_count).groupBy("side", "flank").agg(F.count("*").alias("wells")).where(F.col("wells") >= min_wells)


def first_pairs(prefixes: list[tuple[int, str]], suffixes: list[tuple[int, str]], shortest: int, longest: int) -> Callable[[str | None], str | None]:
    """A function that finds a text's hit of `between_flanks`: of the first pair
    that fits, in the first line that has it, the last start and the nearest end
    there. All flanks are looked up at once, so pairs cost nothing by themselves."""
    import ahocorasick

    place = lambda x: {v: i for i, v in enumerate(sorted(set(x)))}
    by_p, by_s = (place([-w for w, _ in x]) for x in (prefixes, suffixes))
    texts_p, texts_s = (place([f for _, f in x]) for x in (prefixes, suffixes))
    # pairs go by the prefix's number, the suffix's, then their texts
    rank_p = {f: (by_p[-w], texts_p[f]) for w, f in reversed(prefixes)}
    rank_s = {f: (by_s[-w], texts_s[f]) for w, f in reversed(suffixes)}
    automaton = ahocorasick.Automaton()
    for f in {*rank_p, *rank_s} - {""}:
        automaton.add_word(f, (len(f), rank_p.get(f), rank_s.get(f)))
    if len(automaton):
        automaton.make_automaton()

    def find(text: str | None) -> str | None:
        if not text or not rank_p or not rank_s:
            return None
        best, hit = None, None
        for line in LINE.split(text):
            starts, ends = [], []
            for end, (size, p, s) in automaton.iter(line) if len(automaton) else ():
                if p is not None:
                    starts.append((end + 1, p))
                if s is not None:
                    ends.append((end + 1 - size, s))
            if "" in rank_p:
                starts = sorted(starts + [(i, rank_p[""]) for i in range(len(line) + 1)])
            if "" in rank_s:
                ends += [(i, rank_s[""]) for i in range(len(line) + 1)]
            if not starts or not ends:
                continue
            ends.sort()
            own, low, n = None, 0, len(ends)
            for i, p in starts:
                while low < n and ends[low][0] < i + shortest:
                    low += 1
                k = low
                while k < n and ends[k][0] <= i + longest:
                    j, s = ends[k]
                    key = (p[0], s[0], p[1], s[1], -i, j)
                    if own is None or key < own:
                        own = key
                    k += 1
            if own is not None and (best is None or own[:4] < best):
                best, hit = own[:4], line[-own[4] : own[5]]
        return hit

    return find


def between_flanks(reads: DataFrame, flanks: DataFrame, trim_ends: int = 30, flank: int = 100, shortest: int = 15, longest: int = 40) -> DataFrame:
    """(well, case, name, hit, hit_prefix, hit_suffix) of reads without their
    ends: the text between the first pair of flanks that fits, pairs ordered by
    how often their prefix, then their suffix, was seen (ties by text).
    `flanks` comes from `frequent_flanks`; all its pairs are patterns."""
    rows = flanks.collect()  # the frequent ones only
    side = lambda s: sorted(((r.wells, r.flank) for r in rows if r.side == s), key=lambda x: (-x[0], x[1]))
    prefixes, suffixes = side("prefix"), side("suffix")
    body = F.substring("genomic_sequence", F.lit(trim_ends + 1), F.greatest(F.lit(0), F.length("genomic_sequence") - 2 * trim_ends))
    out = reads.where(F.length("genomic_sequence") > 2 * trim_ends).select("well", "case", "name", body.alias("_read"))
    if all(f.isalnum() or not f for _, f in prefixes + suffixes):

        @F.pandas_udf(T.StringType())
        def hit(read: pd.Series) -> pd.Series:
            find = first_pairs(prefixes, suffixes, shortest, longest)
            return pd.Series([find(x) for x in read], dtype="object")

        found = hit("_read")
    else:  # letters that a pattern reads otherwise
        pairs = sorted(((p, s) for p in prefixes for s in suffixes), key=lambda x: (-x[0][0], -x[1][0], x[0][1], x[1][1]))
        match = lambda p, s: F.nullif(F.regexp_extract("_read", f".*(?<={p})(.{{{shortest},{longest}}}?)(?={s})", 1), F.lit(""))
        found = F.coalesce(*[match(p, s) for (_, p), (_, s) in pairs]) if pairs else F.lit(None).cast("string")
    out = out.withColumn("hit", found).where("hit IS NOT NULL")
    start = F.instr("_read", F.col("hit"))
    first = F.greatest(F.lit(1), start - flank)
    return out.select("well", "case", "name", "hit", F.substring("_read", first, start - first).alias("hit_prefix"), F.substring("_read", start + F.length("hit"), F.lit(flank)).alias("hit_suffix"))


def best_alignments(hits: DataFrame, column: str, alleles: DataFrame) -> DataFrame:
    """(value, best_name, distance, gaps, score, best_ref) of each distinct
    value: the allele it aligns to best over its whole length (first by name
    among equals; scores must be positive), its edits, the gaps in it, and the
    allele's stretch."""
    known = [tuple(r) for r in alleles.where("seq <> ''").select("name", "seq").orderBy("name", "seq").collect()]  # a reference dictionary
    sequences = [s for _, s in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                best = trimming.align_best(value, sequences)
                if best and best[1][3] > 0:
                    (name, seq), (first, end, _, score, edits, gaps) = known[best[0]], best[1]
                    out.append((value, name, edits, gaps, score, seq[first:end]))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["value", "best_name", "distance", "gaps", "score", "best_ref"])

    own = hits.select(F.col(column).alias("value")).where("value <> ''").distinct()
    return own.mapInArrow(run, "value string, best_name string, distance long, gaps long, score long, best_ref string")


def annotate(hits: DataFrame, alleles: DataFrame, before: int = 7, after: int = 7) -> DataFrame:
    """Each hit of `between_flanks` with its best alignment, the nearest bases
    on either side, and " Novel" names for those that differ."""
    best = best_alignments(hits, "hit", alleles)
    rows = hits.join(best, F.col("hit") == F.col("value")).drop("value")
    name = F.when(F.col("distance") > 0, F.concat(unique_name("best_name", "hit"), F.lit(" Novel"))).otherwise(F.col("best_name"))
    return rows.select("well", "case", name.alias("best_name"), "distance", "gaps", "score", F.col("hit").alias("best_aln"), F.right("hit_prefix", F.lit(before)).alias("prefix"), F.left("hit_suffix", F.lit(after)).alias("suffix"), "best_ref")


def once(text: Column, k: int) -> Column:
    """Substrings of length k that occur exactly once in a text."""
    at = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(F.array().cast("array<int>"))
    every = F.transform(at, lambda i: F.substring(text, i, F.lit(k)))
    twice = lambda x: F.instr(F.substring(text, F.instr(text, x) + 1, F.length(text)), x) > 0
    return F.filter(F.array_distinct(every), lambda x: ~twice(x))


def gene_fragments(alleles: DataFrame, k: int = 15, longest: int = 60, others: DataFrame | None = None) -> DataFrame:
    """(gene, fragment, k): substrings that every allele of a gene has exactly
    once and no sequence of another gene (nor of `others` (gene, seq)) has. For
    genes without any, k grows until there are some, up to `longest`."""
    own = materialize(alleles.where("seq <> ''").select(gene_of("name").alias("gene"), "name", "seq").distinct(), "alleles")
    genes = own.groupBy("gene").agg(F.count("*").alias("n"))
    outside = own.select("gene", "seq") if others is None else own.select("gene", "seq").unionByName(others.select("gene", "seq").where("seq <> ''"))
    left, out = own, None
    for size in range(k, longest + 1):
        common = left.select("gene", F.explode(once(F.col("seq"), size)).alias("fragment")).groupBy("gene", "fragment").agg(F.count("*").alias("c")).join(genes, "gene").where("c = n").select("gene", "fragment")
        seen = outside.select("gene", F.explode(kmers("seq", size)).alias("fragment")).distinct().groupBy("fragment").agg(F.count("*").alias("_genes"), F.min("gene").alias("_gene"))
        found = common.join(seen, "fragment", "left").where("_genes IS NULL OR (_genes = 1 AND _gene = gene)").select("gene", "fragment", F.lit(size).cast("long").alias("k"))
        found = materialize(found, "fragments") if size < longest else found
        out = found if out is None else out.unionByName(found)
        if size < longest:
            left = materialize(left.join(found.select("gene").distinct(), "gene", "left_anti"), "left")
            if left.isEmpty():
                break
    return out


def sampled_fragments(fragments: DataFrame, most: int = 5, seed: int = 1) -> DataFrame:
    """Up to `most` fragments a gene, by a seeded hash."""
    w = Window.partitionBy("gene").orderBy(F.xxhash64("fragment", F.lit(seed)), "fragment")
    return fragments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def trim_by_distance(reads: DataFrame, alleles: DataFrame, fragments: DataFrame) -> DataFrame:
    """(gene, case, sequence): reads that contain a fragment, cut to as many
    bases before and after it as its gene's alleles have (those of the last
    allele by name that contains it); reads that are too short drop out. A read
    gives a row a fragment."""
    at = F.instr("seq", F.col("fragment"))
    own = alleles.select(gene_of("name").alias("gene"), "name", "seq").join(fragments.select("gene", "fragment"), "gene").where(at > 0)
    sides = own.groupBy("gene", "fragment").agg(F.max_by(F.struct((at - 1).alias("before"), (F.length("seq") - at + 1 - F.length("fragment")).alias("after")), "name").alias("_s")).select("gene", "fragment", "_s.*")
    found = contains(reads.select("case", "genomic_sequence"), "genomic_sequence", fragments.select("fragment").distinct(), "fragment").join(sides, "fragment")
    size = F.length("fragment")
    fits = (F.col("start") - F.col("before") >= 1) & (F.col("start") + size + F.col("after") <= F.length("genomic_sequence"))
    return found.where(fits).select("gene", "case", F.substring("genomic_sequence", F.col("start") - F.col("before"), F.col("before") + size + F.col("after")).alias("sequence"))


def end_profiles(alleles: DataFrame, n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Log2 weights (n x 4) of the first and last n bases of each gene's
    alleles, with the pseudocount of `exact.profile`."""
    side = lambda s, c: alleles.where(F.length("seq") >= n).select(gene_of("name").alias("gene"), F.lit(s).alias("side"), F.posexplode(F.split(c, "")).alias("pos", "base"))
    rows = side(0, F.left("seq", F.lit(n))).unionByName(side(1, F.right("seq", F.lit(n)))).where(F.col("base").isin(*"ACGT")).groupBy("gene", "side", "pos", "base").count().collect()  # 8 n a gene
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["gene"], (np.full((n, 4), 1e-4), np.full((n, 4), 1e-4)))[r["side"]][r["pos"], "ACGT".index(r["base"])] += r["count"]
    return {g: tuple(np.log2(x / x.sum(axis=1, keepdims=True)) for x in p) for g, p in out.items()}


def best_position(c: np.ndarray, weights: np.ndarray) -> int:
    """0-based start of the likeliest window of coded bases, the first among
    equals; other letters don't count, the last window isn't looked at."""
    n = len(weights)
    w = np.hstack([weights, np.zeros((n, 1))])
    size = len(c) - n
    if size <= 0:
        return 0
    return int(sum(w[i][c[i : i + size]] for i in range(n)).argmax())


def profile_segments(reads: DataFrame, profiles: dict[str, tuple[np.ndarray, np.ndarray]], min_length: int = 100) -> DataFrame:
    """(gene, case, genomic_sequence, sequence) of `reads` (gene, case,
    genomic_sequence): the part from the likeliest start to the likeliest end
    behind it, of `min_length` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, parts = [], []
            for i, (gene, read) in enumerate(zip(batch.column("gene").to_pylist(), batch.column("genomic_sequence").to_pylist())):
                if gene not in profiles or not read:
                    continue
                head, tail = profiles[gene]
                n, c = len(head), codes(read)
                start = best_position(c, head)
                rest = c[start + n :]
                stop = best_position(rest, tail) + start + 2 * n if len(rest) > n else -1
                if start + n < stop and stop - start >= min_length:
                    keep.append(i)
                    parts.append(read[start:stop])
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.string())], names=[*batch.schema.names, "sequence"])

    return reads.select("gene", "case", "genomic_sequence").mapInArrow(run, "gene string, case string, genomic_sequence string, sequence string")


def clustered(segments: DataFrame, alleles: DataFrame, blacklist: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """(case, sequence, count, closest, distance, allele_name, gene, length,
    length_db, ratio) of (case, sequence) rows: equal ones counted, with the
    nearest allele, and the ratio to the case's largest count. Sequences with
    other letters, and those that are part of a `blacklist` (seq), drop out. Only
    rows with `keep`, a condition on count and ratio, are compared with alleles."""
    groups = materialize(segments.where("sequence <> ''").groupBy("case", "sequence").agg(F.count("*").alias("count")), "groups")
    groups = groups.withColumn("ratio", F.col("count") / F.max("count").over(Window.partitionBy("case")))
    if keep is not None:
        groups = materialize(groups.where(keep), "kept")
    near = exact.nearest(groups, "sequence", alleles).select(F.col("value").alias("sequence"), F.col("nearest").alias("closest"), "distance")
    sizes = alleles.groupBy(F.col("name").alias("closest")).agg(F.max(F.length("seq")).cast("long").alias("length_db"))
    rows = groups.join(near, "sequence").join(sizes, "closest")
    name = F.when(F.col("distance") == 0, F.col("closest")).otherwise(F.concat(unique_name("closest", "sequence"), F.lit(" Novel")))
    rows = rows.withColumn("allele_name", name).withColumn("gene", gene_of("allele_name")).withColumn("length", F.length("sequence").cast("long"))
    rows = unambiguous(rows, "sequence")
    if blacklist is not None:
        listed = contains(blacklist.where("seq <> ''").select("seq"), "seq", rows.select(F.col("sequence").alias("_v")).distinct(), "_v").select(F.col("_v").alias("sequence")).distinct()
        rows = rows.join(listed, "sequence", "left_anti")
    return rows.select("case", "sequence", "count", "closest", "distance", "allele_name", "gene", "length", "length_db", "ratio")


def search_patterns(reads: DataFrame, alleles: DataFrame, blacklist: DataFrame | None = None, k: int = 20, longest: int = 60, most: int = 5, profile: int | None = None, min_length: int = 100, use_halves: bool = False) -> DataFrame:
    """Clusters of the reads that contain fragments of a gene's own, cut by the
    fragments' distances, or with `profile` by profiles of that many end bases.
    Fragments are k-mers, or with `use_halves` halves of alleles."""
    if use_halves:
        parts = alleles.where("seq <> ''").select(gene_of("name").alias("gene"), F.explode(F.array(*halves("seq"))).alias("fragment")).where("fragment <> ''").distinct()
        alien = contains(alleles.select(gene_of("name").alias("_gene"), "seq"), "seq", parts, "fragment").where("_gene <> gene").select("gene", "fragment").distinct()
        fragments = parts.join(alien, ["gene", "fragment"], "left_anti")
    else:
        fragments = gene_fragments(alleles, k, longest, others=None if blacklist is None else blacklist.select(gene_of("name").alias("gene"), "seq")).select("gene", "fragment")
    some = materialize(sampled_fragments(fragments, most), "sampled")
    if profile is None:
        segments = trim_by_distance(reads, alleles, some)
    else:
        found = contains(reads.select("case", "genomic_sequence").withColumn("_row", F.xxhash64("case", "genomic_sequence")), "genomic_sequence", some, "fragment")
        segments = profile_segments(found.groupBy("gene", "case", "genomic_sequence").agg(F.first("_row")), end_profiles(alleles, profile), min_length)
    return clustered(segments, alleles, blacklist)


def kmer_index(reads: DataFrame, k: int, column: str = "genomic_sequence") -> DataFrame:
    """(kmer, read): which distinct unambiguous reads contain each k-mer."""
    rows = unambiguous(reads, column).select(F.col(column).alias("read")).distinct()
    return rows.select(F.explode(kmers("read", k)).alias("kmer"), "read")


def with_combinations(reads: DataFrame, alleles: DataFrame, k: int = 7, n: int = 3, combinations: int = 100, seed: int = 1, column: str = "genomic_sequence") -> DataFrame:
    """Unambiguous rows of `reads` with `gene`, a row a gene, that contain all n
    k-mers of one of the gene's `combinations`, drawn by a seeded hash from the
    k-mers that all its alleles have and no other gene's have. Only drawn k-mers
    are looked up, and reads stay where they are."""
    own = gene_fragments(alleles, k, k).select("gene", "fragment")
    draw = own.select("gene", "fragment", F.explode(F.sequence(F.lit(1), F.lit(combinations))).alias("combination"))
    w = Window.partitionBy("gene", "combination").orderBy(F.xxhash64("fragment", "combination", F.lit(seed)), "fragment")
    drawn = draw.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy("gene", "combination").agg(F.collect_set("fragment").alias("f")).where(F.size("f") == n)
    sets = [(r.gene, frozenset(r.f)) for r in drawn.select("gene", "f").distinct().collect()]  # `combinations` a gene

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[tuple[str, frozenset[str]]]] = {}
        for gene, some in sets:
            of.setdefault(min(some), []).append((gene, some))
        automaton = ahocorasick.Automaton()
        for f in {f for _, some in sets for f in some}:
            automaton.add_word(f, f)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows, genes = [], []
            for i, read in enumerate(batch.column(column).to_pylist() if len(automaton) else []):
                seen = {f for _, f in automaton.iter(read)}
                if len(seen) < n:
                    continue
                found = {gene for f in seen for gene, some in of.get(f, ()) if some <= seen}
                rows += [i] * len(found)
                genes += found
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(genes, pa.string())], names=[*batch.schema.names, "gene"])

    clean = unambiguous(reads, column)
    return clean.mapInArrow(run, T.StructType([*clean.schema.fields, T.StructField("gene", T.StringType())]))


def combination_search(reads: DataFrame, alleles: DataFrame, k: int = 7, n: int = 3, combinations: int = 100, seed: int = 1, column: str = "genomic_sequence") -> DataFrame:
    """(gene, read): the distinct reads of `with_combinations`."""
    texts = unambiguous(reads, column).select(F.col(column).alias("read")).distinct()
    return with_combinations(texts, alleles, k, n, combinations, seed, "read").select("gene", "read")


def discover_by_combinations(reads: DataFrame, alleles: DataFrame, k: int = 7, n: int = 3, combinations: int = 100, flank: int = 21, min_length: int = 200, max_distance: int = 10, min_count: int = 5, min_ratio: float = 0.1) -> DataFrame:
    """Clusters of the reads `with_combinations` finds, cut by end profiles;
    those near an allele, frequent in themselves and in their case."""
    rows = with_combinations(reads.select("case", "genomic_sequence"), alleles, k, n, combinations)
    segments = profile_segments(rows.select("gene", "case", "genomic_sequence"), end_profiles(alleles, flank), min_length)
    return clustered(segments, alleles, keep=(F.col("count") >= min_count) & (F.col("ratio") >= min_ratio)).where(F.col("distance") <= max_distance)
