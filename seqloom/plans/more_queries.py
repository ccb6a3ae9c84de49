"""Queries over sources and sinks, search options, discovery, clustering and
the older methods, and the same in SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import base_name, gene_of, parse_gene_type, replace_extension, stem, windows_within, without_gaps
from ..operators import aligner, keysets
from ..sources import files
from ..workdir import materialize, scratch
from . import clusters, cohort, discovery, dscan, exact, genome, patterns, simulate
from . import queries as core
from .queries import HEPTAMERS, _alleles, _reads, table

# --- sources and sinks: each writes a table, and reads it back


def io_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tsv")
    files.write_tsv(table(spark, d, "blast").select("qseqid", "sseqid", "pident", "length", "sstrand"), path)
    return files.read_tsv(spark, path)


def io_tsv_plain(spark, d):
    path = scratch(spark, "tsv")
    files.write_tsv(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path, compress=False)
    return files.read_tsv(spark, path)


def io_reads(spark, d):
    path = scratch(spark, "reads")
    files.write_tsv(_reads(spark, d), path)
    return files.read_reads(spark, path)


def io_reads_limit(spark, d):
    """The first 100 reads of a file that is ordered by name."""
    path = scratch(spark, "reads")
    one = _reads(spark, d).select("well", "case", "name", "genomic_sequence").orderBy("name", "well", "case", "genomic_sequence").coalesce(1)
    files.write_tsv(one, path)
    return files.read_reads(spark, path, 100)


def io_fasta(spark, d):
    path = scratch(spark, "fasta")
    files.write_fasta(table(spark, d, "fasta").where("seq <> ''"), path, description="description")
    return files.read_fasta(spark, path).select("name", "description", "seq")


def io_fasta_check(spark, d):
    return files.check_fasta(table(spark, d, "fasta").select("name", "seq"), True)


def io_identifiers(spark, d):
    return table(spark, d, "fasta").select("name", files.valid_identifier("name").alias("valid")).distinct()


def io_fastq(spark, d):
    path = scratch(spark, "fastq")
    files.write_fastq(_reads(spark, d).where("genomic_sequence <> ''").select("name", F.col("genomic_sequence").alias("seq"), F.expr("repeat('@', length(genomic_sequence))").alias("quality")), path)
    return files.read_fastq(spark, path).select("name", "seq", "quality")


def io_by_case(spark, d):
    path = scratch(spark, "split")
    files.write_by_case(_reads(spark, d).where("genomic_sequence <> '' AND case IS NOT NULL").select("case", "name", F.col("genomic_sequence").alias("seq"), F.expr("repeat('I', length(genomic_sequence))").alias("quality")), path)
    lines = spark.read.text(path).withColumn("case", F.regexp_extract(F.col("_metadata.file_path"), "case=([^/]+)/", 1))
    return lines.groupBy("case").agg((F.count("*") / 4).cast("long").alias("n"))


def io_glob(spark, d):
    """The alleles of each locus in a file of its own, collected by a pattern."""
    folder = scratch(spark, "glob")
    for locus in ("IGH", "IGK", "IGL"):
        files.write_named(_alleles(spark, d, locus=locus), f"{folder}/{locus}.tsv")
    return files.read_many(spark, f"{folder}/*.tsv.gz")


def io_indices(spark, d):
    path = f"{scratch(spark, 'indices')}/indices.csv"
    files.write_named(table(spark, d, "indices").select(*files.INDICES), path, lambda df, p: df.write.option("header", True).csv(p))
    return files.read_indices(spark, path)


def io_motifs(spark, d):
    path = scratch(spark, "motifs")
    spark.createDataFrame([(json.dumps(HEPTAMERS),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(k, m) for k, v in files.read_motifs(spark, f"{path}/part-*").items() for m in v], "locus string, motif string")


def io_alignments(spark, d):
    path = scratch(spark, "hits")
    table(spark, d, "blast").select(*files.ALIGNMENTS.names).write.option("sep", "\t").option("compression", "gzip").csv(path)
    return files.read_alignments(spark, path)


def io_thresholds(spark, d):
    path = scratch(spark, "thresholds")
    files.write_tsv(_thresholds(spark, d), path, compress=False)
    return files.read_thresholds(spark, path)


def io_query_fasta(spark, d):
    path = scratch(spark, "query")
    files.write_query_fasta(_reads(spark, d).where("genomic_sequence <> ''"), path, "name", "genomic_sequence", ("well", "case"))
    return files.read_fasta(spark, path).select("name", "description", "seq")


def io_novel(spark, d):
    path = scratch(spark, "novel")
    files.write_fasta(_novel(spark, d), path)
    missing = files.identifiers(spark, f"{path}-absent")
    return files.identifiers(spark, path).unionByName(missing)


def io_extended(spark, d):
    """Alleles with their affixes, written as FASTA and read back."""
    path = scratch(spark, "extended")
    files.write_fasta(discovery.extended(allele_affixes(spark, d)), path)
    return files.read_fasta(spark, path).select("name", "seq")


def io_names(spark, d):
    """Base names, stems and changed extensions of the FASTA files."""
    rows = table(spark, d, "fasta").select("file").distinct()
    return rows.select("file", base_name("file").alias("base"), stem("file").alias("stem"), replace_extension("file", "tsv").alias("renamed"))


def simulated(spark, d):
    """Invented reads, demultiplexed: reads and different alleles of a donor.
    Nothing but the design is read."""
    index = simulate.indices(spark)
    known = materialize(simulate.alleles(spark), "simulated")
    reads = materialize(simulate.reads(spark, known, index), "simulated")
    cases = exact.demultiplex(reads, index)
    return cases.groupBy("case").agg(F.count("*").alias("n"), F.count_distinct(F.regexp_replace("name", r"_read\d+$", "")).alias("templates"))


# --- exact search with options


def _thresholds(spark, d):
    """First alleles need 0.3, D genes 0.2: (name, ratio)."""
    db = _alleles(spark, d)
    first = db.where("name LIKE '%*01'").select("name", F.lit(0.3).alias("ratio"))
    return first.unionByName(db.where("name LIKE '___D%'").select(gene_of("name").alias("name"), F.lit(0.2).alias("ratio")).distinct())


def _novel(spark, d):
    return table(spark, d, "fasta").where("file LIKE '%novel%' AND seq IS NOT NULL").select("name", "seq")


def exact_thresholds(spark, d):
    return exact.above_thresholds(core.exact_counts(spark, d), _thresholds(spark, d), "ratio")


def exact_exempt(spark, d):
    found = exact.matches(_reads(spark, d), _alleles(spark, d), "V", keep=())
    return exact.exact_search(found, min_count=1, min_ratio=0.5, top=1, exempt=_thresholds(spark, d))


def exact_border(spark, d):
    """Matches whose flank reaches the border are rejected in the search."""
    return exact.exact_search(exact.matches(_reads(spark, d), _alleles(spark, d, "V"), "V", extension=20, border=15), 1, 0.05, 2)


def exact_calibrated(spark, d):
    sizes = materialize(exact.calibrated_extensions(_reads(spark, d), _alleles(spark, d, "J"), "J", 40, 20, 0.75), "extensions")
    found = exact.matches(_reads(spark, d), _alleles(spark, d, "J"), "J", extension=40, border=20, extensions=sizes)
    return exact.exact_search(found, 1, 0.05, 2)


def exact_known(spark, d):
    """Which sequences of FASTA files are known alleles."""
    return exact.flag_known(table(spark, d, "fasta").select("name", F.upper("seq").alias("sequence")), _alleles(spark, d))


def demultiplex_patterns(spark, d):
    """Barcodes whose first base may be any, behind two bases, an array index
    and 24 more, for some cases."""
    idx = core._indices(spark, d)
    loose = idx.select("well", F.concat(F.lit("[ACGT]"), F.substring("forward_index", 2, 100)).alias("forward_index"), F.concat(F.lit("[ACGT]"), F.substring("reverse_index", 2, 100)).alias("reverse_index"), "case")
    coded = core._coded(spark, d).select("name", F.concat(F.lit("GGTACGT"), F.expr("repeat('A', 24)"), "genomic_sequence").alias("genomic_sequence")).distinct()
    return exact.demultiplex(coded, loose, min_length=100, array="TACG[TA]", case_filter="[A-Z]+.*[0-4]$")


def demultiplex_array(spark, d):
    """The same with literal barcodes and no filter."""
    coded = core._coded(spark, d).select("name", F.concat(F.lit("GGTACGT"), F.expr("repeat('A', 24)"), "genomic_sequence").alias("genomic_sequence")).distinct()
    return exact.demultiplex(coded, core._indices(spark, d), array="TACGT")


def reads_unambiguous(spark, d):
    return patterns.unambiguous(_reads(spark, d)).select("name", "genomic_sequence").distinct()


def motif_probability(spark, d):
    h = table(spark, d, "heptamer").select(F.trim("heptamer").alias("h"))
    return exact.motif_probability(h, "h", core.pwm_profile(spark, d)).select("motif", F.round("probability", 9).alias("probability"))


def motif_windows(spark, d):
    """Where each allele has a heptamer motif, one substitution allowed."""
    motifs = spark.createDataFrame([(k, m) for k, v in HEPTAMERS.items() for m in v], "locus string, motif string")
    db = _alleles(spark, d).withColumn("locus", F.left("name", F.lit(4)))
    hits = db.join(motifs, "locus").select("name", "motif", F.explode(windows_within("seq", F.col("motif"), 1)).alias("w"))
    return hits.select("name", "motif", F.col("w.start").cast("long").alias("start"), F.col("w.distance").cast("long").alias("distance"))


def gene_types(spark, d):
    one = lambda g: _alleles(spark, d, parse_gene_type(g)).select("name", F.lit(parse_gene_type(g)).alias("kind"))
    return one("v").unionByName(one("D")).unionByName(one(" j "))


# --- discovery


def allele_affixes(spark, d):
    """What the reads with an allele have in common on either side."""
    return discovery.affixes(_reads(spark, d), _alleles(spark, d), 13, 13)


def _segments(spark, d):
    return discovery.segment_clusters(table(spark, d, "blast"), _reads(spark, d), min_edge=1, min_scov=0.1, max_distance=10)


def discover_clusters(spark, d):
    return _segments(spark, d)


def discover_named(spark, d):
    rows = discovery.selected(discovery.untrimmed(_segments(spark, d)), min_count=1, min_ratio=0.1, min_length=30, max_distance=8)
    return discovery.named(rows, _alleles(spark, d))


def discover_cores(spark, d):
    """The whole path from reads: aligned to the extended alleles, clustered,
    trimmed and named."""
    parts = materialize(allele_affixes(spark, d), "affixes")
    db = discovery.combined(discovery.extended(parts), _alleles(spark, d).where("name LIKE '%*9%'"))
    hits = materialize(aligner.search(_reads(spark, d), "name", "genomic_sequence", db, best=True), "hits")
    clusters = materialize(discovery.segment_clusters(hits, _reads(spark, d)), "clusters")
    rows = materialize(discovery.selected(discovery.cores(clusters, parts), min_count=1, min_ratio=0.1), "cores")
    return discovery.named(rows, _alleles(spark, d)).select("well", "case", "sseqid", "allele_name", "full_count", "full_ratio", "aln_qseq", "aln_mismatch", "corecov")


def align_reads(spark, d):
    """Reads aligned to all alleles, without outside programs."""
    return aligner.search(_reads(spark, d), "name", "genomic_sequence", _alleles(spark, d))


def trim_statistics(spark, d):
    coded = core._coded(spark, d).join(core._indices(spark, d).select("well", "forward_index", "reverse_index", "case"), "well")
    return discovery.trim_statistics(core.trimming.trimmed(coded, "genomic_sequence", "forward_index", "reverse_index", "plain"), "case")


def gapless(spark, d):
    return table(spark, d, "blast").where("qseq IS NOT NULL").select("qseq", without_gaps("qseq").alias("plain")).distinct()


def d_training(spark, d):
    known = exact.exact_search(exact.matches(_reads(spark, d), _alleles(spark, d, "D"), "D"), 1, 0.0, 1000)
    return dscan.training_rows(known)


def d_annotated(spark, d):
    """D segments, here exact matches with the base behind them, annotated and
    collapsed like scanned ones."""
    found = exact.matches(_reads(spark, d), _alleles(spark, d, "D"), "D")
    rows = found.where("post_heptamer <> ''").select("well", "case", F.concat("sequence", F.left("post_heptamer", F.lit(1))).alias("d_sequence"), "pre_heptamer", "post_heptamer")
    marked = dscan.annotated(rows.distinct(), _alleles(spark, d, "D"))
    out = dscan.collapsed(marked, "pre_heptamer", ["pre_heptamer", "post_heptamer"])
    return out.select("well", "case", "sequence", "count", "pre_heptamer", "post_heptamer", "isin_db", "db_name", "nearest_db", "nearest_db_dist", "allele_name", "gene", "ratio")


def d_discovered(spark, d):
    """D alleles of all reads by the model trained on the exact matches."""
    parts = materialize(d_training(spark, d), "training")
    return dscan.discovered(_reads(spark, d), _alleles(spark, d, "D"), dscan.train(parts), 0.5, 1, 0.1)


def genome_check(spark, d):
    """Alleles against the FASTA records as a genome; those whose first letter
    of the file name is in the first half lie on the chromosome asked for."""
    contigs = table(spark, d, "fasta").where("seq <> ''").groupBy("name").agg(F.min("file").alias("genome"), F.min("seq").alias("seq"))
    described = contigs.withColumn("description", F.concat(F.lit("chromosome "), F.when(F.col("genome") < "n", "14").otherwise("2"), F.lit(" Primary Assembly")))
    return genome.checked(_alleles(spark, d), "name", genome.concatenated(["seq"]), described, "chromosome 14")


# --- cohort


def cooccurrence_significance(spark, d):
    e = core.cooccurrence_edges(spark, d)
    return e.select("allele_a", "allele_b", F.round("p_enrich", 6).alias("p"), F.round("q_enrich", 6).alias("q"))


def _edges(spark, d):
    return core.cooccurrence_edges(spark, d)


def cooccurrence_details(spark, d):
    groups = clusters.clusters(_edges(spark, d), 0.3, 2)
    return clusters.cluster_details(groups, table(spark, d, "haplotype"), "case", ["allele_1", "allele_2"])


def cooccurrence_complete(spark, d):
    return clusters.clusters(_edges(spark, d), 0.3, 2, "complete")


def cooccurrence_average(spark, d):
    return clusters.clusters(_edges(spark, d), 0.3, 2, "average")


def cooccurrence_strong(spark, d):
    return clusters.strong_edges(_edges(spark, d).withColumn("rho", F.round("rho", 9)), 0.5, 20)


def haplotype_extended(spark, d):
    return cohort.haplotype_input(core.exact_d(spark, d))


def haplotype_novel(spark, d):
    """Calls whose alleles are among the novel records."""
    calls = table(spark, d, "haplotype").select("case", "gene", "allele_1", "allele_2").distinct()
    return cohort.novel_flags(calls, _novel(spark, d))


def haplotype_summary(spark, d):
    return cohort.genotype_summary(table(spark, d, "haplotype"))


# --- sets of sequences


def keyset_conflicts(spark, d):
    return keysets.conflicts(table(spark, d, "fasta").where("seq <> ''").select(F.upper("seq").alias("seq"), "name"), "seq", "name")


def keyset_equality(spark, d):
    """Comparisons of both sets with themselves and each other."""
    a, b = (materialize(x, "set") for x in core._sets(spark, d))
    key = a.agg(F.min("key")).first()[0]
    rows = [("same", keysets.equal(a, a)), ("other", keysets.equal(a, b)), ("has", key is not None and keysets.has(a, key)), ("lacks", keysets.has(a, "no such key"))]
    return spark.createDataFrame(rows, "test string, outcome boolean")


def fasta_diff_names(spark, d):
    a, b = core._sets(spark, d)
    return keysets.diff_names({"fasta": a, "known": b})


def fasta_merge_named(spark, d):
    return keysets.merge(table(spark, d, "fasta"), "name", "seq", "file", "first", " +[Nn]ovel", "description", prefix=True)


def fasta_merge_report(spark, d):
    return keysets.merge_report(table(spark, d, "fasta"), "name", "seq", "file")


def fasta_export_capture(spark, d):
    return keysets.export(table(spark, d, "fasta"), "name", "seq", "description", "file", description_filter=r"(\w+)$", min_cases=1, unique_sequences=True, sort=True)


def fasta_export_columns(spark, d):
    """A header and a sequence of two columns."""
    return keysets.export(table(spark, d, "heptamer"), "db_name", ["sequence", "heptamer"], case="file", min_cases=2)


# --- older methods


def legacy_tags(spark, d):
    """Tags at the end of reads, and both halves of them."""
    rows = _reads(spark, d).where("genomic_sequence IS NOT NULL").select("genomic_sequence").distinct()
    tag, (a, b) = patterns.umi("genomic_sequence"), patterns.halves("genomic_sequence")
    return rows.select("genomic_sequence", *[x.alias(f"tag_{i}") for i, x in enumerate(tag)], a.alias("half_1"), b.alias("half_2"))


def longest_common(spark, d):
    """The longest stretch that each FASTA record and the first allele of its
    gene have in common."""
    first = _alleles(spark, d).groupBy(gene_of("name").alias("gene")).agg(F.min_by("seq", "name").alias("first"))
    rows = table(spark, d, "fasta").where("seq IS NOT NULL").select("name", F.upper("seq").alias("seq"), gene_of("name").alias("gene")).distinct().join(first, "gene")
    return rows.select("name", "seq", patterns.longest_common_substring("seq", "first").alias("common"))


def hamming_search(spark, d):
    found = patterns.hamming_matches(_reads(spark, d), _alleles(spark, d, "D"), 1)
    return found.select("well", "case", "read", "closest_name", "distance", "start", "stop", "prefix", "middle", "suffix", "db_sequence")


def hamming_summary(spark, d):
    db = _alleles(spark, d, "D")
    return patterns.hamming_summary(patterns.hamming_matches(_reads(spark, d), db, 1), db, 0.25, 2)


def frequent_flanks(spark, d):
    return patterns.frequent_flanks(_reads(spark, d), _alleles(spark, d), min_count=2)


def flank_hits(spark, d):
    """Texts between flanks that are frequent around D genes."""
    db = _alleles(spark, d, "D")
    flanks = materialize(patterns.frequent_flanks(_reads(spark, d), db, 8, 4, 2), "flanks")
    return patterns.between_flanks(_reads(spark, d), flanks, 10, 20, 8, 40)


def flank_alleles(spark, d):
    return patterns.annotate(materialize(flank_hits(spark, d), "hits"), _alleles(spark, d, "D"))


def gene_fragments(spark, d):
    return patterns.gene_fragments(_alleles(spark, d), 15, 15)


def fragment_segments(spark, d):
    fragments = materialize(gene_fragments(spark, d), "fragments")
    return patterns.trim_by_distance(_reads(spark, d), _alleles(spark, d), fragments).groupBy("gene", "case", "sequence").agg(F.count("*").alias("n"))


def pattern_alleles(spark, d):
    """By fragments of each gene's own, without those on a blacklist."""
    return patterns.search_patterns(_reads(spark, d), _alleles(spark, d), _alleles(spark, d).where("name LIKE '%*9%'"), 15, 18)


def profile_alleles(spark, d):
    """By combinations of k-mers and profiles of the alleles' ends."""
    return patterns.discover_by_combinations(_reads(spark, d), _alleles(spark, d, "V"), 9, 3, 50, min_length=20, min_count=1)


QUERIES = {f.__name__: f for f in (
    io_tsv, io_tsv_plain, io_reads, io_reads_limit, io_fasta, io_fasta_check, io_identifiers, io_fastq, io_by_case, io_glob, io_indices, io_motifs, io_alignments, io_thresholds, io_query_fasta,
    io_novel, io_extended, io_names, simulated, exact_thresholds, exact_exempt, exact_border, exact_calibrated, exact_known, demultiplex_patterns, demultiplex_array, reads_unambiguous, motif_probability,
    motif_windows, gene_types, allele_affixes, discover_clusters, discover_named, discover_cores, align_reads, trim_statistics, gapless, d_training, d_annotated, d_discovered, genome_check,
    cooccurrence_significance, cooccurrence_details, cooccurrence_complete, cooccurrence_average, cooccurrence_strong, haplotype_extended, haplotype_novel, haplotype_summary, keyset_conflicts,
    keyset_equality, fasta_diff_names, fasta_merge_named, fasta_merge_report, fasta_export_capture, fasta_export_columns, legacy_tags, longest_common, hamming_search, hamming_summary,
    frequent_flanks, flank_hits, flank_alleles, gene_fragments, fragment_segments, pattern_alleles, profile_alleles,
)}


_THRESHOLDS = "SELECT name, 0.3::DOUBLE AS ratio FROM allele_db WHERE name LIKE '%*01' UNION ALL SELECT DISTINCT split_part(name, '*', 1), 0.2 FROM allele_db WHERE name LIKE '___D%'"
_NOVEL = "SELECT DISTINCT name FROM fasta WHERE file LIKE '%novel%' AND seq IS NOT NULL"
_VALID = f"coalesce(regexp_matches(name, '{files.IDENTIFIER}') AND length(name) - length(replace(name, '_', '')) <= 1 AND length(name) - length(replace(name, '*', '')) <= 1, false)"
_S, _E, _N = "instr(d.genomic_sequence, a.seq)", "(instr(d.genomic_sequence, a.seq) + length(a.seq) - 1)", "length(d.genomic_sequence)"
_FREE = f"(CASE WHEN db_name IN (SELECT name FROM ({_THRESHOLDS})) OR gene IN (SELECT name FROM ({_THRESHOLDS})) THEN 0 ELSE 0.5 END)"
_SIZES = core.SQL["border_extensions"]
_OWN = "(SELECT extension FROM sizes WHERE sizes.gene = split_part({}, '*', 1))"
_CALIBRATED = {"prefix": core._cut(f"greatest(1, s - {_OWN.format('db_name')})", "s - 1"), "suffix": core._cut("e + 1", "least(e + 13, n)")}
_CALIBRATED |= {f"{k}_len": f"length({v})" for k, v in _CALIBRATED.items()}
_CODED = "i AS (SELECT *, row_number() OVER () AS well FROM indices), r AS (SELECT DISTINCT d.name, i.forward_index || d.genomic_sequence || i.reverse_index AS s FROM demultiplex d JOIN i ON d.well = i.well WHERE d.genomic_sequence IS NOT NULL)"
_lcs = lambda a, b: f"reverse({core._lcp(f'reverse({a})', f'reverse({b})')})"
_AFFIXES = f"""WITH RECURSIVE p AS (SELECT a.name AS db_name, a.seq AS sequence, d.name AS o, genomic_sequence AS r, instr(genomic_sequence, a.seq) AS s FROM demultiplex d JOIN (SELECT DISTINCT name, seq FROM allele_db) a ON instr(genomic_sequence, a.seq) > 0 WHERE a.seq <> ''),
  x AS (SELECT db_name, sequence, substr(r, greatest(1, s - 13), s - greatest(1, s - 13)) AS p, substr(r, s + length(sequence), 13) AS q, row_number() OVER (PARTITION BY db_name, sequence ORDER BY o NULLS FIRST, r) AS n FROM p),
  f AS (SELECT * FROM x WHERE n = 1 UNION ALL SELECT x.db_name, x.sequence, CASE WHEN f.p = '' THEN x.p ELSE {_lcs('f.p', 'x.p')} END, CASE WHEN f.p = '' THEN x.q ELSE {core._lcp('f.q', 'x.q')} END, x.n
    FROM f JOIN x ON x.db_name = f.db_name AND x.sequence = f.sequence AND x.n = f.n + 1),
  l AS (SELECT db_name, sequence, arg_max(p, n) AS p, arg_max(q, n) AS q FROM f GROUP BY 1, 2),
  affixes AS (SELECT DISTINCT name AS db_name, seq AS sequence, coalesce(p, '') AS prefix, coalesce(q, '') AS suffix FROM allele_db LEFT JOIN l ON name = db_name AND seq = sequence)"""
_SEGMENTS = """WITH b AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, qcovhsp DESC, qcovs DESC, bitscore DESC, sseqid, qstart, sstart) AS k FROM blast WHERE sseqid IS NOT NULL AND qseq IS NOT NULL),
  d AS (SELECT name, well, "case", genomic_sequence, row_number() OVER (PARTITION BY name ORDER BY well NULLS FIRST, "case" NULLS FIRST, genomic_sequence NULLS FIRST) AS k FROM demultiplex),
  h AS (SELECT d.well, d."case", sseqid, replace(qseq, '-', '') AS qseq, mismatch, b.length AS n, slen, genomic_sequence AS g FROM b JOIN d ON qseqid = d.name AND b.k = 1 AND d.k = 1),
  i AS (SELECT *, instr(g, qseq) AS f FROM h), j AS (SELECT * FROM i WHERE f >= 1 AND length(g) - (f + length(qseq) - 1) >= 1 AND n > 0.1 * slen AND NOT starts_with(sseqid, 'P')),
  c AS (SELECT well, "case", sseqid, qseq, mismatch, count(*) AS full_count, split_part(sseqid, '*', 1) AS gene FROM j WHERE mismatch <= 10 GROUP BY ALL),
  segments AS (SELECT *, full_count::DOUBLE / max(full_count) OVER (PARTITION BY well, "case", gene) AS full_ratio FROM c)"""
_hash = lambda name, s: f"split_part({name}, '_', 1) || '_' || {core._HASH.replace('md5(seq)', f'md5({s})')}"
_PARTS = ["pre_nonamer", "pre_spacer", "pre_heptamer", "post_heptamer", "post_spacer", "post_nonamer"]
_KNOWN_D = core._exact_sql(core._type("D"), core._D, 1, 0.0, 1000)
_COMPONENTS = f"""{core._EDGES}, g AS (SELECT *, CASE WHEN v <= 0 THEN 0 ELSE o / sqrt(v) END AS rho FROM e WHERE n_shared >= 3 AND jaccard >= 0.05),
  u AS (SELECT allele_a AS x, allele_b AS y FROM g WHERE rho >= 0.3 UNION SELECT allele_b, allele_a FROM g WHERE rho >= 0.3),
  reach AS (SELECT x, x AS y FROM u UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x),
  groups AS (SELECT min(y) AS group_id, x AS allele FROM reach GROUP BY x)"""
_choose = lambda n, r: f"(lgamma({n} + 1) - lgamma({r} + 1) - lgamma({n} - {r} + 1))"
_HAMMING = """WITH w AS (SELECT DISTINCT genomic_sequence AS r FROM demultiplex WHERE genomic_sequence <> '' AND NOT contains(genomic_sequence, 'N')),
  c AS (SELECT r, name, seq FROM w JOIN (SELECT DISTINCT name, seq FROM allele_db WHERE substr(name, 4, 1) = 'D') a ON contains(r, left(seq, length(seq) // 2)) OR contains(r, substr(seq, length(seq) // 2 + 1))),
  x AS (SELECT r, name, seq, i, hamming(substr(r, i, length(seq)), seq) AS d FROM c, range(1, length(r) - length(seq) + 2) t(i)),
  b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, name, i, seq) AS k FROM x WHERE d <= 1),
  f AS (SELECT well, "case", r AS read, b.name AS closest_name, d AS distance, i AS start, i + length(seq) - 1 AS stop, substr(r, i - 7, 7) AS prefix, substr(r, i, length(seq)) AS middle, substr(r, i + length(seq), 7) AS suffix, seq AS db_sequence
        FROM b JOIN demultiplex ON genomic_sequence = r WHERE k = 1 AND i - 7 > 0 AND length(r) > i + length(seq) + 6)"""


def _flank_sql(where: str, least: int, count: int, wells: int) -> str:
    return f"""p AS (SELECT d.well, d."case", genomic_sequence AS r, a.name, a.seq, instr(genomic_sequence, a.seq) AS s FROM demultiplex d JOIN (SELECT DISTINCT name, seq FROM allele_db a WHERE length(seq) >= {least} {where}) a ON instr(genomic_sequence, a.seq) > 0),
  q AS (SELECT name, well, "case", 'prefix' AS side, substr(r, greatest(1, s - 7), s - greatest(1, s - 7)) AS flank FROM p UNION ALL SELECT name, well, "case", 'suffix', substr(r, s + length(seq), 7) FROM p),
  k AS (SELECT name, well, "case", side, flank FROM q GROUP BY ALL HAVING count(*) >= {count}), flanks AS (SELECT side, flank, count(*) AS wells FROM k GROUP BY 1, 2 HAVING count(*) >= {wells})"""


_FRAGMENTS = """own AS (SELECT DISTINCT split_part(name, '*', 1) AS gene, name, seq FROM allele_db WHERE seq <> ''), w AS (SELECT gene, name, seq, substr(seq, i, 15) AS f FROM own, range(1, length(seq) - 13) t(i)),
  one AS (SELECT gene, name, seq, f FROM w GROUP BY ALL HAVING count(*) = 1), every AS (SELECT gene, f FROM one GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM own WHERE own.gene = one.gene)),
  fragments AS (SELECT gene, f AS fragment FROM every WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.f = every.f AND w.gene <> every.gene))"""

SQL = {
    "io_tsv": "SELECT qseqid, sseqid, pident, length, sstrand FROM blast",
    "io_tsv_plain": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "io_reads": """SELECT well, nullif("case", '') AS "case", nullif(name, '') AS name, nullif(genomic_sequence, '') AS genomic_sequence FROM demultiplex""",
    "io_reads_limit": """SELECT well, nullif("case", '') AS "case", nullif(name, '') AS name, nullif(genomic_sequence, '') AS genomic_sequence FROM (SELECT * FROM demultiplex ORDER BY name NULLS FIRST, well NULLS FIRST, "case" NULLS FIRST, genomic_sequence NULLS FIRST LIMIT 100)""",
    "io_fasta": r"SELECT split_part(h, ' ', 1) AS name, trim(regexp_replace(h, '^\S+', '')) AS description, seq FROM (SELECT trim(concat_ws(' ', name, description)) AS h, seq FROM fasta WHERE seq <> '')",
    "io_fasta_check": f"""SELECT * FROM (SELECT 'empty name' AS problem, count(*) FILTER (coalesce(name = '', true)) AS n FROM fasta UNION ALL SELECT 'empty sequence', count(*) FILTER (coalesce(seq = '', true)) FROM fasta
      UNION ALL SELECT 'bad identifier', count(*) FILTER (NOT {_VALID}) FROM fasta UNION ALL SELECT 'other characters', count(*) FILTER (NOT regexp_full_match(seq, '[ACGT]*')) FROM fasta
      UNION ALL SELECT 'repeated name', count(*) FROM (SELECT name FROM fasta WHERE name <> '' GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated sequence', count(*) FROM (SELECT seq FROM fasta WHERE seq <> '' GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""",
    "io_identifiers": f"SELECT DISTINCT name, {_VALID} AS valid FROM fasta",
    "io_fastq": "SELECT split_part(name, ' ', 1) AS name, genomic_sequence AS seq, repeat('@', length(genomic_sequence)) AS quality FROM demultiplex WHERE genomic_sequence <> ''",
    "io_by_case": 'SELECT "case", count(*) AS n FROM demultiplex WHERE genomic_sequence <> \'\' AND "case" IS NOT NULL GROUP BY 1',
    "io_glob": "SELECT name, seq, left(name, 3) || '.tsv.gz' AS file FROM allele_db WHERE left(name, 3) IN ('IGH', 'IGK', 'IGL')",
    "io_indices": 'SELECT row_number() OVER () AS well, forward_index, reverse_index, "case" FROM indices',
    "io_motifs": f"SELECT * FROM (VALUES {core._MOTIFS}) v(locus, motif)",
    "io_alignments": f"SELECT {', '.join(files.ALIGNMENTS.names)} FROM blast",
    "io_thresholds": _THRESHOLDS,
    "io_query_fasta": "SELECT name, trim(concat_ws(' ', coalesce(CAST(well AS VARCHAR), ''), coalesce(\"case\", ''))) AS description, genomic_sequence AS seq FROM demultiplex WHERE genomic_sequence <> ''",
    "io_novel": _NOVEL,
    "io_extended": f"{_AFFIXES} SELECT db_name AS name, prefix || sequence || suffix AS seq FROM affixes",
    "io_names": r"SELECT DISTINCT file, regexp_extract(file, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, regexp_replace(file, '([^/])\.[^./]*$', '\1') || '.tsv' AS renamed FROM fasta",
    "simulated": "SELECT * FROM (VALUES ('Donor1', 1000::BIGINT, 10::BIGINT), ('Donor2', 1000, 10)) v(\"case\", n, templates)",
    "exact_thresholds": f"{core._COUNTS}, t AS ({_THRESHOLDS}) SELECT exact.* FROM exact LEFT JOIN t a ON db_name = a.name LEFT JOIN t g ON gene = g.name WHERE exact.ratio >= coalesce(a.ratio, g.ratio, 0)",
    "exact_exempt": f"{core._exact_sql('', {}, 1, _FREE, 1)} SELECT * FROM exact",
    "exact_border": f"{core._exact_sql(core._type('V') + f' AND NOT ({_E} + 1 <= least({_E} + 20, {_N}) AND least({_E} + 20, {_N}) >= greatest(1, {_N} - 14))', core._EXT, 1, 0.05, 2)} SELECT * FROM exact",
    "exact_calibrated": core._exact_sql(core._type("J") + f" AND greatest(1, {_S} - {_OWN.format('a.name')}) > least(20, {_N})", _CALIBRATED, 1, 0.05, 2).replace("WITH p AS", f"WITH sizes AS ({_SIZES}), p AS", 1) + " SELECT * FROM exact",
    "exact_known": "SELECT name, upper(seq) AS sequence, coalesce(upper(seq) IN (SELECT seq FROM allele_db WHERE seq IS NOT NULL), false) AS isin_db FROM fasta",
    "demultiplex_patterns": f"""WITH {_CODED}, m AS (SELECT r.name, min(i.well) AS well FROM r JOIN i ON left(s, 1) IN ('A', 'C', 'G', 'T') AND starts_with(substr(s, 2), substr(forward_index, 2)) AND ends_with(s, substr(reverse_index, 2))
        AND substr(s, length(s) - length(reverse_index) + 1, 1) IN ('A', 'C', 'G', 'T') WHERE length(s) + 31 >= 100 GROUP BY 1)
      SELECT m.name, m.well, i."case" FROM m JOIN i USING (well) WHERE regexp_matches(i."case", '^(?:[A-Z]+.*[0-4]$)')""",
    "demultiplex_array": f"""WITH {_CODED}, m AS (SELECT r.name, min(i.well) AS well FROM r JOIN i ON starts_with(s, forward_index) AND ends_with(s, reverse_index) GROUP BY 1) SELECT m.name, m.well, i."case" FROM m JOIN i USING (well)""",
    "reads_unambiguous": "SELECT DISTINCT name, genomic_sequence FROM demultiplex WHERE regexp_full_match(genomic_sequence, '[ACGT]+')",
    "motif_probability": f"""WITH w AS ({core.SQL['pwm_profile']}), o AS (SELECT DISTINCT trim(heptamer) AS motif FROM heptamer WHERE trim(heptamer) <> '' AND length(trim(heptamer)) <= 7),
      l AS (SELECT motif, i - 1 AS pos, upper(substr(motif, i, 1)) AS base FROM o, range(1, length(motif) + 1) t(i))
      SELECT motif, round(CASE WHEN bool_or(l.base = '-') THEN 0 ELSE exp(coalesce(sum(ln(p)), 0)) END, 9) AS probability FROM l LEFT JOIN w ON l.pos = w.pos AND l.base = w.base GROUP BY 1""",
    "motif_windows": f"""WITH q AS (SELECT * FROM (VALUES {core._MOTIFS}) v(locus, motif)), x AS (SELECT name, motif, i AS start, hamming(substr(seq, i, 7), motif) AS distance FROM allele_db JOIN q ON locus = left(name, 4), range(1, length(seq) - 5) t(i))
      SELECT * FROM x WHERE distance <= 1""",
    "gene_types": "SELECT name, substr(name, 4, 1) AS kind FROM allele_db WHERE substr(name, 4, 1) IN ('V', 'D', 'J')",
    "allele_affixes": f"{_AFFIXES} SELECT * FROM affixes",
    "discover_clusters": f"{_SEGMENTS} SELECT * FROM segments",
    "discover_named": f"""{_SEGMENTS} SELECT *, qseq AS aln_qseq, mismatch AS aln_mismatch, CASE WHEN mismatch = 0 THEN sseqid ELSE coalesce((SELECT min(name) FROM allele_db WHERE contains(seq, qseq)), {_hash('sseqid', 'qseq')}) END AS allele_name
      FROM segments WHERE full_count >= 1 AND full_ratio >= 0.1 AND length(qseq) >= 30 AND mismatch BETWEEN 0 AND 8""",
    "gapless": "SELECT DISTINCT qseq, replace(qseq, '-', '') AS plain FROM blast WHERE qseq IS NOT NULL",
    "d_training": f"""{_KNOWN_D}, t AS (SELECT "case", gene, sequence, db_name, CAST(sum("count") AS BIGINT) AS case_count FROM exact GROUP BY ALL), u AS (SELECT *, case_count::DOUBLE / max(case_count) OVER (PARTITION BY "case", gene) AS case_ratio FROM t),
      v AS (SELECT *, max(case_count) OVER (PARTITION BY "case", gene, sequence) AS best FROM u WHERE case_ratio >= 0.2), w AS (SELECT *, dense_rank() OVER (PARTITION BY "case", gene ORDER BY best DESC, sequence) AS place FROM v)
      SELECT w."case", gene, w.db_name, w.sequence, case_count, case_ratio, {', '.join(_PARTS)} FROM w JOIN (SELECT DISTINCT db_name, sequence, {', '.join(_PARTS)} FROM exact) f ON w.db_name = f.db_name AND w.sequence = f.sequence WHERE place <= 2""",
    "d_annotated": f"""WITH a AS (SELECT DISTINCT name, seq FROM allele_db WHERE substr(name, 4, 1) = 'D'), p AS (SELECT well, "case", genomic_sequence AS r, seq, instr(genomic_sequence, seq) AS s FROM demultiplex JOIN a ON instr(genomic_sequence, seq) > 0),
      q AS (SELECT well, "case", seq, r, s, s + length(seq) - 1 AS e, length(r) AS n FROM p),
      x AS (SELECT DISTINCT well, "case", substr(r, s, length(seq) + 1) AS sequence, {core._D['pre_heptamer']} AS pre_heptamer, {core._D['post_heptamer']} AS post_heptamer FROM q WHERE {core._D['post_heptamer']} <> ''),
      y AS (SELECT sequence, (SELECT max(name) FROM a WHERE seq = sequence) AS own, (SELECT arg_min(name, printf('%06d', levenshtein(sequence, seq)) || name) FROM a) AS nearest_db FROM (SELECT DISTINCT sequence FROM x)),
      z AS (SELECT y.*, (SELECT min(levenshtein(y.sequence, seq)) FROM a WHERE name = nearest_db) AS nearest_db_dist FROM y),
      g AS (SELECT well, "case", sequence, pre_heptamer, post_heptamer, count(*) OVER w AS "count", row_number() OVER (w ORDER BY pre_heptamer, post_heptamer) AS k FROM x WINDOW w AS (PARTITION BY well, "case", sequence))
      SELECT well, "case", g.sequence, "count", pre_heptamer, post_heptamer, own IS NOT NULL AS isin_db, coalesce(own, 'Novel') AS db_name, nearest_db, nearest_db_dist,
        CASE WHEN own IS NOT NULL OR nearest_db_dist = 0 THEN nearest_db ELSE {_hash('nearest_db', 'g.sequence')} END AS allele_name, split_part(nearest_db, '*', 1) AS gene,
        "count"::DOUBLE / max("count") OVER (PARTITION BY well, "case", split_part(nearest_db, '*', 1)) AS ratio FROM g JOIN z ON g.sequence = z.sequence WHERE k = 1""",
    "cooccurrence_significance": f"""{core._EDGES}, g AS (SELECT allele_a, allele_b, n_shared AS k, n_a, n_b, CAST((SELECT n FROM t) AS BIGINT) AS n FROM e WHERE n_shared >= 3 AND jaccard >= 0.05),
      h AS (SELECT allele_a, allele_b, least(1, list_sum(list_transform(range(greatest(k, n_b - n_a, 0), least(n, n_b) + 1), lambda i: exp({_choose('n', 'i')} + {_choose('n_a', '(n_b - i)')} - {_choose('(n + n_a)', 'n_b')})))) AS p FROM g),
      c AS (SELECT p, count(*) AS c FROM h GROUP BY 1), r AS (SELECT p, p * (SELECT count(*) FROM h) / sum(c) OVER (ORDER BY p) AS q FROM c), m AS (SELECT p, least(1, min(q) OVER (ORDER BY p DESC)) AS q FROM r)
      SELECT allele_a, allele_b, round(p, 6) AS p, round(q, 6) AS q FROM h JOIN m USING (p)""",
    "cooccurrence_clusters": f"{_COMPONENTS} SELECT * FROM groups",
    "cooccurrence_details": f"""{_COMPONENTS}, l AS (SELECT DISTINCT "case" AS c, trim(a) AS a FROM (SELECT "case", allele_1 AS a FROM haplotype UNION ALL SELECT "case", allele_2 FROM haplotype) WHERE "case" IS NOT NULL AND trim(a) <> '')
      SELECT group_id, allele, string_agg(c, ',' ORDER BY c) AS donors, count(*) AS n_donors FROM groups JOIN l ON a = allele GROUP BY 1, 2""",
    "cooccurrence_strong": f"""{_COMPONENTS}, h AS (SELECT allele_a, allele_b, round(rho, 9) AS rho FROM g) SELECT allele_a, allele_b, rho, (SELECT count(*) FROM h WHERE rho >= 0.5) AS n_all FROM h WHERE rho >= 0.5 ORDER BY 1, 2 LIMIT 20""",
    "haplotype_extended": f"""{core._exact_sql(core._type('D'), core._D, 1, 0.05, 2)} SELECT "case", gene, db_name, {' || '.join(_PARTS[:3])} || sequence || {' || '.join(_PARTS[3:])} AS sequence, full_count AS "count" FROM exact""",
    "haplotype_novel": rf"""WITH n AS ({_NOVEL}) SELECT DISTINCT "case", gene, allele_1, allele_2, coalesce(regexp_replace(allele_1, '_\d+$', '') IN (SELECT name FROM n), false) AS novel_1, coalesce(regexp_replace(allele_2, '_\d+$', '') IN (SELECT name FROM n), false) AS novel_2 FROM haplotype""",
    "haplotype_summary": "SELECT genotype, count(*) AS n, CAST(round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM haplotype), 1) AS DOUBLE) AS percent FROM haplotype GROUP BY 1",
    "keyset_conflicts": """SELECT upper(seq) AS key, count(*) AS "rows", count(DISTINCT name) AS "values", min(name) AS kept FROM fasta WHERE seq <> '' GROUP BY 1 HAVING count(*) > 1""",
    "keyset_equality": "SELECT * FROM (VALUES ('same', true), ('other', false), ('has', true), ('lacks', false)) v(test, outcome)",
    "fasta_diff_names": f"""{core._BOTH} SELECT 'fasta' AS file_a, 'known' AS file_b, 'left_only' AS op, value AS name FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'fasta', 'known', 'right_only', value FROM b WHERE key NOT IN (SELECT key FROM a)""",
    "fasta_merge_named": r"""WITH x AS (SELECT CASE WHEN coalesce(description, '') = '' OR description = name THEN name ELSE name || ' ' || description END AS n, seq, file FROM fasta WHERE seq IS NOT NULL),
      y AS (SELECT regexp_replace(regexp_extract(file, '([^/]+)$', 1), '\.[^.]*$', '') || '_' || CASE WHEN regexp_matches(n, ' +[Nn]ovel') THEN trim(regexp_replace(n, ' +[Nn]ovel', '', 'g')) ELSE n END AS name, seq, file FROM x)
      SELECT name, seq FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY file, name) AS k FROM y) WHERE k = 1""",
    "fasta_merge_report": "SELECT seq, count(*) AS n, string_agg(coalesce(name, '') || ' (from ' || coalesce(file, '') || ')', '; ' ORDER BY file, name) AS names FROM fasta WHERE seq IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "fasta_export_capture": r"""WITH k AS (SELECT name, seq, min(description) AS description FROM fasta WHERE seq IS NOT NULL AND name IS NOT NULL AND regexp_matches(description, '(\w+)$') GROUP BY 1, 2),
      u AS (SELECT seq, name, description, row_number() OVER (PARTITION BY seq ORDER BY name) AS r FROM k) SELECT concat_ws(' ', name, regexp_extract(description, '(\w+)$', 1)) AS header, seq FROM u WHERE r = 1""",
    "fasta_export_columns": "SELECT db_name AS header, coalesce(sequence, '') || coalesce(heptamer, '') AS seq FROM heptamer WHERE (sequence IS NOT NULL OR heptamer IS NOT NULL) AND db_name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT file) >= 2",
    "legacy_tags": "SELECT DISTINCT genomic_sequence, " + ", ".join(f"regexp_extract(genomic_sequence, '{patterns.UMI}', {i}) AS tag_{i - 1}" for i in (1, 2, 3)) + ", left(genomic_sequence, length(genomic_sequence) // 2) AS half_1, substr(genomic_sequence, length(genomic_sequence) // 2 + 1) AS half_2 FROM demultiplex WHERE genomic_sequence IS NOT NULL",
    "hamming_search": f"{_HAMMING} SELECT * FROM f",
    "hamming_summary": f"""{_HAMMING}, g AS (SELECT well, "case", split_part(closest_name, '*', 1) AS gene, prefix, middle, suffix, count(*) AS "count", list_distinct(list(closest_name)) AS names FROM f GROUP BY ALL),
      h AS (SELECT * EXCLUDE (names), unnest(names) AS closest_name FROM g), i AS (SELECT *, max("count") OVER (PARTITION BY well, "case", gene) AS top FROM h)
      SELECT well, "case", gene, prefix, middle, suffix, closest_name, "count", 1::BIGINT AS unique_umi, coalesce((SELECT max(name) FROM allele_db WHERE seq = middle AND substr(name, 4, 1) = 'D'), {_hash('closest_name', 'middle')} || ' Novel') AS allele_name
      FROM i WHERE "count" > top * 0.25 AND "count" >= 2""",
    "frequent_flanks": f"WITH {_flank_sql('', 16, 2, 1)} SELECT * FROM flanks",
    "flank_hits": f"""WITH {_flank_sql(core._type('D'), 8, 4, 2)}, pair AS (SELECT p.flank AS a, s.flank AS b, p.wells * 1000000 + s.wells AS w FROM flanks p, flanks s WHERE p.side = 'prefix' AND s.side = 'suffix'),
      r AS (SELECT row_number() OVER () AS id, well, "case", name, substr(genomic_sequence, 11, length(genomic_sequence) - 20) AS t FROM demultiplex WHERE length(genomic_sequence) > 20),
      h AS (SELECT id, well, "case", name, t, regexp_extract(t, '.*' || a || '(.{{8,40}}?)' || b, 1) AS hit, row_number() OVER (PARTITION BY id ORDER BY w DESC, a, b) AS k FROM r, pair WHERE regexp_matches(t, '.*' || a || '(.{{8,40}}?)' || b))
      SELECT well, "case", name, hit, substr(t, greatest(1, instr(t, hit) - 20), instr(t, hit) - greatest(1, instr(t, hit) - 20)) AS hit_prefix, substr(t, instr(t, hit) + length(hit), 20) AS hit_suffix FROM h WHERE k = 1""",
    "gene_fragments": f"WITH {_FRAGMENTS} SELECT gene, fragment, 15::BIGINT AS k FROM fragments",
    "fragment_segments": f"""WITH {_FRAGMENTS}, s AS (SELECT fragments.gene, fragment, arg_max(instr(seq, fragment) - 1, name) AS b, arg_max(length(seq) - instr(seq, fragment) + 1 - 15, name) AS a FROM fragments JOIN own ON own.gene = fragments.gene AND contains(seq, fragment) GROUP BY 1, 2),
      x AS (SELECT gene, "case", genomic_sequence AS r, instr(genomic_sequence, fragment) AS p, b, a FROM demultiplex JOIN s ON contains(genomic_sequence, fragment))
      SELECT gene, "case", substr(r, p - b, b + 15 + a) AS sequence, count(*) AS n FROM x WHERE p - b >= 1 AND p + 15 + a <= length(r) GROUP BY ALL""",
}
