"""Queries over the reference's own operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import cigar_leading_skip, cigar_span, common_prefix, common_suffix, gene_of, hamming, kmers, reverse_complement, sequence_hash, unique_name
from ..operators import filters, keysets, tables
from ..sources import files
from ..workdir import table
from . import cohort, dscan, exact, trimming

# Heptamer motifs by locus
HEPTAMERS = {
    "IGHV": ["CACAGTG", "CACAATG", "CACAGAG", "CACGGTG", "CACAGCG"],
    "IGLV": ["CACAGTG", "CACGGTG", "CATGGTG", "CACGCTG", "CACAGCG", "CACAGTA", "CATAGTG", "CACAATG"],
    "IGKV": ["CACAGTG", "CACACTG", "CACTGTG", "CACGGTG", "CACAATG", "CACATTG"],
}


def _reads(spark, d):
    return table(spark, d, "demultiplex")


def _alleles(spark, d, gene: str | None = None, locus: str | None = None):
    db = table(spark, d, "allele_db")
    if locus:
        db = db.where(F.col("name").startswith(locus))
    return db.where(F.substring("name", 4, 1) == gene) if gene else db


def exact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: alleles found in reads, counted per case, with ratios."""
    found = exact.matches(_reads(spark, d), _alleles(spark, d), "V", keep=())
    return exact.exact_search(found, min_count=2, min_ratio=0.05, top=1)


def exact_v(spark, d):
    return exact.exact_search(exact.matches(_reads(spark, d), _alleles(spark, d, "V"), "V", keep=("prefix", "heptamer")), 1, 0.05, 3)


def exact_d(spark, d):
    return exact.exact_search(exact.matches(_reads(spark, d), _alleles(spark, d, "D"), "D"), 1, 0.05, 2)


def exact_j(spark, d):
    return exact.exact_search(exact.matches(_reads(spark, d), _alleles(spark, d, "J"), "J", keep=("heptamer", "suffix")), 1, 0.05, 2)


def exact_extension(spark, d):
    return exact.exact_search(exact.matches(_reads(spark, d), _alleles(spark, d, "V"), "V", extension=20), 1, 0.05, 2)


def border_statistics(spark, d):
    return exact.border_statistics(_reads(spark, d), _alleles(spark, d, "V"), "V", 40, 20)


def border_by_gene(spark, d):
    return exact.border_by_gene(border_statistics(spark, d))


def border_extensions(spark, d):
    return exact.calibrated_extensions(_reads(spark, d), _alleles(spark, d, "J"), "J", 40, 20, 0.75)


def fasta_export(spark, d):
    return keysets.export(table(spark, d, "fasta"), "name", "seq", "description", "file", name_filter="^IG[HK]V", description_filter="allele", min_cases=1, cleanup="[*]")


def exact_reference_ratio(spark, d):
    return exact.reference_ratio(exact_counts(spark, d), "IGHV3")


def subject_names(spark, d):
    headers = table(spark, d, "blast").select(F.split_part("sseqid", F.lit("|"), F.lit(1)).alias("subject"))
    return exact.resolve_subjects(headers, "subject", _alleles(spark, d))


def allele_kmers(spark, d):
    """In how many alleles each 8-mer occurs, where that is more than one."""
    return _alleles(spark, d).select(F.explode(kmers("seq", 8)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1")


def allele_common_ends(spark, d):
    """Longest common prefix and suffix of any two alleles of a gene."""
    db = _alleles(spark, d).withColumn("gene", gene_of("name"))
    other = db.select("gene", F.col("name").alias("other"), F.col("seq").alias("_seq"))
    return db.join(other, "gene").where("name < other").select("name", "other", common_prefix("seq", "_seq").alias("prefix"), common_suffix("seq", "_seq").alias("suffix"))


def exact_frequencies(spark, d):
    return exact.frequencies(exact_counts(spark, d), "IGHV", 0.1, 0.1)


def d_scan(spark, d):
    """D genes found in all reads by a model trained on the exact matches."""
    known = exact.matches(_reads(spark, d), _alleles(spark, d, "D"), "D")
    return dscan.scan_reads(dscan.train(known), _reads(spark, d), min_posterior=0.5)


def trim_barcodes(spark, d):
    """Barcodes put on all reads and trimmed again by alignment."""
    coded = _coded(spark, d).join(_indices(spark, d).select("well", "forward_index", "reverse_index"), "well")
    out = trimming.trimmed(coded, "genomic_sequence", "forward_index", "reverse_index", "plain")
    return out.select("name", "aln_qseq", "aln_status", "aln_mismatch")


def _coded(spark, d):
    """Distinct (name, well, plain, genomic_sequence): the table's reads lost
    their barcodes, so the well's own are put back at both ends."""
    rows = _reads(spark, d).select("name", "well", F.col("genomic_sequence").alias("plain")).distinct()
    return rows.join(_indices(spark, d).select("well", "forward_index", "reverse_index"), "well").select("name", "well", "plain", F.concat("forward_index", "plain", "reverse_index").alias("genomic_sequence"))


def demultiplex(spark, d):
    idx = _indices(spark, d)
    coded = _coded(spark, d).select("name", "genomic_sequence").distinct()
    return exact.demultiplex(coded, idx, min_length=100)


def _indices(spark, d):
    """Index rows numbered in file order."""
    return files.numbered(table(spark, d, "indices"), "well")


def demultiplex_stats(spark, d):
    return exact.demultiplex_stats(_reads(spark, d))


def heptamer_search(spark, d):
    """Every locus that has motifs, each with its own."""
    return exact.heptamer_search(_reads(spark, d), _alleles(spark, d), HEPTAMERS, 1, end=3)


def heptamer_summary(spark, d):
    return exact.heptamer_summary(heptamer_search(spark, d), 2, 0.05)


def nearest_allele(spark, d):
    return exact.nearest(table(spark, d, "heptamer"), "sequence", _alleles(spark, d))


def pwm_profile(spark, d):
    return exact.profile(table(spark, d, "heptamer").where("length(trim(heptamer)) = 7").select(F.trim("heptamer").alias("h")), "h")


def cooccurrence_edges(spark, d):
    return cohort.edges(table(spark, d, "haplotype"), "case", ["allele_1", "allele_2"], min_donors=5, min_support=3, min_jaccard=0.05)


def cooccurrence_stats(spark, d):
    return cooccurrence_edges(spark, d).drop("p_enrich", "q_enrich")


def cooccurrence_clusters(spark, d):
    return cohort.components(cooccurrence_edges(spark, d).where("rho >= 0.3"), "allele_a", "allele_b", 2)


def haplotype_calls(spark, d):
    found = exact_v(spark, d)
    return cohort.haplotypes(found.select("case", "gene", "db_name", F.concat("prefix", "sequence").alias("sequence"), F.col("full_count").alias("count")), 1, 0.4)


def table_select(spark, d):
    return tables.select(table(spark, d, "part"), ["p_partkey", "p_brand"])


def table_filter_pattern(spark, d):
    return tables.filter_rows(table(spark, d, "allele_db"), "name", pattern="^IG[HK]V.*[*]0[12]$")


def table_filter_number(spark, d):
    return tables.filter_rows(table(spark, d, "haplotype"), "ratio", compare=">=", threshold=0.2)


def table_transform(spark, d):
    return tables.transform(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", r"Customer#0*(\d+)", r"C-\1", "digits")


def table_aggregate(spark, d):
    return tables.aggregate(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderpriority"], "o_orderkey")


def table_unique(spark, d):
    return tables.unique(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


def table_sort(spark, d):
    return tables.sort(table(spark, d, "blast"), ["sseqid", "qseqid", "bitscore"]).select("sseqid", "qseqid", "bitscore", "length")


def table_leftjoin(spark, d):
    return tables.join(table(spark, d, "customer"), table(spark, d, "orders"), ["c_custkey"], ["o_custkey"], "left", ["c_name"], ["o_orderkey", "o_totalprice"], right_prefix="o")


def table_outerjoin(spark, d):
    return tables.join(table(spark, d, "blast").where("qseqid IS NOT NULL"), _reads(spark, d).where("name IS NOT NULL"), ["qseqid"], ["name"], "outer", ["sseqid"], ["case"])


def table_collect(spark, d):
    a, b = table(spark, d, "allele_db"), table(spark, d, "fasta").select("name", "seq")
    return tables.collect({"allele_db": a, "fasta": b})


def table_exclude(spark, d):
    return tables.exclude(table(spark, d, "fasta").select("name", "seq"), "seq", _alleles(spark, d), "seq")


def filters_chain(spark, d):
    chain = [filters.min_threshold("l_quantity", 10), filters.max_threshold("l_discount", 0.05), filters.min_length("l_returnflag", 1)]
    return filters.apply(table(spark, d, "lineitem"), chain).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def filters_account(spark, d):
    return filters.account(table(spark, d, "blast"), [filters.min_threshold("bitscore", 150), filters.max_threshold("mismatch", 3), filters.min_length("qseq", 60)])


def _sets(spark, d):
    mine = keysets.keyed(table(spark, d, "fasta").where("seq <> ''").select(F.upper("seq").alias("seq"), "name"), "seq", "name")
    return mine, keysets.keyed(_alleles(spark, d).unionByName(table(spark, d, "fasta").where("file LIKE '%novel%' AND seq IS NOT NULL").select("name", F.upper("seq").alias("seq"))), "seq", "name")


def keyset_union(spark, d):
    return keysets.union(*_sets(spark, d))


def keyset_intersect(spark, d):
    return keysets.intersect(*_sets(spark, d))


def keyset_difference(spark, d):
    return keysets.difference(*_sets(spark, d))


def fasta_diff(spark, d):
    a, b = _sets(spark, d)
    return keysets.diff({"fasta": a, "known": b})


def fasta_merge_first(spark, d):
    return keysets.merge(table(spark, d, "fasta"), "name", "seq", "file", "first", "[*]")


def fasta_merge_last(spark, d):
    return keysets.merge(table(spark, d, "fasta"), "name", "seq", "file", "last")


def fasta_hash(spark, d):
    return table(spark, d, "fasta").where("seq IS NOT NULL").select("name", sequence_hash("seq").alias("hash"), unique_name("name", "seq").alias("new_name")).distinct()


def sequence_functions(spark, d):
    """Of every alignment: the segment's reverse complement, its differences
    from the same stretch of its read, and a CIGAR of its counts."""
    reads = _reads(spark, d).groupBy(F.col("name").alias("qseqid")).agg(F.min("genomic_sequence").alias("read"))
    n = lambda c, op: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(n("skipped", "N"), n("nident", "M"), n("mismatch", "X"), n("gapopen", "D"), n("clipped", "S"))
    rows = table(spark, d, "blast").where("qseq IS NOT NULL").select("qseqid", "qseq", "qstart", "nident", "mismatch", "gapopen", (F.col("sstart") - 1).alias("skipped"), (F.col("qlen") - F.col("qend")).alias("clipped")).distinct().join(reads, "qseqid", "left")
    stretch = F.substring("read", F.col("qstart").cast("int"), F.length("qseq"))
    return rows.select("qseqid", "qseq", "qstart", cigar.alias("cigar"), reverse_complement("qseq").alias("rc"), cigar_span(cigar).alias("span"), cigar_leading_skip(cigar).alias("skip"), hamming(F.col("qseq"), stretch).cast("long").alias("ham"))


def blast_best_hit(spark, d):
    """Best alignment of each read by identity, coverage and score, at least 10
    bases from neither end, subject coverage above 0.3."""
    rank = F.struct("pident", "qcovhsp", "qcovs", "bitscore", "sseqid")
    best = table(spark, d, "blast").where("sseqid IS NOT NULL").groupBy("qseqid").agg(F.max(F.struct(rank.alias("k"), F.struct("sseqid", "length", "slen", "mismatch", "qstart", "qend", "qlen", "qseq").alias("r"))).alias("m")).select("qseqid", "m.r.*")
    kept = best.withColumn("scov", F.col("length") / F.col("slen")).where((F.col("qstart") >= 10) & (F.col("qlen") - F.col("qend") >= 10) & (F.col("scov") > 0.3) & ~F.col("sseqid").startswith("P"))
    return kept.select("qseqid", "sseqid", "length", "mismatch", "scov", gene_of("sseqid").alias("gene"))


QUERIES = {f.__name__: f for f in (
    exact_counts, exact_v, exact_d, exact_j, exact_extension, border_statistics, border_by_gene, border_extensions, fasta_export, exact_reference_ratio, subject_names, allele_kmers, allele_common_ends, exact_frequencies, d_scan, trim_barcodes, demultiplex, demultiplex_stats, heptamer_search, heptamer_summary, nearest_allele, pwm_profile,
    cooccurrence_edges, cooccurrence_stats, cooccurrence_clusters, haplotype_calls, table_select, table_filter_pattern, table_filter_number, table_transform, table_aggregate, table_unique, table_sort,
    table_leftjoin, table_outerjoin, table_collect, table_exclude, filters_chain, filters_account, keyset_union, keyset_intersect, keyset_difference, fasta_diff,
    fasta_merge_first, fasta_merge_last, fasta_hash, sequence_functions, blast_best_hit,
)}


def _cut(a: str, b: str) -> str:
    """Characters a..b of the read."""
    return f"CASE WHEN {b} < {a} THEN '' ELSE substr(r, CAST({a} AS BIGINT), CAST({b} - ({a}) + 1 AS BIGINT)) END"


def _exact_sql(where: str, parts: dict[str, str], count: int, ratio: float, top: int) -> str:
    names = "".join(f", {n}" for n in parts)
    cols = "".join(f", {e} AS {n}" for n, e in parts.items())
    order = ", ".join(["full_count DESC", *[f"{n} ASC NULLS FIRST" for n in parts]])
    return f"""WITH p AS (SELECT well, "case", name AS db_name, seq AS sequence, r, s, s + length(seq) - 1 AS e, length(r) AS n FROM (
        SELECT d.well, d."case", d.genomic_sequence AS r, a.name, a.seq, instr(d.genomic_sequence, a.seq) AS s FROM demultiplex d JOIN allele_db a ON instr(d.genomic_sequence, a.seq) > 0 WHERE a.seq <> '' {where})),
      m AS (SELECT well, "case", db_name, sequence{cols} FROM p),
      g AS (SELECT well, "case", db_name, sequence{names}, count(*) AS full_count, split_part(db_name, '*', 1) AS gene FROM m GROUP BY ALL),
      c AS (SELECT *, CAST(sum(full_count) OVER (PARTITION BY well, "case", db_name, sequence) AS BIGINT) AS "count" FROM g),
      x AS (SELECT *, full_count::DOUBLE / max(full_count) OVER (PARTITION BY well, "case", gene) AS full_ratio, "count"::DOUBLE / max("count") OVER (PARTITION BY well, "case", gene) AS ratio FROM c),
      k AS (SELECT *, row_number() OVER (PARTITION BY well, "case", gene, db_name, sequence ORDER BY {order}) AS flank_index FROM x
            WHERE full_count >= {count} AND full_ratio >= {ratio} AND "count" >= {count} AND ratio >= {ratio}),
      exact AS (SELECT well, "case", gene, db_name, "count", full_count, ratio, full_ratio, flank_index, sequence{names} FROM k WHERE flank_index <= {top})"""


_PREFIX = _cut("greatest(1, s - 13)", "s - 1")
_V = {"prefix": _PREFIX, "heptamer": _cut("e + 1", "least(e + 7, n)")}
_D = {
    "pre_nonamer": _cut("greatest(1, s - 28)", "greatest(1, s - 20)"), "pre_spacer": _cut("greatest(1, s - 19)", "greatest(1, s - 8)"), "pre_heptamer": _cut("greatest(1, s - 7)", "s - 1"),
    "post_heptamer": _cut("e + 1", "least(e + 7, n)"), "post_spacer": _cut("e + 8", "least(e + 19, n)"), "post_nonamer": _cut("e + 20", "least(e + 28, n)"),
}
_J = {"heptamer": _cut("greatest(1, s - 7)", "s - 1"), "suffix": _cut("e + 1", "least(e + 13, n)")}
_EXT = {"prefix": _PREFIX, "suffix": _cut("e + 1", "least(e + 20, n)")}
_EXT |= {f"{k}_len": f"length({v})" for k, v in _EXT.items()}
_type = lambda g: f"AND substr(a.name, 4, 1) = '{g}'"
_COUNTS = _exact_sql("", {}, 2, 0.05, 1)
_EXACT_V = _exact_sql(_type("V"), _V, 1, 0.05, 3)
_L = "CASE WHEN starts_with(gene, 'IGHV') THEN \"count\" END"
_FREQ = f"""{_COUNTS}, t AS (SELECT *, CAST(coalesce(sum({_L}) OVER (PARTITION BY well, "case", gene), 0) AS BIGINT) AS gene_count, CAST(coalesce(sum({_L}) OVER (PARTITION BY well, "case"), 0) AS BIGINT) AS case_count FROM exact),
  u AS (SELECT *, coalesce(median({_L}::DOUBLE) OVER (PARTITION BY db_name), 0) AS am, coalesce(median(CASE WHEN starts_with(gene, 'IGHV') THEN gene_count::DOUBLE END) OVER (PARTITION BY gene), 0) AS gm FROM t),
  w AS (SELECT * EXCLUDE (am, gm), "count"::DOUBLE / case_count AS allele_case_freq, gene_count::DOUBLE / case_count AS gene_case_freq, "count"::DOUBLE / am AS allele_median_ratio, gene_count::DOUBLE / gm AS gene_median_ratio,
    "count"::DOUBLE / sum("count") OVER (PARTITION BY well, "case", gene) AS allele_freq FROM u)
  SELECT * FROM w WHERE allele_median_ratio >= 0.1 AND NOT isnan(allele_median_ratio) AND gene_median_ratio >= 0.1 AND NOT isnan(gene_median_ratio)"""
_MOTIFS = ", ".join(f"('{locus}', '{m}')" for locus, motifs in HEPTAMERS.items() for m in motifs)
_HEPT = f"""WITH q AS (SELECT * FROM (VALUES {_MOTIFS}) v(locus, m)),
  a AS (SELECT name AS db_name, seq AS full_match, substr(seq, 1, length(seq) - 3) AS trimmed_match, length(seq) AS db_length, left(name, 4) AS locus FROM allele_db WHERE left(name, 4) IN (SELECT locus FROM q)),
  p AS (SELECT row_number() OVER () AS id, a.*, substr(genomic_sequence, instr(genomic_sequence, trimmed_match) + length(trimmed_match)) AS suffix FROM demultiplex JOIN a ON instr(genomic_sequence, trimmed_match) > 0),
  z AS (SELECT id, k, min(hamming(substr(suffix, k, 7), m)) AS d FROM p JOIN q USING (locus), range(1, length(suffix) - 6) t(k) GROUP BY 1, 2),
  b AS (SELECT id, arg_min(k, d * 100000 + k) AS k FROM z WHERE d <= 1 GROUP BY id),
  f AS (SELECT db_name, full_match, trimmed_match, db_length, length(trimmed_match) + CASE WHEN k IS NULL THEN 0 ELSE k - 1 END AS full_length,
        trimmed_match || CASE WHEN k IS NULL THEN '' ELSE substr(suffix, 1, k - 1) END AS sequence, CASE WHEN k IS NULL THEN '' ELSE substr(suffix, k, 7) END AS heptamer FROM p LEFT JOIN b USING (id))"""
_MINE = "SELECT upper(seq) AS key, min(name) AS value FROM fasta WHERE seq <> '' GROUP BY 1"
_KNOWN = "SELECT key, min(name) AS value FROM (SELECT name, seq AS key FROM allele_db UNION ALL SELECT name, upper(seq) FROM fasta WHERE file LIKE '%novel%' AND seq IS NOT NULL) GROUP BY 1"
_BOTH = f"WITH a AS ({_MINE}), b AS ({_KNOWN})"
_HASH = "'S' || lpad(CAST((('0x' || right(md5(seq), 4))::BIGINT % 10000) AS VARCHAR), 4, '0')"
_rank = 'row_number() OVER (PARTITION BY "case", gene ORDER BY "count" DESC, label)'

_EDGES = """WITH RECURSIVE a AS (SELECT "case" AS c, trim(allele_1) AS a FROM haplotype WHERE "case" IS NOT NULL AND trim(allele_1) <> ''
    UNION ALL SELECT "case", trim(allele_2) FROM haplotype WHERE "case" IS NOT NULL AND trim(allele_2) <> ''),
  s AS (SELECT DISTINCT c, a FROM a WHERE a IN (SELECT a FROM a GROUP BY a HAVING count(*) >= 5)), t AS (SELECT count(DISTINCT c)::DOUBLE AS n FROM s), k AS (SELECT a, count(*) AS n FROM s GROUP BY a),
  p AS (SELECT x.a AS allele_a, y.a AS allele_b, count(*) AS n_shared FROM s x JOIN s y ON x.c = y.c AND x.a < y.a GROUP BY 1, 2),
  e AS (SELECT allele_a, allele_b, ka.n AS n_a, kb.n AS n_b, n_shared, n_shared::DOUBLE / (ka.n + kb.n - n_shared) AS jaccard, ka.n::DOUBLE * (t.n - ka.n) * kb.n * (t.n - kb.n) AS v, t.n * n_shared - ka.n * kb.n AS o FROM p, t, k ka, k kb WHERE ka.a = allele_a AND kb.a = allele_b)"""

_BORDER = f"""WITH p AS (SELECT d."case", split_part(a.name, '*', 1) AS gene, instr(r, a.seq) + length(a.seq) - 1 AS e, length(r) AS n FROM (SELECT *, genomic_sequence AS r FROM demultiplex) d JOIN allele_db a ON instr(r, a.seq) > 0 WHERE a.seq <> '' {_type('V')}),
  j AS (SELECT "case", gene, e + 1 <= least(e + 40, n) AND least(e + 40, n) >= greatest(1, n - 19) AS r FROM p),
  b AS (SELECT "case", gene, count(*) AS matched_total, count(*) FILTER (NOT r) AS accepted_total, count(*) FILTER (r) AS rejected_border, count(*) FILTER (r)::DOUBLE / count(*) AS rejected_ratio FROM j GROUP BY 1, 2)"""

_lcp = lambda a, b: f"left({a}, coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i))), 0))"

SQL = {
    "exact_reference_ratio": f"""{_COUNTS}, r AS (SELECT *, coalesce(max(CASE WHEN starts_with(db_name, 'IGHV3') THEN "count" END) OVER (PARTITION BY well, "case"), 1) AS ref, CAST(sum("count") OVER (PARTITION BY well, "case", gene) AS BIGINT) AS ref_gene_count FROM exact)
      SELECT * EXCLUDE (ref), "count"::DOUBLE / ref AS ref_ratio, ref_gene_count::DOUBLE / ref AS ref_gene_ratio FROM r""",
    "subject_names": r"""WITH s AS (SELECT DISTINCT split_part(sseqid, '|', 1) AS subject FROM blast WHERE sseqid IS NOT NULL), n AS (SELECT DISTINCT name FROM allele_db)
      SELECT subject, coalesce(a.name, b.name) AS db_name FROM s LEFT JOIN n a ON subject = a.name LEFT JOIN n b ON regexp_replace(subject, '_S\d+$', '') = b.name""",
    "allele_kmers": "SELECT kmer, count(*) AS n FROM (SELECT DISTINCT name, seq, substr(seq, i, 8) AS kmer FROM allele_db, range(1, length(seq) - 6) t(i)) GROUP BY 1 HAVING count(*) > 1",
    "allele_common_ends": f"""SELECT a.name, b.name AS other, {_lcp('a.seq', 'b.seq')} AS prefix, reverse({_lcp('reverse(a.seq)', 'reverse(b.seq)')}) AS suffix
      FROM allele_db a JOIN allele_db b ON split_part(a.name, '*', 1) = split_part(b.name, '*', 1) AND a.name < b.name""",
    "border_statistics": f"{_BORDER} SELECT * FROM b",
    "border_by_gene": f"{_BORDER} SELECT gene, avg(rejected_ratio) AS mean_rejected_ratio, CAST(sum(matched_total) AS BIGINT) AS matched_total, CAST(sum(rejected_border) AS BIGINT) AS rejected_border, count(*) AS num_donors FROM b GROUP BY 1",
    "border_extensions": f"""SELECT gene, quantile_disc(v, 0.25) AS extension FROM (SELECT split_part(a.name, '*', 1) AS gene, least(40, greatest(0, instr(r, a.seq) - 1 - least(20, length(r)))) AS v
      FROM (SELECT genomic_sequence AS r FROM demultiplex) d JOIN allele_db a ON instr(r, a.seq) > 0 WHERE a.seq <> '' {_type('J')}) GROUP BY 1""",
    "fasta_export": "SELECT rtrim(regexp_replace(trim(replace(name, '*', '')), '^IG[HK]V', '')) AS header, seq FROM fasta WHERE seq IS NOT NULL AND regexp_matches(name, '^IG[HK]V') AND regexp_matches(description, 'allele') GROUP BY name, seq",
    "cooccurrence_stats": f"{_EDGES} SELECT allele_a, allele_b, n_a, n_b, n_shared, jaccard, CASE WHEN v <= 0 THEN 0 ELSE o / sqrt(v) END AS rho FROM e WHERE n_shared >= 3 AND jaccard >= 0.05",
    "exact_counts": f"{_COUNTS} SELECT * FROM exact",
    "exact_v": f"{_EXACT_V} SELECT * FROM exact",
    "exact_d": f"{_exact_sql(_type('D'), _D, 1, 0.05, 2)} SELECT * FROM exact",
    "exact_j": f"{_exact_sql(_type('J'), _J, 1, 0.05, 2)} SELECT * FROM exact",
    "exact_extension": f"{_exact_sql(_type('V'), _EXT, 1, 0.05, 2)} SELECT * FROM exact",
    "exact_frequencies": _FREQ,
    "demultiplex": """WITH i AS (SELECT *, row_number() OVER () AS well FROM indices),
      r AS (SELECT DISTINCT d.name, i.forward_index || d.genomic_sequence || i.reverse_index AS s FROM demultiplex d JOIN i ON d.well = i.well),
      m AS (SELECT r.name, min(i.well) AS well FROM r JOIN i ON starts_with(s, forward_index) AND ends_with(s, reverse_index) WHERE length(s) >= 100 GROUP BY 1)
      SELECT m.name, m.well, i."case" FROM m JOIN i USING (well)""",
    "demultiplex_stats": """SELECT well, count(*) AS "count", CAST(round_even(avg(length(genomic_sequence)), 1) AS DOUBLE) AS mean_length, CAST(round_even(stddev_samp(length(genomic_sequence)), 1) AS DOUBLE) AS std_length FROM demultiplex GROUP BY well""",
    "heptamer_search": f"{_HEPT} SELECT * FROM f",
    "heptamer_summary": f"""{_HEPT}, g AS (SELECT db_name, sequence, heptamer, count(*) AS "count" FROM f GROUP BY ALL), h AS (SELECT *, "count"::DOUBLE / max("count") OVER (PARTITION BY db_name) AS ratio FROM g)
      SELECT * FROM h WHERE "count" >= 2 AND ratio >= 0.05""",
    "nearest_allele": """WITH v AS (SELECT DISTINCT sequence AS value FROM heptamer WHERE sequence IS NOT NULL), p AS (SELECT value, name, levenshtein(value, seq) AS d FROM v, allele_db),
      k AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY d, name) AS r FROM p) SELECT value, name AS nearest, d AS distance FROM k WHERE r = 1""",
    "pwm_profile": """WITH m AS (SELECT upper(trim(heptamer)) AS h FROM heptamer WHERE length(trim(heptamer)) = 7), l AS (SELECT i - 1 AS pos, substr(h, i, 1) AS base FROM m, range(1, 8) t(i)),
      c AS (SELECT b.pos, b.base, count(l.base) + 0.0001::DOUBLE AS n FROM (SELECT pos, base FROM range(0, 7) q(pos), (SELECT unnest(['A', 'C', 'G', 'T']) AS base)) b LEFT JOIN l ON b.pos = l.pos AND b.base = l.base GROUP BY 1, 2)
      SELECT pos, base, n / sum(n) OVER (PARTITION BY pos) AS p FROM c""",
    "haplotype_calls": f"""{_EXACT_V}, r AS (SELECT "case", gene, db_name, prefix || sequence AS sequence, CAST(sum(full_count) AS BIGINT) AS "count" FROM exact GROUP BY ALL),
      t AS (SELECT db_name, sequence, db_name || '_' || row_number() OVER (PARTITION BY db_name ORDER BY sum("count") DESC, sequence) AS label FROM r GROUP BY db_name, sequence),
      ranked AS (SELECT r.*, label, {_rank} AS rank, "count"::DOUBLE / max("count") OVER (PARTITION BY "case", gene) AS share FROM r JOIN t USING (db_name, sequence)),
      calls AS (SELECT "case", gene, count(*) FILTER (share >= 0.4) AS n, max(label) FILTER (rank = 1) AS allele_1, max(label) FILTER (rank = 2) AS a2, max("count") FILTER (rank = 1) AS count_1, coalesce(max("count") FILTER (rank = 2), 0) AS count_2,
        CAST(sum("count") AS BIGINT) AS total_count, coalesce(string_agg(label, ',' ORDER BY rank) FILTER (rank >= 3), '') AS oa, coalesce(string_agg(label, ',' ORDER BY rank) FILTER (rank >= 3 AND share >= 0.4), '') AS os FROM ranked GROUP BY 1, 2)
      SELECT "case", gene, CASE WHEN n <= 1 THEN 'homozygous' WHEN n = 2 THEN 'heterozygous' ELSE 'duplication' END AS genotype, allele_1, CASE WHEN n >= 2 THEN a2 ELSE '' END AS allele_2, count_1, count_2,
        CAST(round_even(count_1::DOUBLE / total_count, 3) AS DOUBLE) AS freq_1, CAST(round_even(count_2::DOUBLE / total_count, 3) AS DOUBLE) AS freq_2, CAST(round_even(count_2::DOUBLE / count_1, 3) AS DOUBLE) AS ratio, total_count, CASE WHEN n > 2 THEN os ELSE oa END AS other_alleles FROM calls""",
    "table_select": "SELECT p_partkey, p_brand FROM part",
    "table_filter_pattern": "SELECT * FROM allele_db WHERE regexp_matches(name, '^IG[HK]V.*[*]0[12]$')",
    "table_filter_number": "SELECT * FROM haplotype WHERE ratio >= 0.2 AND NOT isnan(ratio)",
    "table_transform": r"SELECT c_custkey, regexp_replace(c_name, '^.*Customer#0*(\d+).*$', 'C-\1') AS c_name, regexp_extract(c_name, 'Customer#0*(\d+)', 1) AS digits FROM customer",
    "table_aggregate": 'SELECT o_custkey, o_orderstatus, count(*) AS "count", arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1, 2',
    "table_unique": "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem",
    "table_sort": "SELECT sseqid, qseqid, bitscore, length FROM blast",
    "table_leftjoin": "SELECT c_custkey, c_name, o_orderkey AS o_o_orderkey, o_totalprice AS o_o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "table_outerjoin": """SELECT coalesce(b.qseqid, d.name) AS qseqid, sseqid, "case" FROM (SELECT * FROM blast WHERE qseqid IS NOT NULL) b FULL JOIN (SELECT * FROM demultiplex WHERE name IS NOT NULL) d ON b.qseqid = d.name""",
    "table_collect": "SELECT name, seq, 'allele_db' AS file FROM allele_db UNION ALL SELECT name, seq, 'fasta' FROM fasta",
    "table_exclude": "SELECT name, seq FROM fasta f WHERE NOT EXISTS (SELECT 1 FROM allele_db a WHERE a.seq IS NOT NULL AND (contains(f.seq, a.seq) OR contains(a.seq, f.seq)))",
    "filters_chain": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_discount <= 0.05 AND length(l_returnflag) >= 1 GROUP BY 1",
    "filters_account": """WITH c AS (SELECT count(*) AS n0, count(*) FILTER (bitscore >= 150) AS n1, count(*) FILTER (bitscore >= 150 AND mismatch <= 3) AS n2, count(*) FILTER (bitscore >= 150 AND mismatch <= 3 AND length(qseq) >= 60) AS n3 FROM blast)
      SELECT 1::BIGINT AS step, 'bitscore >= 150' AS label, n0 AS total, n1 AS kept FROM c UNION ALL SELECT 2, 'mismatch <= 3', n1, n2 FROM c UNION ALL SELECT 3, 'length(qseq) >= 60', n2, n3 FROM c""",
    "keyset_union": f"{_BOTH} SELECT key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (key)",
    "keyset_intersect": f"{_BOTH} SELECT a.key, a.value FROM a JOIN b ON a.key = b.key",
    "keyset_difference": f"{_BOTH} SELECT key, value FROM a WHERE key NOT IN (SELECT key FROM b)",
    "fasta_diff": f"""{_BOTH}, c AS (SELECT count(*) AS u, count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL) AS i, count(*) FILTER (b.key IS NULL) AS l, count(*) FILTER (a.key IS NULL) AS r FROM a FULL JOIN b ON a.key = b.key)
      SELECT 'fasta' AS file_a, 'known' AS file_b, op, n FROM c, LATERAL (SELECT unnest(['union', 'intersection', 'left_only', 'right_only']) AS op, unnest([u, i, l, r]) AS n)""",
    "fasta_merge_first": "SELECT replace(name, '*', '') AS name, seq FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY file, replace(name, '*', '')) AS k FROM fasta WHERE seq IS NOT NULL) WHERE k = 1",
    "fasta_merge_last": "SELECT name, seq FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY file DESC, name DESC) AS k FROM fasta WHERE seq IS NOT NULL) WHERE k = 1",
    "fasta_hash": f"SELECT DISTINCT name, {_HASH} AS hash, split_part(name, '_', 1) || '_' || {_HASH} AS new_name FROM fasta WHERE seq IS NOT NULL",
    "sequence_functions": """WITH r AS (SELECT name AS qseqid, min(genomic_sequence) AS read FROM demultiplex GROUP BY 1),
      b AS (SELECT DISTINCT qseqid, qseq, qstart, nident, mismatch, gapopen, sstart - 1 AS skipped, qlen - qend AS clipped FROM blast WHERE qseq IS NOT NULL),
      x AS (SELECT *, substr(read, qstart, length(qseq)) AS stretch FROM b LEFT JOIN r USING (qseqid))
      SELECT qseqid, qseq, qstart, CASE WHEN skipped > 0 THEN skipped || 'N' ELSE '' END || CASE WHEN nident > 0 THEN nident || 'M' ELSE '' END || CASE WHEN mismatch > 0 THEN mismatch || 'X' ELSE '' END
        || CASE WHEN gapopen > 0 THEN gapopen || 'D' ELSE '' END || CASE WHEN clipped > 0 THEN clipped || 'S' ELSE '' END AS cigar,
      CASE WHEN regexp_full_match(upper(qseq), '[ACGTMRWSYKVHDBN]*') THEN reverse(translate(upper(qseq), 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')) ELSE qseq END AS rc,
      greatest(skipped, 0) + greatest(nident, 0) + greatest(mismatch, 0) + greatest(gapopen, 0) AS span, greatest(skipped, 0) AS skip,
      CASE WHEN length(stretch) = length(qseq) THEN hamming(qseq, stretch) WHEN stretch IS NULL THEN NULL ELSE -1 END AS ham FROM x""",
    "blast_best_hit": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, qcovhsp DESC, qcovs DESC, bitscore DESC, sseqid DESC, length DESC, slen DESC, mismatch DESC, qstart DESC, qend DESC, qlen DESC, qseq DESC NULLS LAST) AS r FROM blast WHERE sseqid IS NOT NULL)
      SELECT qseqid, sseqid, length, mismatch, length::DOUBLE / slen AS scov, split_part(sseqid, '*', 1) AS gene FROM k WHERE r = 1 AND qstart >= 10 AND qlen - qend >= 10 AND length::DOUBLE / slen > 0.3 AND NOT starts_with(sseqid, 'P')""",
}
