"""Command line: `python -m seqloom.cli GROUP COMMAND ...`.

Each command reads files, runs the operators, and writes one named file (tables
as gzipped TSV). The work itself is in the library; this module only maps
options to it."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import sequence_hash, unique_name
from .operators import aligner, keysets, tables
from .plans import clusters, cohort, discovery, dscan, exact, genome
from .sources import files
from .workdir import materialize, release

Run = Callable[[SparkSession, argparse.Namespace], None]


def _share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("must be between 0 and 1")
    return x


def _at_least(least: int) -> Callable[[str], int]:
    def check(text: str) -> int:
        if int(text) < least:
            raise argparse.ArgumentTypeError(f"must be {least} or more")
        return int(text)

    return check


def _names(text: str | None) -> list[str] | None:
    return None if text is None else [x.strip() for x in text.split(",") if x.strip()]


def _alleles(spark: SparkSession, path: str) -> DataFrame:
    return files.read_fasta(spark, path).select("name", "seq")


def _save(df: DataFrame, path: str) -> None:
    print(files.write_named(df, path))


# --- table


def table_join(how: str) -> Run:
    def run(spark, a):
        keys = _names(a.keys)
        left, right = files.read_tsv(spark, a.left), files.read_tsv(spark, a.right)
        _save(tables.join(left, right, _names(a.left_keys) or keys, _names(a.right_keys) or keys, how, _names(a.left_select), _names(a.right_select), a.left_prefix, a.right_prefix), a.output)

    return run


def table_transform(spark, a):
    _save(tables.transform(files.read_tsv(spark, a.input), a.column, a.pattern, a.replacement, a.new_column), a.output)


def table_aggregate(spark, a):
    df = files.read_tsv(spark, a.input).withColumn("_order", F.monotonically_increasing_id())
    _save(tables.aggregate(df, _names(a.group_by), _names(a.keep_columns) or [], "_order", a.count_column), a.output)


def table_unique(spark, a):
    _save(tables.unique(files.read_tsv(spark, a.input), _names(a.columns)), a.output)


def table_sort(spark, a):
    _save(tables.sort(files.read_tsv(spark, a.input), _names(a.columns), a.reverse), a.output)


def table_filter(spark, a):
    _save(tables.filter_rows(files.read_tsv(spark, a.input), a.column, pattern=a.pattern, compare=a.operator, threshold=a.threshold), a.output)


def table_select(spark, a):
    _save(tables.select(files.read_tsv(spark, a.input), _names(a.columns)), a.output)


def table_fasta(spark, a):
    rows = keysets.export(files.read_tsv(spark, a.input), a.colname, a.colseq, a.coldesc, a.case_col if a.mincase > 1 else None, a.filter, a.desc_filter, a.mincase, a.cleanup, a.unique_sequences, not a.no_sort)
    files.write_named(rows, a.output, files.write_fasta, name="header")


def table_collect(spark, a):
    _save(files.read_many(spark, a.pattern), a.output)


def table_exclude(spark, a):
    _save(tables.exclude(files.read_tsv(spark, a.input), a.colseq, _alleles(spark, a.fasta), "seq"), a.output)


# --- fasta


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    return files.read_fasta(spark, paths)


def fasta_merge(spark, a):
    prefer, how = "last" if a.prefer_last else "first", {"cleanup": a.cleanup, "description": "description", "prefix": a.add_source_prefix}
    df = _records(spark, a.inputs)
    rows = keysets.merge(df, "name", "seq", "file", prefer, **how)
    files.write_named(rows if a.no_sort else rows.orderBy("name"), a.output, files.write_fasta)
    for r in keysets.merge_report(df, "name", "seq", "file", **how).collect():  # repeated sequences of reference files
        print(f"{r.n} records: {r.names}")


def fasta_diff(spark, a):
    sets = {p: keysets.keyed(_records(spark, [p]), "seq", "name") for p in a.inputs}
    for r in keysets.diff(sets).collect():
        print(r.file_a, r.file_b, r.op, r.n, sep="\t")
    for r in keysets.diff_names(sets).collect():
        print(r.file_a, r.file_b, r.op, r.name, sep="\t")


def fasta_hash(spark, a):
    for r in _records(spark, [a.input]).select("name", sequence_hash("seq").alias("hash"), unique_name("name", "seq").alias("new")).collect():
        print(r.name, r.hash, r.new, sep="\t")


# --- preprocess, search, discover, analyze


def preprocess_demultiplex(spark, a):
    reads = files.read_fastq(spark, a.fastq)
    index = files.read_indices(spark, a.indices)
    wells = exact.demultiplex(reads.withColumnRenamed("seq", "genomic_sequence"), index, min_length=a.length, array=a.forwardarrayindex or None, case_filter=a.case_filter_regex)
    out = materialize(wells.join(reads.select("name", F.col("seq").alias("genomic_sequence"), "quality"), "name"), "reads")
    rows = out.select("well", "case", "name", "genomic_sequence")
    _save(rows, a.output)
    files.write_named(exact.demultiplex_stats(rows).orderBy("well"), f"{a.output}.log", compress=False)
    if a.split:
        files.write_by_case(out.select("case", "name", F.col("genomic_sequence").alias("seq"), "quality"), f"{a.fastq}_split")


def search_exact(spark, a):
    reads, db = files.read_reads(spark, a.tsv, a.limit or None), _alleles(spark, a.fasta)
    sizes = None
    if a.extension is not None and a.border and a.adjust_per_gene_extension:
        sizes = materialize(exact.calibrated_extensions(reads, db, a.gene, a.extension, a.border, a.adjust_percent), "extensions")
    kinds = {"V": ("prefix",), "J": ("suffix",), "D": ()}[a.gene]
    keep = None if a.extension is not None or a.gene == "D" else kinds + tuple(_names(a.rss) or ())
    found = exact.matches(reads, db, a.gene, a.affix, a.extension, keep, a.border, sizes)
    expect = files.read_thresholds(spark, a.expect) if a.expect else None
    rows = materialize(exact.exact_search(found, a.mincount, a.minratio, a.top, expect if expect is not None else ()), "exact")
    if a.ref_fasta:
        rows = exact.flag_known(rows, _alleles(spark, a.ref_fasta))
    if a.raw:
        _save(rows, a.raw)
    rows = exact.frequencies(rows, a.locus, a.min_allele_mratio, a.min_gene_mratio)
    if expect is not None:
        rows = exact.above_thresholds(rows, expect, "allele_freq")
    if a.deletion:
        rows = exact.above_thresholds(rows, files.read_thresholds(spark, a.deletion), "gene_case_freq")
    for gene in a.refgene or []:
        renamed = {c: f"{c}_{gene}" for c in ("ref_gene_count", "ref_ratio", "ref_gene_ratio")}
        rows = exact.reference_ratio(rows, gene).withColumnsRenamed(renamed)
    _save(rows.orderBy("case", "db_name"), a.output)


def search_heptamer(spark, a):
    motifs = files.read_motifs(spark, a.json)[a.chain]
    found = exact.heptamer_search(files.read_reads(spark, a.tsv), _alleles(spark, a.fasta), motifs, a.maxdist, a.begin, a.end)
    found = materialize(found, "heptamers")
    _save(found, a.output)
    files.write_named(exact.heptamer_summary(found, a.mincount, a.ratio).orderBy("db_name", F.desc("count")), a.summary, compress=False)


def search_genome(spark, a):
    rows = files.read_tsv(spark, a.tsv)
    contigs = _records(spark, a.genome).select(F.col("file").alias("genome"), "name", "description", "seq")
    found = genome.checked(rows, a.colname, genome.concatenated(a.colseq), contigs, a.chromosome, a.tag)
    _save(rows.join(found.where("matched").drop("matched").withColumnRenamed("name", "_name"), F.col(a.colname) == F.col("_name")).drop("_name"), a.output)


# Defaults by gene of discovery from alignments, and those without a gene
PRESETS = {
    "V": {"forward": 20, "reverse": 20, "minfullratio": 0.035, "length": 283, "maxdist": 14, "minfullcount": 5, "minquality": 0.62, "min_corecov": 0.5, "subjects": 5, "coverage": 50, "seed": 28},
    "D": {"forward": 40, "reverse": 40, "minfullratio": 0.2, "length": 5, "maxdist": 20, "minfullcount": 10, "edge": 10, "subjectcov": 0.25, "minquality": 0.5, "subjects": 10, "coverage": 5, "seed": 7},
    "J": {"forward": 12, "reverse": 12, "minfullratio": 0.1, "length": 10, "maxdist": 10, "minfullcount": 10, "subjects": 5, "coverage": 10, "seed": 28},
}
PLAIN = {"forward": 20, "reverse": 20, "minfullratio": 0.1, "length": 290, "maxdist": 20, "minfullcount": 5, "edge": 0, "subjectcov": 0.1, "minquality": 0.75, "min_corecov": 0.6, "subjects": 5, "coverage": 50, "seed": 28}


def discover_align(spark, a):
    o = PLAIN | PRESETS.get(a.gene or "", {}) | {k: getattr(a, k) for k in PLAIN if getattr(a, k) is not None}
    reads, db = files.read_reads(spark, a.input), _alleles(spark, a.fasta)
    pseudo = _alleles(spark, a.pseudo) if a.pseudo else None
    parts = materialize(discovery.affixes(reads, db, o["forward"], o["reverse"]), "affixes") if o["forward"] or o["reverse"] else None
    known = discovery.combined(db, pseudo) if parts is None else discovery.extended(parts)
    hits = aligner.search(reads, "name", "genomic_sequence", known, most_subjects=o["subjects"], seed=o["seed"])
    hits = materialize(hits.where(F.col("qcovhsp") >= o["coverage"]), "hits")
    rows = discovery.segment_clusters(hits, reads, o["edge"], o["subjectcov"], o["maxdist"])
    rows = discovery.untrimmed(rows) if parts is None else discovery.cores(rows, parts, o["minquality"], o["min_corecov"])
    rows = discovery.selected(rows, o["minfullcount"], o["minfullratio"], o["length"], o["maxdist"], a.keep_failed)
    _save(discovery.named(rows, db, a.isin).orderBy("well", "case", "sseqid"), a.output)


def discover_hsmm(spark, a):
    reads, db = files.read_reads(spark, a.tsv, a.limit or None), _alleles(spark, a.fasta)
    known = exact.exact_search(exact.matches(reads, db, "D"), a.mincount, 0.0, 1000)
    parts = materialize(dscan.training_rows(known, a.ratio), "training")
    model = dscan.train(parts, shortest=a.min_gene_len, longest=a.max_gene_len)
    _save(dscan.discovered(reads, db, model, a.min_posterior, a.out_mincount, a.out_minratio, a.min_heptamer_prob_pre, a.min_heptamer_prob_post), a.output)


def analyze_cooccurrence(spark, a):
    calls = files.read_tsv(spark, a.input)
    edges = materialize(cohort.edges(calls, a.case_col, a.allele_col, min_donors=a.min_donors), "edges")
    files.write_named(edges, a.input.removesuffix(".gz").removesuffix(".tsv") + "_edges.tsv", compress=False)
    if a.debug_triangles:
        for r in clusters.strong_edges(edges, a.cluster_threshold).collect():  # twenty at most
            print(f"{r.allele_a} - {r.allele_b}: {r.rho:.3f} (of {r.n_all})")
    if a.clusters:
        groups = clusters.clusters(edges, a.cluster_threshold, a.min_cluster_size, a.cluster_method)
        files.write_named(clusters.cluster_details(groups, calls, a.case_col, [a.allele_col]), a.clusters, compress=False)


def analyze_haplotype(spark, a):
    rows = files.read_tsv(spark, a.input).withColumnsRenamed({a.case_col: "case", a.allele_col: "db_name", a.gene_col: "gene"})
    calls = cohort.haplotypes(cohort.haplotype_input(rows), a.mincount, a.min_ratio)
    novel = files.identifiers(spark, a.novel_fasta) if a.novel_fasta else spark.createDataFrame([], "name string")
    calls = materialize(cohort.novel_flags(calls, novel), "calls")
    files.write_named(calls, a.output, compress=False)
    for r in cohort.genotype_summary(calls).collect():
        print(r.genotype, r.n, f"{r.percent} %", sep="\t")


def parser() -> argparse.ArgumentParser:
    """All commands with their options and defaults."""
    top = argparse.ArgumentParser(prog="seqloom")
    groups = top.add_subparsers(dest="group", required=True)
    made: dict[str, argparse._SubParsersAction] = {}

    def command(group: str, name: str, run: Run, positional: str, **options) -> argparse.ArgumentParser:
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        p = made[group].add_parser(name)
        p.set_defaults(run=run)
        for x in positional.split():
            p.add_argument(x.rstrip("+"), nargs="+" if x.endswith("+") else None)
        for option, spec in options.items():
            p.add_argument(*([f"-{spec['short']}"] if "short" in spec else []), f"--{option.replace('_', '-')}", **{k: v for k, v in spec.items() if k != "short"})
        return p

    flag = lambda **x: {"action": "store_true", **x}
    text = lambda default=None, **x: {"default": default, **x}
    share = lambda default, **x: {"type": _share, "default": default, **x}
    number = lambda default, least=0, **x: {"type": _at_least(least), "default": default, **x}
    need = lambda **x: {"required": True, **x}
    join = {"keys": need(short="k"), "left_keys": text(), "right_keys": text(), "left_prefix": text(""), "right_prefix": text(""), "left_select": text(), "right_select": text()}
    command("table", "outerjoin", table_join("outer"), "left right output", **join)
    command("table", "leftjoin", table_join("left"), "left right output", **join)
    command("table", "transform", table_transform, "input output", column=need(short="c"), pattern=need(short="p"), replacement=need(short="r"), new_column=text())
    command("table", "aggregate", table_aggregate, "input output", group_by=need(short="g"), keep_columns=text(short="k"), count_column=text("count", short="c"))
    command("table", "unique", table_unique, "input output", columns=need(short="c"))
    command("table", "sort", table_sort, "input output", columns=need(short="c"), reverse=flag(short="r"))
    command("table", "filter", table_filter, "input output", column=need(short="c"), pattern=text(), operator=text(choices=["<", "<=", ">=", ">"]), threshold={"type": float, "default": None})
    command("table", "select", table_select, "input output", columns=need(short="c"))
    fasta = {"colname": text("allele_name", short="n"), "colseq": {"nargs": "+", "default": ["seq"], "short": "s"}, "coldesc": text(short="d"), "case_col": text("case"), "filter": text(short="f"), "desc_filter": text(), "cleanup": text(short="c"), "mincase": number(1, 1), "unique_sequences": flag(), "no_sort": flag()}
    command("table", "fasta", table_fasta, "input output", **fasta)
    command("table", "collect", table_collect, "pattern output")
    command("table", "exclude", table_exclude, "input output fasta", colname=text("allele_name", short="n"), colseq=text("seq", short="s"))
    command("fasta", "merge", fasta_merge, "output inputs+", cleanup=text(short="c"), prefer_last=flag(), add_source_prefix=flag(), no_sort=flag())
    command("fasta", "diff", fasta_diff, "inputs+")
    command("fasta", "hash", fasta_hash, "input")
    command("preprocess", "demultiplex", preprocess_demultiplex, "fastq indices output", length=number(200, short="l"), split=flag(short="s"), forwardarrayindex=text("", short="f"), case_filter_regex=text())
    search = {"minratio": share(0.1, short="f"), "mincount": number(5, 1, short="c"), "min_allele_mratio": {"type": float, "default": 0.05}, "min_gene_mratio": {"type": float, "default": 0.05}, "rss": text("heptamer")}
    search |= {"extension": number(None), "border": number(0), "adjust_per_gene_extension": flag(), "adjust_percent": share(1.0), "raw": text(), "gene": text("V", short="g", choices=["V", "D", "J"]), "affix": number(13, 1, short="a")}
    search |= {"top": number(1, 1, short="t"), "refgene": {"nargs": "*", "short": "r"}, "limit": number(0, short="l"), "expect": text(short="e"), "deletion": text(short="d"), "locus": text("IG"), "ref_fasta": text()}
    command("search", "exact", search_exact, "tsv fasta output", **search)
    command("search", "heptamer", search_heptamer, "tsv fasta output summary", json=text("heptamers.json", short="j"), chain=text("IGHV", short="c", choices=["IGHV", "IGKV", "IGLV"]), maxdist=number(1, short="d"), begin=number(0, short="b"), end=number(8, short="e"), mincount=number(1, 1, short="m"), ratio=share(0.25, short="r"))
    command("search", "genome", search_genome, "tsv output genome+", chromosome=text("chromosome 14", short="c"), colname=text("best_name", short="n"), colseq={"nargs": "*", "default": ["prefix", "best_aln", "suffix"], "short": "s"}, tag=text("(.*Primary Assembly.*)|(.*alternate locus.*)", short="t"))
    align = {"pseudo": text("", short="p"), "minfullcount": number(None, short="c"), "minfullratio": share(None, short="f"), "subjectcov": share(None, short="s"), "maxdist": number(None, short="d"), "length": number(None, 1, short="l"), "edge": number(None, short="e"), "gene": text(short="g", choices=list(PRESETS))}
    align |= {"forward": number(None), "reverse": number(None), "subjects": number(None, 1), "coverage": number(None), "seed": number(None, 4), "minquality": share(None, short="q"), "isin": {"action": argparse.BooleanOptionalAction, "default": True}, "keep_failed": flag(), "min_corecov": share(None)}
    command("discover", "align", discover_align, "input fasta output", **align)
    hsmm = {"ratio": share(0.2, short="r"), "mincount": number(10, 1, short="c"), "min_posterior": share(0.7), "min_gene_len": number(10), "max_gene_len": number(70), "limit": number(0, short="l"), "out_mincount": number(10, 1), "out_minratio": share(0.2), "min_heptamer_prob_pre": share(0.05), "min_heptamer_prob_post": share(0.05)}
    command("discover", "hsmm", discover_hsmm, "tsv fasta output", **hsmm)
    together = {"case_col": text("case", short="C"), "allele_col": text("db_name", short="A"), "min_donors": number(2, 1, short="m"), "cluster_method": text("components", choices=["components", "complete", "average", "single"]), "cluster_threshold": share(0.5), "debug_triangles": flag(), "min_cluster_size": number(3, 1), "clusters": text()}
    command("analyze", "cooccurrence", analyze_cooccurrence, "input", **together)
    command("analyze", "haplotype", analyze_haplotype, "input output", case_col=text("case", short="C"), allele_col=text("db_name", short="A"), gene_col=text("gene", short="G"), mincount=number(5, 1, short="c"), min_ratio=share(0.1, short="r"), novel_fasta=text(short="f"))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    session = spark or SparkSession.builder.appName("seqloom").getOrCreate()
    try:
        a.run(session, a)
    except ValueError as e:
        print(f"seqloom: {e}", file=sys.stderr)
        return 2
    finally:
        release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
