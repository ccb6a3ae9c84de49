"""Discovery of alleles from alignments: known affixes around alleles, best
hits, clusters of equal segments, trimming, filters and names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import gene_of, unique_name
from ..operators import filters
from ..operators.dictionary import contains
from . import exact, trimming


def combined(alleles: DataFrame, pseudo: DataFrame | None = None) -> DataFrame:
    """(name, seq) of alleles and pseudogenes, whose names get a P."""
    rows = alleles.select("name", "seq")
    return rows if pseudo is None else rows.unionByName(pseudo.select(F.concat(F.lit("P"), "name").alias("name"), "seq"))


# The affix fold. Its state is (prefix, suffix); a read with the affixes (p, s) makes it (common suffix of prefix and p, common
# prefix of suffix and s), but an empty prefix starts both anew from the read. Whether a state survives a stretch of reads depends on
# the last letter of its prefix only: it does while every read's prefix ends in that letter. So a stretch is summed up by its common
# affixes, the letter all its prefixes end in (if any), and the state it leaves behind a state that doesn't survive, by last letter.


def common_suffix(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return a[len(a) - n :]


def common_prefix(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def step(state: tuple[str, str], read: tuple[str, str]) -> tuple[str, str]:
    if state[0] == "":
        return read
    return common_suffix(state[0], read[0]), common_prefix(state[1], read[1])


def summary(reads: list[tuple[str, str]]) -> dict:
    """What a stretch of reads does to any state that enters it: by the last
    letter of its prefix, None if it survives, else (prefix, suffix, pending),
    where a pending suffix still has to be cut to what the entering one has in
    common (the stretch ended with the read that emptied the prefix)."""
    prefix, suffix = reads[0]
    for p, s in reads[1:]:
        prefix, suffix = common_suffix(prefix, p), common_prefix(suffix, s)
    exits: dict[str, tuple[str, str, bool] | None] = {}
    for letter in sorted({r[0][-1:] for r in reads} | {"", "?"}):  # "?" stands for a letter that no prefix of the stretch ends in
        alive, pending, state, seen = letter != "", False, ("", ""), reads[0][1]
        for r in reads:
            if alive:
                seen = common_prefix(seen, r[1])
                if r[0][-1:] != letter:
                    alive, pending, state = False, True, ("", seen)
            else:
                pending, state = False, r if state[0] == "" else step(state, r)
        exits[letter] = None if alive else (*state, pending)
    return {"prefix": prefix, "suffix": suffix, "exits": exits}


def applied(state: tuple[str, str], stretch: dict) -> tuple[str, str]:
    exits = stretch["exits"]
    out = exits.get(state[0][-1:], exits["?"])
    if out is None:
        return common_suffix(state[0], stretch["prefix"]), common_prefix(state[1], stretch["suffix"])
    return out[0], common_prefix(state[1], out[1]) if out[2] else out[1]


def affixes(reads: DataFrame, alleles: DataFrame, forward: int, reverse: int, order: str = "name") -> DataFrame:
    """(db_name, sequence, prefix, suffix): what the reads that contain an
    allele have in common before (`forward` characters at most) and after it
    (`reverse`), folded in the order of `order` (then of the read). When nothing
    is common before it any more, both start anew from the next read. Alleles
    without reads have empty affixes.

    Reads are range-partitioned by (allele, order), so an allele that many reads
    contain is folded by many tasks; their summaries are folded in turn."""
    own = alleles.select(F.col("name").alias("db_name"), F.col("seq").alias("sequence"))
    pairs = contains(reads.select(F.col(order).alias("_order"), "genomic_sequence"), "genomic_sequence", own, "sequence")
    before = F.greatest(F.lit(1), F.col("start") - forward)
    after = F.col("start") + F.length("sequence")
    rows = pairs.select("db_name", "sequence", "_order", "genomic_sequence", F.substring("genomic_sequence", before, F.col("start") - before).alias("p"), F.substring("genomic_sequence", after, F.lit(reverse)).alias("s"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, key = 0, [], None
        for batch in batches:
            for block, name, seq, p, s in zip(*(batch.column(c).to_pylist() for c in ("block", "db_name", "sequence", "p", "s"))):
                if key is not None and (block, name, seq) != key:
                    yield _summaries(key, held)
                    held = []
                key = (block, name, seq)
                held.append((p, s))
                if len(held) == 10_000:
                    yield _summaries(key, held, part)
                    part, held = part + 1, []
        if held:
            yield _summaries(key, held, part)

    def _summaries(key: tuple, reads: list[tuple[str, str]], part: int = 1 << 40) -> pa.RecordBatch:
        x = summary(reads)
        exits = [{"letter": k, "prefix": v and v[0], "suffix": v and v[1], "pending": v and v[2]} for k, v in x["exits"].items()]
        kind = pa.list_(pa.struct([("letter", pa.string()), ("prefix", pa.string()), ("suffix", pa.string()), ("pending", pa.bool_())]))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.int32()), (part, pa.int64()), (key[1], pa.string()), (key[2], pa.string()), (x["prefix"], pa.string()), (x["suffix"], pa.string()), (exits, kind))], names=["block", "part", "db_name", "sequence", "prefix", "suffix", "exits"])

    ordered = rows.repartitionByRange("db_name", "sequence", "_order", "genomic_sequence").sortWithinPartitions("db_name", "sequence", "_order", "genomic_sequence").withColumn("block", F.spark_partition_id())
    schema = "block int, part long, db_name string, sequence string, prefix string, suffix string, exits array<struct<letter: string, prefix: string, suffix: string, pending: boolean>>"
    stretches = ordered.select("block", "db_name", "sequence", "p", "s").mapInArrow(folded, schema)

    def joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        state = ("", "")
        for x in sorted(table.to_pylist(), key=lambda r: (r["block"], r["part"])):
            exits = {e["letter"]: None if e["prefix"] is None else (e["prefix"], e["suffix"], e["pending"]) for e in x["exits"]}
            state = applied(state, {"prefix": x["prefix"], "suffix": x["suffix"], "exits": exits})
        return pa.table({"db_name": pa.array([key[0].as_py()]), "sequence": pa.array([key[1].as_py()]), "prefix": pa.array([state[0]]), "suffix": pa.array([state[1]])})

    # one row for 10,000 reads and allele, at most one more a task
    found = stretches.groupBy("db_name", "sequence").applyInArrow(joined, "db_name string, sequence string, prefix string, suffix string")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return own.distinct().join(found, ["db_name", "sequence"], "left").select("db_name", "sequence", empty("prefix"), empty("suffix"))


def extended(parts: DataFrame) -> DataFrame:
    """(name, seq) of `affixes`: the alleles with their affixes."""
    return parts.select(F.col("db_name").alias("name"), F.concat("prefix", "sequence", "suffix").alias("seq"))


def best_hits(hits: DataFrame) -> DataFrame:
    """One alignment a query: identity, then coverage of the alignment, of the
    subject, and score decide, then the smaller subject name and start."""
    order = [F.desc(c) for c in ("pident", "qcovhsp", "qcovs", "bitscore")] + [F.asc(c) for c in ("sseqid", "qstart", "sstart")]
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy("qseqid").orderBy(*order))).where("_r = 1").drop("_r")


def segment_clusters(hits: DataFrame, reads: DataFrame, min_edge: int = 10, min_scov: float = 0.1, max_distance: int = 10) -> DataFrame:
    """(well, case, sseqid, qseq, mismatch, full_count, gene, full_ratio) of the
    best hits, in the reads `reads` (name, well, case, genomic_sequence; one row
    a name counts): the aligned segment must be a part of its read that leaves
    `min_edge` bases at either end, cover more than `min_scov` of the subject,
    and differ by at most `max_distance`; pseudogenes (P...) drop out."""
    own = reads.groupBy(F.col("name").alias("qseqid")).agg(F.min_by(F.struct("well", "case", "genomic_sequence"), F.struct("well", "case", "genomic_sequence")).alias("_r")).select("qseqid", "_r.*")
    rows = best_hits(hits.where("sseqid IS NOT NULL AND qseq IS NOT NULL")).join(own, "qseqid").withColumn("qseq", F.replace("qseq", F.lit("-"), F.lit("")))
    first = F.instr("genomic_sequence", F.col("qseq"))
    rows = rows.withColumn("_first", first).where(F.col("_first") > 0)
    left = F.length("genomic_sequence") - (F.col("_first") + F.length("qseq") - 1)
    kept = rows.where((F.col("_first") >= min_edge) & (left >= min_edge) & (F.col("length") > min_scov * F.col("slen")) & ~F.col("sseqid").startswith("P"))
    counts = kept.groupBy("well", "case", "sseqid", "qseq", "mismatch").agg(F.count("*").alias("full_count")).where(F.col("mismatch") <= max_distance)
    counts = counts.withColumn("gene", gene_of("sseqid"))
    return counts.withColumn("full_ratio", F.col("full_count") / F.max("full_count").over(Window.partitionBy("well", "case", "gene")))


def cores(clusters: DataFrame, parts: DataFrame, min_quality: float = 0.75, min_coverage: float = 0.6) -> DataFrame:
    """`clusters` with aln_qseq (the segment without its allele's affixes),
    aln_status, aln_mismatch (its distance to the allele, -1 where trimming
    failed), db_length and corecov (0 where it failed); rows of `min_coverage`
    or more. `parts` comes from `affixes`."""
    names = exact.resolve_subjects(clusters, "sseqid", parts.select(F.col("db_name").alias("name"))).withColumnRenamed("subject", "_subject")
    side = parts.groupBy(F.col("db_name").alias("_name")).agg(F.min_by(F.struct("sequence", "prefix", "suffix"), F.struct("sequence", "prefix", "suffix")).alias("_p"))
    known = names.join(side, F.col("db_name") == F.col("_name")).select("_subject", F.col("_p.sequence").alias("_seq"), F.col("_p.prefix").alias("_prefix"), F.col("_p.suffix").alias("_suffix"))
    rows = clusters.join(known, F.col("sseqid") == F.col("_subject"))
    out = trimming.trimmed(rows, "qseq", "_prefix", "_suffix", "_seq", min_quality).withColumn("db_length", F.length("_seq").cast("long"))
    out = out.withColumn("corecov", F.when(F.col("db_length") > 0, F.coalesce(F.length("aln_qseq"), F.lit(0)) / F.col("db_length")).otherwise(F.lit(0.0)))
    return out.where(F.col("corecov") >= min_coverage).drop("_subject", "_seq", "_prefix", "_suffix")


def untrimmed(clusters: DataFrame) -> DataFrame:
    """The same columns without affixes: the segment is its own core."""
    return clusters.withColumn("aln_qseq", F.col("qseq")).withColumn("aln_mismatch", F.col("mismatch"))


def first_containing(values: DataFrame, column: str, alleles: DataFrame) -> DataFrame:
    """(value, containing) of each distinct non-empty value: the first allele by
    name whose sequence contains it; values in none are left out."""
    own = values.select(F.col(column).alias("value")).where("value <> ''").distinct()
    rows = contains(alleles.select("name", "seq"), "seq", own, "value")
    return rows.groupBy("value").agg(F.min("name").alias("containing"))


def named(clusters: DataFrame, alleles: DataFrame, isin: bool = True) -> DataFrame:
    """Adds allele_name: the subject's where the core doesn't differ, else the
    first allele that contains the core (with `isin`), else the subject's with a
    hash of the core."""
    new = unique_name("sseqid", "aln_qseq")
    if not isin:
        return clusters.withColumn("allele_name", F.when(F.col("aln_mismatch") == 0, F.col("sseqid")).otherwise(new))
    inside = first_containing(clusters.where("aln_mismatch <> 0"), "aln_qseq", alleles)
    rows = clusters.join(inside, F.col("aln_qseq") == F.col("value"), "left")
    return rows.withColumn("allele_name", F.when(F.col("aln_mismatch") == 0, F.col("sseqid")).otherwise(F.coalesce("containing", new))).drop("value", "containing")


def selected(clusters: DataFrame, min_count: int = 5, min_ratio: float = 0.1, min_length: int = 0, max_distance: int = 20, keep_failed: bool = False) -> DataFrame:
    """Rows that pass the output filters."""
    criteria = [filters.min_threshold("full_count", min_count), filters.min_threshold("full_ratio", min_ratio), filters.min_length("qseq", min_length)]
    criteria += [] if keep_failed else [filters.non_negative("aln_mismatch")]
    return filters.apply(clusters, [*criteria, filters.max_threshold("aln_mismatch", max_distance)])


def trim_statistics(rows: DataFrame, gene: str = "gene") -> DataFrame:
    """(gene, attempts, prefix_failures, suffix_failures, short_cores, ok) of
    rows with aln_status."""
    count = lambda s: F.count_if(F.col("aln_status") == s)
    return rows.groupBy(gene).agg(F.count("*").alias("attempts"), count("prefix not found").alias("prefix_failures"), count("suffix not found").alias("suffix_failures"), count("short core").alias("short_cores"), count("ok").alias("ok"))
