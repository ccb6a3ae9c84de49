"""Whether candidate alleles lie on the right chromosome of a genome.

The candidates are the dictionary; the genome streams by in overlapping pieces,
so its size doesn't matter. Every piece reports its local alignments of a
candidate (or its reverse complement), and the best ones decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import reverse_complement
from ..operators import aligner
from ..operators.aligner import MOST_BASES, Seeds, align_batch, cigar, codes

PIECE = 100_000
_HITS = "name string, ref string, description string, genome string, orientation string, pos long, ref_end long, score long, nm long, cigar string"


def concatenated(columns: list[str]) -> Column:
    """The columns' texts in a row; null as empty."""
    return F.concat(F.lit(""), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def subsequence(seq: str | Column, start: Column, length: Column) -> Column:
    """`length` characters from the 0-based `start`, as far as there are any."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    begin = F.greatest(start, F.lit(0))
    return F.substring(seq, (begin + 1).cast("int"), F.greatest(F.lit(0), F.least(start + length, F.length(seq)) - begin).cast("int"))


def hits(candidates: DataFrame, name: str, sequence: str | Column, genome: DataFrame, seed: int = 14, band: int = 16, min_score: int = 60) -> DataFrame:
    """(name, ref, description, genome, orientation, pos, ref_end, score, nm,
    cigar) of the local alignments of candidates in `genome` (genome, name,
    description, seq); pos is 0-based on the forward strand, the CIGAR and its
    clips follow the candidate's own orientation on that strand."""
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    own = candidates.select(F.col(name).alias("name"), F.upper(sequence).alias("seq")).where("name IS NOT NULL AND seq <> ''").distinct()
    size = own.agg(F.sum(F.length("seq"))).first()[0] or 0
    if size > MOST_BASES:
        raise ValueError(f"{size} bases of candidates; at most {MOST_BASES} are a dictionary")
    known = [tuple(r) for r in own.orderBy("name", "seq").collect()]
    both = [(n, "+", s) for n, s in known] + [(n, "-", aligner.reverse_complement(s)) for n, s in known]
    overlap = 2 * max((len(s) for _, s in known), default=0) + 2 * band
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(PIECE))
    pieces = genome.where("seq <> ''").select("genome", "name", "description", "seq", F.explode(starts).alias("_from"))
    pieces = pieces.select("genome", F.col("name").alias("ref"), "description", "_from", F.substring("seq", F.col("_from") + 1, F.lit(PIECE + overlap)).alias("piece")).repartition("ref", "_from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Seeds([s for _, _, s in both], seed)
        for batch in batches:
            rows = []
            for genome_, ref, description, begin, piece in zip(*(batch.column(c).to_pylist() for c in ("genome", "ref", "description", "_from", "piece"))):
                c = codes(piece)
                text, own_at, at = index.hits(c)
                # loci: seeds of one candidate near one diagonal
                cell = (at - own_at + (1 << 40)) // band
                found = {}
                for key in zip(text.tolist(), cell.tolist(), (at - own_at).tolist()):
                    found.setdefault(key[:2], []).append(key[2])
                loci = [(t, int(np.median(d))) for (t, _), d in found.items()]
                windows = []
                for t, diagonal in loci:
                    first = max(0, diagonal - 2 * band)
                    windows.append((first, c[first : diagonal + len(index.texts[t]) + 2 * band]))
                done = align_batch([index.texts[t] for t, _ in loci], [w for _, w in windows], np.array([d - w[0] for (_, d), w in zip(loci, windows)], np.int64), band)
                seen = set()
                for (t, _), (first, _), hit in zip(loci, windows, done):
                    if hit is None or hit.score < min_score:
                        continue
                    name_, strand, seq = both[t]
                    row = (name_, ref, description, genome_, strand, begin + first + hit.s_start, begin + first + hit.s_end, hit.score, hit.edits(), cigar(hit, len(seq)))
                    if row not in seen:
                        seen.add(row)
                        rows.append(row)
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.string()] * 5 + [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=[x.split()[0] for x in _HITS.split(", ")])

    return pieces.mapInArrow(run, _HITS).distinct()


def checked(candidates: DataFrame, name: str, sequence: str | Column, genome: DataFrame, chromosome: str, tag: str = "Primary Assembly", **options) -> DataFrame:
    """(name, matched, position, edit_distance, ref_sequence, orientation,
    cigar) of every candidate: of its best-scoring alignments the first (by
    reference and position) whose description contains `chromosome` and matches
    `tag`. The distance counts differing positions where the reference's
    stretch is as long, else the alignment's edits. Unmatched candidates have
    empty texts and -1."""
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    found = hits(candidates, name, sequence, genome, **options)
    best = found.join(found.groupBy("name").agg(F.max("score").alias("score")), ["name", "score"])
    right = best.where(F.col("description").contains(chromosome) & F.col("description").rlike(tag))
    one = right.groupBy("name").agg(F.min(F.struct("genome", "ref", "pos", "ref_end", "orientation", "nm", "cigar")).alias("m")).select("name", "m.*")
    ref = genome.select(F.col("genome").alias("_g"), F.col("name").alias("_r"), F.col("seq").alias("_s"))
    cut = one.join(ref, (F.col("genome") == F.col("_g")) & (F.col("ref") == F.col("_r"))).withColumn("_cut", subsequence("_s", F.col("pos"), F.col("ref_end") - F.col("pos"))).drop("_s", "_g", "_r")
    own = candidates.select(F.col(name).alias("name"), F.upper(sequence).alias("_own")).where("name IS NOT NULL AND _own <> ''").distinct()
    rows = own.join(cut, "name", "left").withColumn("ref_sequence", F.when(F.col("orientation") == "-", reverse_complement("_cut")).otherwise(F.col("_cut")))
    same = F.aggregate(F.zip_with(F.split("_own", ""), F.split("ref_sequence", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    distance = F.when(F.col("ref_sequence").isNull(), -1).when(F.length("_own") == F.length("ref_sequence"), same).otherwise(F.col("nm"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("name", F.col("ref").isNotNull().alias("matched"), F.when(F.col("ref").isNull(), "").otherwise(F.concat_ws(":", "ref", "pos")).alias("position"), distance.cast("long").alias("edit_distance"), text("ref_sequence"), text("orientation"), text("cigar"))
