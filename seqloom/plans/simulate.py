"""Reads of invented donors: barcodes, a reference, mutated alleles. All of it
follows from a seed by hashes, so any task makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lengths and mutations of the simulated design
BARCODE, LEAST_DISTANCE, FLANK = 10, 4, (20, 30)
KINDS, SIZES = ("insertion", "deletion", "substitution"), (1, 3, 5)
LEADER, SIGNAL = "GTTTTTGT", "CACAGTG"


def bases(seed: Column, n: Column, most: int) -> Column:
    """`n` letters (at most `most`) that follow from `seed`."""
    letter = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(seed, i), F.lit(4)) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(most)), F.lit(1), n.cast("int")), letter), "")


def _text(seed: str, n: int) -> str:
    import xxhash

    return "".join("ACGT"[xxhash.xxh64_intdigest(f"{seed}/{i}") % 4] for i in range(n))


def barcodes(n: int, seed: int = 1) -> list[str]:
    """`n` barcodes that differ in `LEAST_DISTANCE` places or more."""
    out: list[str] = []
    tries = 0
    while len(out) < n:
        new = _text(f"barcode {seed} {tries}", BARCODE)
        tries += 1
        if all(sum(a != b for a, b in zip(new, old)) >= LEAST_DISTANCE for old in out):
            out.append(new)
        if tries > 1000 * (n + 1):
            raise ValueError("no more barcodes at this distance")
    return out


def indices(spark: SparkSession, donors: int = 2, seed: int = 1) -> DataFrame:
    """(well, forward_index, reverse_index, case)."""
    codes = barcodes(2 * donors, seed)
    return spark.createDataFrame([(i + 1, codes[2 * i], codes[2 * i + 1], f"Donor{i + 1}") for i in range(donors)], "well long, forward_index string, reverse_index string, case string")


def mutated(seq: Column, kind: Column, at: Column, size: Column, seed: Column) -> Column:
    """`seq` with `size` letters inserted behind position `at` (1-based),
    deleted from it on, or each replaced by another one."""
    head, rest = F.left(seq, at - 1), F.substring(seq, at + size, F.length(seq))
    turn = lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(3)) + 1).cast("int")
    other = lambda i: F.substring(F.lit("ACGTACG"), (F.instr(F.lit("ACGT"), F.substring(seq, at + i, F.lit(1))) + turn(i)).cast("int"), F.lit(1))
    replaced = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), other), "")
    return F.when(kind == "insertion", F.concat(F.left(seq, at), bases(seed, size, max(SIZES)), F.substring(seq, at + 1, F.length(seq)))).when(kind == "deletion", F.concat(head, rest)).otherwise(F.concat(head, replaced, rest))


def alleles(spark: SparkSession, donors: int = 2, extra: int = 17, length: int = 400, seed: int = 1) -> DataFrame:
    """(name, seq, donor, kind, size): the reference, each donor's alleles of
    every kind and size, and `extra` more."""
    reference = _text(f"reference {seed}", length)
    lo, hi = (50, length - 50) if length > 100 + max(SIZES) else (max(1, length // 4), max(2, 3 * length // 4 - max(SIZES)))
    kind = F.array(*map(F.lit, KINDS))
    size = F.array(*map(F.lit, SIZES))
    pick = lambda xs, what: F.element_at(xs, (F.pmod(F.xxhash64("donor", "n", F.lit(what), F.lit(seed)), F.size(xs)) + 1).cast("int"))
    rows = spark.range(donors).select((F.col("id") + 1).alias("donor"))
    grid = rows.select("donor", F.explode(kind).alias("kind")).select("donor", "kind", F.explode(size).alias("size"))
    own = grid.select("donor", "kind", "size", F.lit(0).alias("n"), F.format_string("REF*%d_%s_%d", "donor", "kind", "size").alias("name"))
    more = rows.select("donor", F.explode(F.sequence(F.lit(1), F.lit(extra))).alias("n")) if extra else rows.select("donor", F.lit(0).alias("n")).limit(0)
    more = more.select("donor", pick(kind, "kind").alias("kind"), pick(size, "size").alias("size"), "n", F.format_string("REF*%d_extra_%d", "donor", "n").alias("name"))
    both = own.unionByName(more)
    place = (F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(hi - lo)) + lo).cast("int")
    made = both.withColumn("_at", place).withColumn("seq", mutated(F.lit(reference), F.col("kind"), F.col("_at"), F.col("size"), F.xxhash64("name", F.lit(seed + 1))))
    return spark.createDataFrame([("REF*01", reference)], "name string, seq string").select("name", "seq", F.lit(None).cast("long").alias("donor"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("size")).unionByName(made.select("name", "seq", "donor", "kind", "size"))


def reads(spark: SparkSession, known: DataFrame, index: DataFrame, per_allele: int = 100, seed: int = 1) -> DataFrame:
    """(name, genomic_sequence): `per_allele` reads of each of a donor's own
    alleles and of the reference, between barcodes and random flanks."""
    wells = index.select(F.col("well").alias("_well"), "forward_index", "reverse_index", F.col("case").alias("_case"))
    own = known.where("donor IS NOT NULL AND name NOT LIKE '%extra%'").join(wells, F.col("donor") == F.col("_well"))
    reference = known.where("donor IS NULL").join(wells, F.lit(True))
    label = F.when(F.col("donor").isNull(), "reference").otherwise(F.concat_ws("_", "kind", F.col("size").cast("string")))
    rows = own.unionByName(reference).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(per_allele))))
    rows = rows.withColumn("name", F.concat(F.col("_case"), F.lit("_"), label, F.lit("_read"), F.col("_n").cast("string")))
    flank = lambda side: bases(F.xxhash64("name", F.lit(side), F.lit(seed)), F.pmod(F.xxhash64("name", F.lit(side + 2), F.lit(seed)), F.lit(FLANK[1] - FLANK[0] + 1)) + FLANK[0], FLANK[1])
    return rows.select("name", F.concat("forward_index", flank(0), F.lit(LEADER), "seq", F.lit(SIGNAL), flank(1), "reverse_index").alias("genomic_sequence"))
