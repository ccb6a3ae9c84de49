"""Readers and writers of TSV, FASTA, FASTQ and JSON, plain or gzip.

Plain files are read in splits by many tasks; gzip never splits. Nulls in a
written field become an empty one. An empty file gives an empty table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

READS = T.StructType([T.StructField("well", T.LongType()), T.StructField("case", T.StringType()), T.StructField("name", T.StringType()), T.StructField("genomic_sequence", T.StringType())])
# Column names of the 19-column alignment table, of an index file and of a threshold table
_TEXT, _REAL = {"qseqid", "sseqid", "sstrand", "qseq"}, {"pident", "qcovs", "qcovhsp", "evalue", "bitscore"}
_ALIGNMENT = "qseqid sseqid pident nident length mismatch gapopen qcovs qcovhsp qstart qend sstart send qlen slen evalue bitscore sstrand qseq".split()
ALIGNMENTS = T.StructType([T.StructField(c, T.StringType() if c in _TEXT else T.DoubleType() if c in _REAL else T.LongType()) for c in _ALIGNMENT])
INDICES = ["forward_index", "reverse_index", "case"]
THRESHOLDS = T.StructType([T.StructField("name", T.StringType()), T.StructField("ratio", T.DoubleType())])
# Fixed value: what an allele identifier looks like
IDENTIFIER = r"[A-Z].*\d.*\*(.*S.*\d.*|.*\d+$)"


def _base_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob matches, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """A tab-separated table; without a schema, types are inferred and whole
    numbers widened to long. Empty fields are null. A glob reads many files."""
    reader = spark.read.option("sep", "\t").option("header", header)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t == "int" else F.col(f"`{n}`") for n, t in df.dtypes])


def read_reads(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Demultiplexed reads: the four columns must be there, others are dropped.
    `limit` takes that many rows from the beginning of the file."""
    df = read_tsv(spark, path)
    missing = [c for c in READS.names if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in READS])
    return rows if limit is None else rows.limit(limit)


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a glob, with each row's base name as `file`. Every file
    must have the same columns in the same order, else ValueError."""
    files = list_files(spark, pattern)
    if not files:
        raise ValueError(f"no file matches {pattern}")
    headers = {f: spark.read.option("sep", "\t").option("header", True).csv(f).columns for f in files}
    for f, columns in headers.items():
        if columns != headers[files[0]]:
            raise ValueError(f"{f} has columns {columns}, {files[0]} has {headers[files[0]]}")
    return read_tsv(spark, files).withColumn("file", _base_name())


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq, file): records begin at a ">" that starts a
    line. The name is the header's first word, the description the rest."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", _base_name().alias("file"))
    record = F.regexp_replace("value", r"^\s*>", "")
    head = F.trim(F.regexp_replace(F.regexp_extract(record, r"^([^\n]*)", 1), "\r", ""))
    rows = raw.where(F.trim(record) != "").select(head.alias("h"), F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", "").alias("seq"), "file")
    return rows.select(F.split_part("h", F.lit(" "), F.lit(1)).alias("name"), F.trim(F.regexp_replace("h", r"^\S+", "")).alias("description"), "seq", "file")


def valid_identifier(name: str | Column) -> Column:
    """Whether a name is an allele identifier: the pattern, and at most one '_' and one '*'."""
    name = F.col(name) if isinstance(name, str) else name
    few = lambda c: F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))) <= 1
    return F.coalesce(name.rlike(IDENTIFIER) & few("_") & few("*"), F.lit(False))


def check_fasta(df: DataFrame, identifiers_only: bool = False) -> DataFrame:
    """(problem, n) of records with an empty name or sequence, a repeated name
    or sequence, a character besides A, C, G and T, and with `identifiers_only` a
    name that is no allele identifier; no rows if fine."""
    tests = {
        "empty name": F.count_if(F.coalesce(F.col("name") == "", F.lit(True))), "empty sequence": F.count_if(F.coalesce(F.col("seq") == "", F.lit(True))),
        "other characters": F.count_if(~F.col("seq").rlike("^[ACGT]*$")),
    }
    if identifiers_only:
        tests["bad identifier"] = F.count_if(~valid_identifier("name"))
    one = df.agg(*[c.alias(k) for k, c in tests.items()])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(f"`{k}`").alias("n")) for k in tests])))
    for c, label in (("name", "repeated name"), ("seq", "repeated sequence")):
        out = out.unionByName(df.where(F.col(c) != "").groupBy(c).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(label).alias("problem"), "n"))
    return out.where("n > 0")


def validated(df: DataFrame) -> DataFrame:
    """`df`, or ValueError with what `check_fasta` finds."""
    problems = check_fasta(df, True).collect()  # six rows at most
    if problems:
        raise ValueError("; ".join(f"{r.n} x {r.problem}" for r in problems))
    return df


def read_fastq(spark: SparkSession, path: str, file: bool = False) -> DataFrame:
    """(name, seq, quality) of four-line records, with the `file`'s base name if
    asked for; the name is the first word after "@". Lines are numbered within their file from the line counts of
    its splits (one row a split), each task puts its own records together, and
    only the records that a split cuts are shuffled. An incomplete record at the
    end of a file is left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    counts = lines.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    starts = {(r.path, r.split): r["first"] for r in counts.select("path", "split", before).collect()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held = None, 0, []

        def row(values: list[str], first: int) -> tuple:
            return (at[0], first // 4, first % 4, values)

        for batch in batches:
            out = []
            for value, *where in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "split"))):
                if tuple(where) != at:
                    if held:
                        out.append(row(held, number - len(held)))
                    at, number, held = tuple(where), starts[tuple(where)], []
                held.append(value)
                number += 1
                if number % 4 == 0:
                    out.append(row(held, number - len(held)))
                    held = []
            yield _lines(out)
        if held:
            yield _lines([row(held, number - len(held))])

    pieces = lines.mapInArrow(records, "path string, record long, first int, lines array<string>")
    whole = pieces.where(F.size("lines") == 4).select("path", "lines")
    joined = pieces.where(F.size("lines") < 4).groupBy("path", "record").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "lines"))), lambda x: x["lines"])).alias("lines"))
    rows = whole.unionByName(joined.where(F.size("lines") == 4).select("path", "lines"))
    clean = lambda i: F.regexp_replace(F.col("lines")[i], "\r$", "")
    name = F.split_part(F.substring(clean(0), 2, 1 << 30), F.lit(" "), F.lit(1))
    return rows.where(F.col("lines")[0].startswith("@")).select(name.alias("name"), clean(1).alias("seq"), clean(3).alias("quality"), *([F.regexp_extract("path", r"([^/]+)$", 1).alias("file")] if file else []))


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.list_(pa.string()))], names=["path", "record", "first", "lines"])


def numbered(df: DataFrame, column: str) -> DataFrame:
    """`df` with a 1-based number in file order; for small files (index files
    have one row a well), as one task numbers it."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn(column, F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    """(well, forward_index, reverse_index, case) of an index file; the
    delimiter is the first of tab, comma and semicolon that its header has. Its
    columns must be exactly these three."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    sep = next((s for s in "\t,;" if s in head), "\t")
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    if df.columns != INDICES:
        raise ValueError(f"{path} has columns {df.columns}, not {INDICES}")
    return numbered(df, "well").select("well", *INDICES)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """The 19-column alignment table, without a header."""
    return read_tsv(spark, path, ALIGNMENTS, header=False)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(name, ratio) of alleles or genes; a name given twice is an error."""
    df = read_tsv(spark, path, THRESHOLDS)
    if not df.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError(f"{path} has a name twice")
    return df


def read_motifs(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A JSON object of motif lists by locus (a configuration file)."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    out = json.loads(text)
    if not isinstance(out, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in out.values()):
        raise ValueError(f"{path} must map loci to lists of motifs")
    return out


def identifiers(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a FASTA file's distinct identifiers; empty if there is no file."""
    if not list_files(spark, path):
        return spark.createDataFrame([], "name string")
    return read_fasta(spark, path).select("name").distinct()


def write_tsv(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", description: str | None = None, compress: bool = False) -> None:
    head = F.concat_ws(" ", F.col(name), F.col(description)) if description else F.col(name)
    df.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_query_fasta(df: DataFrame, path: str, name: str, seq: str, extra: tuple[str, ...] = (), compress: bool = False) -> None:
    """FASTA for an aligner: the header is the name and, after spaces, `extra`
    columns (null as empty); without any it ends in a space."""
    rest = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in extra] or [F.lit("")]
    write_fasta(df.select(F.concat_ws(" ", F.col(name), *rest).alias("head"), F.col(seq).alias("seq")), path, "head", "seq", compress=compress)


def write_fastq(df: DataFrame, path: str, compress: bool = False) -> None:
    _fastq(df).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def _fastq(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "quality").alias("value"))


def write_by_case(df: DataFrame, path: str, case: str = "case", compress: bool = False, salts: int = 16) -> None:
    """FASTQ files in a folder per case (case=...). Rows are spread over
    `salts` tasks a case, so a large case is written by several."""
    rows = _fastq(df, F.col(f"`{case}`").alias("case"), F.pmod(F.xxhash64("name"), F.lit(salts)).alias("_s"))
    rows.repartition("case", "_s").drop("_s").write.mode("overwrite").option("compression", "gzip" if compress else "none").partitionBy("case").text(path)


def one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Joins a written folder of one part into a file of the given name; for
    small outputs that were coalesced to one partition."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} has {len(parts)} parts")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(parts[0], target)
    fs.delete(where, True)


def write_named(df: DataFrame, path: str, write=write_tsv, **options) -> str:
    """A small table as one file of exactly this name; with compression, .gz is
    added if it is missing. Returns the name."""
    if options.get("compress", write is write_tsv) and not path.endswith(".gz"):
        path += ".gz"
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    write(df.coalesce(1), folder, **options)
    one_file(df.sparkSession, folder, path)
    return path

