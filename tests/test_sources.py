"""Readers and writers on files with odd contents."""

import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.sources import files


def test_fasta_headers_with_markers(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_bytes(b">A*01 a > b\r\nAC\r\nGT\r\n>B*02\nTT\n\n>C*03 last >\nGG")
    got = sorted(tuple(r) for r in files.read_fasta(spark, str(p)).collect())
    assert got == [("A*01", "a > b", "ACGT", "x.fasta"), ("B*02", "", "TT", "x.fasta"), ("C*03", "last >", "GG", "x.fasta")]
    (tmp_path / "y.fasta.gz").write_bytes(gzip.compress(p.read_bytes()))
    assert files.read_fasta(spark, str(tmp_path / "y.fasta.gz")).count() == 3
    (tmp_path / "empty.fasta").write_text("")
    assert files.read_fasta(spark, str(tmp_path / "empty.fasta")).count() == 0


def test_validation(spark):
    fine = spark.createDataFrame([("IGHV1-1*01", "ACGT"), ("IGHV1-2*02_S1234", "ACGA")], "name string, seq string")
    assert files.validated(fine).count() == 2
    bad = spark.createDataFrame([("IGHV1-1*01", "ACGT"), ("IGHV1-1*01", "ACGT"), ("x", "ACN"), (None, ""), ("A_1_2*01", None)], "name string, seq string")
    assert {r.problem: r.n for r in files.check_fasta(bad, True).collect()} == {"empty name": 1, "empty sequence": 2, "bad identifier": 3, "other characters": 1, "repeated name": 1, "repeated sequence": 1}
    with pytest.raises(ValueError, match="repeated name"):
        files.validated(bad)


def test_fastq_over_splits(spark, tmp_path):
    """Records that splits cut, qualities that begin like headers, and an
    incomplete record at the end."""
    records = [(f"r{i}", "ACGT" * (i % 7 + 1), "@" * (4 * (i % 7 + 1))) for i in range(500)]
    text = "".join(f"@{n} more\n{s}\n+\n{q}\n" for n, s, q in records)
    (tmp_path / "a.fastq").write_text(text + "@cut\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = files.read_fastq(spark, str(tmp_path / "*.fastq"), file=True)
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((*r, "a.fastq") for r in records)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text.encode()))
    assert files.read_fastq(spark, str(tmp_path / "b.fastq.gz")).count() == 500


def test_many_files_need_one_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\ta\n")
    (tmp_path / "b.tsv").write_text("x\ty\n2\t\n")
    assert sorted(tuple(r) for r in files.read_many(spark, str(tmp_path / "*.tsv")).collect()) == [(1, "a", "a.tsv"), (2, None, "b.tsv")]
    (tmp_path / "c.tsv").write_text("y\tx\nb\t3\n")
    with pytest.raises(ValueError, match="c.tsv"):
        files.read_many(spark, str(tmp_path / "*.tsv"))
    with pytest.raises(ValueError, match="no file"):
        files.read_many(spark, str(tmp_path / "*.none"))


def test_configuration_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("forward_index;reverse_index;case\nAC;GT;one\nCC;GG;two\n")
    assert [tuple(r) for r in files.read_indices(spark, str(tmp_path / "i.csv")).orderBy("well").collect()] == [(1, "AC", "GT", "one"), (2, "CC", "GG", "two")]
    (tmp_path / "bad.csv").write_text("forward_index,case,reverse_index\nAC,one,GT\n")
    with pytest.raises(ValueError):
        files.read_indices(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "m.json").write_text('{"IGHV": ["CACAGTG"]}')
    assert files.read_motifs(spark, str(tmp_path / "m.json")) == {"IGHV": ["CACAGTG"]}
    (tmp_path / "t.tsv").write_text("name\tratio\nA\t0.5\nA\t0.6\n")
    with pytest.raises(ValueError):
        files.read_thresholds(spark, str(tmp_path / "t.tsv"))
    assert files.identifiers(spark, str(tmp_path / "absent.fasta")).count() == 0


def test_named_files_and_limits(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "r1", "AC", 9), (2, None, "r2", None, 9)], "well long, case string, name string, genomic_sequence string, extra int")
    path = files.write_named(df, str(tmp_path / "out.tsv"))
    assert path.endswith("out.tsv.gz") and gzip.open(path, "rt").readline() == "well\tcase\tname\tgenomic_sequence\textra\n"
    assert [tuple(r) for r in files.read_reads(spark, path).collect()] == [(1, "a", "r1", "AC"), (2, None, "r2", None)]
    assert files.read_reads(spark, path, 1).count() == 1
    with pytest.raises(ValueError, match="lacks"):
        files.read_reads(spark, files.write_named(df.drop("case"), str(tmp_path / "less.tsv")))
    by = df.select(F.lit("x").alias("case"), "name", F.lit("AC").alias("seq"), F.lit("II").alias("quality"))
    files.write_by_case(by, str(tmp_path / "split"))
    assert sorted(spark.read.text(str(tmp_path / "split" / "case=x")).toPandas()["value"]) == sorted(["@r1", "AC", "+", "II", "@r2", "AC", "+", "II"])


def test_outside_aligner_and_reports(spark, tmp_path):
    from seqloom.sources import outside, reports

    assert outside.option_tokens('-task x --evalue 3 --a-b "c d" --') == ["-task", "x", "-evalue", "3", "-a-b", "c d", "--"]
    assert outside.version_within("tool: 2.15.0+", (2, 15, 0), (2, 17, 0)) and not outside.version_within("tool 2.9.1", (2, 15, 0), (2, 17, 0)) and not outside.version_within("", (1,), (2,))
    script = tmp_path / "fake.py"
    script.write_text("import sys\nfor line in sys.stdin:\n    if line[0] == '>':\n        print('\\t'.join([line[1:].strip(), 's', '99.5', *['1'] * 4, '80', '80', *['1'] * 6, '0.001', '50', 'plus', 'ACGT']))\n")
    reads = spark.createDataFrame([("a", "ACGT"), ("b", ""), (None, "AC"), ("c", "GG")], "name string, seq string")
    import sys

    rows = outside.search_outside(reads, "name", "seq", [sys.executable, str(script)]).collect()
    assert sorted(r.qseqid for r in rows) == ["a", "c"] and rows[0].pident == 99.5 and rows[0].qstart == 1
    table = reports.count_table(spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "k string"), "k").collect()
    assert [(r.k, r["count"]) for r in table] == [("x", 2), (None, 1), ("y", 1)]
    assert reports.bars([("a", 4), ("bb", 2)], 4) == " a #### 4\nbb ## 2" and reports.bars([]) == ""
