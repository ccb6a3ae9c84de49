from pyspark.sql import functions as F

from seqloom.operators.dictionary import _seeded, contains
from seqloom.operators.skew import heavy_keys, per_key, tree_aggregate
from seqloom.plans import cohort, exact
from seqloom.sources import files

READ, ALLELE = "TTGCATTGCATTGCAGATTACAGATTACACACAGTGAAAAAAAAAAACCCCCCCCCCCCACAAAAACCGGTTGG", "GATTACAGATTACA"


def test_flanks(spark):
    df = spark.createDataFrame([(READ,)], "r string")

    def parts(gene, **k):
        return df.select(*[c.alias(n) for n, c in exact.flanks(gene, F.col("r"), F.lit(16), F.lit(29), **k).items()]).first().asDict()

    assert parts("V") == {"prefix": "GCATTGCATTGCA", "heptamer": "CACAGTG", "spacer": "AAAAAAAAAAACCCCCCCCCCCC", "nonamer": "ACAAAAACC"}
    assert parts("J") == {"nonamer": "T", "spacer": "TTGCATTG", "heptamer": "CATTGCA", "suffix": "CACAGTGAAAAAA"}
    assert parts("D") == {"pre_nonamer": "T", "pre_spacer": "TTGCATTG", "pre_heptamer": "CATTGCA", "post_heptamer": "CACAGTG", "post_spacer": "AAAAAAAAAAAC", "post_nonamer": "CCCCCCCCC"}
    assert parts("V", extension=5) == {"prefix": "GCATTGCATTGCA", "suffix": "CACAG"}
    assert parts("J", extension=5) == {"prefix": "TTGCA", "suffix": "CACAGTGAAAAAA"}


def test_dictionary_join(spark):
    texts = spark.createDataFrame([(1, READ), (2, None), (3, ""), (4, "GATTACAGATTACAGATTACA")], "id int, text string")
    words = spark.createDataFrame([("a", ALLELE), ("b", "CACAGTG"), ("c", ""), ("d", None)], "name string, word string")
    got = sorted((r.id, r.name, r.start) for r in contains(texts, "text", words, "word").collect())
    assert got == [(1, "a", 16), (1, "b", 30), (4, "a", 1)]
    assert sorted((r.id, r.name, r.start) for r in _seeded(texts, "text", words.where("word <> ''"), "word").collect()) == got
    assert contains(texts, "text", words.limit(0), "word").count() == 0


def test_exact_empty(spark):
    reads = spark.createDataFrame([], "well long, case string, name string, genomic_sequence string")
    alleles = spark.createDataFrame([("IGHV1*01", ALLELE)], "name string, seq string")
    assert exact.exact_search(exact.matches(reads, alleles, "V")).count() == 0


def test_heptamers(spark):
    motifs = ["CACAGTG", "CACAATG", "CACAGAG", "CACGGTG", "CACAGCG"]
    cases = {"AACACAGTGTT": 3, "AACACAGTG": None, "CACTGTGAAACACAGTGA": 11, "GGCACAGTCAA": 3, "TTTTTTTTTTTT": None, "ACG": None}
    reads = spark.createDataFrame([(ALLELE + s,) for s in cases], "genomic_sequence string")
    out = {r.sequence: r.heptamer for r in exact.heptamer_search(reads, spark.createDataFrame([("IGHV1*01", ALLELE)], "name string, seq string"), motifs).collect()}
    want = {ALLELE + (s[: k - 1] if k else ""): (s[k - 1 : k + 6] if k else "") for s, k in cases.items()}
    assert out == want


def test_every_locus_is_searched(spark, tmp_path):
    from seqloom.plans import queries

    alleles = {"IGHV1*01": "GATTACAGATTACAAAA", "IGKV1*01": "GGTCCATTGGTCCAAAA", "IGLV1*01": "CTTAGGCTTAGGATAAA", "IGHJ1*01": "TTTGGGTTTGGGCCCAA"}
    motifs = {"IGHV": "CACAGCG", "IGKV": "CACACTG", "IGLV": "CATGGTG"}
    reads = [(1, "D1", f"r{i}", alleles[x][:-3] + "TT" + motifs.get(x[:4], "CACAGTG") + "TTT") for i, x in enumerate(alleles) for _ in range(2)]
    spark.createDataFrame(list(alleles.items()), "name string, seq string").write.parquet(str(tmp_path / "allele_db.parquet"))
    spark.createDataFrame(reads, "well long, case string, name string, genomic_sequence string").write.parquet(str(tmp_path / "demultiplex.parquet"))
    spark.createDataFrame([(s[1:],) for s in alleles.values()] + [(None,)], "sequence string").write.parquet(str(tmp_path / "heptamer.parquet"))
    got = {(r.db_name, r.sequence, r.heptamer, r["count"]) for r in queries.heptamer_summary(spark, str(tmp_path)).collect()}
    assert got == {(x, alleles[x][:-3] + "TT", motifs[x[:4]], 2) for x in alleles if x[:4] in motifs}
    assert {(r.value, r.nearest, r.distance) for r in queries.nearest_allele(spark, str(tmp_path)).collect()} == {(s[1:], x, 1) for x, s in alleles.items()}


def test_cohort(spark):
    sets = {"D1": "AB", "D2": "AB", "D3": "AC", "D4": "BC", "D5": "B", "D6": "C", "D7": "X", "D8": "Y"}
    calls = spark.createDataFrame([(d, a) for d, s in sets.items() for a in s] + [(None, "A"), ("D1", None), ("D1", "")], "case string, allele string")
    e = {(r.allele_a, r.allele_b): r for r in cohort.edges(calls, "case", "allele").collect()}
    assert set(e) == {("A", "B"), ("A", "C"), ("B", "C")}
    ab = e["A", "B"]
    assert (ab.n_a, ab.n_b, ab.n_shared, ab.jaccard) == (3, 4, 2, 0.4) and abs(ab.rho - 0.258199) < 1e-6
    assert abs(ab.p_enrich - 0.975758) < 1e-6 and abs(ab.q_enrich - 0.993939) < 1e-6
    fixed = {(r.allele_a, r.allele_b): r.p_enrich for r in cohort.edges(calls, "case", "allele", corrected=True).collect()}
    assert abs(fixed["A", "B"] - 0.5) < 1e-9
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "a string, b string")
    groups = cohort.components(chain, "a", "b").groupBy("group_id").count().collect()
    assert sorted(map(tuple, groups)) == [("n00", 21), ("x", 2)]
    assert cohort.edges(calls.limit(0), "case", "allele").count() == 0


def test_haplotypes(spark):
    rows = [("D1", "A*01", "V", 10, "ATCGATCG"), ("D1", "A*02", "V", 8, "GCTAGCTA"), ("D2", "A*01", "V", 15, "ATCGATCG"), ("D2", "A*02", "V", 3, "GCTAGCTA")]
    df = spark.createDataFrame(rows, "case string, db_name string, gene string, count long, sequence string")
    out = {r.case: r for r in cohort.haplotypes(df).collect()}
    assert (out["D1"].genotype, out["D1"].allele_1, out["D1"].allele_2, out["D1"].freq_1, out["D1"].ratio) == ("heterozygous", "A*01_1", "A*02_1", 0.556, 0.8)
    assert (out["D2"].genotype, out["D2"].allele_2, out["D2"].total_count) == ("homozygous", "", 15)


def test_tree_aggregate(spark):
    n = 3000
    df = spark.range(n).repartition(40).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    got = {r.k: (r.n, r.s, r.lo, r.hi) for r in tree_aggregate(df, ["k"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, chunks=64, fan_in=4).collect()}
    want = {r.k: (r.n, r.s, r.lo, r.hi) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert got == want
    assert [r.key_value for r in heavy_keys(per_key(df, "k"), 0.04).collect()] == ["hot"]
    assert heavy_keys(per_key(df.limit(0), "k"), 0.04).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A*01", "ACGT", "IIII"), ("B*01", "GGTT", "####")], "name string, seq string, quality string")
    files.write_fasta(df, str(tmp_path / "f"))
    assert sorted((r.name, r.seq) for r in files.read_fasta(spark, str(tmp_path / "f")).collect()) == [("A*01", "ACGT"), ("B*01", "GGTT")]
    assert files.check_fasta(files.read_fasta(spark, str(tmp_path / "f"))).count() == 0
    files.write_fastq(df, str(tmp_path / "q"), compress=True)
    assert sorted(map(tuple, files.read_fastq(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, df.collect()))
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))


def test_demultiplex(spark):
    idx = spark.createDataFrame([(1, "AAC", "GGT", "D1"), (2, "AAC", "GGT", "D2"), (3, "CCC", "TTT", "D3")], "well long, forward_index string, reverse_index string, case string")
    reads = spark.createDataFrame([("r1", "AACxxxxGGT"), ("r2", "CCCxTTT"), ("r3", "CCCxGGT"), ("r4", None), ("r5", "AACGGT")], "name string, genomic_sequence string")
    assert sorted(map(tuple, exact.demultiplex(reads, idx, min_length=7).collect())) == [("r1", 1, "D1"), ("r2", 3, "D3")]


def test_borders(spark):
    df = spark.createDataFrame([(READ,)], "r string")

    def rejects(gene, ext, border):
        return df.select(exact.near_border(gene, F.col("r"), F.lit(16), F.lit(29), ext, border)).first()[0]

    assert [rejects("V", *x) for x in ((40, 10), (30, 10), (45, 1), (44, 1))] == [True, False, True, False]
    assert [rejects("J", *x) for x in ((5, 10), (5, 11), (10, 5), (10, 6))] == [False, True, False, True]


def test_stream_counts_as_batch(spark, tmp_path):
    from seqloom.streaming.reads import case_counts

    rows = spark.createDataFrame([("a", "ACGT", "2021-03-01 04:10:00"), ("a", "AC", "2021-03-01 04:50:00"), ("b", None, "2021-03-01 05:10:00")], "case string, genomic_sequence string, t string").select("case", "genomic_sequence", F.to_timestamp("t").alias("read_ts"))
    rows.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, case_counts(rows).collect()), key=str)
    q = case_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect()), key=str) == want
