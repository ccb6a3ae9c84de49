"""Alignment, discovery, genome check, clustering and the older methods
against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.operators import aligner, dictionary, tables
from seqloom.plans import clusters, cohort, discovery, dscan, exact, genome, patterns, simulate, trimming


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def edited(rng, s, n):
    q = list(s)
    for _ in range(n):
        i = rng.randrange(len(q))
        kind = rng.randrange(3)
        if kind == 0:
            q[i] = rng.choice("ACGT")
        elif kind == 1:
            q[i:i] = rng.choices("ACGT", k=rng.randint(1, 3))
        else:
            del q[i : i + rng.randint(1, 3)]
    return "".join(q)


def smith_waterman(q, s):
    h, e, f = (np.zeros((len(q) + 1, len(s) + 1), int) - (10**6 if x else 0) for x in (0, 1, 1))
    for i in range(1, len(q) + 1):
        for j in range(1, len(s) + 1):
            e[i, j] = max(h[i, j - 1] - 7, e[i, j - 1] - 2)
            f[i, j] = max(h[i - 1, j] - 7, f[i - 1, j] - 2)
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == s[j - 1] else -3), e[i, j], f[i, j])
    return h.max()


def test_banded_alignment_is_optimal():
    rng = random.Random(1)
    for _ in range(25):
        s = dna(rng, rng.randint(40, 80))
        q = dna(rng, 5) + edited(rng, s[rng.randint(0, 6) :], rng.randint(0, 4))
        candidates = aligner.Seeds([s], 8).candidates(aligner.codes(q), 5, 16)
        if not candidates:
            continue
        hit = aligner.align_batch([aligner.codes(q)], [aligner.codes(s)], np.array([candidates[0][1]]))[0]
        score, i, j = 0, hit.q_start, hit.s_start
        for n, op in hit.ops:
            if op == "M":
                score += sum(2 if q[i + x] == s[j + x] else -3 for x in range(n))
            else:
                score -= 5 + 2 * n
            i, j = i + n * (op != "D"), j + n * (op != "I")
        assert (i, j, score) == (hit.q_end, hit.s_end, hit.score) and score == smith_waterman(q, s)


def test_search_table(spark):
    rng = random.Random(2)
    a, b = dna(rng, 80), dna(rng, 80)
    reads = {"plain": dna(rng, 20) + a + dna(rng, 20), "minus": dna(rng, 9) + aligner.reverse_complement(b) + dna(rng, 11), "edited": a[:40] + "A" * 3 + a[40:], "none": dna(rng, 60), "empty": "", "null": None}
    df = spark.createDataFrame([(k, v, 1) for k, v in reads.items()], "name string, seq string, length int")
    hits = {r.qseqid: r for r in aligner.search(df, "name", "seq", spark.createDataFrame([("A*01", a), ("B*01", b)], "name string, seq string")).where("bitscore > 80").collect()}
    assert set(hits) == {"plain", "minus", "edited"}
    assert (hits["plain"].sseqid, hits["plain"].pident, hits["plain"].qstart, hits["plain"].sstrand, hits["plain"].qseq) == ("A*01", 100.0, 21, "plus", a)
    assert (hits["minus"].sseqid, hits["minus"].sstart, hits["minus"].send, hits["minus"].sstrand) == ("B*01", 80, 1, "minus")
    assert hits["edited"].nident == 80 and hits["edited"].gapopen == 1
    assert aligner.search(df.limit(0), "name", "seq", spark.createDataFrame([("A*01", a)], "name string, seq string")).count() == 0


def test_scores_first_is_the_same_alignment():
    rng = random.Random(7)
    subjects = [dna(rng, rng.randint(12, 80)) for _ in range(8)] + ["CA" * 30, "A" * 40, "ACGNNACGTACGTANACGATCGATCG"]
    reads = [dna(rng, rng.randint(0, 40)) + edited(rng, rng.choice(subjects), rng.randint(0, 6)) + dna(rng, rng.randint(0, 40)) for _ in range(300)] + ["CA" * 50, "A" * 90, "N" * 30, "ACG"]
    seeds, coded = aligner.Seeds(subjects, 8), [aligner.codes(r) for r in reads]
    query, subject, diagonal = seeds.candidates_of(coded, 5, 16)
    assert list(zip(query, subject, diagonal)) == [(i, *x) for i, c in enumerate(coded) for x in seeds.candidates(c, 5, 16)]
    pairs = [coded[i] for i in query], [seeds.texts[i] for i in subject], diagonal
    hits = aligner.align_pairs(*pairs)
    assert hits == aligner.align_batch(*pairs) and {len(h.ops) > 1 for h in hits} == {True, False}


def test_search_leaves_reads_where_they_are(spark):
    df = spark.createDataFrame([("a", "ACGTACGGTTACCA" * 3), ("b", "ACGTACGGTTACCA" * 3)], "name string, seq string")
    found = aligner.search(df, "name", "seq", spark.createDataFrame([("A*01", "ACGTACGGTTACCA" * 2)], "name string, seq string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.qseqid for r in found.collect()) == ["a", "b"]


def test_best_hit_of_a_search(spark):
    rng = random.Random(8)
    db = [(f"V*{i:02}", dna(rng, 60)) for i in range(6)]
    db += [("V*01", edited(rng, db[1][1], 3)), ("V*90", db[2][1])]
    reads = [(f"r{i}", dna(rng, 15) + edited(rng, rng.choice(db)[1], i % 4) + dna(rng, 15) + edited(rng, rng.choice(db)[1], 2)) for i in range(120)] + [("none", "ACGT"), ("null", None)]
    reads = spark.createDataFrame(reads, "name string, seq string")
    subjects = spark.createDataFrame(db, "name string, seq string")
    hits = discovery.best_hits(aligner.search(reads, "name", "seq", subjects))
    best = aligner.search(reads, "name", "seq", subjects, best=True)
    assert sorted(best.collect()) == sorted(hits.select(best.columns).collect()) and best.count() == 120


def test_hits_between_many_flanks(spark):
    rng = random.Random(9)
    flanks = [(side, f, rng.randint(1, 6)) for side in ("prefix", "suffix") for f in sorted({dna(rng, rng.choice([3, 4, 7])) for _ in range(60)})] + [("prefix", "", 1)]
    reads = [(1, "c", f"r{i}", dna(rng, rng.randint(5, 150))) for i in range(150)] + [(1, "c", "lines", dna(rng, 60) + "\n" + dna(rng, 60)), (1, "c", "null", None)]
    pairs = sorted(((p, s) for p in flanks for s in flanks if (p[0], s[0]) == ("prefix", "suffix")), key=lambda x: (-x[0][2], -x[1][2], x[0][1], x[1][1]))
    expected = {}
    for _, _, name, read in reads:
        body = (read or "")[5:-5]
        for p, s in pairs if len(read or "") > 10 else ():
            if m := re.search(f".*(?<={p[1]})(.{{8,40}}?)(?={s[1]})", body):
                expected[name] = m[1]
                break
    df = spark.createDataFrame(flanks, "side string, flank string, wells long")
    hits = patterns.between_flanks(spark.createDataFrame(reads, "well long, case string, name string, genomic_sequence string"), df, 5, 100, 8, 40)
    assert {r.name: r.hit for r in hits.collect()} == expected and len(expected) > 100
    none = patterns.between_flanks(spark.createDataFrame(reads, "well long, case string, name string, genomic_sequence string"), df.where("side = 'prefix'"), 5, 100, 8, 40)
    assert none.count() == 0


def test_best_of_many_alignments():
    rng = random.Random(10)
    for _ in range(40):
        reads = [dna(rng, rng.randint(1, 30)) for _ in range(12)]
        value = edited(rng, rng.choice(reads) + dna(rng, 3), 2) or "A"
        every = trimming.align_many(value, reads)
        best = max(range(12), key=lambda i: (every[i][3], -i))
        for cells in (1 << 22, 2000):
            assert trimming.align_best(value, reads, cells) == (best, every[best])
    assert trimming.align_best("ACGT", []) is None


def test_combinations_leave_reads_where_they_are(spark):
    rng = random.Random(11)
    db = [(f"IGHV{g}*01", dna(rng, 70)) for g in range(3)]
    reads = [("c1", dna(rng, 10) + s + dna(rng, 10)) for _, s in db for _ in range(2)] + [("c2", db[0][1]), ("c2", db[0][1] + db[1][1]), ("c2", db[0][1] + "N"), ("c2", dna(rng, 60)), ("c2", ""), ("c2", None)]
    df = spark.createDataFrame(reads, "case string, genomic_sequence string")
    alleles = spark.createDataFrame(db, "name string, seq string")
    found = patterns.with_combinations(df, alleles, 9, 3, 40)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    expected = [(case, read, name.split("*")[0]) for case, read in reads if read and "N" not in read for name, s in db if s in read]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert {(r.gene, r.read) for r in patterns.combination_search(df, alleles, 9, 3, 40).collect()} == {(g, r) for _, r, g in expected}


def test_ratios_count_what_is_not_compared(spark):
    db = spark.createDataFrame([("IGHV1*01", "ACGTACGGTTACCAGT")], "name string, seq string")
    rows = [("c", "ACGTACGGTTACCAGT")] * 10 + [("c", "ACGTACGGTTACCAGA")] * 4 + [("c", "ACGTACGGTTACCACC")] + [("c", "TTTTTTTTTTTTTTTT")] * 20 + [("c", "ACGTNCGGTTACCAGT")] * 25
    found = spark.createDataFrame(rows, "case string, sequence string")
    every = patterns.clustered(found, db)
    kept = patterns.clustered(found, db, keep=(F.col("count") >= 2) & (F.col("ratio") >= 0.2))
    assert {(r.sequence, r["count"], r.ratio) for r in kept.collect()} == {("ACGTACGGTTACCAGT", 10, 0.4), ("TTTTTTTTTTTTTTTT", 20, 0.8)}
    assert sorted(kept.collect()) == sorted(every.where("count >= 2 AND ratio >= 0.2").collect())


def test_affix_fold_by_stretches():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("AC", weights=[5, 1], k=n))
    for _ in range(2000):
        reads = [(text(rng.choice([0, 1, 3])), text(3)) for _ in range(rng.randint(1, 12))]
        want = got = ("", "")
        for r in reads:
            want = discovery.step(want, r)
        i = 0
        while i < len(reads):
            j = i + rng.randint(1, 5)
            got = discovery.applied(got, discovery.summary(reads[i:j]))
            i = j
        assert got == want


def test_discovery_from_simulated_reads(spark):
    """The mutated alleles of invented donors come out under new names."""
    index, known = simulate.indices(spark), simulate.alleles(spark, extra=0, length=120).persist()
    reads = simulate.reads(spark, known, index, per_allele=12)
    rows = reads.join(exact.demultiplex(reads, index), "name").select("well", "case", "name", "genomic_sequence").persist()
    assert rows.count() == 2 * 10 * 12
    reference = known.where("donor IS NULL").select("name", "seq")
    parts = discovery.affixes(rows, reference, 8, 7)
    assert [tuple(r)[2:] for r in parts.collect()] == [(simulate.LEADER, simulate.SIGNAL)]
    hits = aligner.search(rows, "name", "genomic_sequence", discovery.extended(parts))
    found = discovery.cores(discovery.segment_clusters(hits, rows, max_distance=30), parts)
    named = discovery.named(discovery.selected(found, 3, 0.05), reference).collect()
    assert {r.aln_qseq for r in named} == {r.seq for r in known.collect()}
    assert {r.allele_name for r in named if r.aln_mismatch == 0} == {"REF*01"} and all("_S" in r.allele_name for r in named if r.aln_mismatch)
    stats = discovery.trim_statistics(found).collect()
    assert sum(r.ok for r in stats) == sum(r.attempts for r in stats) == len(named)
    assert discovery.affixes(rows.limit(0), reference, 8, 7).first()[2:] == ("", "")


def test_genome_check(spark):
    rng = random.Random(4)
    a, b, c = dna(rng, 100), dna(rng, 100), dna(rng, 100)
    right = dna(rng, 300) + a + dna(rng, 120_000) + aligner.reverse_complement(b[:50] + "T" + b[51:]) + dna(rng, 50)
    g = spark.createDataFrame([("g.fa", "chr14", "chromosome 14 Primary Assembly", right), ("g.fa", "chr2", "chromosome 2 Primary Assembly", dna(rng, 500) + c)], "genome string, name string, description string, seq string")
    alleles = spark.createDataFrame([("a", a), ("b", b), ("c", c), ("n", None), ("d", dna(rng, 60))], "name string, seq string")
    got = {r.name: r for r in genome.checked(alleles, "name", "seq", g, "chromosome 14").collect()}
    assert (got["a"].position, got["a"].edit_distance, got["a"].orientation, got["a"].cigar, got["a"].ref_sequence) == ("chr14:300", 0, "+", "100M", a)
    assert got["b"].orientation == "-" and got["b"].edit_distance == (b[50] != "T") and got["b"].ref_sequence == b[:50] + "T" + b[51:]
    assert not got["c"].matched and got["c"].position == "" and got["d"].edit_distance == -1 and "n" not in got
    assert genome.checked(alleles.limit(0), "name", "seq", g, "chromosome 14").count() == 0


def brute_linkage(names, s, threshold, how):
    groups = [{x} for x in names]
    value = {"complete": min, "single": max, "average": lambda x: sum(x) / len(x)}[how]
    while True:
        scored = [(value([s.get((min(a, b), max(a, b)), 0.0) for a in g for b in h]), g, h) for g, h in itertools.combinations(groups, 2)]
        top = max(scored, key=lambda x: x[0], default=(0, None, None))
        if top[0] < threshold:
            return {frozenset(g) for g in groups}
        groups = [g for g in groups if g not in (top[1], top[2])] + [top[1] | top[2]]


@pytest.mark.parametrize("how", ["complete", "average", "single"])
def test_linkage(spark, how):
    rng = random.Random(5)
    names = [f"a{i:02d}" for i in range(14)]
    s = {p: round(rng.random(), 6) for p in itertools.combinations(names, 2) if rng.random() < 0.45}
    want = {g for g in brute_linkage(names, s, 0.55, how) if len(g) >= 2}
    rows = clusters.clusters(spark.createDataFrame([(a, b, v) for (a, b), v in s.items()], "allele_a string, allele_b string, rho double"), 0.55, 2, how).collect()
    got = {}
    for r in rows:
        got.setdefault(r.group_id, set()).add(r.allele)
    assert {frozenset(x) for x in got.values()} == want and all(min(x) == g for g, x in got.items())


def test_tail_and_adjustment(spark):
    from math import comb

    k, s, f, n = np.array([2, 0, 3, 5]), np.array([4, 10, 6, 5]), np.array([3, 7, 9, 5]), np.array([3, 5, 8, 6])
    want = [sum(comb(a, i) * comb(b, d - i) for i in range(x, d + 1)) / comb(a + b, d) for x, a, b, d in zip(k.tolist(), s.tolist(), f.tolist(), n.tolist())]
    assert np.allclose(cohort.upper_tail(k, s, f, n), want, rtol=1e-10)
    p = [0.01, 0.04, 0.03, 0.04, 0.5, None]
    rows = cohort.bh(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double"), "p", "q").orderBy("i").collect()
    assert [r.q and round(r.q, 9) for r in rows] == [0.05, 0.05, 0.05, 0.05, 0.5, None]
    assert cohort.bh(spark.createDataFrame([], "p double"), "p", "q").count() == 0


def test_edges_count_both_columns(spark):
    rows = [("d1", "a", "b"), ("d1", "c ", None), ("d2", "a", "c"), ("d3", "b", ""), (None, "a", "b"), ("d3", "a", "a")]
    df = spark.createDataFrame(rows, "case string, x string, y string")
    got = {(r.allele_a, r.allele_b): (r.n_a, r.n_b, r.n_shared) for r in cohort.edges(df, "case", ["x", "y"]).collect()}
    assert got == {("a", "b"): (3, 2, 2), ("a", "c"): (3, 2, 2), ("b", "c"): (2, 2, 1)}
    assert cohort.edges(df.limit(0), "case", ["x", "y"]).count() == 0


def test_contains_by_seeds_is_the_same(spark):
    rng = random.Random(6)
    texts = spark.createDataFrame([(i, dna(rng, 60)) for i in range(60)] + [(61, ""), (62, None), (60, "A" * 50), (60, "A" * 50)], "id int, t string")
    known = spark.createDataFrame([(f"p{i}", dna(rng, rng.randint(2, 5))) for i in range(40)] + [("x", None), ("y", ""), ("z", "AAAA"), ("z2", "AAAA")], "name string, p string")
    a, b = (sorted(map(tuple, dictionary.contains(texts, "t", known, "p", most=m).select("id", "t", "name", "p", "start").collect())) for m in (1000, 1))
    assert a == b and a


def test_exclude_and_nearest(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "GG"), (3, None), (4, "TTTTT"), (5, "ACGTA"), (6, "")], "id int, seq string")
    known = spark.createDataFrame([("ACGT",), ("CGGC",), (None,)], "k string")
    assert sorted(r.id for r in tables.exclude(df, "seq", known, "k").collect()) == [3, 4]
    assert tables.exclude(df, "seq", known.limit(0), "k").count() == 6
    rng = random.Random(7)
    alleles = [(f"n{i:02d}", dna(rng, rng.randint(20, 60))) for i in range(40)]
    values = [edited(rng, rng.choice(alleles)[1], rng.randint(0, 6)) for _ in range(60)] + [dna(rng, 30), "", "A"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {v: min((distance(v, s), n) for n, s in alleles) for v in values}
    for most in (100_000, 7):  # one block, and several
        got = {r.value: (r.distance, r.nearest) for r in exact.nearest(spark.createDataFrame([(v,) for v in [*values, None]], "v string"), "v", spark.createDataFrame(alleles, "name string, seq string"), most).collect()}
        assert got == want


def test_d_pipeline_finds_planted_genes(spark):
    rng = random.Random(8)
    parts = [dna(rng, n) for n in (9, 12, 7, 7, 12, 9)]
    genes = {"IGHD1*01": dna(rng, 20), "IGHD2*01": dna(rng, 24)}
    rows = [(w, f"c{w}", dna(rng, 30) + "".join(parts[:3]) + g + "".join(parts[3:]) + dna(rng, 30)) for w in (1, 2) for g in genes.values() for _ in range(12)]
    reads = spark.createDataFrame([*rows, (1, "c1", None), (1, "c1", ""), (1, "c1", "ACGT")], "well long, case string, genomic_sequence string")
    db = spark.createDataFrame(list(genes.items()), "name string, seq string")
    known = exact.exact_search(exact.matches(reads, db, "D"), 1, 0.0, 1000)
    model = dscan.train(dscan.training_rows(known))
    got = {(r.well, r.sequence): (r["count"], r.allele_name, r.isin_db) for r in dscan.discovered(reads, db, model, 0.5, 5, 0.2).collect()}
    assert got == {(w, s): (12, n, True) for w in (1, 2) for n, s in genes.items()}
    p = np.exp(dscan.normal_lengths(10, 20, 15, 2.0))
    assert abs(p.sum() - 1) < 1e-12 and p.argmax() == 5
    with pytest.raises(ValueError):
        dscan.normal_lengths(10, 20, 15, 0)


def test_older_methods(spark):
    rng = random.Random(9)
    alleles = {"IGHD1*01": dna(rng, 30), "IGHD1*02": None, "IGHD2*01": dna(rng, 32)}
    alleles["IGHD1*02"] = alleles["IGHD1*01"][:15] + "A" + alleles["IGHD1*01"][16:]
    if alleles["IGHD1*01"][15] == "A":
        alleles["IGHD1*02"] = alleles["IGHD1*01"][:15] + "C" + alleles["IGHD1*01"][16:]
    db = spark.createDataFrame(list(alleles.items()), "name string, seq string")
    flank = dna(rng, 20), dna(rng, 20)
    new = alleles["IGHD2*01"][:10] + ("A" if alleles["IGHD2*01"][10] != "A" else "C") + alleles["IGHD2*01"][11:]
    texts = [dna(rng, 12) + flank[0] + s + flank[1] + dna(rng, 12) for s in [*alleles.values(), new] for _ in range(6)]
    reads = spark.createDataFrame([(1, "c", f"r{i}", t) for i, t in enumerate(texts)] + [(1, "c", "n", "N" + texts[0]), (1, "c", "e", ""), (1, "c", "x", None)], "well long, case string, name string, genomic_sequence string")
    found = patterns.hamming_matches(reads, db, 1)
    assert found.count() == 24 and {r.middle for r in found.collect()} == {*alleles.values(), new}
    summary = {r.middle: (r["count"], r.allele_name) for r in patterns.hamming_summary(found, db, 0.25, 2).collect()}
    assert summary[alleles["IGHD1*02"]] == (6, "IGHD1*02") and summary[new][1].endswith(" Novel")
    flanks = patterns.frequent_flanks(reads, db, min_count=3)
    assert {(r.side, r.flank, r.wells) for r in flanks.collect()} == {("prefix", flank[0][-7:], 3), ("suffix", flank[1][:7], 3)}
    hits = patterns.between_flanks(reads, flanks, 5, 100, 15, 40)
    assert {r.hit for r in hits.collect()} >= {*alleles.values(), new}
    marked = {r.best_aln: r for r in patterns.annotate(hits, db).collect()}
    assert marked[new].distance == 1 and marked[new].best_name.endswith(" Novel") and marked[alleles["IGHD2*01"]].best_name == "IGHD2*01"
    got = {r.sequence: (r["count"], r.distance) for r in patterns.search_patterns(reads, db, k=10, longest=12).collect()}
    assert got[alleles["IGHD2*01"]] == (6, 0) or got[alleles["IGHD2*01"]][1] == 0
    assert patterns.best_position(aligner.codes("TTTTACGTTT"), np.log2(np.array([[0.97, 0.01, 0.01, 0.01], [0.01, 0.97, 0.01, 0.01]]))) == 4
    halves = spark.range(1).select(*patterns.halves(F.lit("ACGTA"))).first()
    assert tuple(halves) == ("AC", "GTA")
    common = spark.createDataFrame([("xxABCDyy", "zABCDz"), ("a", "b"), ("", "b"), (None, "b")], "a string, b string").select(patterns.longest_common_substring("a", "b")).collect()
    assert [r[0] for r in common] == ["ABCD", "", "", None]
    assert patterns.combination_search(reads, db, 7, 3, 20).count() > 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.tsv").write_text("k\tv\n1\tx\n2\ty\n2\tz\n")
    (tmp_path / "b.tsv").write_text("k\tw\n2\tq\n3\tr\n")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("table", "outerjoin", tmp_path / "a.tsv", tmp_path / "b.tsv", tmp_path / "j.tsv", "-k", "k") == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "j.tsv.gz")).count() == 4
    assert run("table", "filter", tmp_path / "a.tsv", tmp_path / "f.tsv", "-c", "k", "--operator", ">=", "--threshold", "2") == 0
    assert run("table", "filter", tmp_path / "a.tsv", tmp_path / "f.tsv", "-c", "absent", "--pattern", "x") == 2
    assert run("table", "aggregate", tmp_path / "a.tsv", tmp_path / "g.tsv", "-g", "k", "-k", "v") == 0
    (tmp_path / "x.fasta").write_text(">A*01\nACGT\n>B*01\nGGGG\n")
    (tmp_path / "y.fasta").write_text(">C*01\nACGT\n")
    assert run("fasta", "diff", tmp_path / "x.fasta", tmp_path / "y.fasta") == 0
    assert "left_only\tB*01" in capsys.readouterr().out
    assert run("fasta", "merge", tmp_path / "m.fasta", tmp_path / "x.fasta", tmp_path / "y.fasta") == 0
    assert (tmp_path / "m.fasta").read_text() == ">A*01\nACGT\n>B*01\nGGGG\n"
    reads = "well\tcase\tname\tgenomic_sequence\n" + "".join(f"1\tc\tr{i}\tTTACGTACGTAACACAGTGTT\n" for i in range(6))
    (tmp_path / "r.tsv").write_text(reads)
    (tmp_path / "db.fasta").write_text(">IGHV1*01\nACGTACGTAA\n")
    assert run("search", "exact", tmp_path / "r.tsv", tmp_path / "db.fasta", tmp_path / "e.tsv") == 0
    found = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "e.tsv.gz")).collect()
    assert [(r.db_name, r["count"], r.heptamer) for r in found] == [("IGHV1*01", "6", "CACAGTG")]
    with pytest.raises(SystemExit):
        run("search", "exact", "--minratio", "2", "a", "b", "c")
