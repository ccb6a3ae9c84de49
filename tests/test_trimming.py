import itertools
import random

from seqloom.plans.trimming import EXTEND, MATCH, MISMATCH, OPEN, align, trim, trimmed


def best_score(affix, read):
    """Gotoh, cell by cell."""
    low = -(10**9)
    h, d = [0] * (len(read) + 1), [low] * (len(read) + 1)
    for a in affix:
        new, e = [], low
        d = [max(x - OPEN, y - EXTEND) for x, y in zip(h, d)]
        for j in range(len(read) + 1):
            e = max(new[j - 1] - OPEN, e - EXTEND) if j else low
            diagonal = h[j - 1] + (MATCH if a == read[j - 1] else MISMATCH) if j else low
            new.append(max(d[j], e, diagonal))
        h = new
    return max(h)


def global_score(affix, piece):
    """Best score of the affix against exactly this piece."""
    low = -(10**9)
    h = [0] + [-(OPEN + EXTEND * (j - 1)) for j in range(1, len(piece) + 1)]
    d = [low] * len(h)
    for i, a in enumerate(affix):
        d = [max(x - OPEN, y - EXTEND) for x, y in zip(h, d)]
        new, e = [], low
        for j in range(len(h)):
            e = max(new[j - 1] - OPEN, e - EXTEND) if j else low
            new.append(max(d[j], e, h[j - 1] + (MATCH if a == piece[j - 1] else MISMATCH) if j else low))
        h = new
    return h[-1]


def test_alignment_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        read, affix = "".join(rng.choices("ACGT", k=rng.randint(1, 30))), "".join(rng.choices("ACGT", k=rng.randint(1, 10)))
        first, end, matches = align(affix, read)
        assert 0 <= first <= end <= len(read) and 0 <= matches <= len(affix)
        assert global_score(affix, read[first:end]) == best_score(affix, read)


def test_trim():
    core = "GATTACAGATTACA"
    assert trim("TT" + "ACGTACGA" + core + "CCGGTTAA" + "G", "ACGTACGA", "CCGGTTAA", 0.75) == (core, "ok")
    assert trim("ACGTCGA" + core, "ACGTACGA", "", 0.75) == (core, "ok")
    assert trim(core, "", None, 0.75) == (core, "ok")
    assert trim("AAAAAAAAAAAAAAAA", "CCGGTTCC", "", 0.75)[0] is None
    assert trim("ACGTACGA" + "GATT", "ACGTACGA", "", 0.75) == (None, "short core")
    assert trim(None, "A", "A", 0.75) == (None, "empty") and trim("", "A", "A", 0.75) == (None, "empty")


def test_trimmed_table(spark):
    core = "GATTACAGATTACA"
    rows = [("ACGTACGA" + core, "ACGTACGA", "", core)] * 2 + [("ACGTACGA" + core[:-1], "ACGTACGA", None, core), (None, "A", "A", core)]
    out = trimmed(spark.createDataFrame(rows, "q string, p string, s string, ref string"), "q", "p", "s", "ref").collect()
    assert sorted(r.aln_mismatch for r in out) == [-1, 0, 0, 1]
    assert list(itertools.chain.from_iterable([r.aln_qseq] for r in out if r.aln_mismatch == 0)) == [core, core]
