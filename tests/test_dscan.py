import math
import random

import numpy as np

from seqloom.plans.dscan import AFTER, BEFORE, LEFT, RIGHT, scan, scan_reads, train

NAMES = [n for n, _ in BEFORE] + ["sequence"] + [n for n, _ in AFTER]


def naive(model, read):
    best, scores = None, []
    for s in range(len(read)):
        for k in range(len(model.length)):
            d = model.shortest + k
            if s + LEFT + d + RIGHT > len(read):
                continue
            part = read[s : s + LEFT + d + RIGHT]
            if any(c not in "ACGT" for c in part):
                continue
            i = ["ACGT".index(c) for c in part]
            v = sum(model.before[p, i[p]] for p in range(LEFT)) + sum(model.base[x] for x in i[LEFT : LEFT + d]) + model.length[k] + sum(model.after[p, i[LEFT + d + p]] for p in range(RIGHT))
            scores.append(v)
            if math.isfinite(v) and (best is None or v > best[0] + 1e-9):
                best = (v, s + LEFT, d)
    if best is None:
        return None
    return best[1], best[2], 1 / sum(math.exp(v - best[0]) for v in scores)


def test_scan(spark):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    fixed = {n: dna(k) for n, k in (*BEFORE, *AFTER)}
    rows = []
    for _ in range(30):
        gene = dna(rng.randint(12, 18))
        rows.append(tuple(gene if n == "sequence" else fixed[n] for n in NAMES))
    rows.append(tuple("A" for _ in NAMES))  # cut short: left out
    model = train(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in NAMES)))
    assert model.before.shape == (LEFT, 4) and abs(np.exp(model.length).sum() - 1) < 1e-9
    reads = [dna(rng.randint(0, 40)) + "".join(r) + dna(rng.randint(0, 40)) for r in rows[:6]] + [dna(90), "ACGT", "", dna(30) + "N" + dna(70)]
    reads.append("".join(rows[0])[:5] + "N" + "".join(rows[0])[6:])
    for read in reads:
        got, want = scan(model, read), naive(model, read)
        assert (got is None) == (want is None)
        if got:
            assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-6
    found = {r.sequence: r for r in scan_reads(model, spark.createDataFrame([(r,) for r in [*reads, None]], "genomic_sequence string"), min_posterior=0.9).collect()}
    for read, row in zip(reads[:6], rows):
        assert found[read].d_sequence == row[3] and read[found[read].d_start - 1 :].startswith(row[3])
