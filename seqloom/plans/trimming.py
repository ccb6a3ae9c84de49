"""Removal of known affixes from aligned reads, and the distance of the core.

An affix is aligned over its whole length to any stretch of the read (affine
gaps, free ends in the read). Its quality is the share of its bases that match;
below the minimum the trim fails. What lies beyond it is the core.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nucleotide scores and gap costs
MATCH, MISMATCH, OPEN, EXTEND = 5, -4, 10, 1
MIN_CORE = 10
_LOW = -(10**9)


def align(affix: str, read: str) -> tuple[int, int, int]:
    """(first, end, matches): the stretch read[first:end] that the whole affix
    aligns to best (the earliest end among equals), and its matching bases."""
    return align_many(affix, [read])[0][:3]


def align_many(affix: str, reads: list[str], cells: int = 1 << 22) -> list[tuple[int, int, int, int, int, int]]:
    """(first, end, matches, score, edits, gaps) of the whole affix against each
    read, all reads at once: row by row of the affix, where gaps along the read
    come from a running maximum. edits are mismatches and gaps, gaps those in
    the affix. Reads are taken in blocks of about `cells` cells."""
    out: list = [None] * len(reads)
    for some in _blocks(affix, reads, cells):
        for i, r in zip(some, _align_block(affix, [reads[i] for i in some])):
            out[i] = r
    return out


def align_best(affix: str, reads: list[str], cells: int = 1 << 22) -> tuple[int, tuple[int, int, int, int, int, int]] | None:
    """The first read with the greatest score, and its `align_many`; the others
    aren't traced back."""
    best = None
    for some in _blocks(affix, reads, cells):
        block = sorted(some)
        k, found = _align_block(affix, [reads[i] for i in block], best=True)
        if best is None or (-found[3], block[k]) < (-best[1][3], best[0]):
            best = (block[k], found)
    return best


def _blocks(affix: str, reads: list[str], cells: int) -> Iterator[list[int]]:
    n = len(affix)
    order = sorted(range(len(reads)), key=lambda i: len(reads[i]))
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order) and (n + 1) * (len(reads[order[at + size]]) + 1) * (size + 1) <= cells:
            size += 1
        yield order[at : at + size]
        at += size


def _align_block(affix: str, reads: list[str], best: bool = False) -> list[tuple[int, int, int, int, int, int]] | tuple[int, tuple[int, int, int, int, int, int]]:
    n, m, b = len(affix), max(map(len, reads)), len(reads)
    sizes = np.array([len(r) for r in reads])
    q = np.zeros((b, m), np.uint32)
    for i, r in enumerate(reads):
        q[i, : len(r)] = np.frombuffer(r.encode("utf-32-le"), np.uint32)
    inside = np.arange(m + 1)[None, :] <= sizes[:, None]
    h = np.zeros((n + 1, b, m + 1), np.int32)
    across = np.full((n + 1, b, m + 1), _LOW, np.int32)  # gap in the affix
    down = np.full((n + 1, b, m + 1), _LOW, np.int32)  # gap in the read
    offset = (np.arange(m + 1) * EXTEND).astype(np.int32)
    for i in range(1, n + 1):
        down[i] = np.maximum(h[i - 1] - OPEN, down[i - 1] - EXTEND)
        top = down[i].copy()
        top[:, 1:] = np.maximum(top[:, 1:], h[i - 1, :, :-1] + np.where(q == ord(affix[i - 1]), MATCH, MISMATCH))
        running = np.maximum.accumulate(top + offset, axis=1)
        across[i, :, 1:] = running[:, :-1] - offset[1:] - OPEN + EXTEND
        h[i] = np.maximum(top, across[i])
    ends = np.where(inside, h[n], _LOW).argmax(axis=1)
    if best:
        k = int(h[n, np.arange(b), ends].argmax())
        return k, _trace(affix, reads[k], h[:, k], across[:, k], down[:, k], int(ends[k]))
    return [_trace(affix, reads[k], h[:, k], across[:, k], down[:, k], int(ends[k])) for k in range(b)]


def _trace(affix: str, read: str, h: np.ndarray, across: np.ndarray, down: np.ndarray, end: int) -> tuple[int, int, int, int, int, int]:
    i, j, state, matches, edits, gaps = len(affix), end, "h", 0, 0, 0
    score = int(h[i, j])
    while i > 0:
        if state == "h":
            if h[i, j] == down[i, j]:
                state = "down"
            elif h[i, j] == across[i, j]:
                state = "across"
            else:
                same = affix[i - 1] == read[j - 1]
                matches, edits = matches + same, edits + (not same)
                i, j = i - 1, j - 1
        elif state == "down":
            state = "h" if down[i, j] == h[i - 1, j] - OPEN else "down"
            i, edits = i - 1, edits + 1
        else:
            state = "h" if across[i, j] == h[i, j - 1] - OPEN else "across"
            j, edits, gaps = j - 1, edits + 1, gaps + 1
    return j, end, matches, score, edits, gaps


def trim_many(rows: list[tuple[str | None, str | None, str | None]], min_quality: float) -> list[tuple[str | None, str]]:
    """`trim` of many (read, prefix, suffix); reads with one affix are aligned
    together."""
    cores: list[str | None] = [r.replace("-", "") if r else None for r, _, _ in rows]
    status = ["ok" if r else "empty" for r, _, _ in rows]
    for column, side in ((1, "prefix"), (2, "suffix")):
        groups: dict[str, list[int]] = {}
        for k, row in enumerate(rows):
            if status[k] == "ok" and row[column]:
                if cores[k]:
                    groups.setdefault(row[column], []).append(k)
                else:
                    status[k] = f"{side} not found"
        for affix, members in groups.items():
            for k, (first, end, matches, *_) in zip(members, align_many(affix, [cores[k] for k in members])):
                if matches < min_quality * len(affix):
                    status[k] = f"{side} not found"
                else:
                    cores[k] = cores[k][end:] if side == "prefix" else cores[k][:first]
    short = [s == "ok" and len(c) < MIN_CORE for s, c in zip(status, cores)]
    return [(c, "ok") if s == "ok" and not x else (None, "short core" if x else s) for c, s, x in zip(cores, status, short)]


def trim(read: str | None, prefix: str | None, suffix: str | None, min_quality: float) -> tuple[str | None, str]:
    """(core, status): prefix first, then the suffix on the rest. An empty or
    null affix leaves its side alone; a null read, a poor alignment or a core
    under `MIN_CORE` bases fails."""
    return trim_many([(read, prefix, suffix)], min_quality)[0]


def trimmed(df: DataFrame, read: str, prefix: str, suffix: str, reference: str, min_quality: float = 0.75) -> DataFrame:
    """Adds aln_qseq (the core), aln_status and aln_mismatch: the Levenshtein
    distance of the core and `reference`, -1 where trimming failed. Each
    distinct combination is aligned once."""
    keys = [F.col(c).alias(f"_{i}") for i, c in enumerate((read, prefix, suffix))]

    @F.pandas_udf("core string, status string")
    def run(r: pd.Series, p: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(trim_many(list(zip(r, p, s)), min_quality), columns=["core", "status"])

    done = df.select(*keys).distinct().withColumn("_t", run("_0", "_1", "_2"))
    on: Column = F.col(read).eqNullSafe(F.col("_0")) & F.col(prefix).eqNullSafe(F.col("_1")) & F.col(suffix).eqNullSafe(F.col("_2"))
    out = df.join(done, on, "left").drop("_0", "_1", "_2")
    distance = F.when(F.col("_t.core").isNull() | F.col(reference).isNull(), F.lit(-1)).otherwise(F.levenshtein(F.col("_t.core"), F.col(reference)))
    return out.withColumn("aln_qseq", F.col("_t.core")).withColumn("aln_status", F.col("_t.status")).withColumn("aln_mismatch", distance.cast("long")).drop("_t")
