"""Seed-and-extend alignment of many sequences with a dictionary of subjects.

A query and a subject that share a seed (an exact window) are aligned locally
with affine gaps in a band around the diagonal that holds most of their seeds.
All pairs of a batch are aligned at once, row by row, in numpy.

The subjects are held by every task, so they are a dictionary of at most
`MOST_BASES` bases; larger collections are searched the other way round
(`plans/genome.py`: the queries are the dictionary, and the genome streams by).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import polynomial
from ..sources.files import ALIGNMENTS

MOST_BASES = 5_000_000
MOST_CELLS = 1 << 24  # of the bands that are aligned at once
# Scores of nucleotide search, and the statistics that belong to them
REWARD, PENALTY, GAP_OPEN, GAP_EXTEND = 2, -3, 5, 2
LAMBDA, KAPPA = 0.625, 0.41
_LOW = -(1 << 20)
FILTER_BITS = 22  # of a window's hash
_FILTER = np.uint64(64 - FILTER_BITS)
MOST_SCORES = 1 << 23  # held at once while pairs are scored
_CODE = np.full(128, 4, np.uint8)
_CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3, 0, 1, 2, 3]
_BIT = np.array([1, 2, 4, 8, 0], np.uint8)
_COMPLEMENT = np.array([3, 2, 1, 0, 4], np.uint8)
_OTHER = str.maketrans("ACGTacgt", "TGCATGCA")


def codes(text: str) -> np.ndarray:
    """0 to 3 for A, C, G and T in either case, 4 for all else."""
    if text.isascii():
        return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)]


def _strands(c: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    return (c, _COMPLEMENT[c[::-1]])[:n]


def reverse_complement(text: str) -> str:
    return text.translate(_OTHER)[::-1]


@dataclass(frozen=True)
class Hit:
    """A local alignment, 0-based half-open; `ops` are runs of M, I (in the
    query only) and D (in the subject only) from its start."""

    score: int
    q_start: int
    q_end: int
    s_start: int
    s_end: int
    matches: int
    mismatches: int
    ops: tuple[tuple[int, str], ...]

    @property
    def length(self) -> int:
        return sum(n for n, _ in self.ops)

    @property
    def gaps(self) -> int:
        return sum(op != "M" for _, op in self.ops)

    def edits(self) -> int:
        return self.mismatches + sum(n for n, op in self.ops if op != "M")


def align_batch(queries: list[np.ndarray], subjects: list[np.ndarray], diagonals: np.ndarray, band: int = 16) -> list[Hit | None]:
    """The best local alignment of each pair within `band` of its diagonal
    (subject position - query position); None where nothing matches. Among
    equal scores the one that ends first in the query, then in the subject."""
    n_pairs, width = len(queries), 2 * band + 1
    n, m = max(map(len, queries), default=0), max(map(len, subjects), default=0)
    if not n or not m:
        return [None] * n_pairs
    if n * n_pairs * width > MOST_CELLS and n_pairs > 1:
        half = n_pairs // 2
        return align_batch(queries[:half], subjects[:half], diagonals[:half], band) + align_batch(queries[half:], subjects[half:], diagonals[half:], band)
    q, s = np.full((n_pairs, n), 5, np.uint8), np.full((n_pairs, m), 6, np.uint8)
    for i, (a, b) in enumerate(zip(queries, subjects)):
        q[i, : len(a)], s[i, : len(b)] = np.where(a < 4, a, 5), np.where(b < 4, b, 6)
    sizes = np.array([len(b) for b in subjects])[:, None]
    rows, across = np.arange(n_pairs)[:, None], np.arange(width)
    high, down = np.zeros((n_pairs, width), np.int32), np.full((n_pairs, width), _LOW, np.int32)
    best, best_at = np.zeros(n_pairs, np.int32), np.zeros((n_pairs, 2), np.int64)
    came = np.zeros((n, n_pairs, width), np.uint8)  # 0 start, 1 match or mismatch, 2 down, 3 across
    longer = np.zeros((n, n_pairs, width), bool)  # a gap in the subject that goes on
    source = np.zeros((n, n_pairs, width), np.uint8)  # where a gap in the query began
    edge = np.full((n_pairs, 1), _LOW, np.int32)
    for i in range(n):
        j = i + diagonals[:, None] - band + across
        valid = (j >= 0) & (j < sizes)
        letter = s[rows, np.clip(j, 0, m - 1)]
        step = high + np.where(letter == q[:, i, None], REWARD, PENALTY)
        opened, extended = np.hstack([high[:, 1:], edge]) - GAP_OPEN - GAP_EXTEND, np.hstack([down[:, 1:], edge]) - GAP_EXTEND
        longer[i] = extended > opened
        down = np.where(valid, np.maximum(opened, extended), _LOW)
        base = np.where(valid, np.maximum(np.maximum(step, down), 0), _LOW)
        rising = base + GAP_EXTEND * across
        top = np.maximum.accumulate(rising, axis=1)
        held = np.maximum.accumulate(np.where(rising == top, across, 0), axis=1)
        gap = np.hstack([edge, top[:, :-1]]) - GAP_EXTEND * across - GAP_OPEN
        source[i, :, 1:] = held[:, :-1]
        high = np.where(valid, np.maximum(base, gap), 0)
        came[i] = np.where(high <= 0, 0, np.where(high == step, 1, np.where(high == down, 2, 3)))
        at = high.argmax(axis=1)
        now = high[rows[:, 0], at]
        better = now > best
        best[better] = now[better]
        best_at[better] = np.stack([np.full(int(better.sum()), i), at[better]], axis=1)
        high = high.astype(np.int32)
    return [_traced(k, int(best[k]), *map(int, best_at[k]), int(diagonals[k]) - band, q[k], s[k], came, longer, source) if best[k] > 0 else None for k in range(n_pairs)]


def align_pairs(queries: list[np.ndarray], subjects: list[np.ndarray], diagonals: np.ndarray, band: int = 16) -> list[Hit | None]:
    """`align_batch`, for many pairs. The bands' scores alone come first, over
    the stretch of the query that the band crosses. Where the run of the diagonal
    that ends at the best score has that score, it is the alignment: each of its
    cells then has the score of its predecessor and its own letters. Only the
    others, which have gaps, are aligned again with their traces."""
    out: list[Hit | None] = [None] * len(queries)
    sizes, lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (subjects, queries))
    diagonals = np.asarray(diagonals, np.int64)
    begin = np.clip(-diagonals - band, 0, lengths)
    end = np.clip(sizes - diagonals + band, begin, lengths)
    order = np.argsort(end - begin, kind="stable")[::-1]
    order = order[(end - begin)[order] > 0]
    again: list[int] = []
    at = 0
    while at < len(order):
        rows = int(end[order[at]] - begin[order[at]])
        some = order[at : at + max(1, MOST_SCORES // (rows * (2 * band + 1)))]
        at += len(some)
        shift = begin[some] + diagonals[some] - band  # the subject's position in column 0
        q = _laid([queries[k][i:j] for k, i, j in zip(some.tolist(), begin[some].tolist(), end[some].tolist())], np.zeros(len(some), np.int64), rows)
        s = _laid([subjects[k][max(0, i) : max(0, i + rows + 2 * band)] for k, i in zip(some.tolist(), shift.tolist())], np.maximum(0, -shift), rows + 2 * band)
        kind = np.int16 if 2 * rows + 4 * band + 2 < 1 << 15 else np.int32
        best, last, across, first = _scored(q.T.astype(kind, order="C"), s.T.astype(kind, order="C"), band)
        for i, (k, score, e, b, f) in enumerate(zip(some.tolist(), best.tolist(), last.tolist(), across.tolist(), first.tolist())):
            if score <= 0:
                continue
            if f < 0:
                again.append(k)
                continue
            n, at_q = e + 1 - f, int(begin[k])
            same, at_s = (score - PENALTY * n) // (REWARD - PENALTY), at_q + int(diagonals[k]) - band + b
            out[k] = Hit(score, at_q + f, at_q + e + 1, at_s + f, at_s + e + 1, same, n - same, ((n, "M"),))
    hits = align_batch([queries[k][begin[k] : end[k]] for k in again], [subjects[k] for k in again], np.array([diagonals[k] + begin[k] for k in again], np.int64), band)
    for k, h in zip(again, hits):
        out[k] = h and replace(h, q_start=h.q_start + int(begin[k]), q_end=h.q_end + int(begin[k]))
    return out


def _laid(parts: list[np.ndarray], begin: np.ndarray, width: int) -> np.ndarray:
    """A row a part, from column `begin` on, with a bit a letter."""
    out, at = np.zeros((len(parts), width), np.uint8), np.arange(width)
    end = begin + np.fromiter(map(len, parts), np.int64, len(parts))
    out[(at >= begin[:, None]) & (at < end[:, None])] = _BIT[np.concatenate(parts)]
    return out


def _scored(q: np.ndarray, s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, row, column, first row) of the best cell of each pair's band, and
    of its diagonal's run (-1 if that has a lower score). `q` (row, pair) and `s`
    (row + column, pair) have a bit a letter and 0 where nothing can match."""
    (rows, n), width, kind = q.shape, 2 * band + 1, q.dtype
    high = np.zeros((rows + 1, width, n), kind)
    tops = np.empty((rows, n), kind)
    down = np.full((width + 1, n), -(1 << 14), kind)
    x, y, base = (np.empty((width, n), kind) for _ in range(3))
    slope = (GAP_EXTEND * np.arange(width)).astype(kind)[:, None]
    for i in range(rows):
        old, new = high[i], high[i + 1]
        np.bitwise_and(s[i : i + width], q[i], out=base)
        np.minimum(base, 1, out=base)
        base *= kind.type(REWARD - PENALTY)
        base += old
        base += kind.type(PENALTY)
        np.subtract(old[1:], GAP_OPEN + GAP_EXTEND, out=x[:-1])
        down[:-1] -= kind.type(GAP_EXTEND)
        np.maximum(down[1:-1], x[:-1], out=x[:-1])
        down[: width - 1] = x[:-1]
        down[width - 1] = -(1 << 14)
        np.maximum(base, down[:width], out=base)
        np.maximum(base, 0, out=base)
        # a gap along the subject: the running maximum of what came before it in the row
        np.add(base, slope, out=x)
        d = 1
        while d < width:
            y[:d] = x[:d]
            np.maximum(x[d:], x[:-d], out=y[d:])
            x, y, d = y, x, 2 * d
        x -= slope
        x -= kind.type(GAP_OPEN)
        new[0] = base[0]
        # x holds for its own column; the next one costs one extension more
        np.subtract(x[:-1], GAP_EXTEND, out=y[1:])
        np.maximum(base[1:], y[1:], out=new[1:])
        new.max(axis=0, out=tops[i])
    pair = np.arange(n)
    last = tops.argmax(axis=0)
    best = tops[last, pair].astype(np.int64)
    across = high[last + 1, :, pair].argmax(axis=1)
    at = np.arange(rows)[:, None]
    same = (s[at + across, pair] & q) > 0
    run = np.where(at <= last, np.where(same, REWARD, PENALTY), 0)
    left = np.cumsum(run[::-1], axis=0)[::-1]
    reached = (left == best) & (at <= last)
    first = rows - 1 - reached[::-1].argmax(axis=0)
    return best, last, across, np.where(reached.any(axis=0), first, -1)


def _traced(k: int, score: int, i: int, b: int, shift: int, q: np.ndarray, s: np.ndarray, came: np.ndarray, longer: np.ndarray, source: np.ndarray) -> Hit:
    q_end, s_end = i + 1, i + b + shift + 1
    runs: list[list] = []
    matches = mismatches = 0
    width = came.shape[2]

    def add(op: str, n: int = 1) -> None:
        if runs and runs[-1][1] == op:
            runs[-1][0] += n
        else:
            runs.append([n, op])

    while i >= 0 and 0 <= b < width and came[i, k, b]:
        kind = came[i, k, b]
        if kind == 1:
            same = q[i] == s[i + b + shift]
            matches += int(same)
            mismatches += int(not same)
            add("M")
            i -= 1
        elif kind == 3:
            begin = int(source[i, k, b])
            add("D", b - begin)
            b = begin
        else:
            while True:
                add("I")
                more = longer[i, k, b]
                i, b = i - 1, b + 1
                if not more:
                    break
    return Hit(score, i + 1, q_end, i + b + shift + 1, s_end, matches, mismatches, tuple((n, op) for n, op in reversed(runs)))


class Seeds:
    """The exact windows of a dictionary, sorted by hash."""

    def __init__(self, texts: list[str], size: int):
        self.size, self.texts = size, [codes(t) for t in texts]
        parts = [self.windows(c) for c in self.texts]
        self.hash = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in parts)])
        self.text = np.concatenate([np.empty(0, np.int64), *(np.full(len(h), i) for i, (h, _) in enumerate(parts))])
        self.at = np.concatenate([np.empty(0, np.int64), *(at for _, at in parts)])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.text, self.at = self.hash[order], self.text[order], self.at[order]
        self.known = np.zeros(1 << FILTER_BITS, bool)
        self.known[(self.hash >> _FILTER).astype(np.int64)] = True

    def windows(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of the windows of A, C, G and T only."""
        if len(c) < self.size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        bad = np.concatenate(([0], np.cumsum(c == 4)))
        fine = np.flatnonzero(bad[self.size :] == bad[: -self.size])
        return polynomial(c.astype(np.uint64) + np.uint64(1), self.size)[fine], fine

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(dictionary text, its position, position in `c`) of equal windows."""
        h, at = self.windows(c)
        some = np.flatnonzero(self.known[(h >> _FILTER).view(np.int64)])
        h, at = h[some], at[some]
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
        n = hi - lo
        pick = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return self.text[pick], self.at[pick], np.repeat(at, n)

    def candidates(self, c: np.ndarray, most: int, band: int) -> list[tuple[int, int]]:
        """(text, diagonal: its position - that in `c`) of the `most` texts with
        most seeds near one diagonal, the first among equals."""
        _, text, diagonal = self.candidates_of([c], most, band)
        return list(zip(text.tolist(), diagonal.tolist()))

    def candidates_of(self, queries: list[np.ndarray], most: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, text, diagonal) of the `candidates` of many queries, by query,
        then best first."""
        # a letter between two queries keeps windows inside one
        laid = np.full(sum(map(len, queries)) + len(queries), 4, np.uint8)
        starts = np.cumsum([0] + [len(c) + 1 for c in queries])
        for c, at in zip(queries, starts):
            laid[at : at + len(c)] = c
        text, own, other = self.hits(laid)
        if not len(text):
            return (np.empty(0, np.int64),) * 3
        query = np.searchsorted(starts, other, side="right") - 1
        diagonal = own - (other - starts[query])
        # (query, text, cell of diagonals), then the diagonal inside it
        diagonal = diagonal + (1 << 30)
        low = int(diagonal.min()) // band
        cells = int(diagonal.max()) // band - low + 1
        cell = (query * len(self.texts) + text) * cells + diagonal // band - low
        key = np.sort(cell * band + diagonal % band)
        cell, diagonal = key // band, (key // band % cells + low) * band + key % band
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        counts = np.diff(np.append(first, len(cell)))
        owner = cell[first] // cells
        order = np.lexsort((-counts, owner))
        top = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
        of = owner[top] // len(self.texts)
        order = np.lexsort((-counts[top], of))
        top, of = top[order], of[order]
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        rank = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
        top, of = top[rank < most], of[rank < most]
        # the median diagonal of the cell's seeds
        at, n = first[top], counts[top]
        middle = (diagonal[at + (n - 1) // 2] + diagonal[at + n // 2]) / 2
        return of, owner[top] % len(self.texts), np.trunc(middle - (1 << 30)).astype(np.int64)


def cigar(hit: Hit, q_length: int, clip: bool = True) -> str:
    ends = [(hit.q_start, "S"), (q_length - hit.q_end, "S")] if clip else [(0, ""), (0, "")]
    return "".join(f"{n}{op}" for n, op in (ends[0], *hit.ops, ends[1]) if n)


def _aligned_query(text: str, hit: Hit) -> str:
    out, at = [], hit.q_start
    for n, op in hit.ops:
        out.append("-" * n if op == "D" else text[at : at + n])
        at += 0 if op == "D" else n
    return "".join(out)


def search(queries: DataFrame, name: str, sequence: str, subjects: DataFrame, most_subjects: int = 5, seed: int = 11, band: int = 16, max_evalue: float = 10.0, both_strands: bool = True, batch_rows: int = 2000, best: bool = False) -> DataFrame:
    """The 19-column alignment table of `queries` against `subjects` (name,
    seq): up to `most_subjects` a query and strand, best first seeds. Reads stay
    where they are; equal ones of `batch_rows` are aligned once. Null and empty
    sequences have no hits; subjects beyond `MOST_BASES` bases are an error. With
    `best` a row has one hit only, in the order of `discovery.best_hits`."""
    size = subjects.agg(F.sum(F.length("seq"))).first()[0] or 0
    if size > MOST_BASES:
        raise ValueError(f"{size} bases of subjects; at most {MOST_BASES} are a dictionary")
    known = [tuple(r) for r in subjects.where("seq <> '' AND name IS NOT NULL").select("name", "seq").orderBy("name", "seq").collect()]
    strands = 2 if both_strands else 1
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in ALIGNMENTS if f.name != "qseqid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Seeds([s for _, s in known], seed)
        for batch in batches:
            for i in range(0, batch.num_rows, batch_rows):
                part = batch.slice(i, batch_rows)
                distinct = part.column(1).dictionary_encode()
                of, found = _rows(distinct.dictionary.to_pylist(), index)
                own = distinct.indices.to_numpy()
                first = np.searchsorted(of, np.arange(len(distinct.dictionary) + 1))
                n = np.diff(first)[own]
                pick = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                names = part.column(0).take(pa.array(np.repeat(np.arange(len(own)), n)))
                yield pa.RecordBatch.from_arrays([names, *found.take(pa.array(pick)).columns], names=ALIGNMENTS.names)

    def _rows(texts: list[str], index: Seeds) -> tuple[np.ndarray, pa.RecordBatch]:
        """Whose the hits of distinct texts are, ascending, and the hits, one a
        text and name of a subject: the greatest."""
        coded = [c for text in texts for c in _strands(codes(text), strands)]
        form, which, diagonals = index.candidates_of(coded, most_subjects, band)
        hits = align_pairs([coded[k] for k in form.tolist()], [index.texts[k] for k in which.tolist()], diagonals, band)
        chance = [KAPPA * len(c) * max(size, 1) for c in coded]
        kept = [i for i, (k, h) in enumerate(zip(form.tolist(), hits)) if h is not None and chance[k] * math.exp(-LAMBDA * h.score) <= max_evalue]
        form, which, hits = form[kept], which[kept], [hits[i] for i in kept]
        of = lambda f: np.array([f(h) for h in hits], np.int64)
        q_start, q_end, s_start, s_end, matches, score, length, gaps = (of(f) for f in (lambda h: h.q_start, lambda h: h.q_end, lambda h: h.s_start, lambda h: h.s_end, lambda h: h.matches, lambda h: h.score, lambda h: h.length if len(h.ops) > 1 else h.q_end - h.q_start, lambda h: h.gaps if len(h.ops) > 1 else 0))
        minus = form % strands == 1
        forms = [reverse_complement(texts[k]) if x else texts[k] for k, x in zip((form // strands).tolist(), minus.tolist())]
        n, m = (np.array([len(x[k]) for k in at.tolist()], np.int64) for x, at in ((coded, form), (index.texts, which)))
        covered = 100.0 * (q_end - q_start) / n
        aligned = [x[h.q_start : h.q_end] if len(h.ops) == 1 else _aligned_query(x, h) for x, h in zip(forms, hits)]
        columns = {
            "sseqid": [known[k][0] for k in which.tolist()],
            "pident": 100.0 * matches / length,
            "nident": matches,
            "length": length,
            "mismatch": of(lambda h: h.mismatches),
            "gapopen": gaps,
            "qcovs": covered,
            "qcovhsp": covered,
            "qstart": np.where(minus, n - q_end + 1, q_start + 1),
            "qend": np.where(minus, n - q_start, q_end),
            "sstart": np.where(minus, s_end, s_start + 1),
            "send": np.where(minus, s_start + 1, s_end),
            "qlen": n,
            "slen": m,
            "evalue": [chance[k] * math.exp(-LAMBDA * h.score) for k, h in zip(form.tolist(), hits)],
            "bitscore": (LAMBDA * score - math.log(KAPPA)) / math.log(2),
            "sstrand": ["minus" if x else "plus" for x in minus.tolist()],
            "qseq": aligned,
        }
        rows = pa.RecordBatch.from_arrays([pa.array(columns[c], kind) for c, kind in fields], names=[c for c, _ in fields])
        text = form // strands
        greatest: dict[tuple[int, str], int] = {}
        order = ["bitscore", *[c for c, _ in fields if c != "sseqid"]]
        for i, own in enumerate(zip(text.tolist(), columns["sseqid"])):
            other = greatest.setdefault(own, i)
            if other != i and [columns[c][i] for c in order] > [columns[c][other] for c in order]:
                greatest[own] = i
        some = np.fromiter(greatest.values(), np.int64, len(greatest))
        if best and len(some):
            subject = np.unique(np.array(columns["sseqid"], object), return_inverse=True)[1]
            some = some[np.lexsort([np.asarray(x)[some] for x in (columns["sstart"], columns["qstart"], subject, -columns["bitscore"], -covered, -columns["pident"], text)])]
            some = some[np.concatenate(([True], text[some][1:] != text[some][:-1]))]
        elif len(some) < len(text):
            some.sort()
        else:
            return text, rows
        return text[some], rows.take(pa.array(some))

    own = queries.where(F.col(sequence) != "").select(F.col(name).alias("qseqid"), F.col(sequence).alias("_seq"))
    return own.mapInArrow(run, T.StructType([own.schema["qseqid"], *ALIGNMENTS.fields[1:]]))
