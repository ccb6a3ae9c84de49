"""Spans of at least L characters that occur verbatim in other records.

Two passes over the texts:

1. Every text picks fingerprints: of all windows of length K, the one with the
   smallest hash in each run of W consecutive windows, K + W - 1 = L. Equal
   spans of length L pick equal windows, so a shared span has a shared
   fingerprint inside. All fingerprints go into count-min sketches, one a
   partition, merged in fan-in rounds. The merged sketch overestimates counts:
   a fingerprint it estimates at one is in one record only.
2. Fingerprints estimated at two or more are grouped exactly: min and max of
   their record ids tell whether another record has one, without ever gathering
   a group. Around each that is repeated, all windows of length L are grouped
   in the same way (by a 96-bit hash).

No shared window is lost: it contains a repeated fingerprint, whose
neighbourhood is grouped whole. The sketch's size is fixed; if a table fills it,
more fingerprints are grouped (about one in 25 characters, at most), with the
same result. The second pass finds the repeated ones by a filter with `FILL`
counters or more for each, so one in `FILL` others passes by chance at most; where
they are too many for that, fingerprints and records are joined exactly instead.

Records are compared without letter case, repeated rows of one record are one,
null and empty texts and those shorter than L share nothing, records with a
null key are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import chunks, code_points, window_hashes
from ..operators.sketch import build_sketch, cells, flagged, width_for
from ..workdir import materialize

WIDTH = 1 << 26
FILL, WANTED = 64, 1024  # counters of the second filter for a repeated fingerprint: at least, and where there is room
CHUNK = 64_000  # characters hashed at once: what fits a core's cache
SHIFT = np.uint64(32)  # the second filter uses other bits of the hash


def _winnow(h: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """Whether each window is the (rightmost) minimum of some run of w
    consecutive windows of its row; runs are those that lie in the row."""
    n = len(h)
    if n < w:
        return np.zeros(n, bool)
    # position in the low bits: ties go to the later window
    bits = np.uint64(32)  # of the hash, the upper half orders; the same for every batch
    packed = (h >> bits << bits) | (np.uint64(n) - np.arange(n, dtype=np.uint64))
    low, size = packed, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: n - w + 1], low[w - size : n - size + 1])
    inside = rows[: n - w + 1] == rows[w - 1 :]
    at = n - (low[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    picked = np.zeros(n, bool)
    picked[at] = True
    return picked


def _fingerprints(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, offsets = code_points(texts)
    h, rows, start = window_hashes(codes, offsets, k)
    picked = _winnow(h, rows, w)
    return h[picked], rows[picked], start[picked]


def _batches(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.RecordBatch.from_pydict({c: np.concatenate([x[c] for x in parts]) for c in parts[0]})


def shared_windows(records: DataFrame, length: int = 150, spread: int = 51, width: int = WIDTH, filter_width: int = WIDTH) -> DataFrame:
    """(rec_id, start) of the windows of `length` characters, 1 row
    each, that another record has too. `records` has (rec_id, text); a rec_id
    may be repeated with equal text. `width` are the counters of the sketch,
    `filter_width` those the second filter may have."""
    if not 1 <= spread <= length:
        raise ValueError("spread must be between 1 and length")
    k, w = length - spread + 1, spread

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = batch.column("text").to_pylist()
        yield np.concatenate([np.empty(0, np.uint64), *(_fingerprints(texts[i:j], k, w)[0] for i, j in chunks(texts, CHUNK))])

    context = records.sparkSession.sparkContext
    estimated = context.broadcast(build_sketch(records.select("text"), hashes, width, "uint8").flags(2))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = batch.column("rec_id").to_numpy(), batch.column("text").to_pylist(), []
            for i, j in chunks(texts, CHUNK):
                h, rows, _ = _fingerprints(texts[i:j], k, w)
                hit = flagged(estimated.value, cells(h, width))
                out.append({"fp": h[hit].view(np.int64), "rec_id": ids[i:j][rows[hit]]})
            yield from _batches(out)

    found = records.mapInArrow(suspects, "fp long, rec_id long")
    grouped = found.groupBy("fp").agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"))
    exact = materialize(grouped.where("lo < hi").select("fp"), "fingerprints")

    def regions(texts: list[str], ids: np.ndarray, h: np.ndarray, rows: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """The windows that hold one of the repeated fingerprints (h, row,
        start); they start at most w - 1 before it."""
        some = np.unique(rows)
        codes, offsets = code_points([texts[r] for r in some])
        long1, at_rows, at = window_hashes(codes, offsets, length, seed=5)
        long2, _, _ = window_hashes(codes, offsets, length, seed=6)
        n_windows = np.bincount(at_rows, minlength=len(some))
        first = np.concatenate(([0], np.cumsum(n_windows)))
        r = np.searchsorted(some, rows)
        lo = first[r] + np.maximum(0, start - w + 1)
        hi = first[r] + np.minimum(n_windows[r], start + 1)
        lo, hi = lo[hi > lo], hi[hi > lo]
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        keep = np.cumsum(edge[:-1]) > 0
        return {"h": long1[keep].view(np.int64), "g": (long2[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32), "rec_id": ids[some[at_rows[keep]]], "start": at[keep].astype(np.int32)}

    schema = "h long, g int, rec_id long, start int"
    many = exact.count()
    if FILL * many <= filter_width:
        size = width_for(WANTED * many, most=filter_width)

        def repeats(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            yield batch.column("fp").to_numpy().view(np.uint64) >> SHIFT

        repeated = context.broadcast(build_sketch(exact, repeats, size, "uint8").flags(1))

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, out = batch.column("rec_id").to_numpy(), batch.column("text").to_pylist(), []
                for i, j in chunks(texts, CHUNK):
                    h, rows, start = _fingerprints(texts[i:j], k, w)
                    hit = flagged(repeated.value, cells(h >> SHIFT, size))
                    if hit.any():
                        out.append(regions(texts[i:j], ids[i:j], h[hit], rows[hit], start[hit]))
                yield from _batches(out)

        windows = materialize(records.mapInArrow(filtered, schema), "windows")
        repeated.destroy()
    else:
        own = found.join(exact, "fp", "left_semi").distinct().groupBy("rec_id").agg(F.collect_list("fp").alias("fps"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, fps, out = batch.column("rec_id").to_numpy(), batch.column("text").to_pylist(), batch.column("fps").to_pylist(), []
                for i, j in chunks(texts, CHUNK):
                    h, rows, start = _fingerprints(texts[i:j], k, w)
                    known = [set(x) for x in fps[i:j]]
                    hit = np.fromiter((x in known[r] for x, r in zip(h.view(np.int64).tolist(), rows.tolist())), bool, len(h))
                    if hit.any():
                        out.append(regions(texts[i:j], ids[i:j], h[hit], rows[hit], start[hit]))
                yield from _batches(out)

        windows = materialize(records.join(own, "rec_id").select("rec_id", "text", "fps").mapInArrow(joined, schema), "windows")
    estimated.destroy()
    shared = windows.groupBy("h", "g").agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi")).where("lo < hi").select("h", "g")
    return windows.join(shared, ["h", "g"], "left_semi").select("rec_id", "start")


def shared_lengths(tables: dict[str, DataFrame], length: int = 150, spread: int = 51, width: int = WIDTH, filter_width: int = WIDTH) -> DataFrame:
    """(tbl, rec_key, shared_length, n_chars, shared_share) of every record
    with a shared span; `tables` maps a table's name to its (rec_key, text).

    shared_length counts the characters of the record that lie in a span of at
    least `length` characters found in another record of any of the tables.
    """
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("tbl"), F.col("rec_key").cast("string").alias("rec_key"), F.upper("text").alias("text")).where(F.length("text") >= length)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where("rec_key IS NOT NULL").withColumn("rec_id", F.xxhash64("tbl", "rec_key"))
    found = shared_windows(rows.select("rec_id", "text"), length, spread, width, filter_width).distinct()
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("rec_id").orderBy("start"))
    covered = found.select("rec_id", F.least(F.coalesce(gap, F.lit(length)), F.lit(length)).alias("new")).groupBy("rec_id").agg(F.sum("new").cast("long").alias("shared_length"))
    keys = rows.select("rec_id", "tbl", "rec_key", F.length("text").cast("long").alias("n_chars"))
    named = keys.join(materialize(covered, "covered"), "rec_id").groupBy("tbl", "rec_key", "shared_length").agg(F.max("n_chars").alias("n_chars"))
    return named.select("tbl", "rec_key", "shared_length", "n_chars", (F.col("shared_length") / F.col("n_chars")).alias("shared_share"))
