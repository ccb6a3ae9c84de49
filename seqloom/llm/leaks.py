"""Evaluation passages inside training documents, by winnowing.

A text becomes a row of words; every run of k words is hashed, and of each
window of w consecutive hashes the smallest (rightmost on ties) is kept as a
fingerprint. Two texts that share t = k + w - 1 consecutive words keep an
equal fingerprint from them. Documents and items are joined on fingerprints,
and every hit is extended on the texts: an item leaked into a document when
`span` consecutive words of it occur there consecutively, or all of its words
when it has fewer.

The guarantee depends on t, so items are handled by class t = min(words, span);
a document is fingerprinted once per class that occurs (at most `span`).

The item side is broadcast only when it has at most `broadcast_rows`
fingerprints; otherwise both sides are shuffled by fingerprint. Each (document,
item) comes out once however often it matches. Null texts, and items without a
word, match nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import chunks, mix64, polynomial
from ..workdir import materialize
from .shared_spans import _winnow

# Fixed pattern: tags (<..> or [..]) and entities
MARKUP = re.compile(r"</?[^\W\d_][^<>\n]*>|\[/?[^\W\d_][^\[\]\n]*\]|&(?:[^\W\d_]\w*|#\d+|#[xX][0-9a-fA-F]+);")
WORD = re.compile(r"[^\W_]+")
SPAN = 13


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, markup and entities removed."""
    return WORD.findall(MARKUP.sub(" ", text).lower())


def _word_hashes(texts: list[str], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the offset of each text."""
    import xxhash

    out: list[int] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        for w in words(t):
            h = cache.get(w)
            if h is None:
                if len(cache) > 200_000:
                    cache.clear()
                h = cache[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        offsets[i + 1] = len(out)
    return np.array(out, np.uint64), offsets


def _class_shape(t: int) -> tuple[int, int]:
    """(k, w) of a class: k words a fingerprint, w hashes a window."""
    k = t // 2 + 1
    return k, t - k + 1


def fingerprints(hashes: np.ndarray, offsets: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) of class t for rows of word hashes."""
    k, w = _class_shape(t)
    h = polynomial(hashes, k)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    inside = np.arange(len(h)) + k <= offsets[1:][rows] if len(h) else np.zeros(0, bool)
    h, rows = mix64(h[inside] + np.uint64(t)), rows[inside]
    picked = _winnow(h, rows, w)
    return h[picked], rows[picked]


def _emit(id_column: str, classes: list[int] | None, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column(id_column).to_numpy(), batch.column("text").to_pylist()
            for i, j in chunks(texts, 500_000):
                hashes, offsets = _word_hashes(texts[i:j], cache)
                n = np.diff(offsets)
                for t in classes if classes is not None else np.unique(np.minimum(n, span)):
                    if t < 1:
                        continue
                    h, rows = fingerprints(hashes, offsets, int(t))
                    if classes is None:  # an item belongs to one class
                        mine = np.minimum(n[rows], span) == t
                        h, rows = h[mine], rows[mine]
                    both = np.unique(np.stack([h.view(np.int64), ids[i:j][rows].astype(np.int64)]), axis=1) if len(h) else np.empty((2, 0), np.int64)
                    yield pa.RecordBatch.from_pydict({"fp": both[0], id_column: both[1], "t": pa.array([int(t)] * both.shape[1], pa.int32())})

    return run


def contains_passage(document: list[str], item: list[str], span: int) -> bool:
    """Whether `span` consecutive words of the item (all, if fewer) occur
    consecutively in the document."""
    n = min(span, len(item))
    if not n:
        return False
    runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(document[i : i + n]) in runs for i in range(len(document) - n + 1))


def leaked(documents: DataFrame, items: DataFrame, span: int = SPAN, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id) of every item that leaked into a document.
    `documents` has (doc_id, text), `items` (item_id, text); ids are integers."""
    documents, items = documents.select("doc_id", "text").where("text IS NOT NULL"), items.select("item_id", "text").where("text IS NOT NULL")
    tests = materialize(items.mapInArrow(_emit("item_id", None, span), "fp long, item_id long, t int"), "items")
    classes = sorted(r[0] for r in tests.select("t").distinct().collect())  # at most `span` values
    small = tests.limit(broadcast_rows + 1).count() <= broadcast_rows
    seen = documents.mapInArrow(_emit("doc_id", classes, span), "fp long, doc_id long, t int")
    hits = seen.join(F.broadcast(tests) if small else tests, ["fp", "t"]).select("doc_id", "item_id").distinct()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list[str]] = {}
        for batch in batches:
            keep, last, doc_words = [], None, []
            for text, item in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist()):
                if text is not last:
                    last, doc_words = text, words(text)
                if item not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[item] = words(item)
                keep.append(contains_passage(doc_words, parsed[item], span))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").filter(pa.array(keep)), "item_id": batch.column("item_id").filter(pa.array(keep))})

    texts = hits.join(documents, "doc_id").join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
    return texts.select("doc_id", "item_id", "text", "item_text").mapInArrow(extend, "doc_id long, item_id long")
