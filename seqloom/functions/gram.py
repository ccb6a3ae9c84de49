"""Co-occurrence counts of a block of records as a blocked Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ITEM_BLOCK = 512


def gram(record: np.ndarray, item: np.ndarray, n_items: int, block: int = ITEM_BLOCK, most_cells: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, count), a < b, over distinct 0-based (record, item) pairs."""
    n_rows = int(record.max()) + 1 if len(record) else 0
    order = np.argsort(item, kind="stable")
    rows, items = record[order], item[order]
    n_blocks = -(-n_items // block)
    bounds = np.searchsorted(items, np.arange(n_blocks + 1) * block)
    step = max(1, most_cells // (2 * block))

    def dense(b: int, lo: int, hi: int) -> np.ndarray:
        r, i = rows[bounds[b] : bounds[b + 1]], items[bounds[b] : bounds[b + 1]]
        inside = (r >= lo) & (r < hi)
        m = np.zeros((hi - lo, block), np.float32)
        m[r[inside] - lo, i[inside] - b * block] = 1
        return m

    for x in range(n_blocks):
        for y in range(x, n_blocks):
            if bounds[x] == bounds[x + 1] or bounds[y] == bounds[y + 1]:
                continue
            total = np.zeros((block, block), np.int64)
            for lo in range(0, n_rows, step):
                hi = min(n_rows, lo + step)
                left = dense(x, lo, hi)
                total += (left.T @ (left if x == y else dense(y, lo, hi))).astype(np.int64)
            if x == y:
                total = np.triu(total, 1)
            a, b = np.nonzero(total)
            if len(a):
                yield a + x * block, b + y * block, total[a, b]
