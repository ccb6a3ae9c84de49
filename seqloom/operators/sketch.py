"""Count-min sketches built over a whole table and merged in fan-in rounds.

Each partition adds its hashes to its own sketch of fixed size; the sketches
travel as tiles (a slice of the counters), so no task ever holds more than
`FAN_IN` copies of one tile, whatever the number of partitions. The merged
sketch has a fixed, small size, which is what bounds its broadcast. Estimates
never fall below the true count (saturating at the counter's maximum).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
TILE = 1 << 17
_SCHEMA = "tile int, part long, cells binary"


def _saturating(total: np.ndarray, dtype: np.dtype) -> np.ndarray:
    return np.minimum(total, np.iinfo(dtype).max).astype(dtype)


def _pack(piece: np.ndarray) -> bytes:
    return zlib.compress(piece.tobytes(), 1)


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)


def cells(h: np.ndarray, width: int) -> np.ndarray:
    """Counter of each hash; `width` is a power of two."""
    return (h & np.uint64(width - 1)).astype(np.int64)


def width_for(items: int, least: int = 1 << 18, most: int = 1 << 26) -> int:
    """A power of two of at least `items` counters, within fixed bounds."""
    return min(most, max(least, 1 << max(0, items - 1).bit_length()))


@dataclass(frozen=True)
class Sketch:
    """A merged sketch; the driver keeps its tiles compressed."""

    width: int
    dtype: str
    tiles: dict[int, bytes]

    def load(self) -> float:
        """Mean of the counters: what chance adds to an estimate."""
        return sum(float(_unpack(b, self.dtype).sum(dtype=np.uint64)) for b in self.tiles.values()) / self.width

    def flags(self, least: int) -> np.ndarray:
        """Which counters reach `least`, packed eight to a byte."""
        out = np.zeros(self.width // 8, np.uint8)
        for t, b in self.tiles.items():
            piece = np.packbits(_unpack(b, self.dtype) >= least, bitorder="little")
            out[t * TILE // 8 : t * TILE // 8 + len(piece)] = piece
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros(self.width, self.dtype)
        for t, b in self.tiles.items():
            piece = _unpack(b, self.dtype)
            out[t * TILE : t * TILE + len(piece)] = piece
        return out


def flagged(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the counters `at` are marked in `packed`."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def build_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], width: int, dtype: str = "uint16", fan_in: int = FAN_IN) -> Sketch:
    """Merged sketch (`width` counters) of the hashes that `hashes` yields
    for the batches of `df`. Empty input gives zeros. `df` should be a scan: its
    number of partitions is asked for, to know the number of rounds."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype)
        seen = False
        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    seen = True
                    at, n = np.unique(cells(h, width), return_counts=True)
                    total[at] = _saturating(total[at].astype(np.int64) + n, np.dtype(dtype))
        if not seen:
            return
        part = TaskContext.get().partitionId()
        for t in range(0, width, TILE):
            piece = total[t : t + TILE]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"tile": pa.array([t // TILE], pa.int32()), "part": pa.array([part], pa.int64()), "cells": pa.array([_pack(piece)], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = None
        for c in rows["cells"]:
            piece = _unpack(c.as_py(), dtype).astype(np.uint64)
            total = piece if total is None else total + piece
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "cells": pa.array([_pack(_saturating(total, np.dtype(dtype)))], pa.binary())})

    parts = max(1, df.rdd.getNumPartitions())
    tiles = df.mapInArrow(local, _SCHEMA)
    while True:
        tiles = tiles.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("tile", "part").applyInArrow(merge, _SCHEMA)
        parts = -(-parts // fan_in)
        if parts <= 1:
            break
    # at most `width` counters, compressed
    return Sketch(width, dtype, {r["tile"]: bytes(r["cells"]) for r in tiles.collect()})
