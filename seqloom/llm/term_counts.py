"""How often every distinct term occurs, and in how many records.

Burst-trie counting. A burst trie keeps terms in containers and splits
("bursts") a container by the next character of its terms when it holds more
than `CAPACITY`. Three steps:

1. Every task builds a trie of its own records and hands on its containers:
   one row a container, with the path that leads to it, its first and last term
   and its terms with two counters each. A term that makes up a third of all
   rows leaves each task once.
2. Routing prefixes adapt to the data in rounds: a prefix whose containers hold
   more than `route_rows` entries is replaced by longer ones, as long as what
   all its terms begin with and one character more; containers that span
   several of them are split. Each round is a written table.
3. Containers go to the worker of their routing prefix, where the subtrees of
   all tasks are merged: a container meets the one at its path, counters of
   equal terms are added, and what grew too large bursts again.

Terms are compared by code point. Null and empty terms are no terms; null
amounts count as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workdir import materialize

CAPACITY = 4096
_ENTRY = "field string, term string, records long, total long"
_COUNTERS = "array<struct<term: string, records: long, total: long>>"
_CONTAINER = f"field string, route string, path string, first string, last string, n long, terms {_COUNTERS}"
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("records", pa.int64()), ("total", pa.int64())]))

Entry = tuple[str, int, int]


class BurstTrie:
    """Terms with two counters each. Inner nodes branch on one character;
    leaves are hash containers that burst into an inner node."""

    __slots__ = ("capacity", "children", "container", "depth", "here")

    def __init__(self, depth: int = 0, capacity: int = CAPACITY):
        self.depth, self.capacity = depth, capacity
        self.container: dict[str, list[int]] | None = {}
        self.children: dict[str, BurstTrie] = {}
        self.here: list[int] | None = None  # the term that ends at this node

    def add(self, term: str, records: int, total: int) -> None:
        self.absorb("", [(term, records, total)])

    def absorb(self, path: str, terms: list[Entry]) -> None:
        """Merges a container whose terms all begin with `path`: it descends to
        the node of that path, or as far as this trie has branched."""
        node = self
        while node.container is None and node.depth < len(path):
            node = node._child(path[node.depth])
        node._merge(terms)

    def _child(self, c: str) -> BurstTrie:
        child = self.children.get(c)
        if child is None:
            child = self.children[c] = BurstTrie(self.depth + 1, self.capacity)
        return child

    def _merge(self, terms: list[Entry]) -> None:
        if self.container is None:
            below: dict[str, list[Entry]] = {}
            for entry in terms:
                term, records, total = entry
                if len(term) == self.depth:
                    self.here = [records, total] if self.here is None else [self.here[0] + records, self.here[1] + total]
                else:
                    below.setdefault(term[self.depth], []).append(entry)
            for c, part in below.items():
                self._child(c)._merge(part)
            return
        held = self.container
        for term, records, total in terms:
            counters = held.get(term)
            if counters is None:
                held[term] = [records, total]
            else:
                counters[0] += records
                counters[1] += total
        if len(held) > self.capacity:
            self.container = None
            self._merge([(term, *counters) for term, counters in held.items()])

    def containers(self, path: str = "") -> Iterator[tuple[str, list[Entry]]]:
        """(path, terms in order) of every container; a term that ends at an
        inner node is one of its own."""
        if self.container is not None:
            if self.container:
                yield path, sorted((term, *counters) for term, counters in self.container.items())
            return
        if self.here is not None:
            yield path, [(path, *self.here)]
        for c in sorted(self.children):
            yield from self.children[c].containers(path + c)

    def items(self) -> Iterator[tuple[str, list[int]]]:
        """All terms in order."""
        for _, terms in self.containers():
            for term, records, total in terms:
                yield term, [records, total]


def _containers(rows: list[tuple[str, str, str, list[Entry]]]) -> pa.RecordBatch:
    """Rows of (field, route, path, terms in order)."""
    field, route, path, terms = zip(*rows) if rows else ((), (), (), ())
    as_dicts = [[{"term": t, "records": r, "total": n} for t, r, n in x] for x in terms]
    return pa.RecordBatch.from_arrays([
        *(pa.array(x, pa.string()) for x in (field, route, path, [x[0][0] for x in terms], [x[-1][0] for x in terms])),
        pa.array([len(x) for x in terms], pa.int64()), pa.array(as_dicts, _TERMS),
    ], names=["field", "route", "path", "first", "last", "n", "terms"])


def _entries(values: list[dict]) -> list[Entry]:
    return [(x["term"], x["records"], x["total"]) for x in values]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers cut by the first `cut` characters of their terms."""
    for batch in batches:
        out = []
        for field, path, cut, terms in zip(*(batch.column(c).to_pylist() for c in ("field", "path", "cut", "terms"))):
            parts: dict[str, list[Entry]] = {}
            for entry in _entries(terms):
                parts.setdefault(entry[0][:cut], []).append(entry)
            out += [(field, route, max(path, route, key=len), part) for route, part in parts.items()]
        yield _containers(out)


def count_terms(df: DataFrame, fields: dict[str, Column], amount: Column | None = None, route_rows: int = 200_000, local_terms: int = 500_000) -> DataFrame:
    """(field, term, records, total): for each field, its distinct terms, the
    number of rows with the term and the sum of `amount` over them (rows if
    there is none)."""
    value = F.coalesce(amount, F.lit(0)).cast("long") if amount is not None else F.lit(1).cast("long")
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), term.cast("string").alias("term")) for name, term in fields.items()])
    rows = df.select(F.explode(pairs).alias("x"), value.alias("total")).select("x.field", "x.term", F.lit(1).cast("long").alias("records"), "total").where("term <> ''")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            for field in sorted(tries):
                for path, terms in tries[field].containers():
                    yield _containers([(field, "", path, terms)])

        for batch in batches:
            # equal terms of a batch are added once
            t = pa.Table.from_batches([batch]).group_by(["field", "term"]).aggregate([("records", "sum"), ("total", "sum")])
            by: dict[str, list[Entry]] = {}
            for f, *entry in zip(*(t[c].to_pylist() for c in ("field", "term", "records_sum", "total_sum"))):
                by.setdefault(f, []).append(tuple(entry))
            for f, terms in by.items():
                tries.setdefault(f, BurstTrie()).absorb("", terms)
            held += t.num_rows
            if held > local_terms:  # bounds the task's memory; the merge adds what was split
                yield from done()
                tries, held = {}, 0
        yield from done()

    routed = materialize(rows.mapInArrow(local, _CONTAINER), "containers")
    while True:
        sizes = routed.groupBy("field", "route").agg(F.sum("n").alias("all"), F.min("first").alias("lo"), F.max("last").alias("hi"))
        full = sizes.where((F.col("all") > route_rows) & (F.col("lo") < F.col("hi"))).collect()  # at most all entries / route_rows
        if not full:
            break
        cuts = [(r["field"], r["route"], len(os.path.commonprefix([r["lo"], r["hi"]])) + 1) for r in full]
        table = F.broadcast(df.sparkSession.createDataFrame(cuts, "field string, route string, cut int"))
        cut = routed.join(table, ["field", "route"]).select("field", "path", "cut", "terms").mapInArrow(_split, _CONTAINER)
        routed = materialize(routed.join(table, ["field", "route"], "left_anti").select(*cut.columns).unionByName(cut), "containers")

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for batch in batches:
            for path, terms in zip(batch.column("path").to_pylist(), batch.column("terms").to_pylist()):
                trie.absorb(path, _entries(terms))
        field = key[0].as_py()
        for _, terms in trie.containers():
            term, records, total = zip(*terms)
            yield pa.RecordBatch.from_pydict({"field": pa.array([field] * len(terms), pa.string()), "term": pa.array(term, pa.string()), "records": pa.array(records, pa.int64()), "total": pa.array(total, pa.int64())})

    return routed.groupBy("field", "route").applyInArrow(merge, _ENTRY)


def mark_terms(terms: DataFrame, common_share: float, min_records: int, min_total: int) -> DataFrame:
    """Adds `mark`: 'common' above `common_share` of the field's records with a
    term, else 'rare' below `min_records` or `min_total`, else 'kept'."""
    terms = materialize(terms, "counted")
    whole = terms.groupBy("field").agg(F.sum("records").alias("_all"))
    mark = F.when(F.col("records") > common_share * F.col("_all"), "common").when((F.col("records") < min_records) | (F.col("total") < min_total), "rare").otherwise("kept")
    return terms.join(F.broadcast(whole), "field").withColumn("mark", mark).drop("_all")
