"""Substring join of texts with a dictionary of patterns.

One Aho-Corasick pass over a text finds all patterns at once, so the cost is
the length of the text, not that times the dictionary. The automaton is built
from a dictionary of at most `MOST` entries; a larger one is joined by seeds (the
patterns' leading characters as an equi-join key), all in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 100_000


def contains(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, most: int = MOST) -> DataFrame:
    """`texts` x `patterns` where the pattern occurs, with `start` (1-based,
    first occurrence). Null and empty texts or patterns match nothing."""
    named = patterns.where(F.col(pattern) != "")
    distinct = [r[0] for r in named.select(pattern).distinct().limit(most + 1).collect()]
    if len(distinct) > most:
        return _seeded(texts, text, named, pattern)
    schema = T.StructType([*texts.schema.fields, T.StructField("_pattern", T.StringType()), T.StructField("start", T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in distinct:
            automaton.add_word(p, p)
        if distinct:
            automaton.make_automaton()
        for batch in batches:
            rows, found, starts = [], [], []
            for i, t in enumerate(batch.column(text).to_pylist() if distinct else []):
                first: dict[str, int] = {}
                for end, p in automaton.iter(t) if t else ():
                    first.setdefault(p, end - len(p) + 2)
                rows += [i] * len(first)
                found += first.keys()
                starts += first.values()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string()), pa.array(starts, pa.int32())], names=[*batch.schema.names, "_pattern", "start"])

    hits = texts.mapInArrow(scan, schema)
    return hits.join(named, F.col("_pattern") == F.col(pattern)).drop("_pattern")


def _seeded(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Patterns are grouped by length class (powers of two); their leading
    characters, as many as the class has at least, are the seeds. Only (hash of
    the text, position, seed) of each distinct text is exploded, and hits are
    verified on the texts."""
    known = patterns.select(F.col(pattern).alias("_pattern")).distinct().withColumn("_class", F.floor(F.log2(F.length("_pattern"))).cast("int"))
    known = known.withColumn("_size", F.pow(F.lit(2.0), F.col("_class")).cast("int"))
    seeds = known.select("_pattern", "_size", F.xxhash64(F.left(F.col("_pattern"), F.col("_size"))).alias("_seed"))
    sizes = sorted(r[0] for r in known.select("_size").distinct().collect())  # one a power of two
    own = texts.where(F.col(text) != "").select(F.xxhash64(text).alias("_id"), F.col(text).alias("_text")).distinct()
    windows = None
    for n in sizes:
        at = F.when(F.length("_text") >= n, F.sequence(F.lit(1), F.length("_text") - n + 1)).otherwise(F.array().cast("array<int>"))
        part = own.select("_id", F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.substring("_text", i, F.lit(n))).alias("seed")))).alias("w"))
        part = part.select("_id", F.lit(n).alias("_size"), F.col("w.at").alias("_at"), F.col("w.seed").alias("_seed"))
        windows = part if windows is None else windows.unionByName(part)
    hits = windows.join(seeds, ["_size", "_seed"]).select("_id", "_at", "_pattern")
    found = own.join(hits, "_id").where(F.substring("_text", F.col("_at"), F.length("_pattern")) == F.col("_pattern"))
    first = found.groupBy("_text", "_pattern").agg(F.min("_at").alias("start"))
    joined = texts.join(first, F.col(text) == F.col("_text")).join(patterns, F.col("_pattern") == F.col(pattern))
    return joined.select(*[F.col(f"`{c}`") for c in texts.columns], F.col("start").cast("int").alias("start"), *[F.col(f"`{c}`") for c in patterns.columns])
