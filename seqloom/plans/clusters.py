"""Groups of co-occurring alleles, with their donors, and edge diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workdir import materialize
from .cohort import components

MOST_MEMBERS = 8_000  # of a component that one task clusters: its matrix has the square of it in cells


def linkage_groups(similarity: np.ndarray, threshold: float, linkage: str) -> np.ndarray:
    """Group number of each row of a symmetric similarity matrix: the closest
    two groups merge while their similarity (the least over all their pairs for
    complete, the mean for average, the greatest for single linkage) reaches
    `threshold`. Among equally close ones the first in row order merge."""
    n = len(similarity)
    s = similarity.astype(np.float64).copy()
    np.fill_diagonal(s, -np.inf)
    group, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    best = s.argmax(axis=1) if n else np.empty(0, int)
    for _ in range(n - 1):
        top = np.where(alive, s[np.arange(n), best], -np.inf)
        i = int(top.argmax())
        if top[i] < threshold - 1e-12:
            break
        a, b = sorted((i, int(best[i])))
        if linkage == "complete":
            row = np.minimum(s[a], s[b])
        elif linkage == "single":
            row = np.maximum(s[a], s[b])
        else:
            row = (size[a] * s[a] + size[b] * s[b]) / (size[a] + size[b])
        row[[a, b]] = -np.inf
        row[~alive] = -np.inf
        s[a, :] = s[:, a] = row
        s[b, :] = s[:, b] = -np.inf
        group[group == group[b]] = group[a]
        size[a] += size[b]
        alive[b] = False
        stale = alive & ((best == a) | (best == b) | (s[:, a] > s[np.arange(n), best]))
        stale[a] = True
        best[stale] = s[stale].argmax(axis=1)
    return group


def clusters(edges: DataFrame, threshold: float = 0.5, min_size: int = 3, linkage: str = "components", value: str = "rho") -> DataFrame:
    """(group_id, allele) of groups of at least `min_size` alleles of `edges`
    (allele_a, allele_b, value; no edge and negative values count as 0), named by
    their smallest member.

    `linkage` is `components` or `single` (both: connected by edges of
    `threshold` or more), `complete` or `average`. Groups of any linkage lie
    within such components, so each component is clustered by itself; one of more
    than `MOST_MEMBERS` alleles is an error for the latter two."""
    if linkage not in ("components", "single", "complete", "average"):
        raise ValueError("linkage must be components, single, complete or average")
    links = materialize(edges.select("allele_a", "allele_b", F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)).alias("s")), "links")
    strong = components(links.where(F.col("s") >= threshold), "allele_a", "allele_b", min_size)
    if linkage in ("components", "single"):
        return strong
    strong = materialize(strong, "components")
    if not strong.groupBy("group_id").count().where(F.col("count") > MOST_MEMBERS).isEmpty():
        raise ValueError(f"a component has more than {MOST_MEMBERS} alleles")
    side = lambda x: strong.select(F.col("allele").alias(f"allele_{x}"), F.col("group_id").alias(f"_{x}"))
    inside = links.join(side("a"), "allele_a").join(side("b"), "allele_b").where("_a = _b").select(F.col("_a").alias("group_id"), "allele_a", "allele_b", "s")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        a, b = t["allele_a"].to_pylist(), t["allele_b"].to_pylist()
        names = sorted({*a, *b})
        at = {x: i for i, x in enumerate(names)}
        s = np.zeros((len(names), len(names)))
        i, j = [at[x] for x in a], [at[x] for x in b]
        s[i, j] = s[j, i] = t["s"].to_numpy()
        group = linkage_groups(s, threshold, linkage)
        yield pa.RecordBatch.from_pydict({"label": pa.array([names[g] for g in group], pa.string()), "allele": pa.array(names, pa.string())})

    found = materialize(inside.groupBy("group_id").applyInArrow(run, "label string, allele string"), "groups")
    large = found.groupBy("label").agg(F.count("*").alias("n"), F.min("allele").alias("group_id")).where(F.col("n") >= min_size)
    return found.join(large, "label").select("group_id", "allele")


def cluster_details(groups: DataFrame, calls: DataFrame, donor: str, alleles: list[str]) -> DataFrame:
    """(group_id, allele, donors, n_donors): the sorted donors of each member,
    joined by commas."""
    listed = F.array(*[F.trim(F.col(f"`{c}`")) for c in alleles])
    rows = calls.select(F.col(f"`{donor}`").alias("donor"), F.explode(listed).alias("allele")).where("donor IS NOT NULL AND allele <> ''").distinct()
    held = rows.join(groups.select("allele").distinct(), "allele", "left_semi").groupBy("allele").agg(F.array_sort(F.collect_list("donor")).alias("_d"))
    return groups.join(held, "allele").select("group_id", "allele", F.array_join("_d", ",").alias("donors"), F.size("_d").cast("long").alias("n_donors"))


def strong_edges(edges: DataFrame, threshold: float = 0.5, most: int = 20, value: str = "rho") -> DataFrame:
    """(allele_a, allele_b, value, n_all): the first `most` edges (by name) of
    `threshold` or more, with the number of all of them."""
    strong = materialize(edges.where(F.col(value) >= threshold).select("allele_a", "allele_b", value), "strong")
    return strong.orderBy("allele_a", "allele_b").limit(most).withColumn("n_all", F.lit(strong.count()).cast("long"))
