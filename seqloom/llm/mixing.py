"""Sources combined to target shares of tokens by Poisson replication.

A source's wanted tokens are target_share * budget, at most max_repeats times
what it has. What sources fall short of is given to the others in proportion to
their targets (as far as their own caps allow), so the total stays at the
budget where it can. For each source the repetition rate is wanted / available.
A document's number of copies is a hash-seeded Poisson draw, inverted at
u = hash(doc, seed) and cut at max_repeats; the mean is solved so that the cut
draw has the wanted rate in expectation (a rate equal to the cap gives every
document max_repeats times). Copies are exploded and put in a global random
order by hash. Draws depend on the document only, so a lost task redraws the
same.

Sizes are tokens of a public byte-level BPE tokenizer, whose file is a
parameter. Source names are compared trimmed and without case. Documents with a
null source, or one that has no target, take no part; null or empty texts have
no tokens and are never drawn. Repeated rows are different documents. Every
target source is reported with its target, planned and actual share; `reached`
says whether the actual share is within `tolerance` of the target, which also
fails for sources that make up for others. Empty tables give empty shares.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workdir import materialize

SEED = 20210301
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of byte-level BPE vocabularies of this size
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def _encoder(path: str):
    import tiktoken

    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """`df` with `n_tokens`, the tokens of its text column (null as 0)."""

    @F.pandas_udf("long")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(tokenizer)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn("n_tokens", size(F.col(text)))


def cut_mean(mean: float, cap: int) -> float:
    """E[min(Poisson(mean), cap)]."""
    if mean <= 0:
        return 0.0
    return cap - math.fsum((cap - n) * math.exp(n * math.log(mean) - mean - math.lgamma(n + 1)) for n in range(cap))


def poisson_mean(rate: float, cap: int) -> float:
    """The mean whose Poisson draws, cut at `cap`, average `rate`; infinite
    when the rate is the cap itself."""
    if rate >= cap:
        return math.inf
    lo, hi = 0.0, 1.0
    while cut_mean(hi, cap) < rate:
        hi *= 2
        if hi > 64 * (cap + 64):  # the rate is the cap within rounding
            return math.inf
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < rate else (lo, mid)
    return (lo + hi) / 2


def thresholds(mean: float, cap: int) -> list[float]:
    """P(Poisson <= n) for n below cap: copies = how many of them u exceeds."""
    if math.isinf(mean):
        return [-1.0] * cap
    if mean <= 0:
        return [1.0] * cap
    out, total = [], 0.0
    for n in range(cap):
        total += math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
        out.append(total)
    return out


def wanted_tokens(shares: list[float], limits: list[float], budget: float) -> list[float]:
    """Tokens of each source: proportional to its share, none above its limit,
    together the budget if the limits allow."""
    out, open_ = [0.0] * len(shares), set(range(len(shares)))
    left = float(budget)
    while open_:
        total = sum(shares[i] for i in open_)
        short = {i for i in open_ if total > 0 and shares[i] / total * left >= limits[i]}
        if total <= 0 or not short:
            for i in open_:
                out[i] = shares[i] / total * left if total > 0 else 0.0
            break
        for i in short:
            out[i] = float(limits[i])
            left -= limits[i]
        open_ -= short
    return out


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of target sources."""
    known = targets.select(F.trim("source").alias("source")).distinct()
    docs = documents.select("doc_id", F.lower(F.trim("source")).alias("_key"), "text").where("_key IS NOT NULL")
    named = docs.join(F.broadcast(known.withColumn("_key", F.lower("source"))), "_key")  # one row a source
    return with_tokens(named, "text", tokenizer).select("doc_id", "source", "n_tokens")


def plan(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> list[dict]:
    """One entry a target source: its tokens, planned tokens, rate and
    thresholds. `budget` is the total to compose, by default the tokens there are."""
    tokens = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a source
    rows = targets.select(F.trim("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").collect()
    budget = sum(tokens.values()) if budget is None else budget
    have = [tokens.get(r["source"], 0) for r in rows]
    wanted = wanted_tokens([r["target_share"] for r in rows], [n * int(r["max_repeats"]) for n, r in zip(have, rows)], budget)
    out = []
    for r, n, w in zip(rows, have, wanted):
        cap = int(r["max_repeats"])
        rate = w / n if n else 0.0
        out.append({"source": r["source"], "target_share": r["target_share"], "max_repeats": cap, "tokens": n, "planned": w, "rate": rate, "cuts": thresholds(poisson_mean(rate, cap), cap)})
    return out


def draws(docs: DataFrame, cuts: list[tuple[str, list[float]]], seed: int) -> DataFrame:
    """`docs` (doc_id, source, ...) with their `copies`: how many of their
    source's thresholds u exceeds. u is 52 bits of the MD5 of id and seed."""
    table = docs.sparkSession.createDataFrame(cuts, "source string, cuts array<double>")
    bits = F.conv(F.left(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)))), F.lit(13)), 16, 10).cast("long")
    drawn = docs.withColumn("u", (bits + F.lit(0.5)) / F.lit(float(1 << 52))).join(F.broadcast(table), "source")  # one row a source
    return drawn.withColumn("copies", F.size(F.filter("cuts", lambda c: F.col("u") > c))).drop("u", "cuts")


def _draw(sizes: DataFrame, targets: list[dict], seed: int) -> DataFrame:
    """Documents of `sizes` with their `copies`, at least one."""
    return draws(sizes.where("n_tokens > 0"), [(p["source"], p["cuts"]) for p in targets], seed).where("copies > 0")


def mixture(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, order_key): the mixture's records in
    global random order; copy_no counts from 1 to at most max_repeats."""
    sizes = materialize(sized(documents, targets, tokenizer), "sizes")
    drawn = _draw(sizes, plan(sizes, targets, budget), seed)
    exploded = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = exploded.withColumn("order_key", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))
    return out.select("doc_id", "source", "copy_no", "n_tokens", "order_key").orderBy("order_key", "doc_id", "copy_no")


def shares(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, tolerance: float = 0.01) -> DataFrame:
    """(source, target_share, planned_share, actual_share, tokens_available,
    tokens_used, planned_total, actual_total, copies, most_repeats, max_repeats,
    reached): the mixture measured. Planned shares are of the planned total,
    actual ones of what was drawn."""
    sizes = materialize(sized(documents, targets, tokenizer), "sizes")
    goals = plan(sizes, targets, budget)
    used = _draw(sizes, goals, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    used = materialize(used, "used")
    total, planned = used.agg(F.sum("tokens_used")).first()[0] or 0, sum(p["planned"] for p in goals)
    rows = [(p["source"], p["target_share"], p["planned"] / planned if planned else 0.0, p["tokens"], p["max_repeats"]) for p in goals]
    plan_df = sizes.sparkSession.createDataFrame(rows, "source string, target_share double, planned_share double, tokens_available long, max_repeats int")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    actual = F.coalesce("tokens_used", F.lit(0)) / F.lit(float(max(total, 1)))
    return plan_df.join(used, "source", "left").select(
        "source", "target_share", "planned_share", actual.alias("actual_share"), "tokens_available", zero("tokens_used"), F.lit(round(planned)).cast("long").alias("planned_total"),
        F.lit(total).cast("long").alias("actual_total"), zero("copies"), zero("most_repeats"), "max_repeats", (F.abs(actual - F.col("target_share")) <= tolerance).alias("reached"),
    )
