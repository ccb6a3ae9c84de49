"""Texts that were cut off by a field limit or in transfer.

A logistic regression over hashed features of a text's ending, trained on
texts this table itself provides: values that are not at a field limit stand
for intact ones, and artificial cuts of them for truncated ones. Then every
record is scored, those of the sample by a fit that hasn't seen them; one is
truncated if that is as likely as not.

Features: closing characters and punctuation, the last tokens, broken or
unclosed markup, whether the end lies in a signature, quote or link, how much
more often than lengths nearby the source has a different text of this length,
the distance to the source's next such length, and how often the corpus ends a
sentence after the last one, two and three words.

All statistics cover all records. Word runs are counted exactly; those that
make up less than 1 / `ITEMS` of all are dropped, so at most `ITEMS` are left to
broadcast whatever the corpus, and a run's frequency classes are relative to
that limit. Length histograms are exact, too.

Artificial cuts of a text: two at random places, one at one of the lengths that
stand out in the table (drawn by their excess), one inside a tag or entity and
one inside a character of several bytes where it has any. A complete text may
fill its field: each text also stands for one, with the share of the texts of
that length that the lengths nearby account for as its weight. The sample holds
texts that were really cut: after a first fit, each counts as intact only with
the probability found (by a fit on other texts), and the prior is the mean of
what was found.

Only fitting the weights uses a sample: about `sample` records, those with the
smallest hashes of their id. Null, empty and blank texts are not cases; null
sources share one length histogram, names are compared trimmed and without
case. Repeated rows are scored alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import mix64
from ..workdir import materialize

SAMPLE = 10_000
ITEMS = 1 << 21
DIMS = 1 << 20
INTACT, CUT, FILLS = 0, 1, 2  # labels; the last is an intact text that fills its field
FIRST_PRIOR = 0.5  # share of cut texts that the first fit assumes: even odds
STEPS, MORE_STEPS, REFITS = 60, 25, 2
L2 = 0.002
THRESHOLD = 0.5
AROUND = 12  # lengths on each side that tell how many texts one should have
STANDS_OUT = 4.0  # an excess from which a length is a candidate for a field limit

TOKEN = re.compile(r"https?://\S+|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]|_")
_WITH_BREAKS = re.compile(r"https?://\S+|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|\n|[^\w\s]|_")
_BROKEN = re.compile(r"(?:</?[a-zA-Z]?[^<>\n]{0,80}|\[/?[a-zA-Z]?[^\[\]\n]{0,80}|&#?\w{0,8}|�+)$")
_LONGEST = 84  # characters that a broken tag or entity has at most
_SIGNED = re.compile(r"\n-- ?\n")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*>|\[/?[a-zA-Z][^\[\]\n]*\]|&#?\w{1,8};")
_CLOSERS = "\"'”’»)]}*_"
_ENDS = ".!?…:;"
_STOPS = ".!?…"


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s)


def _norm(token: str) -> str:
    return "0" if token.isdigit() else "http" if token.startswith("http") and "/" in token else token.lower()


def _run_keys(words: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of runs of one, two and three words from the words' hashes; 0 where
    there is no word before, or none before that."""
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    u = mix64(words + np.uint64(1))
    b = mix64(mix64(words * one + before) + np.uint64(2))
    t = mix64(mix64((words * one + before) * two + first) + np.uint64(3))
    return u, b, t


class _Vocabulary:
    """Numbers for the tokens of a task, with what counting needs to know."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hash: list[int] = [0]
        self.kind: list[int] = [0]  # 0 other, 1 word, 2 stop, 3 line break

    def numbers(self, tokens: list[str]) -> list[int]:
        out = [*map(self.number.get, tokens)]
        if None in out:
            for i, token in enumerate(tokens):
                if out[i] is None:
                    out[i] = self.number.get(token) or self._add(token)
        return out

    def _add(self, token: str) -> int:
        n = self.number[token] = len(self.hash)
        word = token[0].isalnum()
        self.hash.append(_hash(_norm(token)) if word else 0)
        self.kind.append(1 if word else 3 if token == "\n" else 2 if token[0] in _STOPS else 0)
        return n


def run_counts(texts: list[str], vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, times, times that a sentence or line ends after it) of the runs of
    one to three words of all texts; a text's last token is left out, as what
    follows it isn't known."""
    flat: list[int] = []
    for t in texts:
        flat += vocabulary.numbers(_WITH_BREAKS.findall(t))
        flat.append(0)
    at = np.array(flat, np.int64)
    kind = np.array(vocabulary.kind, np.int8)[at] if len(at) else np.empty(0, np.int8)
    kept = np.flatnonzero(kind != 3)
    breaks = np.append(kind[1:] == 3, False)[kept] if len(at) else np.empty(0, bool)
    at, kind = at[kept], kind[kept]
    last = np.append(at[1:] == 0, True) if len(at) else np.empty(0, bool)
    stop = breaks | (np.append(kind[1:] == 2, False) if len(at) else np.empty(0, bool))
    word = kind == 1
    goes_on = np.concatenate(([False], (word & ~stop)[:-1])) & word if len(at) else np.empty(0, bool)
    two = goes_on & np.concatenate(([False], goes_on[:-1])) if len(at) else goes_on
    h = np.array(vocabulary.hash, np.uint64)[at] if len(at) else np.empty(0, np.uint64)
    zero = np.uint64(0)
    before = np.where(goes_on, np.concatenate((h[:1], h[:-1])), zero)
    first = np.where(two, np.concatenate((h[:2], h[:-2]))[: len(h)], zero)
    mine = word & ~last
    keys = np.concatenate(_run_keys(h[mine], before[mine], first[mine]))
    stops = np.tile(stop[mine], 3)
    own, inverse = np.unique(keys, return_inverse=True)
    return own, np.bincount(inverse, minlength=len(own)), np.bincount(inverse, stops, minlength=len(own)).astype(np.int64)


def _rate_class(n: np.ndarray, stops: np.ndarray, least: int) -> np.ndarray:
    """1 + frequency class (three) * 6 + class of the share of ends (six)."""
    often = np.where(n < 3 * least, 0, np.where(n < 12 * least, 1, 2))
    share = stops / np.maximum(n, 1)
    return (1 + often * 6 + np.where(stops == 0, 0, 1 + np.searchsorted([0.05, 0.25, 0.6, 0.9], share, side="right"))).astype(np.uint8)


class Runs:
    """Classes of the frequent word runs, by key; 0 for the others."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.classes = keys[order], classes[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.uint8)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.classes[at], 0)


def corpus_runs(documents: DataFrame) -> Runs:
    """Exact counts of all word runs of `documents` (text), as classes of those
    that make up 1 / `ITEMS` of all or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary()
        for batch in batches:
            if len(vocabulary.hash) > 500_000:
                vocabulary = _Vocabulary()
            k, n, s = run_counts(batch.column("text").to_pylist(), vocabulary)
            yield pa.RecordBatch.from_pydict({"key": k.view(np.int64), "n": n.astype(np.int64), "stops": s})

    rows = documents.where("text IS NOT NULL").select("text").mapInArrow(count, "key long, n long, stops long")
    counts = materialize(rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops")), "runs")
    least = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // ITEMS))
    frequent = counts.where(F.col("n") >= least).toArrow()  # at most ITEMS rows
    n, stops = frequent["n"].to_numpy(), frequent["stops"].to_numpy()
    return Runs(frequent["key"].to_numpy().view(np.uint64), _rate_class(n, stops, least))


def _char_class(c: str) -> str:
    return "a" if c.islower() else "A" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c if ord(c) < 0x2000 else "*"


def _opened(body: str, name: str) -> bool:
    return body.count(f"<{name}>") + body.count(f"<{name} ") > body.count(f"</{name}>")


def ending_features(text: str, limit: str) -> tuple[list[str], tuple[int, int, int], tuple[str, str, str]]:
    """Features of a text's end but those of its last words; the hashes of the
    last three words (0 where there is none) and what goes into their features."""
    body = text.rstrip()
    tail = body[-400:]
    f = ["bias", f"limit {limit}", f"space {text != body and text[-1:] or ''}"]
    broken = _BROKEN.search(tail, max(0, len(tail) - _LONGEST)) if any(c in tail for c in "<[&\ufffd") else None
    if broken and broken.group():
        kind = broken.group()[0]
        closed = ""
        if kind in "<[" and len(broken.group()) > 2 and broken.group()[1:2] == " ":
            closed = "free"
        f.append(f"broken {kind}{closed}")
        f.append(f"broken {kind}{closed} {_norm(broken.group()[1:5])}")
        # what the broken piece follows counts as the end, too
        tail = tail[: broken.start()].rstrip() or tail
    line = tail.rsplit("\n", 1)[-1]
    tokens = TOKEN.findall(tail[-120:])[-6:]
    normal = [_norm(t) for t in tokens]
    c1, c2 = _char_class(tail[-1:] or " "), _char_class(tail[-2:-1] or " ")
    f += [f"c1 {c1}", f"c2 {c2}{c1}", f"c3 {_char_class(tail[-3:-2] or ' ')}{c2}{c1}"]
    f += [f"t1 {' '.join(normal[-1:])}", f"t2 {' '.join(normal[-2:])}", f"t3 {' '.join(normal[-3:])}"]
    last = tail.rstrip(_CLOSERS)[-1:]
    f.append(f"stop {last in _ENDS and last != '' and last or ''} {tail[-1:] in _CLOSERS}")
    signed = _SIGNED.search(tail, max(0, len(tail) - 160))
    state = f"sig{tail.count(chr(10), signed.end())}" if signed else "quote" if line.startswith(">") else "line1" if len(line) == len(tail) else "line"
    f.append(f"in {state}")
    f.append(f"in {state} {c1} {len(line) // 15}")
    f.append(f"short {min(len(line), 40) // 8} {c1}")
    if tokens and tokens[-1].startswith("http"):
        f += ["link", f"link {re.sub('[a-z]+', 'a', re.sub('[0-9]+', '9', tokens[-1].lower()))}"]
    if "<" in body:
        f += [f"open {i}" for i, t in enumerate("pbi") if _opened(body, t)]
    if "[" in body:
        f += [f"open {i}" for i, t in ((3, "quote"), (4, "url")) if body.count(f"[{t}") > body.count(f"[/{t}")]
    if body.count("(") > body.count(")"):
        f.append("open 5")
    f.append(f"started {body[:3] == '<p>'} {body[-4:] == '</p>'}")
    if not (normal and tokens[-1][0].isalnum()):
        return f, (0, 0, 0), ("", "", "")
    before = normal[-2] if len(normal) > 1 and normal[-2][0].isalnum() else ""
    first = normal[-3] if before and len(normal) > 2 and normal[-3][0].isalnum() else ""
    f.append(f"sx {normal[-1][-3:]}")
    hashes = tuple(_hash(w) if w else 0 for w in (normal[-1], before, first))
    return f, hashes, (state, limit, f"{min(len(normal[-1]), 6)} {tokens[-1][0].isupper()}")


def features(texts: list[str], limits: list[str], runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row, and the number of each."""
    parts = [ending_features(t, limit) for t, limit in zip(texts, limits)]
    words = np.array([p[1] for p in parts], np.uint64).reshape(len(parts), 3)
    classes = [runs(k) for k in _run_keys(words[:, 0], words[:, 1], words[:, 2])]
    out: list[int] = []
    sizes = np.zeros(len(parts), np.int64)
    for i, ((f, (word, _, _), (state, limit, shape)), ru, rb, rt) in enumerate(zip(parts, *(c.tolist() for c in classes))):
        if word:
            f += [f"ru {ru}", f"rb {rb}", f"rt {rt}", f"rbt {rb} {rt}", f"rr {ru} {rb} {state}", f"rl {ru} {rb} {limit}", f"len {shape} {(ru + 5) // 6}"]
        own = {_hash(x) & (DIMS - 1) for x in f}
        out += own
        sizes[i] = len(own)
    return np.array(out, np.int64), sizes


def cut_at(text: str, u: float) -> str | None:
    """`text` cut inside a word or sentence at about the share u, or None
    where there is no such place."""
    n = len(text)
    return cut_to(text, 1 + int(u * (n - 1))) if n else None


def cut_to(text: str, at: int) -> str | None:
    """The first `at` characters, unless they end where the text could."""
    if not 0 < at < len(text):
        return None
    head = text[:at]
    body = head.rstrip()
    if not body or body[-1] in _ENDS + _CLOSERS + ">" or "\n" in head[len(body) :]:
        return None
    rest = text[len(body) :].lstrip(" ")
    if not rest or rest[0] in "\n" or (rest[0] in _STOPS and not text[at - 1 : at].isspace()):
        return None
    return head


def artificial_cuts(text: str, rng: np.random.Generator) -> list[str]:
    """Cuts at two random places, inside one of the text's tags or entities,
    and inside one of its characters of several bytes."""
    out = [cut_at(text, rng.random()), cut_at(text, rng.random())]
    spans = [m.span() for m in _MARKUP.finditer(text)]
    if spans:
        a, b = spans[int(rng.integers(len(spans)))]
        out.append(text[: int(rng.integers(a + 1, b))])
    wide = [i for i, c in enumerate(text) if ord(c) > 127] if not text.isascii() else []
    if wide:
        i = wide[int(rng.integers(len(wide)))]
        data = text[i].encode("utf-8", "replace")
        out.append(text[:i] + data[: int(rng.integers(1, len(data)))].decode("utf-8", "replace") if len(data) > 1 else None)
    return [x for x in out if x and x.strip()]


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Without BLAS, whose threads would contend with other tasks."""
    return float((a * b).sum())


def fit(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, dims: int, w: np.ndarray | None = None, steps: int = STEPS, l2: float = L2) -> np.ndarray:
    """Logistic regression on sparse 0/1 rows (indices below `dims`), from the weights
    `w` if there are any: `steps` of L-BFGS on the whole of it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, w[flat], len(sizes))
        loss = np.logaddexp(0.0, z) - labels * z
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) * weights
        return float((weights * loss).sum() + 0.5 * l2 * _dot(w, w)), np.bincount(flat, error[owner], dims) + l2 * w

    w = np.zeros(dims) if w is None else w.copy()
    now, grad = value(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps if len(sizes) else 0):
        q, kept = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * _dot(s, q)
            q -= a * y
            kept.append(a)
        if past:
            s, y, rho = past[-1]
            q /= rho * _dot(y, y)
        else:
            q /= max(1.0, float(np.abs(q).sum()))
        for (s, y, rho), a in zip(past, reversed(kept)):
            q += s * (a - rho * _dot(y, q))
        slope, size = _dot(grad, q), 1.0
        for _ in range(25):
            after, next_grad = value(w - size * q)
            if after <= now - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, next_grad - grad
        if _dot(s, y) > 1e-12:
            past = [*past[-9:], (s, y, 1 / _dot(s, y))]
        done = now - after < 1e-7 * abs(now)
        w, now, grad = w + s, after, next_grad
        if done:
            break
    return w


def _fold(ids: np.ndarray, seed: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) & np.uint64(1)).astype(np.int64)


def score(w: np.ndarray, flat: np.ndarray, sizes: np.ndarray, model: np.ndarray | None = None) -> np.ndarray:
    """Scores by the weights `w`, or by those of each row's `model`."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    z = np.bincount(owner, w[flat] if model is None else w[model[owner], flat], len(sizes))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def field_limits(docs: DataFrame) -> DataFrame:
    """(source_key, n, c, near) of the lengths n that stand out: c different
    texts, where the mean of the lengths around is `near` (Laplace's one added to
    both). Different ones, as a stock reply makes its length stand out, too."""
    lengths = docs.select("source_key", "n", F.xxhash64("text").alias("h")).distinct().groupBy("source_key", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source_key").orderBy("n").rangeBetween(-AROUND, AROUND)
    near = (F.sum("c").over(w) - F.col("c")) / (2 * AROUND)
    return lengths.withColumn("near", near).where(F.col("c") + 1 >= STANDS_OUT * (F.col("near") + 1))


class Limits:
    """The lengths of each source that stand out: as each needs STANDS_OUT times
    the texts of the lengths nearby, about a quarter of the lengths there are at
    most, however many texts."""

    def __init__(self, rows: list[tuple[str, int, int, float]]):
        self.own: dict[str, dict[int, int]] = {}
        for source, n, c, near in rows:
            self.own.setdefault(source, {})[n] = int(math.log2((c + 1) / (near + 1)))
        self.ascending = {s: np.array(sorted(x)) for s, x in self.own.items()}
        self.pool = [(n, int(math.log2((c + 1) / (near + 1))), c, near) for _, n, c, near in sorted(rows)]
        self.mass = np.cumsum([c - near for _, _, c, near in self.pool])

    def feature(self, source: str, n: int) -> str:
        """Class of the excess at this length, and of the distance to the next one."""
        own = self.own.get(source)
        if not own:
            return "none"
        if n in own:
            return f"at {own[n]}"
        at = np.searchsorted(self.ascending[source], n)
        gap = int(self.ascending[source][at]) - n if at < len(self.ascending[source]) else 0
        return f"below {gap.bit_length()}" if 0 < gap <= 8 else "off"

    def draw(self, rng: np.random.Generator) -> tuple[int, int, float] | None:
        """(length, class, share that lengths nearby account for, to the rest)
        of a length that stands out, by its excess."""
        if not self.pool:
            return None
        n, level, c, near = self.pool[min(int(np.searchsorted(self.mass, rng.random() * self.mass[-1], side="right")), len(self.pool) - 1)]
        return n, level, near / max(c - near, 1e-9)


def truncation_scores(documents: DataFrame, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(doc_id, source_key, at_limit, score, cut) of every record with a
    non-blank text; `documents` has (doc_id, source, text)."""
    return _scored(documents, sample, seed)[0]


def truncation_report(documents: DataFrame, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(precision, recall, prior): recall on held-out artificial cuts, the
    precision to expect of the sample's texts at lengths that don't stand out, and
    the share of cut ones among these."""
    found = _scored(documents, sample, seed)[1]
    return documents.sparkSession.createDataFrame([tuple(found[c] for c in ("precision", "recall", "prior"))], "precision double, recall double, prior double")


def _scored(documents: DataFrame, sample: int, seed: int) -> tuple[DataFrame, dict[str, float]]:
    docs = documents.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source_key"), "text", F.length("text").alias("n")).where("trim(text) <> ''")
    context = docs.sparkSession.sparkContext
    runs = context.broadcast(corpus_runs(documents))
    standing = materialize(field_limits(docs), "limits").collect()  # see Limits
    limits = context.broadcast(Limits([(r.source_key, r.n, r.c, r.near) for r in standing]))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = runs.value, limits.value
        for batch in batches:
            texts, at, label, weight, fold = [], [], [], [], []
            for doc_id, source, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source_key", "text"))):
                if lengths.feature(source, len(text)).startswith("at"):
                    continue
                rng = np.random.default_rng([seed, doc_id & 0x7FFFFFFF])
                made = [(text, lengths.feature(source, len(text)), INTACT, 1.0)]
                made += [(cut, lengths.feature(source, len(cut)), CUT, 1.0) for cut in artificial_cuts(text, rng)]
                drawn = lengths.draw(rng)
                if drawn:
                    n, level, by_chance = drawn
                    cut = cut_to(text, n)
                    if cut is not None:
                        made += [(cut, f"at {level}", CUT, 1.0), (text, f"at {level}", FILLS, by_chance)]
                for values, x in zip((texts, at, label, weight), zip(*made)):
                    values += x
                fold += [int(_fold(np.array([doc_id]), seed)[0])] * len(made)
            flat, sizes = features(texts, at, known)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(weight, pa.float64()), pa.array(fold, pa.int32()), lists], names=["label", "weight", "fold", "features"])

    rows = docs.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) < F.lit(int(min(1.0, sample / max(rows, 1)) * (1 << 53)))
    drawn = docs.where(draw).select("doc_id", "source_key", "text").mapInArrow(examples, "label int, weight double, fold int, features array<int>").toArrow()
    labels, weights = drawn["label"].to_numpy().astype(float), drawn["weight"].to_numpy()
    lists = drawn["features"].combine_chunks()
    flat, sizes = (lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)) if len(lists) else (np.empty(0, np.int64), np.empty(0, np.int64))
    w, report = _trained(flat, sizes, labels, weights, drawn["fold"].to_numpy())
    model = context.broadcast(w)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths, w = runs.value, limits.value, model.value
        for batch in batches:
            texts, sources = batch.column("text").to_pylist(), batch.column("source_key").to_pylist()
            at = [lengths.feature(s, len(t)) for s, t in zip(sources, texts)]
            flat, sizes = features(texts, at, known)
            other = 1 - _fold(batch.column("doc_id").to_numpy(), seed)  # the fit that hasn't seen the text
            s = score(w, flat, sizes, other)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source_key"), pa.array([x.startswith("at") for x in at], pa.bool_()), pa.array(s, pa.float64())], names=["doc_id", "source_key", "at_limit", "score"])

    out = docs.select("doc_id", "source_key", "text").mapInArrow(scored, "doc_id long, source_key string, at_limit boolean, score double")
    return out.withColumn("cut", F.col("score") >= THRESHOLD), report


def _trained(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """Weights of the fits on either fold, and what held-out examples tell:
    precision, recall and the prior. Texts taken as intact are weighted by the probability that they are. All scores
    come from the fit on the other fold."""
    used, cols = np.unique(flat, return_inverse=True)
    intact, prior, own = labels == INTACT, FIRST_PRIOR, weights.copy()
    cut = (labels == CUT).astype(float)
    ends = np.cumsum(sizes)
    parts = [(at, np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in at]) if len(at) else np.empty(0, np.int64)) for at in (np.flatnonzero(fold == f) for f in (0, 1))]
    models: list[np.ndarray | None] = [None, None]

    def balanced() -> np.ndarray:
        odds = prior / (1 - prior) * max(own[intact].sum(), 1e-9) / max(weights[cut == 1].sum(), 1e-9)
        return np.where(intact, own, weights * odds)

    for n in range(1 + REFITS):
        now, found = balanced(), np.zeros(len(sizes))
        for f, (at, some) in enumerate(parts):
            models[f] = fit(cols[some], sizes[at], cut[at], now[at], len(used), models[f], MORE_STEPS if n else STEPS)
        for f, (at, some) in enumerate(parts):
            found[at] = score(models[1 - f], cols[some], sizes[at])
        own = np.where(intact, weights * np.where(found < THRESHOLD, 1 - found, 0), weights)
        prior = float(np.clip((weights[intact] * found[intact]).sum() / max(weights[intact].sum(), 1e-9), 0.001, 0.5))
    w = np.zeros((2, DIMS), np.float32)
    w[:, used] = models
    return w, _measured(found[cut == 1], found[intact], (weights * (1 - found))[intact], prior)


def _measured(cuts: np.ndarray, others: np.ndarray, mass: np.ndarray, prior: float) -> dict[str, float]:
    """Recall for held-out scores of artificial cuts, and the precision that the
    scores of the sample's own texts, held out as well, let expect: they are intact
    with a probability of `mass`, and mixed with cuts at the prior."""
    recall = float((cuts >= THRESHOLD).mean()) if len(cuts) else 0.0
    false = float(mass[others >= THRESHOLD].sum() / max(mass.sum(), 1e-9))
    hits, alarms = prior * recall, (1 - prior) * false
    return {"precision": hits / max(hits + alarms, 1e-12), "recall": recall, "prior": prior}


def truncated(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source_key, at_limit, score) of the records that were cut."""
    return truncation_scores(documents, sample).where("cut").drop("cut")


def truncation_rates(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(source_key, n_docs, n_cut, cut_share, n_at_limit) of every source."""
    scores = truncation_scores(documents, sample)
    cut = F.col("cut").cast("int")
    return scores.groupBy("source_key").agg(F.count("*").alias("n_docs"), F.sum(cut).alias("n_cut"), F.avg(cut).alias("cut_share"), F.sum(F.when(F.col("at_limit"), 1).otherwise(0)).alias("n_at_limit"))
