"""The operators against brute force on small inputs, with nulls, empty and
long texts, ties, repeated rows, empty tables and extra columns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seqloom.llm")

from seqloom.llm import item_pairs, leaks, mixing, near_duplicates, shared_spans, term_counts, top_items, truncation  # noqa: E402


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def family(rng, n=300, copies=5, edits=4):
    base = dna(rng, n)
    out = [base]
    for _ in range(copies):
        s = list(base)
        for _ in range(rng.randint(1, edits)):
            i = rng.randrange(len(s))
            kind = rng.randrange(3)
            if kind == 0:
                s[i] = rng.choice("ACGT")
            elif kind == 1:
                s.insert(i, dna(rng, 3))
            else:
                j = rng.randrange(len(s))
                a, b = sorted((i, j))
                s = s[b:] + s[:b] if rng.random() < 0.3 else s[:a] + s[a + 1 :]
        out.append("".join(s))
    return out


def brute_pairs(rows, k, t):
    seen = {}
    for key, text in rows:
        if text and key is not None:
            seen.setdefault(text.upper(), set()).add(key)
    grams = {x: {x[i : i + k] for i in range(len(x) - k + 1)} for x in seen}
    out = set()
    for x, y in itertools.combinations_with_replacement(sorted(seen), 2):
        both = len(grams[x] & grams[y])
        either = len(grams[x] | grams[y])
        if either and both >= t * either:
            out |= {tuple(sorted((a, b))) for a in seen[x] for b in seen[y] if a != b}
    return out


def test_near_duplicates(spark):
    rng = random.Random(3)
    texts = [s for _ in range(12) for s in family(rng)] + [dna(rng, 300) for _ in range(40)]
    conserved = dna(rng, 120)  # a window of every tenth text, more than a bucket holds
    texts += [dna(rng, 100) + conserved + dna(rng, 100) for _ in range(60)]
    texts += ["ACGTACGTACGTA", "ACGTACGTACGTAC", dna(rng, 20) * 2, "", None, "ACGT", "ACGT", dna(rng, 50_000)]
    rows = [(f"r{i:04d}", t) for i, t in enumerate(texts)]
    rows += [("r0000", texts[0]), ("copy1", texts[1].lower()), ("copy2", texts[1]), (None, texts[2])]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "key string, value string, id string, anchor int")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "key", "value").collect()}
    assert got == brute_pairs(rows, 12, 0.5)
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "key", "value").count() == 0
    classes = near_duplicates.near_duplicate_classes(df.where("key = 'copy1' OR key = 'copy2' OR key = 'r0000'"), "key", "value").collect()
    assert {r["key"]: r.copies for r in classes} == {"copy1": 1, "copy2": 1, "r0000": 2}
    assert len({r.class_id for r in classes}) == 1 and {r["key"]: r.links for r in classes} == {"copy1": 1, "copy2": 1, "r0000": 1}


def test_planted_classes(spark):
    """Equal window sets at other lengths, tandem repeats, and single inserts."""
    rng = random.Random(17)
    rows = []
    for i in range(20):
        unit, short, base = dna(rng, 40), dna(rng, 7), dna(rng, 300)
        rows += [(f"length{i:02d}a", unit * 2), (f"length{i:02d}b", unit * 20), (f"tandem{i:02d}a", short * 40), (f"tandem{i:02d}b", short * 41)]
        rows += [(f"insert{i:02d}a", base), (f"insert{i:02d}b", base[:150] + dna(rng, 9) + base[150:])]
    shared = dna(rng, 40)  # twenty texts with one window set, more than a bucket holds
    rows += [(f"same{i:02d}", shared * (2 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, value string")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "key", "value").collect()}
    assert got == brute_pairs(rows, 12, 0.5)
    for kind, n in (("length", 20), ("tandem", 20), ("insert", 20), ("same", 190)):
        assert sum(a.startswith(kind) for a, _ in got) >= n


def test_shuffled_ids_give_the_same_pairs(spark):
    """Both sides of the switches from broadcast to shuffle."""
    rng = random.Random(19)
    rows = [(f"r{i:03d}", s) for i, s in enumerate([s for _ in range(6) for s in family(rng)] + family(rng, 200, 30, 2))]
    rows += [(f"c{i:04d}", rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, value string")
    narrow = near_duplicates.Settings(broadcast_copied=0, broadcast_ids=0)
    a, b = (sorted(map(tuple, near_duplicates.near_duplicate_pairs(df, "key", "value", s).collect())) for s in (near_duplicates.Settings(), narrow))
    assert a == b and a


@pytest.mark.parametrize("n", [14, 24, 48, 96, 128, 200, 300, 600, 3000])
def test_recall_by_length(spark, n):
    """Edited pairs of similarity 0.5 to 0.6, of texts of one length."""
    rng = random.Random(n)
    rows, want = [], set()
    while len(want) < 150:
        a = dna(rng, n)
        s = list(a)
        for _ in range(rng.randint(0, max(1, n // 30))):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        b = "".join(s) + (dna(rng, rng.randint(0, max(1, n // 2))) if rng.random() < 0.5 else "")
        both, either = near_duplicates.shared_windows(a, b, 12)
        if a != b and either * 0.5 <= both <= either * 0.6:
            i = len(want)
            rows += [(f"{i:04d}a", a), (f"{i:04d}b", b)]
            want.add((f"{i:04d}a", f"{i:04d}b"))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "key string, value string"), "key", "value").collect()}
    print(f"recall at {n} characters: {len(got & want)} of {len(want)}")
    assert len(got & want) >= 0.99 * len(want)


def test_large_family_is_joined(spark):
    """More variants than a bucket holds: the bands must find them."""
    rng = random.Random(5)
    rows = [(f"v{i:03d}", s) for i, s in enumerate(family(rng, 300, 60, 2))]
    want = brute_pairs(rows, 12, 0.5)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "key string, value string"), "key", "value").collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_hot_family_of_mixed_lengths(spark):
    """Short variants, hot throughout, against texts about half of which is the
    family's core: no common anchor, whatever the sampled windows say."""
    rng = random.Random(11)
    rows = []
    for f in range(3):
        core = dna(rng, 200)
        short = [core[rng.randrange(6) : 200 - rng.randrange(6)] for _ in range(30)]
        longer = [dna(rng, n // 2) + core + dna(rng, n - n // 2) for n in (rng.randrange(125, 180) for _ in range(60))]
        rows += [(f"f{f}_{i:03d}", x) for i, x in enumerate(short + longer)]
    want = brute_pairs(rows, 12, 0.5)
    mixed = {p for p in want if (p[0][3:] < "030") != (p[1][3:] < "030")}
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "key string, value string"), "key", "value").collect()}
    assert len(mixed) > 2000 and got <= want and len(got & mixed) >= 0.97 * len(mixed)


@pytest.mark.parametrize("group", [None, 400])
def test_no_pair_is_lost_to_frequent_windows(spark, monkeypatch, group):
    """Texts that share nothing but windows of many texts, all pairs of them;
    with parts worked on whole and by groups of texts."""
    rng = random.Random(23)
    if group:
        monkeypatch.setattr(near_duplicates, "GROUP", group)
    rows = []
    for f in range(2):
        core = dna(rng, 200)
        short = [core[rng.randrange(6) : 200 - rng.randrange(6)] for _ in range(20)]
        longer = [dna(rng, n // 2) + core + dna(rng, n - n // 2) for n in (rng.randrange(150, 190) for _ in range(60))]
        rows += [(f"f{f}_{i:03d}", x) for i, x in enumerate(short + longer)]
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "key string, value string"), "key", "value").collect()}
    assert got == brute_pairs(rows, 12, 0.5)


def test_chance_meetings_are_few(spark):
    """Unrelated texts share windows by chance; hardly any of them become
    candidates, and all true pairs do."""
    rng = random.Random(29)
    settings = near_duplicates.Settings(k=8)
    texts = [s for _ in range(10) for s in family(rng)] + [dna(rng, rng.randrange(270, 330)) for _ in range(700)]
    texts += [dna(rng, 3000)]
    texts += [texts[-1][:2000] + dna(rng, 900)]
    rows = [(f"r{i:04d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key string, value string")
    want = brute_pairs(rows, 8, 0.5)
    distinct = near_duplicates.distinct_texts(df, "key", "value", settings)[0]
    candidates = near_duplicates.candidate_pairs(distinct, settings, len(rows)).count()
    print(f"{candidates} candidates, {len(want)} pairs")
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "key", "value", settings).collect()} == want
    assert candidates < len(want) + 1000


def test_pairs_by_two_windows_and_by_one():
    """Both searches of a part find the same pairs as often, in one slice or
    many; the one by two windows gives up beyond its memory."""
    rng = np.random.default_rng(31)
    text, h = np.unique([rng.integers(0, 400, 3000), rng.integers(0, 300, 3000)], axis=1).astype(np.uint32)
    entries = np.sort((h.astype(np.uint64) << np.uint64(32)) | text)
    items = lambda found: (x for a, b, n in found for x in zip(a.tolist(), b.tolist(), n.tolist()) if x[0] != x[1])
    one = {(a, b): n for a, b, n in items(near_duplicates._by_one(entries, 400))}
    twice = {p: n * (n - 1) // 2 for p, n in one.items() if n > 1}
    for twos in (1 << 20, 500):
        assert {(a, b): n for a, b, n in items([near_duplicates._by_two(text, h, twos)])} == twice
    some = {(a, b): n for a, b, n in items(near_duplicates._by_one(entries, 50))}
    assert twice and some == {p: n for p, n in one.items() if p[0] < 50}
    assert near_duplicates._by_two(text, h, most=10) is None
    assert len(near_duplicates._by_two(text[:0], h[:0])[0]) == 0


@pytest.mark.parametrize("slices", [2, 7, 300])
def test_slices_of_a_part_find_what_the_part_finds(slices):
    """All pairs that meet often enough in a part meet in one of its slices,
    and what the slices are sent doesn't grow with their number."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(37)
    low, high = near_duplicates._bounds(5, 1)
    pool = rng.integers(low, high, 3000)
    families = [rng.choice(pool, 9, replace=False) for _ in range(40)]
    own = [np.unique(np.concatenate((rng.choice(families[i % 40], rng.integers(2, 9), replace=False), rng.choice(pool, 3)))) for i in range(400)]
    count = np.array([len(x) for x in own])
    sizes = np.where(np.arange(400) % 10, 313, 30)  # some may meet but once
    blocks, at = [], np.append(0, np.cumsum(count))
    h, number = np.concatenate(own), np.arange(400) + (7 << 16)
    for i in (200, 0):  # blocks come in any order
        blocks.append(near_duplicates._row(5, near_duplicates._pack(h[at[i] : at[i + 200]], count[i : i + 200], number[i : i + 200], sizes[i : i + 200])))
    settings = near_duplicates.Settings()
    pairs = lambda found: {tuple(sorted(p)) for x in found for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
    whole = pairs(near_duplicates._meet((pa.scalar(5),), iter(blocks), settings, 1))
    sent, found = 0, set()
    for x in near_duplicates._sliced(iter(blocks), slices):
        part = x.column("part")[0].as_py()
        assert part // slices == 5
        sent += len(near_duplicates._unpack(x.column("entries")[0].as_py())[0])
        found |= pairs(near_duplicates._meet((pa.scalar(part),), iter([x]), settings, slices))
    assert len(whole) > 500 and whole <= found
    assert sent <= (count * (count + 1) // 2).sum()


def test_repeats_of_a_unit_are_near_duplicates(spark):
    """The same distinct windows, however often repeated."""
    rng = random.Random(13)
    unit, end = dna(rng, 40), dna(rng, 200)
    rows = [("a", unit * 3), ("b", unit * 8), ("c", unit * 30), ("n1", end + "N" * 50), ("n2", end + "N" * 900), ("x", dna(rng, 300))]
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "key string, value string"), "key", "value").collect()}
    assert got == brute_pairs(rows, 12, 0.5) == {("a", "b"), ("a", "c"), ("b", "c"), ("n1", "n2")}


@pytest.mark.parametrize("n, k", [(20, 4), (60, 4), (110, 12), (160, 12), (300, 12)])
def test_bands_join_texts_of_any_length(n, k):
    """Pairs at J 0.5 to 0.55 made of a shared part and own parts of letters."""
    rng = random.Random(n)
    word = lambda m: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=m))
    pairs = []
    while len(pairs) < 300:
        shared, own = word(2 * n // 3 + k), n // 3
        a, b = shared + word(own - k // 2), shared + word(own - k // 2)
        both, either = near_duplicates.shared_windows(a, b, k)
        if 0.5 <= both / either:
            pairs.append((a, b))
    rows, keys, _ = near_duplicates._band_keys([x for p in pairs for x in p], k)
    found = {}
    for r, x in zip(rows.tolist(), keys.tolist()):
        found.setdefault(r, set()).add(x)
    assert sum(bool(found[2 * i] & found[2 * i + 1]) for i in range(len(pairs))) >= 0.99 * len(pairs)


def test_manhattan_is_a_lower_bound():
    rng = random.Random(1)
    texts = [dna(rng, 200) for _ in range(20)] + family(rng, 200)
    cells, n = near_duplicates.embed(texts, 12)
    for i, j in itertools.combinations(range(len(texts)), 2):
        both, either = near_duplicates.shared_windows(texts[i], texts[j], 12)
        assert near_duplicates.manhattan(cells[i : i + 1], cells[j : j + 1])[0] <= either - both


def test_item_pairs(spark):
    rng = random.Random(2)
    items = [f"g{i}*0{j}" for i in range(8) for j in range(2)]
    rows = [(f"b{b}", f" {x} ") for b in range(120) for x in rng.sample(items, 4)] + [(f"b{b}", x) for b in range(30) for x in ("p*1", "q*1")]
    rows += [("pool", f"z{i}*1") for i in range(1500)] + [("pool", x) for x in items] + [(None, "p*1"), ("b1", None), ("b1", "  "), ("b1", "p*1")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "case string, item string, pos int")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in item_pairs.item_pairs(item_pairs.baskets(df, "case", ["item"]), 5, 0.01, 1.5).collect()}
    sets = {}
    for b, x in rows:
        if b and x and x.strip():
            sets.setdefault(b, set()).add(x.strip())
    n, count = len(sets), {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    want = {}
    common = sorted(x for x in count if count[x] >= 5)
    for a, b in itertools.combinations(common, 2):
        ab = sum(a in s and b in s for s in sets.values())
        if ab >= 5 and ab * 100 >= n and ab * n >= 1.5 * count[a] * count[b]:
            want[a, b] = (ab, count[a], count[b], n)
    assert got == want and ("p*1", "q*1") in got
    assert item_pairs.item_pairs(item_pairs.baskets(df.limit(0), "case", ["item"]), 5, 0.01, 3).count() == 0


def test_top_items(spark):
    rows = [("a", f"g{i:03d}", i % 7, "x") for i in range(200)] + [("b", "g1", 1, "x"), ("b", "g1", 9, "x"), ("b", None, 99, "x"), (None, "g", 1, "x"), ("c", "g", None, "x")]
    df = spark.createDataFrame(rows, "case string, gene string, count_1 long, salt string")
    got = {(r.group_key, r.rank): r["item"] for r in top_items.top_items(df, "case", "gene", "count_1", 3, salts=4).collect()}
    assert got == {("a", 1): "g006", ("a", 2): "g013", ("a", 3): "g020", ("b", 1): "g1"}
    assert top_items.top_items(df.limit(0), "case", "gene", "count_1", 3).count() == 0


def test_shared_spans(spark):
    rng = random.Random(4)
    span, other = dna(rng, 150), dna(rng, 149)
    rows = {"a": dna(rng, 60) + span + dna(rng, 40), "b": span.lower(), "c": dna(rng, 10) + other + "A", "d": dna(rng, 30) + other + "C", "e": dna(rng, 400), "f": span * 3, "g": "", "h": None}
    left = spark.createDataFrame([*[(k, t, 0) for k, t in rows.items()], ("e", rows["e"], 0), (None, span, 0)], "rec_key string, text string, start int")
    right = spark.createDataFrame([("e", rows["e"][100:350]), ("z", dna(rng, 500))], "rec_key string, text string")
    got = {(r.tbl, r.rec_key): r.shared_length for r in shared_spans.shared_lengths({"x": left, "y": right}).collect()}
    assert got == {("x", "a"): 150, ("x", "b"): 150, ("x", "f"): 450, ("x", "e"): 250, ("y", "e"): 250}
    assert shared_spans.shared_lengths({"x": left.limit(0)}).count() == 0
    full = shared_spans.shared_lengths({"x": left, "y": right}, width=1 << 3, filter_width=1)  # a full sketch, and the exact join
    assert {(r.tbl, r.rec_key): r.shared_length for r in full.collect()} == got


def test_term_counts(spark):
    rng = random.Random(6)
    terms = ["hot"] * 300 + [rng.choice(["ab", "abc", "b"]) + str(rng.randrange(400)) for _ in range(700)] + [None, "", "hot" + "x" * 5000]
    df = spark.createDataFrame([(t, i % 3 or None, "k") for i, t in enumerate(terms)], "t string, n long, term string")
    want = {}
    for i, t in enumerate(terms):
        if t:
            r, s = want.get(t, (0, 0))
            want[t] = (r + 1, s + (i % 3))
    for route_rows in (200_000, 20):  # without and with adaptive routes
        got = {r.term: (r.records, r.total) for r in term_counts.count_terms(df.repartition(5), {"f": F.col("t")}, F.col("n"), route_rows=route_rows).collect()}
        assert got == want
    marks = {r.term: r.mark for r in term_counts.mark_terms(term_counts.count_terms(df, {"f": F.col("t")}, F.col("n")), 0.05, 3, 2).collect()}
    assert marks["hot"] == "common" and marks["hot" + "x" * 5000] == "rare"
    assert term_counts.count_terms(df.limit(0), {"f": F.col("t")}).count() == 0


def test_burst_trie_bursts():
    trie = term_counts.BurstTrie(capacity=4)
    words = ["a", "ab", "abc", "abcd", "abd", "b", "ba", "", "abcde", "a"]
    for w in words:
        trie.add(w, 1, 2)
    assert [(t, c) for t, c in trie.items()] == sorted((w, [words.count(w), 2 * words.count(w)]) for w in set(words))


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = {1: f"intro <b>{item.title()}</b> end", 2: item.replace("seven", "x"), 3: "a " + " ".join(item.split()[1:]), 4: "Short &amp; sweet: alpha,beta", 5: "alpha gamma beta", 6: None, 7: "", 8: "x " * 20_000 + item}
    items = {1: item, 2: "alpha beta", 3: "", 4: None, 5: "??"}
    d = spark.createDataFrame([(k, t, "z") for k, t in docs.items()], "doc_id long, text string, fp string")
    i = spark.createDataFrame([(k, t, "z") for k, t in items.items()], "item_id long, text string, fp string")
    for most in (1_000_000, 1):  # broadcast and shuffled
        assert sorted(map(tuple, leaks.leaked(d, i, broadcast_rows=most).collect())) == [(1, 1), (3, 1), (4, 2), (8, 1)]
    assert leaks.leaked(d.limit(0), i).count() == 0 and leaks.leaked(d, i.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(n, " ".join(rng.choices(["pump", "valve", "chain"], k=rng.randint(5, 40))), s) for n, s in enumerate(rng.choices(["A ", "a", "b", None, "other"], k=3000))]
    d = spark.createDataFrame([*docs, (9001, None, "a"), (9002, "", "b")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 3), ("c", 0.1, 4)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(d, t).collect()
    caps = {"a": 2, "b": 3}
    assert all(1 <= r.copy_no <= caps[r.source] for r in rows) and [r.order_key for r in rows] == sorted(r.order_key for r in rows)
    s = {r.source: r for r in mixing.shares(d, t).collect()}
    assert not s["c"].reached and s["c"].tokens_used == 0
    # the missing source's share goes to the others in proportion, so none has its own
    assert abs(s["a"].actual_share - 1 / 3) < 0.02 and abs(s["b"].planned_share - 2 / 3) < 1e-9 and not s["a"].reached
    assert abs(s["a"].planned_total - s["a"].actual_total) < 0.03 * s["a"].planned_total
    both = mixing.shares(d, t.where("source <> 'c'").withColumn("target_share", F.col("target_share") / 0.9), budget=40_000).collect()
    assert all(r.reached and abs(r.actual_share - r.target_share) <= 0.01 for r in both)
    assert mixing.wanted_tokens([0.5, 0.3, 0.2], [10, 1000, 1000], 100) == [10, 54, 36]
    assert mixing.wanted_tokens([0.5, 0.3, 0.2], [10, 20, 30], 100) == [10, 20, 30]
    assert s["a"].copies == sum(r.source == "a" for r in rows)
    for rate, cap in ((0.2, 1), (0.9, 2), (1.7, 2), (3.9, 4), (600, 1000), (999.5, 1000)):
        assert abs(mixing.cut_mean(mixing.poisson_mean(rate, cap), cap) - rate) < 1e-6
    assert mixing.mixture(d.limit(0), t).count() == 0


def test_truncation(spark):
    rng = random.Random(9)
    subjects, verbs, ends = ["The pump", "My valve", "That chain"], ["was noisy", "feels old", "never worked"], ["this morning", "after lunch", "on Tuesday"]

    def text():
        s = " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(ends)}." for _ in range(rng.randint(2, 9)))
        return s + rng.choice(["", "", " thanks in advance", "\n\n-- \nuser12", " http://a.example/b/12", " :-)"])

    rows, cut = [], set()
    for i in range(1500):
        t = text()
        if i % 10 == 0:
            c = truncation.cut_at(t, rng.random())
            if c:
                t = c
                cut.add(i)
        rows.append((i, rng.choice(["A", "a ", None]), t))
    d = spark.createDataFrame([*rows, (9001, "a", None), (9002, "a", ""), (9003, "a", "   "), (9004, "a", "?"), (9005, "a", "word " * 50_000 + "end.")], "doc_id long, source string, text string")
    found = {r.doc_id for r in truncation.truncated(d).collect()}
    hits = len(found & cut)
    assert hits >= 0.85 * len(cut) and hits >= 0.85 * len(found)
    assert truncation.truncated(d.limit(0)).count() == 0


def test_truncation_report_and_limits(spark):
    """A source whose field holds 60 characters, and one that doesn't cut."""
    rng = random.Random(21)
    nouns, verbs = ["pump", "valve", "chain", "hinge", "server", "kettle", "ladder"], ["was noisy", "feels old", "never worked", "needs oil", "fell down"]

    def text():
        return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} after {' '.join(rng.choices(nouns, k=rng.randint(1, 9)))} number {rng.randint(2, 90)} arrived." for _ in range(rng.randint(1, 4)))

    rows = []
    for i in range(2400):
        t = text()
        rows.append((i, "wide", t) if i % 3 else (i, "Narrow ", t[:60]))
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    limits = {(r.source_key, r.n) for r in truncation.field_limits(d.select(F.lower(F.trim("source")).alias("source_key"), F.length("text").alias("n"), "text")).collect()}
    assert ("narrow", 60) in limits and not any(s == "wide" for s, _ in limits)
    rates = {r.source_key: r for r in truncation.truncation_rates(d).collect()}
    cut = sum(s == "Narrow " and not t.endswith(".") for _, s, t in rows)
    assert abs(rates["narrow"].n_cut - cut) <= 0.05 * cut and rates["wide"].n_cut <= 0.02 * rates["wide"].n_docs
    report = truncation.truncation_report(d).first()
    assert report.precision > 0.9 and report.recall > 0.9


def test_word_runs_by_brute_force():
    texts = ["One two three. Four five\nsix one two three.", "one two", "", "Hi, one two x"]
    runs = truncation.Runs(*[x for i, x in enumerate(truncation.run_counts(texts, truncation._Vocabulary())) if i < 2])
    h = lambda *w: truncation._run_keys(*(truncation.np.array([truncation._hash(x) if x else 0], truncation.np.uint64) for x in (w + ("", "", ""))[:3]))
    assert runs(h("two", "one")[1])[0] == 3 and runs(h("three", "two", "one")[2])[0] == 2 and runs(h("six", "five")[1])[0] == 0
    assert runs(h("one")[0])[0] == 4 and runs(h("x")[0])[0] == 0 and runs(h("five", "four")[1])[0] == 1
