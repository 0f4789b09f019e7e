import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import neardup, shingles


def grams(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def test_shingles_are_those_of_the_words():
    rnd = random.Random(1)
    texts = ["", " ", "a b c", "a b c d e", "a  b\tc\nd e f\r\n", "é ü 日本 x y z é ü 日本 x y"] + [" ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 30))) + rnd.choice(["", " "]) for _ in range(200)]
    names = {}
    for span, words in shingles.parts(pa.array(texts)):
        t, h, n = shingles.counted(*words.shingles(5))
        for i, text in enumerate(texts[span]):
            want = grams(text)
            assert sorted(n[t == i].tolist()) == sorted(want.values()), text
        one, two = words.digests()
        for i, text in enumerate(texts[span]):
            assert names.setdefault((one[i], two[i]), text.split()) == text.split()
        assert len({(a, b) for a, b in zip(one, two)}) == len({tuple(x.split()) for x in texts})
    whole = {g for x in texts for g in grams(x)}
    hashes = {h for _, w in shingles.parts(pa.array(texts)) for h in w.shingles(5)[1].tolist()}
    assert len(whole) == len(hashes)


@pytest.mark.parametrize("shared", [20, 60, 90])
def test_samples_agree_with_the_weighted_similarity(shared):
    rnd = np.random.default_rng(shared)
    h = rnd.integers(0, 2**63, 140).astype(np.uint64)
    w = rnd.uniform(0.5, 3, 140)
    a, b = np.sort(h[:100]), np.sort(h[100 - shared : 200 - shared])
    weight = dict(zip(h.tolist(), w))
    wa, wb = np.array([weight[x] for x in a.tolist()]), np.array([weight[x] * (1.3 if i % 3 else 1) for i, x in enumerate(b.tolist())])
    s = neardup.samples(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 4000)
    assert abs((s[0] == s[1]).mean() - neardup.similarity((a, wa), (b, wb))) < 0.03


def brute(rows, threshold=0.8):
    n = len(rows)
    total = Counter()
    df = np.zeros(neardup.BUCKETS, dtype=np.int64)
    sets = []
    for span, words in shingles.parts(pa.array([t or "" for _, t in rows])):
        t, h, times = shingles.counted(*words.shingles(5))
        t = t + span.start
        sets.append((t, h, times))
    t, h, times = (np.concatenate(x) for x in zip(*sets))
    df += np.bincount((h >> np.uint64(20)).astype(np.int64) % neardup.BUCKETS, minlength=neardup.BUCKETS)
    idf = neardup.weights_of(df, n)
    w = (1 + np.log(times)) * idf[(h >> np.uint64(20)).astype(np.int64) % neardup.BUCKETS]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            same = (rows[i][1] or "").split() == (rows[j][1] or "").split()
            a, b = (h[t == i], w[t == i]), (h[t == j], w[t == j])
            if same or (len(a[0]) and len(b[0]) and neardup.similarity(a, b) >= threshold):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(120)] for _ in range(8)]
    rows = []
    for b in base:
        for _ in range(6):
            words = list(b)
            for _ in range(rnd.choice([0, 0, 1, 1, 12])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [base[0][0] + " short", "", "  ", None, rows[0], rows[0].replace(" ", "\n")]
    rnd.shuffle(rows)
    rows = [(10 * i + 3, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, class string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == brute(rows)
    kept = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert kept == set(brute(rows).values())


def test_large_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ALL_PAIRS", 6)
    rnd = random.Random(7)
    words = [f"w{rnd.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(150):
        own = list(words)
        own[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(500 + i, words[0] + " " + " ".join(f"q{i}{k}" for k in range(50))) for i in range(20)]
    rows += [(None, "a b c"), (0, rows[0][1]), (900, "twice"), (900, "or not")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in neardup.classes(df).collect():
        got[r.class_id].add(r.doc_id)
    assert got[0] == set(range(150)) and all(got[500 + i] == {500 + i} for i in range(20)) and got[900] == {900} and got[None] == {None}
    assert neardup.classes(df.filter("false")).count() == 0
    assert neardup.keep_one(df).filter("doc_id = 0").count() == 1


@pytest.mark.parametrize("limit", [4, 64])
def test_large_buckets_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "ALL_PAIRS", limit)
    rnd = random.Random(11)
    new = iter(range(10**6))
    centre = [f"w{rnd.randrange(10**6)}" for _ in range(304)]

    def altered(words, *places):
        """Words replaced so far apart that each takes five shingles."""
        return [f"n{next(new)}" if i in places else w for i, w in enumerate(words)]

    rows = [altered(centre, rnd.randrange(280)) for _ in range(90)]
    for _ in range(12):
        inner = centre[: rnd.randrange(283, 287)]  # linked to the centre
        outer = altered(inner, 5, 65, 125)  # linked to the inner one only, at 0.9 of it
        rows += [inner, outer, altered(outer, *rnd.sample(range(10, 260, 6), 2))]
    pair = [altered(centre, *range(4, 100, 12)) for _ in range(2)]
    for p in pair:
        rows += [altered(p, 150), altered(p, 180), altered(p, 150, 180, 210)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == brute(rows)


def test_blocks_agree_with_the_weighted_similarity():
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(40)}" for _ in range(120)]
    texts = [" ".join(words[rnd.randrange(30) : rnd.randrange(60, 120)] * rnd.choice([1, 1, 3])) for _ in range(40)] + ["a", "é ü"]
    idf = np.linspace(1, 1.1, 1000).astype(np.float32)
    sets = []
    for text in texts:
        (_, one), = shingles.parts(pa.array([text]))
        sets.append(neardup._weighted(one, idf, 5)[1:])
    one, two = neardup.Block(pa.array(texts[:25]), idf, 5), neardup.Block(pa.array(texts), idf, 5)
    want = np.array([[neardup.similarity(a, b) for b in sets] for a in sets[:25]])
    shared = one.shared(two, 7)
    assert np.abs(shared / (one.total[:, None] + two.total - shared) - want).max() < 1e-5
    for threshold in (0.8, float(want[0, 1]), float(want[3, 9])):
        assert (one.linked(two, threshold) == (want >= threshold - 1e-6)).all()


def own_classes(rows, threshold=0.8, size=5):
    """Classes by plain dictionaries: own shingles, document frequencies and weighted Jaccard, all pairs. Also the least distance of any pair from the threshold."""
    sets = [grams(t or "", size) for _, t in rows]
    df = Counter(g for s in sets for g in s)
    n = len(rows)
    idf = {g: 1 + neardup.SPREAD * math.log(n / c) / math.log(n + 2) for g, c in df.items()}
    weighed = [{g: (1 + math.log(c)) * idf[g] for g, c in s.items()} for s in sets]
    total = [sum(w.values()) for w in weighed]
    parent, margin, linked = list(range(n)), 1.0, set()

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = sum(min(w, weighed[j][g]) for g, w in weighed[i].items() if g in weighed[j])
            near = both / (total[i] + total[j] - both) if total[i] + total[j] else 1.0
            margin = min(margin, abs(near - threshold))
            if near >= threshold:
                linked.add((j, i))
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    return {d: min(g) for g in groups.values() for d in g}, margin, linked


@pytest.mark.parametrize("changed", [1, 3])
def test_chains_in_a_large_group(spark, changed):
    """400 copies of a text with one word changed, and 60 chains text - M - P in which P is linked to M alone."""
    rnd, new = random.Random(11), iter(range(10**6))
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]

    def altered(words, *places):
        return [f"n{next(new)}" if i in places else w for i, w in enumerate(words)]

    rows = [altered(base, rnd.randrange(200)) for _ in range(400)]
    for _ in range(60):
        spots = rnd.sample(range(3, 197, 6), changed + 4)
        m = altered(base, *spots[:changed])
        rows += [m, altered(m, *spots[changed:])]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want, _, _ = own_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = sum(got[401 + 2 * k] == got[400 + 2 * k] for k in range(60) if want[401 + 2 * k] == want[400 + 2 * k])
    assert got == want or (same >= 58 and sum(got[d] != c for d, c in want.items()) <= 3), same


@pytest.mark.parametrize("crowd", [2, 64])
def test_many_kinds_of_edits_in_one_group(spark, monkeypatch, crowd):
    """Typos, cut ends, added passages and shared passages, around a text that isn't there itself."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rnd, new = random.Random(5), iter(range(10**6))
    base = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
    shared = [[f"s{k}x{i}" for i in range(20)] for k in range(4)]
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = f"n{next(new)}"
        if i % 4 == 1:
            w = w[: rnd.randrange(100, 160)]
        if i % 4 == 2:
            w += shared[rnd.randrange(4)][: rnd.randrange(5, 20)]
        if i % 4 == 3:
            at = rnd.randrange(100)
            w = w[:at] + w[at + rnd.randrange(5, 40) :]
        rows.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(rows)]
    want, _, linked = own_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = sum(got[a] == got[b] for a, b in linked)
    assert all(want[d] == want[c] for d, c in got.items()) and joined >= 0.998 * len(linked), (joined, len(linked))


def test_ids_with_two_texts_tie_them(spark):
    rnd = random.Random(2)
    text = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(20):
        one, two = text(), text()
        rows += [(i, " ".join(one)), (i, " ".join(two)), (100 + i, " ".join(one[:60] + ["new"] + one[61:])), (200 + i, " ".join(two[:60] + ["new"] + two[61:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in neardup.classes(df).collect():
        got[r.class_id].add(r.doc_id)
    assert got == {i: {i, 100 + i, 200 + i} for i in range(20)}
    kept = sorted((r.doc_id, r.text) for r in neardup.keep_one(df.repartition(3)).collect())
    assert kept == [(i, min(t for d, t in rows if d == i)) for i in range(20)]


def test_what_a_text_has_beyond_the_pivot_bounds_its_links():
    rnd = np.random.default_rng(3)
    idf, threshold = np.linspace(1, 1.1, 64).astype(np.float32), 0.8
    names = np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))

    def drawn(base, most):
        keep = dict(base)
        for h in rnd.choice(names, rnd.integers(0, most), replace=False).tolist():
            keep.pop(h, None)
        for h in rnd.choice(names, rnd.integers(0, most), replace=False).tolist():
            keep[h] = float(rnd.choice([1.0, 1.05, 1.7]))
        at = sorted(keep)
        return keep, (np.array(at, dtype=np.uint64), np.array([keep[h] for h in at], dtype=np.float32))

    checked = 0
    for _ in range(1500):
        held, pivot = drawn({h: 1.0 for h in names[:150].tolist()}, 30)
        own, x = drawn(held, 40)
        _, y = drawn(own, 20)
        if neardup.similarity(x, pivot) >= threshold or neardup.similarity(x, y) < threshold:
            continue
        _, reach, keys, ask = neardup.beyond(x, pivot, idf, threshold)
        lighter, _, index, _ = neardup.beyond(y, pivot, idf, threshold)
        assert lighter > reach or set(keys[:ask].tolist()) & set(index.tolist())
        checked += 1
    assert checked > 30
