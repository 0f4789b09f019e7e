"""Near-duplicate links and clusters against brute force, with buckets of several slices and tiles."""

import hashlib
import random

import pyarrow as pa
import pytest

from tidemark.operators import similarity


def urls(seed, n=260):
    """One large host, small ones, copies of shingle sets, odd rows."""
    rnd = random.Random(seed)
    hosts = ["tionsh.example.net"] * 6 + [f"m.th{rnd.choice('abcdef')}n.example.org" for _ in range(4)]
    out = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de'])}/{rnd.randint(1, 99999)}{rnd.choice(['', '#top', '?page=2&ref=x', '.html'])}" for _ in range(n)]
    return out + [out[3], out[5].upper(), "", " ", "ab", None, None, "é" * 9]


def brute(texts, hashes=48, bands=12, threshold=0.55):
    """rep of each row, and links {(a, b): (exact, estimated)} of the representatives."""
    sets = []
    for t in texts:
        t = (t or "").strip().lower()
        sets.append(frozenset([t] if len(t) < 3 else (t[i : i + 3] for i in range(len(t) - 2))))
    first = {}
    rep = [first.setdefault(s, i) for i, s in enumerate(sets)]
    digest = {x: b"".join(hashlib.md5(f"{block}:{x}".encode()).digest() for block in range(12)) for s in first for x in s}
    sig = {s: [min(int.from_bytes(digest[x][4 * h : 4 * h + 4], "big") for x in s) for h in range(hashes)] for s in first}
    ids, links = sorted(set(rep)), {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y, u, v = sets[a], sets[b], sig[sets[a]], sig[sets[b]]
            exact = len(x & y) / len(x | y)
            if exact >= threshold and any(u[4 * k : 4 * k + 4] == v[4 * k : 4 * k + 4] for k in range(bands)):
                links[a, b] = (exact, sum(p == q for p, q in zip(u, v)) / hashes)
    return rep, links


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, item string")


@pytest.mark.parametrize("most", [300, 1 << 17])
def test_pairs_like_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "SLICE", most)
    texts = urls(most)
    got = [tuple(r) for r in similarity.pairs(similarity.signatures(table(spark, texts), "id", "item")).collect()]
    want = brute(texts)[1]
    assert len(got) == len(want) > 3000 and {(a, b): (x, y) for a, b, x, y in got} == want


def test_pairs_are_compared_in_tiles(spark):
    plan = similarity.pairs(similarity.signatures(table(spark, urls(1, 20)), "id", "item"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan  # sets aren't joined to sets, pair by pair


@pytest.mark.parametrize("block, small, batch", [(7, 5, 3), (16, 40, 64), (1024, 128, 1000)])
def test_tiles(monkeypatch, block, small, batch):
    """Sides, blocks and batches cut anywhere; a pair in the first band that it shares."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "SMALL", small)
    rnd = random.Random(block)
    rows, want = [], {}
    for tile in range(30):
        band, sides = rnd.randrange(3), rnd.choice([[0], [1, 2]])
        n = rnd.choice([1, 2, 5, 30])
        made = [{"id": 100 * tile + i, "sh": sorted(rnd.sample(range(9), rnd.randint(4, 9))), "sig": [rnd.randint(0, 1) if k // 2 != band else 7 for k in range(6)], "tile": tile, "band": band, "side": rnd.choice(sides)} for i in rnd.sample(range(n), n)]
        made.sort(key=lambda r: r["side"])
        for i, x in enumerate(made):
            for y in made[i + 1 :]:
                whole = [k for k in range(3) if x["sig"][2 * k : 2 * k + 2] == y["sig"][2 * k : 2 * k + 2]]
                exact = len({*x["sh"]} & {*y["sh"]}) / len({*x["sh"]} | {*y["sh"]})
                if whole[0] == band and exact >= 0.6 and (x["side"] == 0 or x["side"] != y["side"]):
                    want[min(x["id"], y["id"]), max(x["id"], y["id"])] = (exact, sum(p == q for p, q in zip(x["sig"], y["sig"])) / 6)
        rows += made
    schema = pa.schema([("id", pa.int64()), ("sh", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64())), ("tile", pa.int64()), ("band", pa.int32()), ("side", pa.int32())])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=batch)
    got = [r for out in similarity._tiles(iter(batches), 2, 0.6) for r in out.to_pylist()]
    assert len(got) == len(want) > 100 and {(r["a"], r["b"]): (r["exact"], r["estimated"]) for r in got} == want


@pytest.mark.parametrize("most", [600, 1 << 22])
def test_clusters_like_the_scan(spark, monkeypatch, most):
    """Rounds of short prefixes, and one of all."""
    monkeypatch.setattr(similarity, "ROUND", most)
    monkeypatch.setattr(similarity, "SHARE", 0)
    monkeypatch.setattr(similarity, "SLICE", 1000)
    texts = urls(most)
    rep, links = brute(texts)
    near = {i: set() for i in rep}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    seen, want = set(), set()
    for i in sorted(near):
        if i not in seen:
            seen |= {i} | near[i]
            want |= {(i, j) for j in {i} | near[i]}
    got = [tuple(r) for r in similarity.clusters(similarity.signatures(table(spark, texts), "id", "item")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(member < seed for seed, member in want)


def test_clusters_make_few_links(spark, monkeypatch):
    """Links of the seeds, not of all: a large group doesn't make its pairs."""
    monkeypatch.setattr(similarity, "ROUND", 200)
    monkeypatch.setattr(similarity, "SHARE", 0)
    settled, write = [], similarity.settle

    def counted(df, label):
        settled.append(write(df, label))
        return settled[-1]

    monkeypatch.setattr(similarity, "settle", counted)
    sizes = []
    monkeypatch.setattr(similarity, "discard", lambda t: sizes.append(t.count()) if t is not None else None)
    signed = similarity.signatures(table(spark, urls(7)), "id", "item")
    similarity.clusters(signed).count()
    assert max(sizes) < similarity.pairs(signed).count() / 4


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, item string")
    signed = similarity.signatures(empty, "id", "item")
    assert similarity.clusters(signed).count() == similarity.pairs(signed).count() == similarity.members(signed).count() == 0
