"""Invariants and cases worked out by hand."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.components import components
from tidemark.operators import graph, mining, ml, relational, similarity, sketches
from tidemark.sources import generate


def names(spark, items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "id long, item string")


def test_bloom_has_no_false_negatives(spark):
    bits, hashes = sketches.bloom_size(1000, 0.01)
    assert (bits, hashes) == (9585, 6)
    df = names(spark, [f"192.168.1.{i}" for i in range(500)])
    got = sketches.bloom_probe(df.withColumn("item", F.concat(F.lit(" "), "item")), "item", sketches.bloom_build(df, "item", bits, hashes), bits, hashes)
    assert got.filter("maybe").count() == 500


def test_bloom_false_positives(spark):
    bits, hashes = sketches.bloom_size(2000, 0.05)
    built = sketches.bloom_build(names(spark, [f"malicious_{i}" for i in range(1000)]), "item", bits, hashes)
    assert sketches.bloom_probe(names(spark, [f"clean_{i}" for i in range(2000)]), "item", built, bits, hashes).filter("maybe").count() < 200
    assert sketches.bloom_rate(bits, hashes, 0) == 0.0 and 0 < sketches.bloom_rate(bits, hashes, 1000) < 0.05
    assert sketches.bloom_size(0, 2) == sketches.bloom_size(1000, 0.01)


@pytest.mark.parametrize("seed", range(20))
def test_dgim_within_half(seed):
    rnd = random.Random(seed)
    window, p = rnd.choice([1, 2, 10, 100, 500]), rnd.choice([0.02, 0.35, 0.9])
    d, bits = sketches.Dgim(window), []
    for _ in range(1500):
        bits.append(int(rnd.random() < p))
        d.update(bits[-1])
        true = sum(bits[-window:])
        assert abs(d.count() - true) <= 0.5 * true
    assert all(n <= 2 for n in d.distribution().values())


def test_dgim_by_hand():
    d = sketches.Dgim(10)
    for b in [1] * 7 + [0] * 4:
        d.update(b)
    assert abs(d.count() - 6) <= 3
    one = sketches.Dgim(10)
    one.update(1)
    assert one.count() == 1


def test_fm_in_range(spark):
    """A mean of powers of two has a heavy tail: single estimates are within a factor of 16, their median within 4."""
    got = []
    for prefix in ("source-", "h", "visitor ", "k", "node:"):
        df = names(spark, [f"{prefix}{i % 2000}" for i in range(4000)])
        got.append(sketches.fm_estimate(sketches.fm_registers(df, "item")).first().estimate)
    assert all(2000 / 4 < x < 2000 * 16 for x in got) and 2000 / 4 < sorted(got)[2] < 2000 * 4, got
    assert sketches.fm_registers(names(spark, [None]).filter("item IS NOT NULL"), "item").count() == 0


def test_murmur3_of_known_texts(spark):
    known = {("", 0): 0, ("", 1): 0x514E28B7, ("hello", 0): 0x248BFA47, ("hello, world", 0): 0x149BBB7F, ("The quick brown fox jumps over the lazy dog", 0): 0x2E4FF723}
    for (text, seed), want in known.items():
        row = spark.createDataFrame([(text, None)], "t string, u string").select(hashing.murmur3_32(seed, F.col("t")).alias("h"), hashing.murmur3_32(seed, F.col("u")).alias("n"), hashing.seeded(seed, F.col("t"), 1000).alias("b")).first()
        assert (row.h, row.n, row.b) == (want, None, want % 1000)


def test_hashes_of_a_digest(spark):
    row = spark.range(1).select(*(hashing.h32(s, F.lit("x")).alias(f"h{s}") for s in range(6)), hashing.digests(F.lit("x"), 6).alias("d")).first()
    for s in range(6):
        assert row[f"h{s}"] == int(hashlib.md5(f"{s // 4}:x".encode()).hexdigest()[8 * (s % 4) :][:8], 16)
    assert len(row.d) == 2


def test_cms_never_below(spark):
    true = {"a": 700, "b": 1500, "c": 2600, "d": 90}
    df = names(spark, [k for k, n in true.items() for _ in range(n)])
    w, depth = sketches.cms_size()
    half = sketches.cms_build(df.filter("id % 2 = 0"), "item", w, depth), sketches.cms_build(df.filter("id % 2 = 1"), "item", w, depth)
    got = {r["item"]: r.estimate for r in sketches.cms_query(df, "item", sketches.cms_merge(*half), w, depth).collect()}
    assert all(got[k] >= n for k, n in true.items())
    assert [r["item"] for r in sketches.cms_top_k(df, "item", sketches.cms_build(df, "item", w, depth), w, depth, 2).collect()] == ["c", "b"]


def test_reservoir(spark):
    df = names(spark, [f"row {i}" for i in range(500)])
    assert sketches.reservoir(df, "id", 50).count() == 50 and sketches.reservoir(df, "id", 900).count() == 500


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_exact_window(spark, block):
    rnd = random.Random(3)
    bits = [rnd.randint(0, 1) for _ in range(300)]
    df = spark.createDataFrame([(7 * i - 40, b) for i, b in enumerate(bits)], "o long, b int")
    got = {r.ord: (r.pos, r.ones) for r in sketches.running_ones(df, "o", "b", block).collect()}
    assert got == {7 * i - 40: (i + 1, sum(bits[: i + 1])) for i in range(300)}
    if block == 4096:
        window = {r.ord: r.ones_in_window for r in sketches.exact_window(df, "o", "b", 25).collect()}
        assert window == {7 * i - 40: sum(bits[max(0, i - 24) : i + 1]) for i in range(300)}
        assert sketches.exact_window(df.filter("false"), "o", "b", 25).count() == 0


def test_near_duplicate_urls(spark):
    urls = ["http://bad.example/login/index.php?id=1", "http://bad.example/login/index.php?id=2", "https://news.other.org/story"]
    signed = similarity.signatures(names(spark, urls), "id", "item", hashes=32)
    got = {r.matched_id for r in similarity.query(signed, F.lit(urls[0]), bands=8, rows=4, threshold=0.5).collect()}
    assert got == {0, 1}


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([("",), ("ab",), (" ABC ",)], "t string").select(similarity.shingles(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [[""], ["ab"], ["abc"]]
    one = spark.range(1).select(similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("a"), similarity.jaccard(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))).alias("b")).first()
    assert (one.a, one.b) == (1.0, 0.5)


@pytest.mark.parametrize("seed", range(2))
def test_star_clusters_follow_the_scan(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({tuple(sorted(rnd.sample(range(30), 2))) for _ in range(35)})
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(30)}
    seen, want = set(), set()
    for i in range(30):
        if i not in seen:
            seen |= {i} | near[i]
            want |= {(i, i)} | {(i, j) for j in near[i]}
    got = similarity.star_clusters(spark.range(30), spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want


def test_tags_at_the_bounds(spark):
    def of(port=0, hour=12, packets=10, syn=0, length=100, label="BENIGN"):
        return [F.lit(x).cast(t) for x, t in ((port, "long"), (hour, "long"), (packets, "long"), (syn, "long"), (length, "double"), (label, "string"))]

    def tags(**k):
        return spark.range(1).select(mining.tags(*of(**k)).alias("t")).first().t

    assert [tags(hour=h)[1].removeprefix("time_") for h in (5, 6, 8, 9, 17, 18, 22, 23)] == ["late_night", "evening", "evening", "business_hours", "business_hours", "evening", "evening", "late_night"]
    assert [tags(packets=n)[2].removeprefix("volume_") for n in (3, 4, 100, 101)] == ["micro_probe", "moderate", "moderate", "massive_flood"]
    assert [[t for t in tags(length=n) if t.startswith("payload")] for n in (59, 60, 500, 501)] == [["payload_tiny_header_only"], [], [], ["payload_large_data"]]
    assert tags(port=None, hour=None, packets=None, syn=None, length=None, label=None) == ["port_ephemeral", "time_business_hours", "volume_micro_probe", "payload_tiny_header_only", "TARGET_BENIGN"]


def test_itemsets_and_rules(spark):
    baskets = [["a", "b", "TARGET_x"], ["a", "TARGET_x"], ["a", "c", "TARGET_y"], ["b", "c", "a", "TARGET_x"], ["c", None, "c"]]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    sets = mining.itemsets(df, "items", 0.2)
    want = Counter()
    for b in baskets:
        u = sorted({x for x in b if x})
        want.update(c for k in (1, 2, 3) for c in itertools.combinations(u, k))
    assert {tuple(r["items"]): r.cnt for r in sets.collect()} == dict(want)
    found = mining.rules(sets, 0.5).collect()
    assert found and all(0 <= r.support <= 1 and 0.5 <= r.confidence <= 1 and r.lift > 0 and r.plain_english for r in found)
    best = next(r for r in found if r.antecedent == ["b"] and r.consequent == "TARGET_x")
    assert (best.support, best.confidence, best.lift) == (0.4, 1.0, 1.67)


def test_pagerank_with_a_dangling_node(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    got = {r.node: r.pagerank for r in graph.pagerank(edges).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["b"] > got["a"]
    nodes, alpha = ["a", "b"], 0.85
    p = np.array([0.5, 0.5])
    for _ in range(200):
        p = (1 - alpha) / 2 + alpha * (np.array([0, p[0]]) + p[1] / 2)
    assert all(abs(got[n] - x) < 1e-5 for n, x in zip(nodes, p))


def test_merged_edges_keep_the_last(spark):
    one = spark.createDataFrame([("a", "b", 1.0), ("a", None, 1.0)], "src string, dst string, weight double")
    two = spark.createDataFrame([("a", "b", 2.0)], "src string, dst string, weight double")
    assert [tuple(r) for r in graph.merged_edges(one, two).collect()] == [("a", "b", 2.0)]


@pytest.mark.parametrize("seed, d, crowd", [(0, 3, 25), (1, 3, 25), (2, 2, 120), (3, 1, 60), (4, 2, 40), (5, 4, 25)])
def test_dbscan_against_brute_force(spark, seed, d, crowd):
    rnd = np.random.default_rng(seed)
    x = np.vstack([rnd.normal(c[:d], 0.6, (crowd, d)) for c in ((0, 0, 0, 0), (5, 5, 0, 0), (0, 6, 3, 0))] + [rnd.uniform(-9, 9, (20, d))])
    x = np.vstack([x, x[:5]])  # some points come again
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *"abcd"[:d]])
    eps, least = 1.2, 5
    near = [np.flatnonzero(((x - r) ** 2).sum(axis=1) <= eps * eps).tolist() for r in x]
    core = [len(n) >= least for n in near]
    want, number = [-1] * len(x), 0
    for i in range(len(x)):
        if core[i] and want[i] == -1:
            todo, want[i] = [i], number
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and want[j] == -1:
                        want[j] = number
                        todo.append(j)
            number += 1
    for i in range(len(x)):
        if not core[i]:
            want[i] = min([want[j] for j in near[i] if core[j]], default=-1)
    assert {r.id: r.cluster for r in ml.dbscan(df, "id", list("abcd"[:d]), eps, least).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1000), 300)
    edges = [(a, b) for a, b in zip(ids[:120], ids[1:121])]  # a long path in random order
    edges += [(ids[200], x) for x in ids[201:230]] + [tuple(rnd.sample(ids[120:200], 2)) for _ in range(50)] + [(ids[299], ids[299])]
    rnd.shuffle(edges)
    parent = {i: i for e in edges for i in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(7 * i % 101,) for i in range(101)], "v long").repartition(5)
    assert sorted(map(tuple, ml.numbered(df, "v").collect())) == [(i, i) for i in range(101)]
    assert ml.numbered(df.filter("false"), "v").count() == 0


def test_silhouette_by_hand():
    x = np.array([[0.0], [1.0], [5.0], [7.0]])
    want = np.mean([(5.5 + 0.5 - 1) / 6, (5 - 1) / 5, (4.5 - 2) / 4.5, (6.5 - 2) / 6.5])
    assert abs(ml.silhouette(x, np.array([3, 3, 9, 9])) - want) < 1e-12
    assert ml.silhouette(x, np.zeros(4)) == 0.0


def test_isolation_forest_finds_the_outlier(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, *map(float, r)) for i, r in enumerate(rnd.normal(0, 1, (400, 2)))] + [(400, 30.0, 30.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = ml.anomalies(df, ["x", "y"], "id", contamination=0.05)
    worst = got.orderBy("anomaly_score").first()
    assert worst.id == 400 and worst.anomaly_label == -1
    assert 5 <= got.filter("is_anomaly = 1").count() <= 30


def test_pca_against_numpy(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(0, 1, (300, 4)) @ rnd.normal(0, 1, (4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    got, share = ml.pca(df, ["a", "b", "c", "d"], ["id"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    want = np.abs(z @ vectors[:, ::-1][:, :2])
    rows = np.array([(r.pca_1, r.pca_2) for r in got.orderBy("id").collect()])
    assert np.allclose(np.abs(rows), want, atol=2e-3) and np.allclose(share, 100 * values[::-1][:2] / values.sum(), atol=0.1)


def test_kmeans_and_profiles(spark):
    flows = generate.flow_rows(spark, 600)
    out, k, score = ml.kmeans_search(flows, ["Flow_Duration", "Total_Fwd_Packets", "Packet_Length_Mean"], (3, 4), restarts=1)
    got = ml.cluster_profiles(out).collect()
    assert len(got) == k and score[k] == max(score.values()) > 0 and sum(r.size for r in got) == 600 and abs(sum(r.pct_total for r in got) - 100) < 1


def test_generators(spark):
    rows = generate.indicator_rows(spark)
    assert {r.ioc_type: r["count"] for r in rows.groupBy("ioc_type").count().collect()} == {"ip:port": 240, "url": 800, "cve": 7, "ip": 690}
    flows = generate.flow_rows(spark, 4000, spark.createDataFrame([("1.2.3.4",)], "ip string"))
    share = {r.Label: r["count"] / 4000 for r in flows.groupBy("Label").count().collect()}
    assert all(abs(share[p[0]] - p[1]) < 0.04 for p in generate.PROFILES)
    attacks = flows.filter("is_attack = 1")
    assert 0.28 < attacks.filter("Src_IP = '1.2.3.4'").count() / attacks.count() < 0.42


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, " a "), (2, "b"), (3, None)], "id long, k string")
    listed = spark.createDataFrame([("a ",), (None,)], "ip string")
    assert [r.id for r in relational.semi_matches(df, "k", listed, "ip").collect()] == [1]
    assert sorted(r.id for r in relational.semi_matches(df, "k", listed, "ip", anti=True).collect()) == [2, 3]
    assert relational.filled(df, {"k": "-"}).filter("id = 3").first().k == "-"
    assert [r.id for r in relational.last_rows(df, "id", 2).collect()] == [2, 3]
    assert [c for c in relational.normalised_names(df.toDF("Flow Bytes/s", " x ")).columns] == ["Flow_Bytes_s", "x"]


def test_places_stay_and_guards(spark):
    geo = spark.createDataFrame([(0, "A", "AA", 10.0, 20.0, "x"), (1, "B", "BB", -10.0, 0.0, "y")], "geo_id long, Country string, Country_Code string, base_lat double, base_lon double, ASN string")
    df = spark.createDataFrame([(i, "p" if i % 2 else "q") for i in range(40)] + [(99, "none"), (None, "p")], "id long, label string")
    got = {r.id: r for r in relational.geo_enriched(df, "id", "label", geo, {"p": [0], "q": [0, 1]}).collect()}
    assert len(got) == 42 and got[99].Country is None and {got[i].Country for i in range(0, 40, 2)} == {"A", "B"} and {got[i].Country for i in range(1, 40, 2)} == {"A"}
    assert all(abs(got[i].Latitude - 10) <= 1.5 and abs(got[i].Longitude - 20) <= 1.5 for i in range(1, 40, 2))
    assert relational.has(df, "id", "label") and not relational.has(df, "id", "other")


def test_a_large_filter_is_joined(spark, monkeypatch):
    df = names(spark, ["a", "b ", " c", "d", None])
    built = sketches.bloom_build(df.filter("id < 2"), "item", 512, 4)
    one = sorted(map(tuple, sketches.bloom_probe(df, "item", built, 512, 4).collect()))
    monkeypatch.setattr(sketches, "SENT_BITS", 64)
    assert one == sorted(map(tuple, sketches.bloom_probe(df, "item", built, 512, 4).collect())) and dict(one)["a"] and dict(one)["b "]


def test_threat_graph_by_hand(spark):
    i = spark.createDataFrame([(1, "1.1.1.1:80", "fam", "1.1.1.1"), (2, "http://x.example/a/b", "fam", "2.2.2.2"), (3, "http://y", "", "3.3.3.3"), (4, "CVE-1", "flaw", ""), (5, "a/b", None, None)], "ioc_id long, ioc_value string, malware_family string, ip_address string")
    f = spark.createDataFrame([(1, "2.2.2.2", "9.9.9.9", 22, "Botnet", 1), (2, "2.2.2.2", "9.9.9.9", 22, "DDoS", 1), (3, "1.1.1.1", "9.9.9.9", 22, "BENIGN", 0)], "row_id long, Src_IP string, Dst_IP string, Dst_Port long, Label string, is_attack long")
    e = graph.threat_edges(i, f)
    assert {tuple(r) for r in e.collect()} == {
        ("IP: 1.1.1.1", "Family: fam", "belongs_to_family", 1.5), ("IP: 2.2.2.2", "Family: fam", "belongs_to_family", 1.5), ("Domain: x.example", "Family: fam", "delivers_malware", 2.0),
        ("Domain: x.example", "IP: 2.2.2.2", "resolves_to", 1.2), ("Domain: a/b", "Family: Unknown", "delivers_malware", 2.0), ("IP: 2.2.2.2", "Target: 9.9.9.9:22", "attacks_via_DDoS", 1.0),
    }
    kinds = {r.node: r.type for r in graph.threat_kinds(e).collect()}
    assert kinds["IP: 2.2.2.2"] == "attacker_ip" and kinds["IP: 1.1.1.1"] == "c2_ip" and kinds["Target: 9.9.9.9:22"] == "victim_asset"
