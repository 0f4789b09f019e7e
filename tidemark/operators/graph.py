"""Property graphs as edge and vertex tables; weighted PageRank as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import discard, settle


def merged_edges(*parts: DataFrame) -> DataFrame:
    """src, dst, weight of all parts; of equal edges the one of the last part stays."""
    out = None
    for i, p in enumerate(parts):
        p = p.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src IS NOT NULL AND dst IS NOT NULL").withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("src", "dst").agg(F.max_by("weight", F.struct("part", "weight")).alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, pagerank. Weights are normalised by source; the rank of nodes without edges out is spread over all.

    Stops when the summed change is below nodes * tolerance. Edges stay dealt out by source, and a round deals the ranks out once for both
    of its joins. All ranks add up to one, so what a round must spread is what its ranks lack: their sum comes with the job that writes
    them, and the share of it is added when they are read. The plan of a round never holds the one before, and a lost executor
    costs one round at most.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("w"))
    shares = settle(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("w")).alias("share")), "shares")
    nodes = settle(vertices(edges), "nodes")
    if not (n := nodes.count()):
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    shares = shares.repartition("src").persist()  # rebuilt from its table, if an executor is lost
    ranks, last = nodes.select("node", F.lit(1.0 / n).alias("pagerank")), None
    for _ in range(iterations):
        given = shares.join(ranks.select(F.col("node").alias("src"), "pagerank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        seen = Observation()
        own = (F.lit((1 - alpha) / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("own")
        step = settle(ranks.join(given, "node", "left").select("node", own, F.col("pagerank").alias("before")).observe(seen, F.sum("own").alias("sum")), "ranks")
        spread = (1 - seen.get["sum"]) / n
        discard(last)
        ranks, last = step.select("node", (F.col("own") + F.lit(spread)).alias("pagerank")), step
        if tolerance and step.agg(F.sum(F.abs(F.col("own") + F.lit(spread) - F.col("before")))).first()[0] < n * tolerance:
            break
    shares.unpersist()
    return ranks


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def top_nodes(ranks: DataFrame, edges: DataFrame, kinds: DataFrame, n: int = 15) -> DataFrame:
    """rank, node, type, pagerank, in_degree, out_degree of the ``n`` first nodes. ``kinds``: node, type."""
    first = ranks.withColumn("pagerank", F.round("pagerank", 8)).orderBy(F.desc("pagerank"), "node").limit(n)
    order = Window.orderBy(F.desc("pagerank"), "node")  # over n rows
    return first.join(kinds, "node", "left").join(degrees(edges), "node", "left").withColumn("rank", F.row_number().over(order)).select("rank", "node", "type", "pagerank", "in_degree", "out_degree")


def export_nodes(ranks: DataFrame, kinds: DataFrame, base: int = 10) -> DataFrame:
    """node, type and a drawing size that grows with the rank."""
    return ranks.join(kinds, "node", "left").select("node", "type", (F.lit(base) + F.round("pagerank", 8) * 300).cast("int").alias("size"))


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``: two semi-joins."""
    n = nodes.select("node")
    return edges.join(n, edges.src == n.node, "left_semi").join(n, edges.dst == n.node, "left_semi")


def placed_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges with the positions (node, x, y) of both ends: two joins."""
    one = positions.select(F.col("node").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    other = positions.select(F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(one, "src").join(other, "dst").select("src", "dst", "x0", "y0", "x1", "y1")


def threat_edges(indicators: DataFrame, flows: DataFrame, order: str = "ioc_id", flow_order: str = "row_id") -> DataFrame:
    """src, dst, relation, weight of an infrastructure graph over all rows: listed address and domain to family, domain to address,
    attacker to target. An edge that comes again has the relation of its last row. Fixed values: prefixes, relations, weights."""
    i = indicators.select(order, F.trim(F.coalesce("ioc_value", F.lit(""))).alias("ioc"), F.trim(F.coalesce("malware_family", F.lit("Unknown"))).alias("fam"), F.trim(F.coalesce("ip_address", F.lit(""))).alias("ip")).filter("fam <> ''")
    parts = F.split("ioc", "/")
    i = i.withColumn("domain", F.when(F.col("ioc").contains("http") | F.col("ioc").contains("/"), F.when(F.size(parts) > 2, parts[2]).otherwise(F.substring("ioc", 1, 30))))
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    edge = lambda src, dst, relation, weight, at: (src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"), F.col(at).cast("long").alias("at"))
    known = i.filter("ip <> ''").select(*edge(named("IP: ", "ip"), named("Family: ", "fam"), "belongs_to_family", 1.5, order))
    carries = i.filter("domain IS NOT NULL").select(*edge(named("Domain: ", "domain"), named("Family: ", "fam"), "delivers_malware", 2.0, order))
    points = i.filter("domain IS NOT NULL AND ip <> ''").select(*edge(named("Domain: ", "domain"), named("IP: ", "ip"), "resolves_to", 1.2, order))
    target = F.concat(F.lit("Target: "), F.col("Dst_IP"), F.lit(":"), F.col("Dst_Port"))
    hits = flows.filter("is_attack = 1 AND Src_IP IS NOT NULL").select(named("IP: ", "Src_IP").alias("src"), target.alias("dst"), F.concat(F.lit("attacks_via_"), F.coalesce("Label", F.lit("Attack"))).alias("relation"), F.lit(1.0).alias("weight"), F.col(flow_order).cast("long").alias("at"))
    every = known.unionByName(carries).unionByName(points).unionByName(hits)
    return every.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "weight"), "at").alias("x")).select("src", "dst", "x.relation", "x.weight")


def threat_kinds(edges: DataFrame) -> DataFrame:
    """node, type: an address that attacks is an attacker, listed or not."""
    attacks = F.col("relation").startswith("attacks_via_")
    ends = edges.select(F.col("src").alias("node"), attacks.alias("attacker")).union(edges.select("dst", F.lit(False)))
    kind = F.when(F.col("node").startswith("Family: "), "malware_family").when(F.col("node").startswith("Domain: "), "c2_domain").when(F.col("node").startswith("Target: "), "victim_asset").when(F.col("attacker"), "attacker_ip").otherwise("c2_ip")
    return ends.groupBy("node").agg(F.max("attacker").alias("attacker")).select("node", kind.alias("type"))
