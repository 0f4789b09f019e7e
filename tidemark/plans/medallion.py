"""Bronze to silver to gold, the summary, and experiments on the sketches and formats."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import graph, mining, ml, relational, similarity, sketches
from tidemark.sources import feeds

FEATURES = ["Flow_Duration", "Total_Fwd_Packets", "Total_Backward_Packets", "Packet_Length_Mean", "SYN_Flag_Count", "Dst_Port", "Hour"]
WINDOW = 2000


def _listed(indicators: DataFrame) -> DataFrame:
    return indicators.filter(F.col("ioc_type").isin("ip", "ip:port"))


def headline(flows: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row: the counts and estimates of the summary."""
    ips = _listed(indicators).select(F.trim("ip_address").alias("__k")).distinct().withColumn("hit", F.lit(1))
    both = flows.select("Src_IP", "is_attack").join(ips, F.col("Src_IP") == F.col("__k"), "left")
    attacker = F.when(F.col("is_attack") == 1, F.col("Src_IP"))
    counts = both.agg(F.count("*").alias("total_flow_logs"), F.coalesce(F.sum("is_attack"), F.lit(0)).alias("total_attack_logs"), F.count("hit").alias("headline_feed_matches"), F.countDistinct(attacker).alias("flajolet_martin_exact"))
    tracked = indicators.agg(F.count("*").alias("threat_iocs_tracked"))
    indexed = ips.agg(F.count("*").alias("threat_ips_indexed"))
    estimate = sketches.fm_estimate(sketches.fm_registers(flows.filter("is_attack = 1"), "Src_IP")).select(F.col("estimate").alias("flajolet_martin_estimate"))
    window = sketches.dgim_window(flows, "row_id", "is_attack", WINDOW).select(F.col("estimate").alias("dgim_sliding_window_count"))
    for one in (tracked, indexed, estimate, window):
        counts = counts.join(F.broadcast(one))  # one row each
    return counts


def tagged(flows: DataFrame) -> DataFrame:
    """row_id, tags."""
    packets = F.col("Total_Fwd_Packets") + F.col("Total_Backward_Packets")
    return flows.select("row_id", mining.tags(F.col("Dst_Port"), F.col("Hour"), packets, F.col("SYN_Flag_Count"), F.col("Packet_Length_Mean"), F.col("Label")).alias("tags"))


def _rows(df: DataFrame, *order: Column | str, n: int | None = None) -> DataFrame:
    """One row: all rows (or the first ``n``) as a JSON array. For tables of a bounded size."""
    if n is not None:
        df = df.orderBy(*order).limit(n)
    return df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("x"))


def summary(flows: DataFrame, indicators: DataFrame, clusters: tuple[int, int] = (3, 7), rules: int = 15, campaigns: int = 10, nodes: int = 500, near: float = 0.5, least: int = 10) -> DataFrame:
    """One row with the 20 keys of the summary document (fixed names); what is nested is JSON.

    Whatever is listed is bounded: rules and campaigns as many as asked for, the graph by its ``nodes`` of highest rank and the edges between them.
    """
    clustered, k, scores = ml.kmeans_search(flows, FEATURES, clusters, restarts=1)
    _, shares = ml.pca(flows, FEATURES, ["row_id"])
    points = ml.taken(ml.zscored(flows, FEATURES), "row_id", 5000).select("row_id", *FEATURES[:3])  # as many as the method takes
    edges = graph.settle(graph.threat_edges(indicators, flows), "threat-edges")
    ranks = graph.settle(graph.pagerank(edges), "threat-ranks")
    kinds = graph.threat_kinds(edges)
    top = graph.top_nodes(ranks, edges, kinds, nodes)
    between = graph.between(edges, top)
    shown = graph.export_nodes(ranks.join(F.broadcast(top.select("node")), "node", "left_semi"), kinds)  # ``nodes`` rows
    drawn = shown.agg(F.collect_list(F.struct("*")).alias("nodes")).join(F.broadcast(between.agg(F.collect_list(F.struct("*")).alias("edges"))))
    urls = similarity.signatures(indicators.filter(F.col("ioc_type") == "url"), "ioc_id", "ioc_value")
    stars = similarity.star_clusters(urls.select("id"), similarity.pairs(urls)).groupBy(F.col("seed")).agg(F.count("*").alias("size")).filter("size > 1")
    found = ml.anomalies(flows, FEATURES, "row_id", ["is_attack"])
    sets = mining.itemsets(tagged(flows), "tags", 0.015)
    nested = {
        "cluster_profiles": _rows(ml.cluster_profiles(clustered)),
        "dbscan_summary": _rows(ml.dbscan_summary(ml.dbscan(points, "row_id", FEATURES[:3], near, least))),
        "top_kingpin_nodes": _rows(top, "rank", n=15),
        "graph_visualization": drawn.select(F.to_json(F.struct("nodes", "edges")).alias("x")),
        "association_rules": _rows(mining.rules(sets, 0.1), F.desc("lift"), F.desc("confidence"), "antecedent", "consequent", n=rules),
        "phishing_campaign_clusters": _rows(stars, F.desc("size"), "seed", n=campaigns),
        "anomaly_detection_metrics": _rows(ml.anomaly_metrics(found)),
        "benchmarks": _rows(accuracy(flows, indicators)),
    }
    out = headline(flows, indicators)
    for name, one in nested.items():
        out = out.join(F.broadcast(one.select(F.col("x").alias(name))))  # one row each
    return out.withColumns(
        {
            "execution_timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
            "optimal_kmeans_k": F.lit(k),
            "silhouette_scores": F.to_json(F.create_map(*(F.lit(x) for name, score in scores.items() for x in (str(name), score)))),
            "pca_variance": F.to_json(F.array(*(F.lit(float(x)) for x in shares))),
        }
    )


def gold_tables(flows: DataFrame) -> dict[str, DataFrame]:
    """By name. A table that stands on a column which the flows lack is left out."""
    has, out = lambda *c: relational.has(flows, *c), {}
    if has("Label", "Flow_Duration", "Packet_Length_Mean"):
        out["attacks_by_type"] = relational.by_label(flows, "Label", {"avg_duration": "Flow_Duration", "avg_packet_len": "Packet_Length_Mean"})
    if has("Hour", "Label"):
        out["hourly_attacks"] = relational.counted(flows, ["Hour", "Label"])
    if has("is_attack"):
        attacks = flows.filter("is_attack = 1")
        if has("Dst_Port"):
            out["top_attacked_ports"] = relational.top_counts(attacks, "Dst_Port", 20)
        if has("DayOfWeek", "Hour"):
            out["hourly_attack_heatmap"] = relational.counted(attacks, ["DayOfWeek", "Hour"], "attack_count")
        if has("Country", "Country_Code", "Latitude", "Longitude", "Label"):
            out["geo_threat_map"] = relational.geo_map(attacks, ["Country", "Country_Code"], "Latitude", "Longitude", "Label")
    return out


def accuracy(flows: DataFrame, indicators: DataFrame, window: int = WINDOW) -> DataFrame:
    """sketch, estimate, exact, rel_err_pct of each sketch over the same rows."""
    attacks = flows.filter("is_attack = 1")
    whole = Window.partitionBy()  # over five rows
    width, depth = sketches.cms_size(0.002, 0.01)
    bits, hashes = sketches.bloom_size(1000, 0.01)
    exact = attacks.agg(F.countDistinct("Src_IP").cast("double").alias("exact"))
    fm = sketches.fm_estimate(sketches.fm_registers(attacks, "Src_IP")).select(F.lit("flajolet_martin").alias("sketch"), F.col("estimate").cast("double").alias("estimate")).crossJoin(exact)  # one row each
    top = relational.top_counts(attacks, "Dst_Port", 5, "n")
    cms = sketches.cms_query(top, "Dst_Port", sketches.cms_build(attacks, "Dst_Port", width, depth), width, depth).join(top, "Dst_Port").select(F.lit("count_min").alias("sketch"), F.sum("estimate").over(whole).cast("double").alias("estimate"), F.sum("n").over(whole).cast("double").alias("exact")).limit(1)
    built = sketches.bloom_build(_listed(indicators), "ip_address", bits, hashes)
    probed = sketches.bloom_probe(flows, "Src_IP", built, bits, hashes)
    listed = _listed(indicators).select(F.trim("ip_address").alias("Src_IP")).distinct().withColumn("hit", F.lit(1))
    bloom = probed.join(listed, "Src_IP", "left").agg(F.sum(F.col("maybe").cast("double")).alias("estimate"), F.sum(F.coalesce("hit", F.lit(0)).cast("double")).alias("exact")).select(F.lit("bloom").alias("sketch"), "estimate", "exact")
    dgim = sketches.dgim_window(flows, "row_id", "is_attack", window).select(F.lit("dgim").alias("sketch"), F.col("estimate").cast("double").alias("estimate"), F.col("exact").cast("double").alias("exact"))
    out = fm.select("sketch", "estimate", "exact").unionByName(cms).unionByName(bloom).unionByName(dgim)
    return out.withColumn("rel_err_pct", F.round(100 * F.abs(F.col("estimate") - F.col("exact")) / F.greatest(F.lit(1.0), F.col("exact")), 2))


def memory(flows: DataFrame, indicators: DataFrame) -> DataFrame:
    """sketch, sketch_bytes, exact_bytes, saved_pct: what the sketches hold against the exact sets and counters, by the bytes of the values."""
    bits, hashes = sketches.bloom_size(1000, 0.01)
    width, depth = sketches.cms_size(0.002, 0.01)
    listed = _listed(indicators).select(F.trim("ip_address").alias("k")).distinct().agg(F.sum(F.length("k")).alias("exact_bytes"))
    attackers = flows.filter("is_attack = 1").select("Src_IP").distinct().agg(F.sum(F.length("Src_IP")).alias("exact_bytes"))
    ports = flows.select("Dst_Port").distinct().agg((F.count("*") * 16).alias("exact_bytes"))
    window = sketches.dgim_window(flows, "row_id", "is_attack", WINDOW).select((F.size("buckets") * 16).alias("sketch_bytes"), F.lit(WINDOW).alias("exact_bytes"))
    one = lambda name, size, df: df.select(F.lit(name).alias("sketch"), F.lit(size).cast("long").alias("sketch_bytes"), F.col("exact_bytes").cast("long").alias("exact_bytes"))
    out = one("bloom", -(-bits // 8), listed).unionByName(one("flajolet_martin", 32 * 4, attackers)).unionByName(one("count_min", width * depth * 8, ports))
    out = out.unionByName(window.select(F.lit("dgim").alias("sketch"), F.col("sketch_bytes").cast("long"), F.col("exact_bytes").cast("long")))
    return out.withColumn("saved_pct", F.round(100 * (1 - F.col("sketch_bytes") / F.greatest(F.lit(1), F.col("exact_bytes"))), 1))


def formats(flows: DataFrame, root: str, columns: tuple[str, str] = ("Label", "Flow_Duration")) -> dict[str, dict[str, float]]:
    """Bytes on disk and seconds to read two columns of the flows, as CSV and as Parquet, written under ``root``."""
    spark, out = flows.sparkSession, {}
    feeds.write_csv(flows, f"{root}/csv")
    feeds.write_parquet(flows, f"{root}/parquet")
    jvm = spark.sparkContext._jvm
    readers = {"csv": lambda: spark.read.schema(flows.schema).option("header", True).csv(f"{root}/csv"), "parquet": lambda: spark.read.parquet(f"{root}/parquet")}
    for name, reader in readers.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        began = time.perf_counter()
        reader().select(*columns).write.format("noop").mode("overwrite").save()
        out[name] = {"bytes": size, "seconds": round(time.perf_counter() - began, 3)}
    return out


def run(spark: SparkSession, flows: DataFrame, indicators: DataFrame, root: str) -> None:
    """Bronze CSV, silver Parquet, gold Parquet and the summary. Gold reads silver, so raw files are read once."""
    feeds.write_csv(flows, f"{root}/bronze/flows")
    feeds.write_json_snapshot(indicators, f"{root}/bronze/threat_iocs", "ioc_value" if "ioc_id" not in indicators.columns else "ioc_id")
    feeds.write_parquet(flows, f"{root}/silver/logs")
    feeds.write_parquet(relational.keep_first(indicators, ["ioc_value", "source"], "ioc_id"), f"{root}/silver/threat_iocs")
    logs, listed = spark.read.parquet(f"{root}/silver/logs"), spark.read.parquet(f"{root}/silver/threat_iocs")
    for name, table in gold_tables(logs).items():
        feeds.write_parquet(table, f"{root}/gold/{name}")
    clustered, _, _ = ml.kmeans_search(logs, FEATURES, (3, 4), restarts=1)
    shown, _ = ml.pca(clustered, FEATURES, ["row_id", "cluster", "Label", "is_attack", "Dst_Port", "Flow_Duration"])
    feeds.write_parquet(shown, f"{root}/gold/pca_clusters")
    feeds.write_parquet(summary(logs, listed, (3, 4)), f"{root}/gold/gold_summary")
