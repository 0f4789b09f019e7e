"""Made-up indicator lists and flow logs, from ``spark.range``: any size, in parallel, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import geo_dimension

#: Of each label: share, duration (ms), packets forward and back, mean length, SYN, ports, countries by number. The values are this
#: library's own, chosen so that every label can be told by one or two features.
PROFILES = (
    # Ordinary sessions: some seconds, both directions alike, all kinds of lengths, from anywhere.
    ("BENIGN", 0.60, 200, 45000, 4, 40, 4, 60, 90, 1100, 0, (443, 80, 53, 22), (0, 1, 2, 3, 4, 5, 6, 7)),
    # A flood: short, hardly answered, small packets by the hundred.
    ("DDoS", 0.12, 10, 800, 120, 900, 0, 3, 42, 120, 1, (80, 443), (1, 5, 6)),
    # A probe: one or two packets, reset at once, on ports that administrators use.
    ("PortScan", 0.11, 1, 40, 1, 2, 0, 1, 40, 52, 1, (22, 21, 3389, 5555, 8080), (2, 4)),
    # A sign of life to a controller: long, sparse, even.
    ("Botnet", 0.06, 60000, 300000, 3, 12, 3, 12, 60, 180, 0, (8080, 443, 5555), (2, 8, 9)),
    # Log-ins tried one after the other: the same few packets both ways.
    ("Brute Force", 0.07, 1500, 9000, 12, 24, 12, 24, 70, 140, 1, (22, 3389, 21), (1, 2, 6)),
    # A long request to a web service, a short answer.
    ("Web Attack", 0.04, 300, 4000, 6, 15, 3, 9, 600, 1400, 0, (80, 8080, 443), (3, 4, 7)),
)


def indicator_rows(spark: SparkSession, c2: int = 1200, urls: int = 800, cves: int = 7, brute: int = 1500) -> DataFrame:
    """Controllers, URLs, vulnerabilities and password guessers; 240 controllers and 690 guessers differ, the rest are repeats."""
    ip = lambda a, b: f"concat('{a}.', id % 8 + 10, '.', id % {b}, '.', id % 5 + 1)"
    common = ("CAST(50 + id % 50 AS BIGINT) AS confidence", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id % 720 AS INT)) AS first_seen")
    parts = [
        spark.range(c2).selectExpr("id % 240 AS id", "id AS row").selectExpr("row", f"concat({ip(45, 240)}, ':', 443 + id % 3) AS ioc_value", "'ip:port' AS ioc_type", f"{ip(45, 240)} AS ip_address", "CAST(443 + id % 3 AS BIGINT) AS port", "'botnet_cc' AS threat_type", "concat('family', id % 6) AS malware_family", "'controllers' AS source", "'command server' AS description", *common),
        spark.range(urls).selectExpr("id AS row", "concat('http://site', id, '.example/', id % 13) AS ioc_value", "'url' AS ioc_type", f"{ip(91, 250)} AS ip_address", "CAST(80 AS BIGINT) AS port", "'malware_download' AS threat_type", "concat('family', id % 6) AS malware_family", "'downloads' AS source", "'harmful link' AS description", *common),
        spark.range(cves).selectExpr("id AS row", "concat('CVE-2024-', 1000 + id) AS ioc_value", "'cve' AS ioc_type", "'' AS ip_address", "CAST(0 AS BIGINT) AS port", "'exploit' AS threat_type", "'none' AS malware_family", "'vulnerabilities' AS source", "'known flaw' AS description", *common),
        spark.range(brute).selectExpr("id % 690 AS id", "id AS row").selectExpr("row", f"{ip(185, 690)} AS ioc_value", "'ip' AS ioc_type", f"{ip(185, 690)} AS ip_address", "CAST(22 AS BIGINT) AS port", "'brute_force' AS threat_type", "'guesser' AS malware_family", "'guessers' AS source", "'password guessing' AS description", *common),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("__n", F.row_number().over(Window.partitionBy("ioc_value", "source").orderBy("row"))).filter("__n = 1").drop("__n", "row")


def flow_rows(spark: SparkSession, n: int, known: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``n`` flows over seven days; 35 % of attacks come from a ``known`` address (first column), where one is given."""
    bounds, total = [], 0.0
    for p in PROFILES:
        total += p[1]
        bounds.append(total)
    u = F.rand(seed)
    label = F.lit(len(PROFILES) - 1)
    for i in reversed(range(len(PROFILES) - 1)):
        label = F.when(F.col("u") < bounds[i], i).otherwise(label)
    profiles = spark.createDataFrame(
        [(i, *p[:1], *map(float, p[2:10]), p[10], list(p[11]), list(p[12])) for i, p in enumerate(PROFILES)],
        "pid int, Label string, d0 double, d1 double, f0 double, f1 double, b0 double, b1 double, l0 double, l1 double, SYN_Flag_Count long, ports array<int>, places array<int>",
    )
    base = spark.range(n).withColumn("u", u).withColumn("pid", label).drop("u").join(F.broadcast(profiles), "pid")  # six rows
    whole = lambda a, b, s: F.floor(F.col(a) + F.rand(s) * (F.col(b) - F.col(a) + 1)).cast("long")
    pick = lambda c, s: F.element_at(c, (F.floor(F.rand(s) * F.size(c)) + 1).cast("int"))
    flow = base.select(
        F.col("id").alias("row_id"), "Label", "SYN_Flag_Count", whole("d0", "d1", seed + 1).alias("Flow_Duration"), whole("f0", "f1", seed + 2).alias("Total_Fwd_Packets"), whole("b0", "b1", seed + 3).alias("Total_Backward_Packets"),
        F.round(F.col("l0") + F.rand(seed + 4) * (F.col("l1") - F.col("l0")), 2).alias("Packet_Length_Mean"), pick("ports", seed + 5).cast("long").alias("Dst_Port"), pick("places", seed + 6).cast("long").alias("geo_id"),
        F.concat(F.lit("100."), *(x for i in range(3) for x in (F.floor(F.rand(seed + 7 + i) * 250).cast("string"), F.lit("." if i < 2 else "")))).alias("own_ip"), F.concat(F.lit("192.168.1."), (F.col("id") % 20).cast("string")).alias("Dst_IP"),
        F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, CAST(id * 604800D / {max(n, 1)} AS INT))").alias("ts"), F.rand(seed + 10).alias("r"), F.rand(seed + 11).alias("jx"), F.rand(seed + 12).alias("jy"),
    )
    flow = flow.join(F.broadcast(geo_dimension(spark)), "geo_id")  # ten rows
    s = F.greatest(F.lit(0.001), F.col("Flow_Duration") / 1000.0)
    packets = F.col("Total_Fwd_Packets") + F.col("Total_Backward_Packets")
    source = F.col("own_ip")
    if known is not None:
        listed = known.select(F.col(known.columns[0]).alias("ip")).distinct().orderBy("ip").limit(200)  # as many as the generator reuses
        listed = listed.withColumn("k", F.row_number().over(Window.orderBy("ip")) - 1)
        count = max(listed.count(), 1)
        flow = flow.withColumn("k", F.when((F.col("Label") != "BENIGN") & (F.col("r") < 0.35), F.col("row_id") % count)).join(F.broadcast(listed), "k", "left")
        source = F.coalesce("ip", "own_ip")
    return flow.select(
        "row_id", "Flow_Duration", "Total_Fwd_Packets", "Total_Backward_Packets", F.round(packets * F.col("Packet_Length_Mean") / s, 2).alias("Flow_Bytes_s"), F.round(packets / s, 2).alias("Flow_Packets_s"), "Packet_Length_Mean", "SYN_Flag_Count", "Dst_Port",
        source.alias("Src_IP"), "Dst_IP", "ts", F.hour("ts").cast("long").alias("Hour"), F.date_format("ts", "EEEE").alias("DayOfWeek"), "Country", "Country_Code", "ASN", F.round(F.col("base_lat") + F.col("jx") * 3 - 1.5, 4).alias("Latitude"), F.round(F.col("base_lon") + F.col("jy") * 3 - 1.5, 4).alias("Longitude"),
        "Label", (F.col("Label") != "BENIGN").cast("long").alias("is_attack"),
    )
