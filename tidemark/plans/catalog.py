"""Every query outside the training-data subpackage: name -> (callable, DuckDB SQL or None).

The operators take any table; here they are bound to the driver's tables. Each SQL restates a query
from its definition, over the same flow and indicator projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.lineage import settle
from tidemark.operators import graph, mining, ml, relational, similarity, sketches
from tidemark.plans import medallion, serving
from tidemark.sources import feeds, generate
from tidemark.sources.tables import COUNTRIES, FLOWS_SQL, INDICATORS_SQL, LABELS, flows, geo_dimension, indicators, read
from tidemark.streaming import windows

QUERIES: dict = {}
_WITH = f"WITH f AS ({FLOWS_SQL}), i AS ({INDICATORS_SQL})"


def query(name: str, sql: str | None = None, prefix: bool = True):
    def register(function):
        QUERIES[name] = (function, None if sql is None else f"{_WITH} {sql}" if prefix and not sql.lstrip().startswith(",") else f"{_WITH}{sql}" if prefix else sql)
        return function

    return register


def _mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18, 4))) AS DOUBLE) / count({column})"


# Aggregates


@query("attacks_by_type", f"SELECT Label, count(*) AS count, {_mean('Flow_Duration')} AS avg_duration, {_mean('Total_Fwd_Packets')} AS avg_packets, {_mean('Packet_Length_Mean')} AS avg_packet_len FROM f GROUP BY Label")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relational.by_label(flows(spark, d), "Label", {"avg_duration": "Flow_Duration", "avg_packets": "Total_Fwd_Packets", "avg_packet_len": "Packet_Length_Mean"})


@query("demo_rollup", "SELECT Label, count(*) AS flow_count, round(avg(Flow_Duration), 1) AS avg_duration, round(avg(Packet_Length_Mean), 1) AS avg_len, round(avg(Total_Fwd_Packets), 1) AS avg_fwd FROM f GROUP BY Label")
def _(spark, d):
    return flows(spark, d).groupBy("Label").agg(F.count("*").alias("flow_count"), F.round(F.avg("Flow_Duration"), 1).alias("avg_duration"), F.round(F.avg("Packet_Length_Mean"), 1).alias("avg_len"), F.round(F.avg("Total_Fwd_Packets"), 1).alias("avg_fwd")).orderBy(F.desc("flow_count"), "Label")


@query("label_share", "SELECT Label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY Label")
def _(spark, d):
    return relational.label_shares(flows(spark, d), "Label")


@query("kpi_summary", "SELECT count(*) AS total_flows, sum(is_attack)::BIGINT AS attacks, round(100.0 * sum(is_attack) / greatest(1, count(*)), 2) AS attack_pct, CASE WHEN sum(is_attack) > 100 THEN 'High' ELSE 'Medium' END AS posture FROM f")
def _(spark, d):
    out = flows(spark, d).agg(F.count("*").alias("total_flows"), F.coalesce(F.sum("is_attack"), F.lit(0)).alias("attacks"))
    return out.withColumns({"attack_pct": F.round(100.0 * F.col("attacks") / F.greatest(F.lit(1), F.col("total_flows")), 2), "posture": relational.posture(F.col("attacks"))})


@query("top_attacked_ports", "SELECT Dst_Port, count(*) AS count FROM f WHERE is_attack = 1 GROUP BY Dst_Port ORDER BY count DESC, Dst_Port LIMIT 20")
def _(spark, d):
    return relational.top_counts(flows(spark, d).filter("is_attack = 1"), "Dst_Port", 20)


@query("exact_topk", "SELECT Src_IP, count(*) AS count FROM f GROUP BY Src_IP ORDER BY count DESC, Src_IP LIMIT 10")
def _(spark, d):
    return relational.top_counts(flows(spark, d), "Src_IP", 10)


@query("hourly_heatmap", "SELECT DayOfWeek, Hour, count(*) AS attack_count FROM f WHERE is_attack = 1 GROUP BY ALL")
def _(spark, d):
    return relational.counted(flows(spark, d).filter("is_attack = 1"), ["DayOfWeek", "Hour"], "attack_count")


@query("hourly_attacks", "SELECT Hour, Label, count(*) AS count FROM f GROUP BY ALL")
def _(spark, d):
    return relational.counted(flows(spark, d), ["Hour", "Label"]).orderBy("Hour", "Label")


@query("heatmap_pivot", "SELECT DayOfWeek, " + ", ".join(f"count(*) FILTER (WHERE Hour = {h}) AS h{h}" for h in range(24)) + " FROM f WHERE is_attack = 1 GROUP BY DayOfWeek")
def _(spark, d):
    return relational.heatmap_pivot(flows(spark, d).filter("is_attack = 1"))


@query("geo_threat_map", "SELECT Country, Country_Code, round(Latitude, 0) + 0.0 AS Latitude, round(Longitude, 0) + 0.0 AS Longitude, Label, count(*) AS attack_count FROM f WHERE is_attack = 1 GROUP BY ALL")
def _(spark, d):
    return relational.geo_map(flows(spark, d).filter("is_attack = 1"), ["Country", "Country_Code"], "Latitude", "Longitude", "Label")


@query("country_rollup", "SELECT Country, count(*) AS attacks FROM f WHERE is_attack = 1 GROUP BY Country")
def _(spark, d):
    found = relational.geo_map(flows(spark, d).filter("is_attack = 1"), ["Country", "Country_Code"], "Latitude", "Longitude", "Label")
    return found.groupBy("Country").agg(F.sum("attack_count").alias("attacks")).orderBy(F.desc("attacks"), "Country")


@query("geo_enrichment", "SELECT Country, n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(["United States", "China", "Russia", "Germany", "Netherlands", "Brazil", "India", "United Kingdom", "Iran", "North Korea"])) + ") g(geo_id, Country) ON c_custkey % 10 = geo_id GROUP BY ALL", prefix=False)
def _(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    geo = geo_dimension(spark)  # ten rows
    out = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(F.broadcast(geo), c.c_custkey % 10 == geo.geo_id)
    return out.groupBy("Country", "n_name", "r_name").agg(F.count("*").alias("customers"))


@query("exact_distinct", "SELECT count(DISTINCT Src_IP) AS distinct_count FROM f WHERE is_attack = 1")
def _(spark, d):
    return relational.exact_distinct(flows(spark, d).filter("is_attack = 1"), "Src_IP")


# Projections


@query("flow_rates", "SELECT row_id, round((Total_Fwd_Packets + Total_Backward_Packets) * Packet_Length_Mean / greatest(0.001, Flow_Duration / 1000.0), 2) AS bytes_per_s, round((Total_Fwd_Packets + Total_Backward_Packets) / greatest(0.001, Flow_Duration / 1000.0), 2) AS packets_per_s FROM f")
def _(spark, d):
    return relational.rates(flows(spark, d), "Total_Fwd_Packets", "Total_Backward_Packets", "Packet_Length_Mean", "Flow_Duration").select("row_id", "bytes_per_s", "packets_per_s")


@query("normalised_silver", "SELECT event_id, extract(hour FROM ts)::BIGINT AS Hour, dayname(ts) AS DayOfWeek, strftime(ts, '%Y-%m-%d %H:%M:%S') AS Timestamp, (event_type <> 'view')::BIGINT AS is_attack, value AS Flow_Bytes_s FROM events", prefix=False)
def _(spark, d):
    raw = read(spark, d, "events").select("event_id", "ts", F.col("event_type").alias(" Label"), F.col("value").alias("Flow Bytes/s"))
    out = relational.time_parts(relational.normalised_names(raw), "ts").withColumn("is_attack", relational.attack_flag("Label", "view"))
    return out.select("event_id", "Hour", "DayOfWeek", "Timestamp", "is_attack", "Flow_Bytes_s")


#: Tags and bounds, as in operators/mining.py.
_TAGS = """SELECT row_id, list_filter([
  CASE WHEN Dst_Port = 22 THEN 'port_22_SSH' WHEN Dst_Port IN (80, 8080) THEN 'port_80_HTTP' WHEN Dst_Port IN (443, 8443) THEN 'port_443_HTTPS' WHEN Dst_Port = 3389 THEN 'port_3389_RDP' WHEN Dst_Port IN (21, 23) THEN 'port_insecure_telnet_ftp' WHEN Dst_Port = 53 THEN 'port_53_DNS' ELSE 'port_ephemeral' END,
  CASE WHEN Hour >= 23 OR Hour <= 5 THEN 'time_late_night' WHEN Hour BETWEEN 9 AND 17 THEN 'time_business_hours' ELSE 'time_evening' END,
  CASE WHEN Total_Fwd_Packets + Total_Backward_Packets > 100 THEN 'volume_massive_flood' WHEN Total_Fwd_Packets + Total_Backward_Packets < 4 THEN 'volume_micro_probe' ELSE 'volume_moderate' END,
  CASE WHEN SYN_Flag_Count > 0 THEN 'flag_syn_probe' END,
  CASE WHEN Packet_Length_Mean < 60 THEN 'payload_tiny_header_only' WHEN Packet_Length_Mean > 500 THEN 'payload_large_data' END,
  'TARGET_' || Label], lambda x: x IS NOT NULL) AS tags FROM f"""


@query("kpi_defaults", "SELECT s_suppkey, coalesce(nullif(s_acctbal, 73.0), -1.0) AS balance, round(s_suppkey / 1024.0, 2) AS kilobytes FROM supplier", prefix=False)
def _(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", F.expr("nullif(s_acctbal, 73.0D)").alias("balance"), relational.kilobytes(F.col("s_suppkey").cast("double")).alias("kilobytes"))
    return relational.filled(rows, {"balance": -1.0})


@query("flow_tags", _TAGS)
def _(spark, d):
    return _tagged(spark, d)


def _tagged(spark, d):
    return medallion.tagged(flows(spark, d))


@query("later", "SELECT event_id, ts + to_seconds(event_id % 3600) AS later FROM events", prefix=False)
def _(spark, d):
    return read(spark, d, "events").select("event_id", relational.later(F.col("ts"), F.expr("event_id % 3600")).alias("later"))


@query("prefixed_labels", "SELECT DISTINCT concat('Group ', row_id % 5) AS cluster_name, concat('Port ', Dst_Port) AS port_name FROM f WHERE Dst_Port IS NOT NULL")
def _(spark, d):
    rows = flows(spark, d).filter("Dst_Port IS NOT NULL").withColumn("c", F.col("row_id") % 5)
    return rows.select(relational.prefixed("Group ", "c").alias("cluster_name"), relational.prefixed("Port ", "Dst_Port").alias("port_name")).distinct()


_LEVELS = "CASE n_nationkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' ELSE 'Other' END"


@query("posture_display", f"SELECT n_nationkey, CASE {_LEVELS} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in relational.SHOWN.items()) + f" ELSE 'ELEVATED' END AS text, CASE {_LEVELS} " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in relational.SHOWN.items()) + " ELSE '#F59E0B' END AS colour FROM nation", prefix=False)
def _(spark, d):
    text, colour = relational.shown(F.expr(_LEVELS))
    return read(spark, d, "nation").select("n_nationkey", text.alias("text"), colour.alias("colour"))


_PLACES = {label: [i, (i + 3) % 10, (i + 5) % 10] for i, label in enumerate(LABELS)}


@query("geo_enriched", ", g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c[0]}', '{c[1]}', {c[2]}::DOUBLE, {c[3]}::DOUBLE)" for i, c in enumerate(COUNTRIES)) + ") t(geo_id, Country, Country_Code, lat, lon)), p AS (SELECT row_id, (list_position([" + ", ".join(f"'{x}'" for x in LABELS) + "], Label) - 1 + [0, 3, 5][CAST(('0x' || substr(md5('0:' || row_id::VARCHAR), 1, 8)) AS BIGINT) % 3 + 1]) % 10 AS geo_id FROM f)"
       " SELECT row_id, g.Country, g.Country_Code, round(lat + (CAST(('0x' || substr(md5('0:' || row_id::VARCHAR), 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 2 - 1) * 1.5::DOUBLE, 4) AS Latitude, round(lon + (CAST(('0x' || substr(md5('0:' || row_id::VARCHAR), 17, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 2 - 1) * 1.5::DOUBLE, 4) AS Longitude FROM p JOIN g USING (geo_id)")  # fmt: skip
def _(spark, d):
    return relational.geo_enriched(flows(spark, d).select("row_id", "Label"), "row_id", "Label", geo_dimension(spark), _PLACES).select("row_id", "Country", "Country_Code", "Latitude", "Longitude")


_BYTES = "list_transform(range(1, length(n_name) + 1), lambda i: unicode(substr(n_name, i::INTEGER, 1))::UBIGINT)"


def _murmur_sql(seed: int) -> str:
    """MurmurHash3 over ASCII bytes, as a fold over blocks of four and what is left."""
    m, rot = "((({0}) * {1}) & 4294967295)", "(((({0}) << {1}) & 4294967295) | (({0}) >> {2}))"
    word = "(b[4 * k + 1] | (coalesce(b[4 * k + 2], 0) << 8) | (coalesce(b[4 * k + 3], 0) << 16) | (coalesce(b[4 * k + 4], 0) << 24))"
    return f"""w AS (SELECT n_nationkey, len(b) AS n, list_transform(range(0, (len(b) + 3) // 4), lambda k: struct_pack(v := {word}, whole := 4 * k + 4 <= len(b))) AS ws FROM (SELECT n_nationkey, {_BYTES} AS b FROM nation)),
    x AS (SELECT n_nationkey, n, list_transform(ws, lambda q: struct_pack(v := {m.format(rot.format(m.format("q.v", 3432918353), 15, 17), 461845907)}, whole := q.whole)) AS ws FROM w),
    h AS (SELECT n_nationkey, n, list_reduce(ws, lambda a, q: struct_pack(v := CASE WHEN q.whole THEN (({rot.format("xor(a.v, q.v)", 13, 19)}) * 5 + 3864292196) & 4294967295 ELSE xor(a.v, q.v) END, whole := true), struct_pack(v := {seed}::UBIGINT, whole := true)).v AS v FROM x),
    h1 AS (SELECT n_nationkey, xor(v, n::UBIGINT) AS v FROM h), h2 AS (SELECT n_nationkey, (xor(v, v >> 16) * 2246822507) & 4294967295 AS v FROM h1), h3 AS (SELECT n_nationkey, (xor(v, v >> 13) * 3266489909) & 4294967295 AS v FROM h2)
    SELECT n_nationkey, xor(v, v >> 16)::BIGINT AS murmur FROM h3"""


@query("murmur3", "WITH " + _murmur_sql(7), prefix=False)
def _(spark, d):
    return read(spark, d, "nation").select("n_nationkey", hashing.murmur3_32(7, F.col("n_name")).alias("murmur"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"id\":', event_id, ',\"type\":\"', event_type, '\"}') AS doc FROM events", prefix=False)
def _(spark, d):
    rows = read(spark, d, "events")
    return rows.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


# Joins


@query("headline_semi_join", "SELECT count(*) AS matches FROM f WHERE Src_IP IN (SELECT trim(ip_address) FROM i WHERE ioc_type IN ('ip', 'ip:port'))")
def _(spark, d):
    listed = indicators(spark, d).filter(F.col("ioc_type").isin("ip", "ip:port"))
    return relational.semi_matches(flows(spark, d), "Src_IP", listed, "ip_address").agg(F.count("*").alias("matches"))


@query("clean_anti_join", "SELECT DISTINCT Src_IP FROM f WHERE Src_IP NOT IN (SELECT trim(ip_address) FROM i WHERE ioc_type IN ('ip', 'ip:port'))")
def _(spark, d):
    listed = indicators(spark, d).filter(F.col("ioc_type").isin("ip", "ip:port"))
    return relational.semi_matches(flows(spark, d), "Src_IP", listed, "ip_address", anti=True).select("Src_IP").distinct()


_FIRST_IOC = "x AS (SELECT ip_address, threat_type, malware_family, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY ioc_id) AS k FROM i WHERE ioc_type IN ('ip', 'ip:port')) WHERE k = 1)"


@query("ioc_lookup", f", {_FIRST_IOC} SELECT a.Src_IP, threat_type, malware_family, confidence, x.ip_address IS NOT NULL AS listed FROM (SELECT DISTINCT Src_IP FROM f) a LEFT JOIN x ON a.Src_IP = x.ip_address")
def _(spark, d):
    return serving.check_ips(flows(spark, d).select("Src_IP").distinct(), "Src_IP", indicators(spark, d))


@query("ioc_dedup", "SELECT ioc_id, ioc_value, source FROM (SELECT *, row_number() OVER (PARTITION BY ioc_value, source ORDER BY ioc_id) AS k FROM i) WHERE k = 1")
def _(spark, d):
    return relational.keep_first(indicators(spark, d), ["ioc_value", "source"], "ioc_id").select("ioc_id", "ioc_value", "source")


@query("point_lookup", "SELECT ioc_id, ip_address, confidence FROM i WHERE ip_address = '10.0.0.0' ORDER BY ioc_id LIMIT 1")
def _(spark, d):
    return indicators(spark, d).filter("ip_address = '10.0.0.0'").orderBy("ioc_id").limit(1).select("ioc_id", "ip_address", "confidence")


# Sketches

_H = "CAST(('0x' || substr(md5(CAST({s} // 4 AS VARCHAR) || ':' || CAST({v} AS VARCHAR)), 1 + 8 * ({s} % 4), 8)) AS BIGINT)"
_BITS, _HASHES = sketches.bloom_size(1000, 0.01)
_LISTED = "SELECT DISTINCT trim(ip_address) AS k FROM i WHERE ioc_type IN ('ip', 'ip:port')"
_BLOOM = f"b AS (SELECT DISTINCT {_H.format(s='s', v='k')} % {_BITS} AS pos FROM ({_LISTED}), (SELECT unnest(range(0, {_HASHES})) AS s))"


@query("bloom_build", f", {_BLOOM} SELECT pos FROM b")
def _(spark, d):
    return sketches.bloom_build(indicators(spark, d).filter(F.col("ioc_type").isin("ip", "ip:port")), "ip_address", _BITS, _HASHES)


@query("bloom_probe", f", {_BLOOM}, p AS (SELECT DISTINCT Src_IP, {_H.format(s='s', v='Src_IP')} % {_BITS} AS pos FROM (SELECT DISTINCT Src_IP FROM f), (SELECT unnest(range(0, {_HASHES})) AS s)) SELECT Src_IP, count(b.pos) = count(*) AS maybe FROM p LEFT JOIN b USING (pos) GROUP BY Src_IP")
def _(spark, d):
    built = sketches.bloom_build(indicators(spark, d).filter(F.col("ioc_type").isin("ip", "ip:port")), "ip_address", _BITS, _HASHES)
    return sketches.bloom_probe(flows(spark, d), "Src_IP", built, _BITS, _HASHES)


_FM = f"r AS (SELECT s AS seed, max(CASE WHEN h = 0 THEN 32 ELSE bit_count((h & -h) - 1) END) AS register FROM (SELECT s, {_H.format(s='s', v='l_partkey')} AS h FROM (SELECT DISTINCT l_partkey FROM lineitem), (SELECT unnest(range(0, 32)) AS s)) GROUP BY s)"


@query("bloom_bits", f", {_BLOOM} SELECT count(*) AS set_bits, round(pow(1 - exp(-{_HASHES} * (SELECT count(*) FROM ({_LISTED}))::DOUBLE / {_BITS}), {_HASHES}), 12) AS expected_fpr FROM b")
def _(spark, d):
    listed = indicators(spark, d).filter(F.col("ioc_type").isin("ip", "ip:port"))
    inserted = listed.select("ip_address").distinct().count()
    out = sketches.bloom_build(listed, "ip_address", _BITS, _HASHES).agg(F.count("*").alias("set_bits"))
    return out.withColumn("expected_fpr", F.lit(round(sketches.bloom_rate(_BITS, _HASHES, inserted), 12)))


@query("approx_distinct", "SELECT count(DISTINCT l_partkey) AS exact, true AS within_bound FROM lineitem", prefix=False)
def _(spark, d):
    out = read(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("a"))
    return out.select("exact", (F.abs(F.col("a") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within_bound"))


@query("fm_registers", f", {_FM} SELECT seed::INTEGER AS seed, register::INTEGER AS register FROM r")
def _(spark, d):
    return sketches.fm_registers(read(spark, d, "lineitem"), "l_partkey")


@query("fm_estimate", f", {_FM} SELECT round_even(median(m), 0)::BIGINT AS estimate FROM (SELECT seed // 8 AS g, avg(pow(2.0, register) / 0.77351) AS m FROM r GROUP BY 1)")
def _(spark, d):
    return sketches.fm_estimate(sketches.fm_registers(read(spark, d, "lineitem"), "l_partkey"))


_W, _D = sketches.cms_size(0.002, 0.01)
_CMS = f"c AS (SELECT l_partkey AS k, r, {_H.format(s='r', v='l_partkey')} % {_W} AS col, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest(range(0, {_D})) AS r)), cells AS (SELECT r, col, sum(n) AS cnt FROM c GROUP BY 1, 2), e AS (SELECT k AS l_partkey, min(cnt)::BIGINT AS estimate FROM c JOIN cells USING (r, col) GROUP BY k)"


@query("cms_query", f", {_CMS} SELECT * FROM e")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    return sketches.cms_query(rows, "l_partkey", sketches.cms_build(rows, "l_partkey", _W, _D), _W, _D)


@query("cms_topk", f", {_CMS} SELECT * FROM e ORDER BY estimate DESC, l_partkey LIMIT 20")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    return sketches.cms_top_k(rows, "l_partkey", sketches.cms_build(rows, "l_partkey", _W, _D), _W, _D, 20)


@query("exact_window", "SELECT row_id AS ord, sum(is_attack) OVER (ORDER BY row_id ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)::BIGINT AS ones_in_window FROM f")
def _(spark, d):
    return sketches.exact_window(flows(spark, d), "row_id", "is_attack", 2000)


_DGIM = "n AS (SELECT coalesce(sum(is_attack), 0)::BIGINT AS n FROM (SELECT is_attack FROM f ORDER BY row_id DESC LIMIT 2000)), l AS (SELECT n, CAST(floor(log2(n + 1)) AS BIGINT) AS levels FROM n)"
_SIZES = "flatten(list_transform(range(0, levels), lambda i: CASE WHEN ((n + 1) >> i) & 1 = 1 THEN [1::BIGINT << i, 1::BIGINT << i] ELSE [1::BIGINT << i] END))"


# Buckets of a window that starts empty are the digits (1 or 2) of the number of ones.
@query("dgim", f', {_DGIM} SELECT 2000::BIGINT AS "window", n AS exact, n - CASE WHEN n > 0 THEN (1::BIGINT << (levels - 1)) // 2 ELSE 0 END AS estimate, {_SIZES} AS buckets FROM l')
def _(spark, d):
    return sketches.dgim_window(flows(spark, d), "row_id", "is_attack", 2000)


@query("dgim_histogram", f", {_DGIM} SELECT size, count(*) AS buckets FROM (SELECT unnest({_SIZES}) AS size FROM l) GROUP BY size")
def _(spark, d):
    out = sketches.dgim_window(flows(spark, d), "row_id", "is_attack", 2000)
    return out.select(F.explode("buckets").alias("size")).groupBy("size").agg(F.count("*").alias("buckets"))


@query("reservoir", "SELECT row_id, Label, md5('42:' || row_id::VARCHAR) AS reservoir_key FROM f ORDER BY reservoir_key, row_id LIMIT 200")
def _(spark, d):
    return sketches.reservoir(flows(spark, d).select("row_id", "Label"), "row_id", 200)


# Order and sets


@query("recent_events", "SELECT row_id, ts, Src_IP, Dst_Port, Country, Label FROM f ORDER BY row_id DESC LIMIT 12")
def _(spark, d):
    return serving.recent(flows(spark, d))


@query("first_rows", "SELECT row_id, Label FROM f ORDER BY row_id LIMIT 500")
def _(spark, d):
    return relational.first_rows(flows(spark, d).select("row_id", "Label"), "row_id", 500)


@query("exact_sample", "SELECT row_id, Label FROM f ORDER BY md5('42:' || row_id::VARCHAR), row_id LIMIT 1000")
def _(spark, d):
    return relational.sampled(flows(spark, d).select("row_id", "Label"), 1000, "row_id")


@query("shuffled", "SELECT row_id, Label FROM f")
def _(spark, d):
    return relational.shuffled(flows(spark, d).select("row_id", "Label"), "row_id", 7)


@query("first_appearances", "SELECT Src_IP, min(row_id) AS first_seen FROM f GROUP BY Src_IP")
def _(spark, d):
    return relational.first_appearances(flows(spark, d), "Src_IP", "row_id")


@query("union_all", "SELECT ioc_value, source FROM i UNION ALL SELECT ioc_value, 'copy' AS source FROM i")
def _(spark, d):
    one = indicators(spark, d).select("ioc_value", "source")
    return one.unionByName(one.withColumn("source", F.lit("copy")))


@query("set_sizes", "SELECT n_nationkey, len(list_distinct(list_concat(a, b)))::INTEGER AS both_or_either, len(list_intersect(a, b))::INTEGER AS both, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS first_only FROM (SELECT n_nationkey, list_distinct([n_nationkey % 3, n_regionkey, 7]) AS a, list_distinct([n_regionkey, n_nationkey % 5]) AS b FROM nation)", prefix=False)
def _(spark, d):
    sets = read(spark, d, "nation").selectExpr("n_nationkey", "array_distinct(array(n_nationkey % 3, n_regionkey, 7)) AS a", "array_distinct(array(n_regionkey, n_nationkey % 5)) AS b")
    return sets.select("n_nationkey", F.size(F.array_union("a", "b")).alias("both_or_either"), F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("first_only"))


@query("ranked", "SELECT Src_IP, n, row_number() OVER (ORDER BY n DESC, Src_IP)::INTEGER AS rank FROM (SELECT Src_IP, count(*) AS n FROM f GROUP BY 1) ORDER BY rank LIMIT 15")
def _(spark, d):
    return relational.ranked(relational.counted(flows(spark, d), ["Src_IP"], "n"), [F.desc("n"), "Src_IP"], 15)


# Similarity

_URL = "lower(regexp_replace(coalesce(url, ''), '^\\s+|\\s+$', '', 'g'))"
_SHINGLES = f"s AS (SELECT page_id, CASE WHEN length(u) < 3 THEN [u] ELSE list_distinct(list_transform(range(1, length(u) - 1), lambda i: substr(u, i, 3))) END AS sh FROM (SELECT page_id, {_URL} AS u FROM pages))"
_SIGS = f"g AS (SELECT page_id, sh, [" + ", ".join(f"list_min(list_transform(sh, lambda x: {_H.format(s=j, v='x')}))" for j in range(48)) + "] AS sig FROM s)"
_ONE = "u AS (SELECT *, min(page_id) OVER (PARTITION BY list_sort(sh)) AS rep FROM g), o AS (SELECT page_id, sh, sig FROM u WHERE page_id = rep)"
_MET = f"{_ONE}, m AS (SELECT page_id, b, list_slice(sig, 4 * b + 1, 4 * b + 4) AS key FROM o, (SELECT unnest(range(0, 12)) AS b)), q AS (SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM m x JOIN m y ON x.b = y.b AND x.key = y.key AND x.page_id < y.page_id)"
_PAIRS = "pr AS (SELECT a, b, round(exact, 6) AS exact, round(estimated, 6) AS estimated FROM (SELECT a, b, len(list_intersect(x.sh, y.sh)) / len(list_distinct(list_concat(x.sh, y.sh))) AS exact, len(list_filter(list_zip(x.sig, y.sig), lambda p: p[1] = p[2])) / 48.0 AS estimated FROM q JOIN o x ON x.page_id = a JOIN o y ON y.page_id = b) WHERE exact >= 0.55)"


@query("shingles", f", {_SHINGLES} SELECT page_id, len(sh)::INTEGER AS n_shingles, list_sort(sh) AS shingles FROM s")
def _(spark, d):
    out = read(spark, d, "pages").select("page_id", similarity.shingles(F.col("url")).alias("sh"))
    return out.select("page_id", F.size("sh").alias("n_shingles"), F.sort_array("sh").alias("shingles"))


@query("jaccard", f", {_SHINGLES} SELECT x.page_id, round(len(list_intersect(x.sh, y.sh)) / len(list_distinct(list_concat(x.sh, y.sh))), 6) AS jaccard FROM s x JOIN s y ON y.page_id = x.page_id + 1")
def _(spark, d):
    one = read(spark, d, "pages").select("page_id", similarity.shingles(F.col("url")).alias("sa"))
    other = one.select((F.col("page_id") - 1).alias("page_id"), F.col("sa").alias("sb"))
    return one.join(other, "page_id").select("page_id", F.round(similarity.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


@query("minhash_sig", f", {_SHINGLES}, {_SIGS} SELECT page_id, sig FROM g")
def _(spark, d):
    return similarity.signatures(read(spark, d, "pages"), "page_id", "url").select(F.col("id").alias("page_id"), "sig")


@query("minhash_pairs", f", {_SHINGLES}, {_SIGS}, {_MET}, {_PAIRS} SELECT * FROM pr")
def _(spark, d):
    out = similarity.pairs(similarity.signatures(read(spark, d, "pages"), "page_id", "url"))
    # Not F.round, which makes decimal text of every number.
    return out.select("a", "b", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("exact", "estimated")))


@query("minhash_members", f", {_SHINGLES} SELECT page_id AS id, min(page_id) OVER (PARTITION BY list_sort(sh)) AS rep FROM s")
def _(spark, d):
    return similarity.members(similarity.shingled(read(spark, d, "pages"), "page_id", "url"))


_STARS = """e AS MATERIALIZED (SELECT a, list(b) AS nb FROM (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY a),
w AS MATERIALIZED (SELECT page_id, coalesce(nb, []) AS nb, row_number() OVER (ORDER BY page_id) AS rn FROM o LEFT JOIN e ON a = page_id),
st AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS covered, NULL::BIGINT AS seed UNION ALL
  SELECT w.rn, CASE WHEN list_contains(covered, page_id) THEN covered ELSE list_concat(covered, [page_id], nb) END, CASE WHEN list_contains(covered, page_id) THEN NULL ELSE page_id END FROM st JOIN w ON w.rn = st.rn + 1),
sm AS (SELECT seed, unnest(list_concat([page_id], nb)) AS rep FROM st JOIN w ON seed = page_id)"""


@query("minhash_clusters", f"WITH RECURSIVE {_SHINGLES}, {_SIGS}, {_MET}, {_PAIRS}, {_STARS} SELECT seed, u.page_id AS member FROM sm JOIN u USING (rep)", prefix=False)
def _(spark, d):
    signed = settle(similarity.signatures(read(spark, d, "pages"), "page_id", "url").drop("text"), "signed")
    own = similarity.members(signed)
    return similarity.clusters(signed).select("seed", F.col("member").alias("rep")).join(own, "rep").select("seed", F.col("id").alias("member"))


_ASKED = "https://thther.example.org/en/685"
_SIGS64 = "g AS (SELECT page_id, url, sh, [" + ", ".join(f"list_min(list_transform(sh, lambda x: {_H.format(s=j, v='x')}))" for j in range(64)) + "] AS sig FROM s)"


@query("minhash_query", f", s AS (SELECT page_id, url, CASE WHEN length(u) < 3 THEN [u] ELSE list_distinct(list_transform(range(1, length(u) - 1), lambda i: substr(u, i, 3))) END AS sh FROM (SELECT page_id, url, {_URL} AS u FROM (SELECT page_id, url FROM pages UNION ALL SELECT -1, '{_ASKED}'))), {_SIGS64}, k AS (SELECT * FROM g WHERE page_id = -1), c AS (SELECT g.page_id AS matched_id, g.url AS matched_document, len(list_intersect(g.sh, k.sh)) / len(list_distinct(list_concat(g.sh, k.sh))) AS exact_jaccard, len(list_filter(list_zip(g.sig, k.sig), lambda p: p[1] = p[2])) / 64.0 AS minhash_estimated_jaccard, len(list_filter(range(0, 16), lambda b: list_slice(g.sig, 4 * b + 1, 4 * b + 4) = list_slice(k.sig, 4 * b + 1, 4 * b + 4))) AS shared FROM g, k WHERE g.page_id <> -1) SELECT matched_id, matched_document, round(exact_jaccard, 6) AS exact_jaccard, round(minhash_estimated_jaccard, 6) AS minhash_estimated_jaccard FROM c WHERE shared > 0 AND exact_jaccard >= 0.5")
def _(spark, d):
    signed = similarity.signatures(read(spark, d, "pages"), "page_id", "url", hashes=64)
    out = similarity.query(signed, F.lit(_ASKED))
    return out.withColumns({c: F.round(c, 6) for c in ("exact_jaccard", "minhash_estimated_jaccard")})


# Mining

_TX = f"d AS (SELECT list_sort(list_distinct(tags)) AS t, count(*) AS n FROM ({_TAGS}) GROUP BY 1), n AS (SELECT sum(n) AS n FROM d), ix AS (SELECT unnest(range(1, 8)) AS i)"
_SETS = """s AS (
  SELECT items, sum(n)::BIGINT AS cnt FROM (
    SELECT [t[x.i]] AS items, n FROM d, ix x WHERE x.i <= len(t)
    UNION ALL SELECT [t[x.i], t[y.i]], n FROM d, ix x, ix y WHERE x.i < y.i AND y.i <= len(t)
    UNION ALL SELECT [t[x.i], t[y.i], t[z.i]], n FROM d, ix x, ix y, ix z WHERE x.i < y.i AND y.i < z.i AND z.i <= len(t)
  ) GROUP BY items
), fs AS (SELECT items, cnt, cnt / n AS support FROM s, n WHERE cnt >= 0.015 * n - 1e-9)"""


@query("itemsets", f", {_TX}, {_SETS} SELECT items, cnt, round(support, 6) AS support FROM fs")
def _(spark, d):
    return mining.itemsets(_tagged(spark, d), "tags", 0.015).withColumn("support", F.round("support", 6))


@query("assoc_rules", f""", {_TX}, {_SETS}, r AS (
  SELECT items, support AS s, unnest(list_filter(items, lambda x: starts_with(x, 'TARGET_'))) AS consequent FROM fs WHERE len(items) > 1
), a AS (
  SELECT *, list_filter(items, lambda x: x <> consequent) AS antecedent FROM r
) SELECT antecedent, consequent, round(s, 4) AS support, round(s / x.support, 4) AS confidence, round(s / x.support / y.support, 2) AS lift,
  concat('When ', array_to_string(list_transform(antecedent, lambda i: replace(i, '_', ' ')), ' and '), ', the flow is ', substr(consequent, 8), ' with confidence ', format('{{:.1f}}', 100 * s / x.support), '%') AS plain_english
FROM a JOIN fs x ON x.items = antecedent JOIN fs y ON y.items = [consequent] WHERE s / x.support >= 0.1 - 1e-12""")
def _(spark, d):
    return mining.rules(mining.itemsets(_tagged(spark, d), "tags", 0.015), 0.1)


# Graph

_EDGES = """e AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1.5::DOUBLE AS weight FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 2.0 FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.2 FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1.0 FROM nation WHERE n_nationkey % 3 = 0
)"""
_KIND = "CASE substr(node, 1, 1) WHEN 'c' THEN 'customer' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' ELSE 'region' END"


def _edges(spark, d):
    c, s, n = (read(spark, d, t) for t in ("customer", "supplier", "nation"))
    return graph.merged_edges(
        c.selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst", "1.5D AS weight"),
        s.selectExpr("concat('s', s_suppkey) AS src", "concat('n', s_nationkey) AS dst", "2.0D AS weight"),
        n.selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst", "1.2D AS weight"),
        n.filter("n_nationkey % 3 = 0").selectExpr("concat('r', n_regionkey) AS src", "concat('n', n_nationkey) AS dst", "1.0D AS weight"),
    )


def _kinds(ranks):
    return ranks.select("node", F.expr(_KIND).alias("type"))


def _ranks_sql(rounds: int) -> str:
    out = [f"{_EDGES}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), k AS (SELECT count(*) AS n FROM v), w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), r0 AS (SELECT node, 1.0 / n AS p FROM v, k)"]
    for i in range(rounds):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / n + 0.85 * (coalesce(g.p, 0) + l.p / n) AS p FROM v CROSS JOIN k CROSS JOIN (SELECT coalesce(sum(p), 0) AS p FROM r{i} WHERE node NOT IN (SELECT src FROM e)) l LEFT JOIN (SELECT dst, sum(p * share) AS p FROM r{i} JOIN w ON r{i}.node = w.src GROUP BY dst) g ON v.node = g.dst)")
    return ", ".join(out)


_ROUNDS = 15


@query("edge_endpoints", f", {_EDGES} SELECT src, dst FROM e WHERE src LIKE 'n%' AND dst LIKE 'r%'")
def _(spark, d):
    e = _edges(spark, d)
    top = graph.vertices(e).filter("node LIKE 'n%' OR node LIKE 'r%'")
    return graph.between(e, top).filter("src LIKE 'n%'").select("src", "dst")


@query("graph_edges", f", {_EDGES} SELECT src, dst, weight FROM e")
def _(spark, d):
    return _edges(spark, d)


@query("pagerank_top", f", {_ranks_sql(_ROUNDS)}, dg AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node) SELECT row_number() OVER (ORDER BY round(p, 8) DESC, node)::INTEGER AS rank, node, {_KIND} AS type, round(p, 8) AS pagerank, in_degree, out_degree FROM r{_ROUNDS} JOIN dg USING (node) ORDER BY round(p, 8) DESC, node LIMIT 15")
def _(spark, d):
    e = _edges(spark, d)
    ranks = graph.pagerank(e, iterations=_ROUNDS, tolerance=0)
    return graph.top_nodes(ranks, e, _kinds(ranks), 15)


@query("graph_export", f", {_ranks_sql(_ROUNDS)} SELECT node, {_KIND} AS type, CAST(trunc(10 + round(p, 8) * 300) AS INTEGER) AS size, CAST(greatest(9, least(36, trunc(10 + round(p, 8) * 300))) AS INTEGER) AS shown_size, CASE {_KIND} WHEN 'region' THEN '#d62728' WHEN 'nation' THEN '#1f77b4' ELSE '#7f7f7f' END AS colour FROM r{_ROUNDS}")
def _(spark, d):
    ranks = graph.pagerank(_edges(spark, d), iterations=_ROUNDS, tolerance=0)
    return graph.export_nodes(ranks, _kinds(ranks)).withColumns(relational.node_style())


_AT = "SELECT node, round(cos(length(node)), 6) AS x, round(sin(length(node)), 6) AS y FROM"


@query("edge_positions", f", {_EDGES}, v AS ({_AT} (SELECT src AS node FROM e UNION SELECT dst FROM e)) SELECT src, dst, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM e JOIN v p ON src = p.node JOIN v q ON dst = q.node")
def _(spark, d):
    e = _edges(spark, d)
    at = graph.vertices(e).selectExpr("node", "round(cos(length(node)), 6) AS x", "round(sin(length(node)), 6) AS y")
    return graph.placed_edges(e, at)


_THREATS = """ti AS (SELECT *, CASE WHEN contains(ioc, 'http') OR contains(ioc, '/') THEN CASE WHEN len(string_split(ioc, '/')) > 2 THEN string_split(ioc, '/')[3] ELSE substr(ioc, 1, 30) END END AS domain
  FROM (SELECT ioc_id, trim(ioc_value) AS ioc, trim(malware_family) AS fam, trim(ip_address) AS ip FROM i) WHERE fam <> ''),
tx AS (
  SELECT 'IP: ' || ip AS src, 'Family: ' || fam AS dst, 'belongs_to_family' AS relation, 1.5::DOUBLE AS weight, ioc_id AS pos FROM ti WHERE ip <> ''
  UNION ALL SELECT 'Domain: ' || domain, 'Family: ' || fam, 'delivers_malware', 2.0, ioc_id FROM ti WHERE domain IS NOT NULL
  UNION ALL SELECT 'Domain: ' || domain, 'IP: ' || ip, 'resolves_to', 1.2, ioc_id FROM ti WHERE domain IS NOT NULL AND ip <> ''
  UNION ALL SELECT 'IP: ' || Src_IP, concat('Target: ', Dst_IP, ':', Dst_Port), 'attacks_via_' || Label, 1.0, row_id FROM f WHERE is_attack = 1 AND Dst_Port IS NOT NULL
), e AS (SELECT src, dst, max_by(relation, pos) AS relation, max_by(weight, pos) AS weight FROM tx GROUP BY src, dst),
kd AS (SELECT node, CASE WHEN starts_with(node, 'Family: ') THEN 'malware_family' WHEN starts_with(node, 'Domain: ') THEN 'c2_domain' WHEN starts_with(node, 'Target: ') THEN 'victim_asset' WHEN bool_or(attacker) THEN 'attacker_ip' ELSE 'c2_ip' END AS type FROM (SELECT src AS node, starts_with(relation, 'attacks_via_') AS attacker FROM e UNION ALL SELECT dst, false FROM e) GROUP BY node)"""


def _threats(spark, d):
    return graph.settle(graph.threat_edges(indicators(spark, d), flows(spark, d).filter("Dst_Port IS NOT NULL")), "threats")


@query("threat_graph", f", {_THREATS} SELECT src, dst, relation, weight FROM e")
def _(spark, d):
    return _threats(spark, d)


@query("threat_nodes", f", {_THREATS} SELECT node, type FROM kd")
def _(spark, d):
    return graph.threat_kinds(_threats(spark, d))


@query("threat_kingpins", f", {_ranks_sql(_ROUNDS).replace(_EDGES, _THREATS)}, dg AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node) SELECT row_number() OVER (ORDER BY round(p, 8) DESC, node)::INTEGER AS rank, node, type, round(p, 8) AS pagerank, in_degree, out_degree FROM r{_ROUNDS} JOIN dg USING (node) JOIN kd USING (node) ORDER BY round(p, 8) DESC, node LIMIT 15")
def _(spark, d):
    e = _threats(spark, d)
    return graph.top_nodes(graph.pagerank(e, iterations=_ROUNDS, tolerance=0), e, graph.threat_kinds(e), 15)


# Machine learning

FEATURES = ["Flow_Duration", "Total_Fwd_Packets", "Total_Backward_Packets", "Packet_Length_Mean", "SYN_Flag_Count", "Dst_Port", "Hour"]
_Z = "z AS (SELECT row_id, Label, is_attack, " + ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in FEATURES) + " FROM f)"


@query("zscore", f", {_Z} SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM z")
def _(spark, d):
    return ml.zscored(flows(spark, d), FEATURES).select("row_id", *(F.round(c, 6).alias(c) for c in FEATURES))


@query("covariance", f", {_Z} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(avg({a} * {b}), 5) AS cov FROM z" for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
def _(spark, d):
    return ml.covariance(ml.zscored(flows(spark, d), FEATURES), FEATURES).withColumn("cov", F.round("cov", 5))


@query("pca")
def _(spark, d):
    return ml.pca(flows(spark, d), FEATURES, ["row_id", "Label", "is_attack", "Dst_Port", "Flow_Duration"])[0]


@query("kmeans")
def _(spark, d):
    return ml.kmeans_search(flows(spark, d), FEATURES, (3, 6))[0].select("row_id", "Label", "cluster")


@query("cluster_profiles")
def _(spark, d):
    return ml.cluster_profiles(ml.kmeans_search(flows(spark, d), FEATURES, (3, 6))[0])


_GIVEN = "c AS (SELECT *, row_id % 4 AS cluster FROM f), z AS (SELECT cluster, count(*) AS size, avg(Flow_Duration) AS d, avg(Total_Fwd_Packets) + avg(Total_Backward_Packets) AS p, avg(Packet_Length_Mean) AS l, 100 * avg((SYN_Flag_Count > 0)::INTEGER) AS syn FROM c GROUP BY cluster), t AS (SELECT cluster, Label, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, Label) AS k FROM c GROUP BY cluster, Label)"


@query("cluster_profiles_given", f", {_GIVEN} SELECT cluster AS cluster_id, size, round(100.0 * size / sum(size) OVER (), 1)::DOUBLE AS pct_total, Label AS dominant_label, round(100.0 * n / size, 1)::DOUBLE AS purity_pct, CASE WHEN contains(Label, 'DDoS') OR (p > 100 AND syn > 50) THEN 'High' WHEN contains(Label, 'PortScan') OR (d < 100 AND syn > 50) THEN 'Medium' WHEN contains(Label, 'Botnet') OR d > 10000 THEN 'High' WHEN contains(Label, 'Brute') OR contains(Label, 'Patator') THEN 'High' ELSE 'Low' END AS risk_level, round(d, 1) AS avg_duration_ms, round(p, 1) AS avg_packets, round(l, 1) AS avg_packet_length, round(syn, 1) AS syn_flag_pct, concat('Mostly ', Label, ' traffic') AS interpretation FROM z JOIN t USING (cluster) WHERE k = 1")
def _(spark, d):
    return ml.cluster_profiles(flows(spark, d).withColumn("cluster", F.col("row_id") % 4))


@query("cluster_counts", "SELECT row_id % 4 AS cluster, Label, count(*) AS n FROM f GROUP BY ALL")
def _(spark, d):
    return relational.counted(flows(spark, d).withColumn("cluster", F.col("row_id") % 4), ["cluster", "Label"], "n")


@query("anomaly_metrics_given", "SELECT count(*) AS rows, count(*) FILTER (WHERE row_id % 20 = 3) AS anomalies, count(*) FILTER (WHERE row_id % 20 = 3 AND is_attack = 1) AS attacks_among_anomalies, round(100.0 * count(*) FILTER (WHERE row_id % 20 = 3 AND is_attack = 1) / greatest(1, count(*) FILTER (WHERE row_id % 20 = 3)), 1)::DOUBLE AS purity_pct FROM f")
def _(spark, d):
    return ml.anomaly_metrics(flows(spark, d).withColumn("is_anomaly", (F.col("row_id") % 20 == 3).cast("int")))


_FEW = "x AS (SELECT row_id, Label, Flow_Duration / 1000.0 AS a, Packet_Length_Mean / 10.0 AS b FROM f ORDER BY md5('42:' || row_id::VARCHAR), row_id LIMIT 400)"


@query("silhouette", f", {_FEW}, y AS (SELECT p.row_id, p.Label AS own, q.Label AS other, sum(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))) AS s, count(*) AS n FROM x p, x q GROUP BY ALL), v AS (SELECT row_id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = other THEN n END) AS n, min(CASE WHEN own <> other THEN s / n END) AS b FROM y GROUP BY row_id) SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM v")
def _(spark, d):
    rows = relational.sampled(flows(spark, d).selectExpr("row_id", "Label", "Flow_Duration / 1000.0D AS a", "Packet_Length_Mean / 10.0D AS b"), 400, "row_id")
    return spark.createDataFrame([(round(ml.silhouette_of(rows, ["a", "b"], "Label", "row_id"), 6),)], "silhouette double")


_NEAR = "p AS (SELECT c_custkey AS id, c_acctbal / 60.0 AS x, c_nationkey::DOUBLE AS y FROM customer), nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25), core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 4)"
_DBSCAN = f"RECURSIVE {_NEAR}, ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach AS (SELECT id, id AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id AND reach.root < ce.b), lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM lab)), al AS (SELECT nb.a AS id, min(num.c) AS c FROM nb JOIN lab ON nb.b = lab.id JOIN num USING (root) WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a UNION ALL SELECT lab.id, num.c FROM lab JOIN num USING (root)), res AS (SELECT p.id, coalesce(al.c, -1)::BIGINT AS cluster FROM p LEFT JOIN al ON p.id = al.id)"


@query("dbscan", f"WITH {_DBSCAN} SELECT id, cluster FROM res", prefix=False)
def _(spark, d):
    return _dbscan(spark, d)


def _dbscan(spark, d):
    points = read(spark, d, "customer").selectExpr("c_custkey AS id", "c_acctbal / 60.0D AS x", "CAST(c_nationkey AS DOUBLE) AS y")
    return ml.dbscan(points, "id", ["x", "y"], 1.5, 4)


@query("dbscan_summary", f"WITH {_DBSCAN} SELECT count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS clusters, count(*) FILTER (WHERE cluster = -1) AS noise, round(100.0 * count(*) FILTER (WHERE cluster = -1) / greatest(1, count(*)), 2) AS noise_pct FROM res", prefix=False)
def _(spark, d):
    return ml.dbscan_summary(_dbscan(spark, d))


@query("anomalies")
def _(spark, d):
    return ml.anomalies(flows(spark, d), FEATURES, "row_id").select("row_id", "anomaly_label", "anomaly_score", "is_anomaly")


@query("anomaly_metrics")
def _(spark, d):
    return ml.anomaly_metrics(ml.anomalies(flows(spark, d), FEATURES, "row_id", ["is_attack"]))


# Windows over time (batch form of the streaming plans)


@query("tumbling_rates", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, Label, count(*) AS n, {_mean('Packet_Length_Mean')} AS avg_len FROM f GROUP BY ALL")
def _(spark, d):
    return windows.tumbling(flows(spark, d), "ts", "1 hour", "Label", "Packet_Length_Mean")


@query("sliding_rates", "SELECT w AS window_start, count(*) AS n, sum(is_attack)::BIGINT AS attacks FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' * k AS w, is_attack FROM f, (SELECT unnest(range(0, 6)) AS k)) GROUP BY w")
def _(spark, d):
    return windows.sliding(flows(spark, d), "ts", "6 hours", "1 hour", "is_attack")


@query("session_windows", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s", prefix=False)
def _(spark, d):
    return windows.sessions(read(spark, d, "events"), "ts", "30 minutes", "user_id")


@query("interval_join", "SELECT a.row_id, b.event_id FROM f a JOIN events e ON a.row_id = e.event_id JOIN events b ON b.user_id = e.user_id AND b.event_type = 'view' AND b.ts >= e.ts AND b.ts <= e.ts + INTERVAL '6 hours' WHERE a.is_attack = 1")
def _(spark, d):
    rows = read(spark, d, "events")
    hits = rows.filter("event_type = 'error'").select(F.col("event_id").alias("row_id"), "user_id", "ts")
    views = rows.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("seen"))
    return windows.joined(hits, views, "user_id", "ts", "seen", "6 hours").select("row_id", "event_id")


# Sources and plans


@query("feed_scan", "SELECT split_part(line, ',', 2) AS ip, split_part(line, ',', 3) AS family FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN '# comment' ELSE concat('t,10.0.0.', CAST(s_suppkey AS VARCHAR), ',fam', CAST(s_nationkey AS VARCHAR)) END AS line FROM supplier) WHERE NOT starts_with(line, '#')", prefix=False)
def _(spark, d):
    lines = read(spark, d, "supplier").selectExpr("CASE WHEN s_suppkey % 5 = 0 THEN '# comment' ELSE concat('\"t\",\"10.0.0.', s_suppkey, '\",\"fam', s_nationkey, '\"') END AS value")
    return feeds.parse_feed(lines)


_ADDRESS = "concat('{a}.', id % 8 + 10, '.', id % {b}, '.', id % 5 + 1)"
_MADE = "50 + row % 50 AS confidence, TIMESTAMP '2024-01-01' + to_hours(row % 720) AS first_seen"
_LISTS = " UNION ALL ".join([
    f"SELECT concat({_ADDRESS.format(a=45, b=240)}, ':', 443 + id % 3) AS ioc_value, 'ip:port' AS ioc_type, {_ADDRESS.format(a=45, b=240)} AS ip_address, 443 + id % 3 AS port, 'botnet_cc' AS threat_type, concat('family', id % 6) AS malware_family, 'controllers' AS source, 'command server' AS description, {_MADE} FROM (SELECT range % 240 AS id, range AS row FROM range(1200)) WHERE row < 240",
    f"SELECT concat('http://site', id, '.example/', id % 13), 'url', {_ADDRESS.format(a=91, b=250)}, 80, 'malware_download', concat('family', id % 6), 'downloads', 'harmful link', {_MADE} FROM (SELECT range AS id, range AS row FROM range(800))",
    f"SELECT concat('CVE-2024-', 1000 + row), 'cve', '', 0, 'exploit', 'none', 'vulnerabilities', 'known flaw', {_MADE} FROM (SELECT range AS row FROM range(7))",
    f"SELECT {_ADDRESS.format(a=185, b=690)}, 'ip', {_ADDRESS.format(a=185, b=690)}, 22, 'brute_force', 'guesser', 'guessers', 'password guessing', {_MADE} FROM (SELECT range % 690 AS id, range AS row FROM range(1500)) WHERE row < 690",
])


@query("synthetic_indicators", _LISTS, prefix=False)
def _(spark, d):
    return generate.indicator_rows(spark)


@query("synthetic_flows")
def _(spark, d):
    return generate.flow_rows(spark, 50_000, read(spark, d, "supplier").selectExpr("concat('10.9.', s_suppkey % 250, '.', s_nationkey) AS ip"))


def _listing(rows: tuple, names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({names})"


@query("knowledge", _listing(feeds.KNOWLEDGE, "attack, mitre_id, severity, explanation, defence, analogy, impact"), prefix=False)
def _(spark, d):
    return feeds.knowledge(spark)


@query("algorithm_notes", _listing(feeds.NOTES, "algorithm, title, question, how, analogy"), prefix=False)
def _(spark, d):
    return feeds.algorithm_notes(spark)


_FM_ATTACKERS = _FM.replace("SELECT DISTINCT l_partkey FROM lineitem", "SELECT DISTINCT Src_IP AS l_partkey FROM f WHERE is_attack = 1")


@query("gold_summary", f", {_DGIM}, {_FM_ATTACKERS} SELECT count(*) AS total_flow_logs, coalesce(sum(is_attack), 0)::BIGINT AS total_attack_logs, (SELECT count(*) FROM f WHERE Src_IP IN (SELECT trim(ip_address) FROM i WHERE ioc_type IN ('ip', 'ip:port'))) AS headline_feed_matches, count(DISTINCT CASE WHEN is_attack = 1 THEN Src_IP END) AS flajolet_martin_exact, (SELECT count(*) FROM i) AS threat_iocs_tracked, (SELECT count(*) FROM ({_LISTED})) AS threat_ips_indexed, (SELECT round_even(median(m), 0)::BIGINT FROM (SELECT seed // 8 AS g, avg(pow(2.0, register) / 0.77351) AS m FROM r GROUP BY 1)) AS flajolet_martin_estimate, (SELECT n - CASE WHEN n > 0 THEN (1::BIGINT << (levels - 1)) // 2 ELSE 0 END FROM l) AS dgim_sliding_window_count FROM f")
def _(spark, d):
    return medallion.headline(flows(spark, d), indicators(spark, d))


@query("summary_document")
def _(spark, d):
    return medallion.summary(flows(spark, d), indicators(spark, d))


@query("sketch_memory")
def _(spark, d):
    return medallion.memory(flows(spark, d), indicators(spark, d))


@query("sketch_accuracy")
def _(spark, d):
    return medallion.accuracy(flows(spark, d), indicators(spark, d))


for _name, (_function, _) in QUERIES.items():
    _function.__name__ = _name
