"""The driver's tables as a flow log and an indicator list.

``flows`` gives the 20 columns of a flow log from ``events``; ``indicators`` gives the 10 columns of an
indicator list from ``supplier``. Both are plain projections, so filters and column choices reach the
Parquet scan. ``FLOWS_SQL`` and ``INDICATORS_SQL`` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Country, code, latitude, longitude, network of the geographic dimension.
COUNTRIES = (
    ("United States", "US", 37.7749, -122.4194, "AS15169 Google LLC"),
    ("China", "CN", 39.9042, 116.4074, "AS4134 Chinanet"),
    ("Russia", "RU", 55.7558, 37.6173, "AS12389 Rostelecom"),
    ("Germany", "DE", 52.5200, 13.4050, "AS24940 Hetzner Online"),
    ("Netherlands", "NL", 52.3676, 4.9041, "AS60781 LeaseWeb"),
    ("Brazil", "BR", -23.5505, -46.6333, "AS28573 Claro"),
    ("India", "IN", 19.0760, 72.8777, "AS55836 Reliance Jio"),
    ("United Kingdom", "GB", 51.5074, -0.1278, "AS2856 British Telecom"),
    ("Iran", "IR", 35.6892, 51.3890, "AS58224 TIC"),
    ("North Korea", "KP", 39.0392, 125.7625, "AS131279 Star JV"),
)
#: Traffic labels.
LABELS = ("BENIGN", "DDoS", "PortScan", "Botnet", "Brute Force", "Web Attack")
PORTS = (22, 80, 443, 3389, 21, 53, 8080, 5555)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_dimension(spark: SparkSession) -> DataFrame:
    """Ten rows: Country, Country_Code, base_lat, base_lon, ASN."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(COUNTRIES)], "geo_id long, Country string, Country_Code string, base_lat double, base_lon double, ASN string")


def _pick(values: tuple, index: str, kind: str = "string") -> str:
    quoted = [f"'{v}'" if kind == "string" else str(v) for v in values]
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quoted)) + " END"


def _flow_columns(k: str, hour: str, day: str) -> dict[str, str]:
    """The projection, in SQL that Spark and DuckDB share; ``k`` is the number in ``props``."""
    label = "CASE WHEN event_type <> 'error' THEN 0 ELSE 1 + event_id % 5 END"
    geo = "user_id % 10"
    return {
        "row_id": "event_id",
        "Flow_Duration": "event_id * 37 % 15000",
        "Total_Fwd_Packets": "event_id * 7 % 120 + 1",
        "Total_Backward_Packets": "event_id * 3 % 40",
        "Packet_Length_Mean": "40.0 + value * 2.0",
        "SYN_Flag_Count": "event_id % 2",
        "Dst_Port": f"CAST({_pick(PORTS, f'({k}) % 8', 'long')} AS BIGINT)",
        "Src_IP": "concat('10.', CAST(user_id % 7 AS VARCHAR(20)), '.', CAST(user_id % 250 AS VARCHAR(20)), '.', CAST(user_id % 31 AS VARCHAR(20)))",
        "Dst_IP": "concat('192.168.1.', CAST(event_id % 20 AS VARCHAR(20)))",
        "ts": "ts",
        "Hour": hour,
        "DayOfWeek": day,
        "Country": _pick(tuple(c[0] for c in COUNTRIES), geo),
        "Country_Code": _pick(tuple(c[1] for c in COUNTRIES), geo),
        "ASN": _pick(tuple(c[4] for c in COUNTRIES), geo),
        "Latitude": f"CAST({_pick(tuple(c[2] for c in COUNTRIES), geo, 'double')} AS DOUBLE) + (event_id % 30) / 20.0 - 0.75",
        "Longitude": f"CAST({_pick(tuple(c[3] for c in COUNTRIES), geo, 'double')} AS DOUBLE) + (event_id % 30) / 20.0 - 0.75",
        "Label": _pick(LABELS, f"({label})"),
        "is_attack": "CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT)",
    }


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _flow_columns("try_cast(get_json_object(props, '$.k') AS BIGINT)", "CAST(hour(ts) AS BIGINT)", "date_format(ts, 'EEEE')")
    return read(spark, sf_dir, "events").selectExpr(*(f"{sql} AS {name}" for name, sql in columns.items()))


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


FLOWS_SQL = _select(_flow_columns("CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)", "CAST(extract(hour FROM ts) AS BIGINT)", "dayname(ts)"), "events")

_IP = "concat('10.', CAST(s_suppkey * 3 % 7 AS VARCHAR(20)), '.', CAST(s_suppkey * 3 % 250 AS VARCHAR(20)), '.', CAST(s_suppkey * 3 % 31 AS VARCHAR(20)))"
_INDICATOR_COLUMNS = {
    "ioc_id": "s_suppkey",
    "ioc_type": _pick(("ip", "ip:port", "url", "cve"), "s_suppkey % 4"),
    "ip_address": f"CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE {_IP} END",
    "port": "CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 1000 + s_suppkey % 5 END",
    "ioc_value": f"CASE s_suppkey % 4 WHEN 0 THEN concat(' ', {_IP}, ' ') WHEN 1 THEN concat({_IP}, ':', CAST(1000 + s_suppkey % 5 AS VARCHAR(20))) WHEN 2 THEN concat('http://', {_IP}, '/x') ELSE concat('CVE-2024-', CAST(1000 + s_suppkey % 9 AS VARCHAR(20))) END",
    "threat_type": _pick(("botnet_cc", "malware_download", "exploit"), "s_suppkey % 3"),
    "malware_family": "concat('family', CAST(s_nationkey AS VARCHAR(20)))",
    "confidence": "CAST(50 + s_suppkey % 50 AS BIGINT)",
    "source": "concat('feed', CAST(s_suppkey % 3 AS VARCHAR(20)))",
    "description": "s_name",
}


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(*(f"{sql} AS {name}" for name, sql in _INDICATOR_COLUMNS.items()))


INDICATORS_SQL = _select(_INDICATOR_COLUMNS, "supplier")
