"""Reading and writing: indicator feeds, CSV, JSON and Parquet, and static knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The cleaned flow log. One schema for every reader and writer.
FLOW_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("row_id", "Flow_Duration", "Total_Fwd_Packets", "Total_Backward_Packets")]
    + [T.StructField(n, T.DoubleType()) for n in ("Flow_Bytes_s", "Flow_Packets_s", "Packet_Length_Mean")]
    + [T.StructField(n, T.LongType()) for n in ("SYN_Flag_Count", "Dst_Port")]
    + [T.StructField(n, T.StringType()) for n in ("Src_IP", "Dst_IP")]
    + [T.StructField("ts", T.TimestampNTZType()), T.StructField("Hour", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("DayOfWeek", "Country", "Country_Code", "ASN")]
    + [T.StructField(n, T.DoubleType()) for n in ("Latitude", "Longitude")]
    + [T.StructField("Label", T.StringType()), T.StructField("is_attack", T.LongType())]
)


def parse_feed(lines: DataFrame, column: str = "value") -> DataFrame:
    """ip, family of a comma-separated feed: no comments, quotes stripped, at least two fields; field 1 is the address, 2 the family."""
    parts = F.split(F.regexp_replace(F.col(column), '"', ""), ",")
    kept = lines.filter(~F.col(column).startswith("#") & (F.trim(column) != ""))
    return kept.select(parts.alias("p")).filter(F.size("p") >= 2).select(F.trim(F.get("p", F.lit(1))).alias("ip"), F.trim(F.coalesce(F.get("p", F.lit(2)), F.lit("unknown"))).alias("family"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A landed feed file."""
    return parse_feed(spark.read.text(path))


def fetch_feed(spark: SparkSession, url: str, timeout: float = 5.0, otherwise: DataFrame | None = None) -> DataFrame:
    """A feed from a web address, fetched by the driver (a list of some thousand lines); ``otherwise``, where that fails and one is given."""
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            lines = answer.read().decode("utf-8", "replace").splitlines()
    except OSError:
        if otherwise is None:
            raise
        return otherwise
    return parse_feed(spark.createDataFrame([(x,) for x in lines], "value string"))


def read_flows_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """With a header and an explicit schema: no extra pass to infer one."""
    df = spark.read.schema(FLOW_SCHEMA).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_snapshot(df: DataFrame, path: str, order: str, n: int = 1000) -> None:
    """The first ``n`` rows by an ordinal."""
    df.orderBy(order).limit(n).write.mode("overwrite").json(path)


#: Names, technique numbers and severities; the words are this library's own.
KNOWLEDGE = (
    ("DDoS", "T1498", "High", "Many machines send more requests than a service can answer.", "Rate limits, scrubbing, anycast", "A crowd in a doorway", "The service can't be reached"),
    ("PortScan", "T1046", "Medium", "Someone tries every door to see which ones open.", "Filtering, scan detection", "Trying each handle in a street", "Open services become known"),
    ("Botnet", "T1071", "High", "Infected machines call home for orders.", "Egress filtering, sinkholes", "Sleepers waiting for a call", "Machines act for someone else"),
    ("Brute Force", "T1110", "High", "Passwords are tried one after the other.", "Lock-outs, second factors", "Every key of a large ring", "Accounts are taken over"),
    ("Web Attack", "T1190", "High", "A request carries code the server should never run.", "Input checks, patches", "An order hidden in a form", "Data leaks or is altered"),
    ("C2 Beacon", "T1071.001", "Critical", "A regular sign of life to a controller.", "Beacon detection, blocking", "A lamp in a window each night", "Control from outside persists"),
    ("Malware URL", "T1204", "High", "A link leads to a harmful download.", "URL filtering", "A gift with a hidden guest", "Harmful code is started"),
    ("Exploit", "T1203", "Critical", "A known flaw is used before it is mended.", "Patching, isolation", "A lock whose trick is known", "Code runs on the host"),
    ("BENIGN", "-", "None", "Ordinary traffic.", "None needed", "Everyday traffic on a road", "None"),
)

#: Names of the algorithms; the words are this library's own.
NOTES = (
    ("Bloom Filter", "Membership in little memory", "Is this address on the list?", "Every listed item sets a few bits; an item with an unset bit is surely not listed.", "A guest list of ink marks"),
    ("DGIM", "Counting in a sliding window", "How many attacks were there lately?", "Ones are kept in buckets of doubling sizes; the oldest counts by half.", "Coins changed into ever larger notes"),
    ("Flajolet-Martin", "Counting distinct items", "How many different attackers were there?", "The longest run of trailing zero bits among hashes grows with their number.", "Guessing tosses from the longest run of heads"),
    ("Count-Min Sketch", "Counting frequent items", "Which ports are hit most?", "Items share counters in several rows; the least of an item's counters is never too low.", "Several tally sheets, the lowest wins"),
    ("MinHash + LSH", "Finding texts that are alike", "Which addresses belong to one campaign?", "Minima of hashed shingles agree as often as the sets overlap; bands of them make candidates.", "Comparing a few marks of fingerprints"),
    ("PageRank", "Finding nodes that matter", "Which server holds a network together?", "Rank flows along links until it settles; nodes that many ranked ones point to gather it.", "Asking whom everyone calls"),
)


def knowledge(spark: SparkSession) -> DataFrame:
    """Nine rows: attack, mitre_id, severity, explanation, defence, analogy, impact."""
    return spark.createDataFrame(KNOWLEDGE, "attack string, mitre_id string, severity string, explanation string, defence string, analogy string, impact string")


def algorithm_notes(spark: SparkSession) -> DataFrame:
    """Six rows: algorithm, title, question, how, analogy."""
    return spark.createDataFrame(NOTES, "algorithm string, title string, question string, how string, analogy string")


def replay_files(df: DataFrame, directory: str, files: int, key: str, seed: int = 7, max_events: int | None = None) -> None:
    """A table (or ``max_events`` rows of it, drawn by hash) dealt into files in random order, for a stream to read one by one."""
    at = F.xxhash64(F.col(key), F.lit(seed))
    df = df if max_events is None else df.orderBy(at, key).limit(max_events)
    df.withColumn("__f", F.pmod(at, F.lit(files)).cast("int")).repartition(files, "__f").drop("__f").write.mode("overwrite").json(directory)
