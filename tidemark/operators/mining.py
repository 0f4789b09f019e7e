"""Transactions of tags, frequent itemsets of up to three items, and rules about targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import settle


def tags(port: Column, hour: Column, packets: Column, syn: Column, length: Column, label: Column) -> Column:
    """Tags and bounds. Tags of a flow: port class, time of day, volume, SYN, payload, target. Missing values: 0, hour 12, BENIGN."""
    port, hour = F.coalesce(port, F.lit(0)), F.coalesce(hour, F.lit(12))
    packets, syn, length, label = F.coalesce(packets, F.lit(0)), F.coalesce(syn, F.lit(0)), F.coalesce(length, F.lit(0)), F.coalesce(label, F.lit("BENIGN"))
    service = (
        F.when(port == 22, "port_22_SSH")
        .when(port.isin(80, 8080), "port_80_HTTP")
        .when(port.isin(443, 8443), "port_443_HTTPS")
        .when(port == 3389, "port_3389_RDP")
        .when(port.isin(21, 23), "port_insecure_telnet_ftp")
        .when(port == 53, "port_53_DNS")
        .otherwise("port_ephemeral")
    )
    time = F.when((hour >= 23) | (hour <= 5), "time_late_night").when(hour.between(9, 17), "time_business_hours").otherwise("time_evening")
    volume = F.when(packets > 100, "volume_massive_flood").when(packets < 4, "volume_micro_probe").otherwise("volume_moderate")
    payload = F.when(length < 60, "payload_tiny_header_only").when(length > 500, "payload_large_data")
    return F.array_compact(F.array(service, time, volume, F.when(syn > 0, "flag_syn_probe"), payload, F.concat(F.lit("TARGET_"), label)))


def itemsets(transactions: DataFrame, column: str, min_support: float) -> DataFrame:
    """items (sorted array of 1 to 3), cnt and support of those with at least ``min_support``.

    The transactions are read once: equal ones are counted, and the counts are written. Combinations are made inside each
    distinct transaction, from frequent single items only, and counted with partial aggregates; no join.
    """
    rows = transactions.select(F.sort_array(F.array_distinct(F.filter(column, lambda x: x.isNotNull()))).alias("t"))
    rows = settle(rows.groupBy("t").agg(F.count("*").alias("n")), "transactions")
    n = rows.agg(F.sum("n")).first()[0] or 0
    least = F.lit(float(n) * min_support - 1e-9)
    single = rows.select(F.explode("t").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("c")).filter(F.col("c") >= least)
    frequent = [r.i for r in single.select("i").collect()]  # 1 / min_support * items of a row, at most
    kept = rows.withColumn("t", F.array_intersect("t", F.array(*(F.lit(i) for i in sorted(frequent))).cast("array<string>")))
    two = "transform(filter(t, (y, j) -> j > i), y -> array(x, y))"
    three = "flatten(transform(filter(t, (y, j) -> j > i), y -> transform(filter(t, z -> z > y), z -> array(x, y, z))))"
    sets = F.expr(f"concat(transform(t, x -> array(x)), flatten(transform(t, (x, i) -> {two})), flatten(transform(t, (x, i) -> {three})))")
    out = kept.select(F.explode(sets).alias("items"), "n").groupBy("items").agg(F.sum("n").alias("cnt")).filter(F.col("cnt") >= least)
    return out.withColumn("support", F.col("cnt") / F.lit(float(max(n, 1))))


def rules(sets: DataFrame, min_confidence: float, target: str = "TARGET_") -> DataFrame:
    """Rules with one or two items in front and one target behind: support and confidence to 4 places, lift to 2."""
    sets = settle(sets, "sets")  # read three times
    whole = sets.filter(F.size("items") > 1).select("items", F.col("support").alias("s"), F.explode(F.filter("items", lambda i: i.startswith(target))).alias("consequent"))
    whole = whole.withColumn("antecedent", F.array_except("items", F.array("consequent"))).filter(~F.exists("antecedent", lambda i: i.startswith(target)))
    front = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("sf"))
    back = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("support").alias("sb"))
    both = whole.join(front, "antecedent").join(back, "consequent").withColumn("c", F.col("s") / F.col("sf")).filter(F.col("c") >= min_confidence - 1e-12)
    name = F.regexp_replace("consequent", f"^{target}", "")
    words = F.concat_ws(" and ", F.transform("antecedent", lambda i: F.replace(i, F.lit("_"), F.lit(" "))))
    text = F.concat(F.lit("When "), words, F.lit(", the flow is "), name, F.lit(" with confidence "), F.format_number(F.col("c") * 100, 1), F.lit("%"))
    out = both.select("antecedent", "consequent", F.round("s", 4).alias("support"), F.round("c", 4).alias("confidence"), F.round(F.col("c") / F.col("sb"), 2).alias("lift"), text.alias("plain_english"))
    return out.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent")
