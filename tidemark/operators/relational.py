"""Projections, filters, joins, aggregates, orders and set operations of the flow and indicator tables.

Every function takes the columns it works on, so any table can stand for the flow log. Rows have no
order of their own: what depends on order takes an ordinal column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import h32, trimmed

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


# Projections


def normalised_names(df: DataFrame) -> DataFrame:
    """Column names stripped, with blanks and slashes as underscores."""
    return df.toDF(*(c.strip().replace(" ", "_").replace("/", "_") for c in df.columns))


def attack_flag(label: str = "Label", benign: str = "BENIGN") -> Column:
    """1, 0, or null where the label is."""
    return (F.col(label) != benign).cast("long")


def seconds(duration_ms: Column) -> Column:
    return F.greatest(F.lit(0.001), duration_ms / 1000.0)


def rates(df: DataFrame, forward: str, backward: str, length: str, duration: str) -> DataFrame:
    """With bytes_per_s and packets_per_s, to two places."""
    packets, s = F.col(forward) + F.col(backward), seconds(F.col(duration))
    return df.withColumns({"bytes_per_s": F.round(packets * F.col(length) / s, 2), "packets_per_s": F.round(packets / s, 2)})


def time_parts(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"Hour": F.hour(ts).cast("long"), "DayOfWeek": F.date_format(ts, "EEEE"), "Timestamp": F.date_format(ts, "yyyy-MM-dd HH:mm:ss")})


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("stream_timestamp", F.current_timestamp())


def later(ts: Column, secs: Column) -> Column:
    """A timestamp some seconds later."""
    return ts + F.make_interval(secs=secs)


#: How the levels of :func:`posture` are shown, and what an unknown level is shown as.
SHOWN = {"Low": ("LOW RISK", "#10B981"), "Medium": ("ELEVATED", "#F59E0B"), "High": ("HIGH RISK", "#FF2A85"), "Critical": ("CRITICAL", "#F43F5E")}


def posture(matches: Column) -> Column:
    return F.when(matches > 100, "High").otherwise("Medium")


def shown(level: Column) -> tuple[Column, Column]:
    """(text, colour) of a level, looked up in a map; those of Medium for an unknown one."""
    look = lambda k: F.coalesce(F.create_map(*(F.lit(x) for name, both in SHOWN.items() for x in (name, both[k])))[level], F.lit(SHOWN["Medium"][k]))
    return look(0), look(1)


def prefixed(prefix: str, column: str) -> Column:
    """A label like "Group 3"; null for null."""
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def has(df: DataFrame, *columns: str) -> bool:
    """Whether a table has all these columns: what stands on a missing one is left out."""
    return set(columns) <= set(df.columns)


def geo_enriched(df: DataFrame, key: str, label: str, geo: DataFrame, places: dict[str, Sequence[int]], jitter: float = 1.5) -> DataFrame:
    """With Country, Country_Code, ASN, Latitude and Longitude of a place (``geo_id``) that the key's hash picks from its label's, moved by up to
    ``jitter`` degrees each way. The same key gives the same place on every run; a label without places gives nulls."""
    picks = F.create_map(*(x for name, ids in places.items() for x in (F.lit(name), F.array(*(F.lit(int(i)) for i in ids)))))[F.col(label)]
    moved = lambda seed: (h32(seed, F.col(key)) / float(1 << 32) * 2 - 1) * jitter
    rows = df.withColumn("__p", picks).withColumn("__p", F.get("__p", F.pmod(h32(0, F.col(key)), F.greatest(F.size("__p"), F.lit(1))).cast("int")))
    both = rows.join(F.broadcast(geo.withColumnRenamed("geo_id", "__g")), F.col("__p") == F.col("__g"), "left")  # ten rows
    return both.withColumns({"Latitude": F.round(F.col("base_lat") + moved(1), 4), "Longitude": F.round(F.col("base_lon") + moved(2), 4)}).drop("__p", "__g", "base_lat", "base_lon")


def node_style(size: str = "size", kind: str = "type") -> dict[str, Column]:
    """Size within 9 to 36, and a colour by kind."""
    colour = F.when(F.col(kind) == "region", "#d62728").when(F.col(kind) == "nation", "#1f77b4").otherwise("#7f7f7f")
    return {"shown_size": F.greatest(F.lit(9), F.least(F.lit(36), F.col(size))), "colour": colour}


def kilobytes(bytes_: Column) -> Column:
    return F.round(bytes_ / 1024.0, 2)


def filled(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls replaced by defaults; a zero stays a zero."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# Aggregates


def exact_avg(column: str) -> Column:
    """The mean from an exact decimal sum (4 places): the same whatever the order of the rows."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column)


def by_label(df: DataFrame, label: str, means: dict[str, str]) -> DataFrame:
    """count and the named means for each label, most frequent first."""
    return df.groupBy(label).agg(F.count("*").alias("count"), *(exact_avg(c).alias(n) for n, c in means.items())).orderBy(F.desc("count"), label)


def top_counts(df: DataFrame, key: str, n: int, out: str = "count") -> DataFrame:
    """The most frequent keys, ties by key. Null keys don't count."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out)).orderBy(F.desc(out), key).limit(n)


def counted(df: DataFrame, keys: Sequence[str], out: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def heatmap_pivot(df: DataFrame, day: str = "DayOfWeek", hour: str = "Hour") -> DataFrame:
    """A row for each weekday that occurs, Monday first, and a column h0 to h23 of counts."""
    wide = df.groupBy(day).pivot(hour, list(range(24))).count().fillna(0)
    order = F.array_position(F.array(*(F.lit(d) for d in WEEKDAYS)), F.col(day))
    return wide.select(F.col(day), *(F.col(str(h)).alias(f"h{h}") for h in range(24))).orderBy(order)


def geo_map(df: DataFrame, place: Sequence[str], latitude: str, longitude: str, label: str, places: int = 0) -> DataFrame:
    """Counts by place, label and coordinates rounded to a grid, so that jitter doesn't split places."""
    # + 0.0: no negative zero
    grid = df.withColumns({latitude: F.round(latitude, places) + 0.0, longitude: F.round(longitude, places) + 0.0})
    return counted(grid, [*place, latitude, longitude, label], "attack_count")


def label_shares(df: DataFrame, label: str) -> DataFrame:
    return counted(df, [label]).withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6))


def exact_distinct(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("distinct_count"))


# Joins


def semi_matches(df: DataFrame, key: str, listed: DataFrame, listed_key: str, anti: bool = False) -> DataFrame:
    """Rows whose key is (or isn't) listed; both sides trimmed. Spark broadcasts the list only below its own size limit."""
    keys = listed.filter(F.col(listed_key).isNotNull()).select(trimmed(F.col(listed_key)).alias("__k")).distinct()
    out = df.withColumn("__k", trimmed(F.col(key))).join(keys, "__k", "left_anti" if anti else "left_semi")
    return out.drop("__k")


def lookup(asked: DataFrame, key: str, details: DataFrame, details_key: str, order: Sequence[str]) -> DataFrame:
    """Every asked key with the first matching row's details, or nulls and ``listed`` false. Nothing is made up."""
    first = details.withColumn("__n", F.row_number().over(Window.partitionBy(details_key).orderBy(*order))).filter("__n = 1").drop("__n")
    first = first.withColumnRenamed(details_key, "__k")
    return asked.join(first, F.col(key) == F.col("__k"), "left").withColumn("listed", F.col("__k").isNotNull()).drop("__k")


# Order


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows, in ascending order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key: the first by the ordinal."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def first_appearances(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they first appear."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), uniform, and the same on every run: least hash of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a random but repeatable order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)


def ranked(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows by the order, numbered from 1. Only these rows meet in one task."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
