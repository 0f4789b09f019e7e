"""Windows over event time. The same functions take a table or a stream (with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import exact_avg


def tumbling(df: DataFrame, ts: str, length: str, key: str, value: str) -> DataFrame:
    out = df.groupBy(F.window(ts, length).alias("w"), key).agg(F.count("*").alias("n"), exact_avg(value).alias("avg_len"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "avg_len")


def sliding(df: DataFrame, ts: str, length: str, step: str, flag: str) -> DataFrame:
    out = df.groupBy(F.window(ts, length, step).alias("w")).agg(F.count("*").alias("n"), F.sum(flag).alias("attacks"))
    return out.select(F.col("w.start").alias("window_start"), "n", "attacks")


def sessions(df: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def on_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """With a watermark: state is kept, and events are waited for, so long after the latest event seen; later ones are dropped by
    the aggregates and joins that follow. Without effect on a table."""
    return stream.withWatermark(ts, delay)


def joined(left: DataFrame, right: DataFrame, key: str, ts: str, other_ts: str, within: str) -> DataFrame:
    """Rows of the right at most ``within`` after a left row of the same key. Of two streams, both need a watermark, which bounds the state."""
    near = (F.col(other_ts) >= F.col(ts)) & (F.col(other_ts) <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & near).drop("__key")
