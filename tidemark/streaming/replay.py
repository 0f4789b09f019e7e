"""Replaying a table as a stream, sketches kept up to date by batches, and a stateful sliding window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.shipping import ship
from tidemark.operators import sketches
from tidemark.operators.relational import stamped


def replay(spark: SparkSession, directory: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of JSON files, some in each batch, stamped with the time of processing."""
    return stamped(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(directory))


def to_json(stream: DataFrame, directory: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """New files for each batch: a reader never sees half an event. A batch at once after the other until all is read, or one
    ``every`` so often ("2 seconds"), until the query is stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.format("json").option("path", directory).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class LiveSketches:
    """Count-Min, Flajolet-Martin, Bloom and reservoir of a stream, as tables in ``directory``.

    Every batch's sketch is merged into the last one and written under the batch's number, so a batch
    that runs twice gives the same table: sums start from the number before.
    """

    def __init__(self, directory: str, key: str, width: int, depth: int, bits: int, hashes: int, capacity: int = 200):
        self.directory, self.key, self.width, self.depth, self.bits, self.hashes, self.capacity = directory, key, width, depth, bits, hashes, capacity

    def path(self, kind: str, batch: int) -> str:
        return f"{self.directory}/{kind}/{batch}"

    def update(self, df: DataFrame, batch: int) -> None:
        spark, k = df.sparkSession, self.key
        fresh = {
            "cms": sketches.cms_build(df, k, self.width, self.depth),
            "fm": sketches.fm_registers(df, k),
            "bloom": sketches.bloom_build(df, k, self.bits, self.hashes),
            "reservoir": df.select(k, F.md5(F.concat(F.lit("42:"), F.col(k).cast("string"))).alias("rk")),
        }
        for kind, new in fresh.items():
            if batch:
                new = new.unionByName(spark.read.parquet(self.path(kind, batch - 1)))
            if kind == "cms":
                new = new.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))
            elif kind == "fm":
                new = new.groupBy("seed").agg(F.max("register").alias("register"))
            elif kind == "bloom":
                new = new.distinct()
            else:
                new = new.orderBy("rk", k).limit(self.capacity)
            new.write.mode("overwrite").parquet(self.path(kind, batch))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dgim_stream(stream: DataFrame, key: str, order: str, bit: str, window: int) -> DataFrame:
    """key, time and the estimate of ones among the key's last ``window`` bits, after each batch. State: the buckets."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        time, ends, sizes = state.get if state.exists else (0, [], [])
        d = sketches.Dgim(window, list(zip(ends, sizes)), time)
        rows = pd.concat(list(parts)).sort_values(order)  # a batch has no order of its own
        for b in rows[bit]:
            d.update(int(b))
        state.update((d.time, [e for e, _ in d.buckets], [s for _, s in d.buckets]))
        yield pd.DataFrame({"key": [str(k[0])], "time": [d.time], "estimate": [d.count()]})

    ship(stream.sparkSession)
    grouped = stream.groupBy(key)
    return grouped.applyInPandasWithState(step, "key string, time long, estimate long", "time long, ends array<long>, sizes array<long>", "update", "NoTimeout")
