"""The read queries over materialised tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational, sketches


def check_ips(asked: DataFrame, key: str, indicators: DataFrame) -> DataFrame:
    """Details of listed addresses; nulls, and ``listed`` false, for others."""
    details = indicators.filter(F.col("ioc_type").isin("ip", "ip:port")).select("ioc_id", "ip_address", "threat_type", "malware_family", "confidence")
    return relational.lookup(asked, key, details, "ip_address", ["ioc_id"]).drop("ioc_id")


def recent(flows: DataFrame, n: int = 12) -> DataFrame:
    return relational.last_rows(flows.select("row_id", "ts", "Src_IP", "Dst_Port", "Country", "Label"), "row_id", n)


class IndicatorFilter:
    """A Bloom filter of listed addresses on the driver, complete before anyone can see it.

    Its positions are at most as many as the filter has bits, a size fixed when it is made.
    """

    def __init__(self, indicators: DataFrame, rate: float = 0.01):
        listed = indicators.filter(F.col("ioc_type").isin("ip", "ip:port")).select("ip_address").distinct()
        self.bits, self.hashes = sketches.bloom_size(max(1000, listed.count()), rate)
        self._set = bytearray(-(-self.bits // 8))
        for r in sketches.bloom_build(listed, "ip_address", self.bits, self.hashes).collect():
            self._set[r.pos >> 3] |= 1 << (r.pos & 7)

    @property
    def memory_bytes(self) -> int:
        return len(self._set)

    def maybe(self, ip: str) -> bool:
        """False is certain; true may be a false positive."""
        for seed in range(self.hashes):
            digest = hashlib.md5(f"{seed // 4}:{ip.strip()}".encode()).hexdigest()  # as functions.hashing.h32
            pos = int(digest[8 * (seed % 4) :][:8], 16) % self.bits
            if not self._set[pos >> 3] & 1 << (pos & 7):
                return False
        return True


class Api:
    """What a dashboard asks for, over the folder that the medallion plan wrote. Missing tables give None.

    Tables are opened once. Those of a bounded size are kept in memory; :meth:`refresh` lets go of all.
    """

    #: Gold tables whose size doesn't grow with the flows.
    SMALL = ("gold/gold_summary", "gold/attacks_by_type", "gold/top_attacked_ports")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._open: dict[str, DataFrame] = {}
        self._filter: IndicatorFilter | None = None

    def _table(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        if name not in self._open:
            try:
                found = self.spark.read.parquet(f"{self.root}/{name}")
            except AnalysisException:
                return None
            self._open[name] = found.persist() if name in self.SMALL else found
        return self._open[name]

    def refresh(self) -> None:
        for table in self._open.values():
            table.unpersist()
        self._open, self._filter = {}, None

    def summary(self) -> DataFrame | None:
        return self._table("gold/gold_summary")

    def attacks(self) -> DataFrame | None:
        return self._table("gold/attacks_by_type")

    def ports(self) -> DataFrame | None:
        return self._table("gold/top_attacked_ports")

    def geo(self) -> DataFrame | None:
        return self._table("gold/geo_threat_map")

    def clusters(self, n: int = 500) -> DataFrame | None:
        found = self._table("gold/pca_clusters")
        return None if found is None else relational.first_rows(found, "row_id", n)

    def stream(self, n: int = 12) -> DataFrame | None:
        found = self._table("silver/logs")
        return None if found is None else recent(found, n)

    def check_ip(self, ip: str) -> DataFrame | None:
        """Details of an address. The filter answers for most that aren't listed; the table is read for the others only."""
        found = self._table("silver/threat_iocs")
        if found is None:
            return None
        if self._filter is None:
            self._filter = IndicatorFilter(found)
        asked = self.spark.createDataFrame([(ip.strip(),)], "ip string")
        return check_ips(asked, "ip", found if self._filter.maybe(ip) else found.limit(0))
