"""What the operators share: reading a table, settling an intermediate result, packing rows by key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import discard, settle, shared_dir
from tidemark.functions.shipping import ship

#: Odd multipliers and shifts of the 64-bit finaliser (public domain constants of splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


__all__ = ["discard", "mix", "settle", "shared_dir", "ship", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 in, uint64 out, the input is left alone."""
    h = h ^ (h >> _S30)
    h *= _M1
    h ^= h >> _S27
    h *= _M2
    h ^= h >> _S31
    return h


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
