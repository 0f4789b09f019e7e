"""Seeded hash families.

``h32`` (the default) takes 32 bits of md5: one digest of ``block:value`` serves four seeds, seed s taking the
eight hexadecimal digits from place ``s % 4`` of block ``s // 4``. Any SQL engine can restate it, so sketches can be compared
value by value. ``fast32`` is the cheaper choice for production; ``murmur3_32`` is MurmurHash3 x86_32 with any seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship


def trimmed(col: Column) -> Column:
    """As text, without white space at either end."""
    return F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")


def digests(value: Column, seeds: int) -> Column:
    """An array of as many md5 digests as ``seeds`` seeds of ``h32`` need. Keep it in a column of its own, so that each is made once."""
    return F.array(*(F.md5(F.concat(F.lit(f"{block}:"), value.cast("string"))) for block in range(-(-seeds // 4))))


def picked(made: Column, seed: int) -> Column:
    """``h32`` of a seed from :func:`digests`, as eight hexadecimal digits: they sort like the numbers."""
    return F.substring(made[seed // 4], 1 + 8 * (seed % 4), 8)


def number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def h32(seed: int, value: Column) -> Column:
    return number(F.substring(F.md5(F.concat(F.lit(f"{seed // 4}:"), value.cast("string"))), 1 + 8 * (seed % 4), 8))


def fast32(seed: int, value: Column) -> Column:
    return F.xxhash64(F.lit(seed), value).bitwiseAND(F.lit(0xFFFFFFFF))


def trailing_zeros(h: Column) -> Column:
    """Of a 32-bit number; 32 for zero."""
    return F.when(h == 0, F.lit(32)).otherwise(F.bit_count((h.bitwiseAND(-h)) - F.lit(1)).cast("int"))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_32_of(values: pd.Series, seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 of the UTF-8 bytes of each text, all texts of a batch at a time; 0 for nulls. Multipliers and
    shifts are the algorithm's own (public domain, fixed values)."""
    c1, c2, five, more = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32(5), np.uint32(0xE6546B64)
    raw = [b"" if v is None else str(v).encode() for v in values]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.full(len(raw), seed & 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 1024)):  # texts of about the same length together
        wide = -(-int(sizes[part].max(initial=0)) // 4) * 4 + 4
        block = np.frombuffer(b"".join(raw[i].ljust(wide, b"\0") for i in part), dtype="<u4").reshape(len(part), wide // 4)
        h, n = out[part], sizes[part]
        for k in range(wide // 4):
            whole, tail = n >= 4 * k + 4, (n > 4 * k) & (n < 4 * k + 4)
            mixed = _rotl(block[:, k] * c1, 15) * c2
            h = np.where(whole, _rotl(h ^ mixed, 13) * five + more, np.where(tail, h ^ mixed, h))
        h = h ^ n.astype(np.uint32)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        out[part] = h
    return out


def murmur3_32(seed: int, value: Column) -> Column:
    """MurmurHash3 x86_32 as a number from 0 to 2**32 - 1; null for null. Spark's own ``hash`` differs where the bytes aren't a multiple of four."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(murmur3_32_of(v, seed).astype("int64")).where(v.notna().to_numpy(), None).astype("Int64")

    ship(SparkSession.active())
    return run(value.cast("string"))


def seeded(seed: int, value: Column, bound: int = 10_000_000, h=None) -> Column:
    """A hash below ``bound``."""
    return F.pmod((h or murmur3_32)(seed, value), F.lit(bound))
