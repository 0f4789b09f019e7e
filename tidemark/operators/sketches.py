"""Mergeable sketches as relations: every sketch is an aggregate that combines map-side.

Bloom filter: the set of bit positions. Flajolet-Martin: the greatest number of trailing zeros for each
seed. Count-Min: a count for each row and column. Reservoir: the rows of least random key. Sliding
window: buckets of powers of two.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import h32, trailing_zeros, trimmed
from tidemark.functions.shipping import ship

Hash = Callable


# Bloom filter


def bloom_size(expected: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions). Bad arguments count as 1000 items and a rate of 0.01."""
    n = expected if expected > 0 else 1000
    p = rate if 0 < rate < 1 else 0.01
    bits = max(64, int(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, int(bits / n * math.log(2)))


def bloom_rate(bits: int, hashes: int, inserted: int) -> float:
    """The rate of false positives to expect."""
    return (1 - math.exp(-hashes * inserted / bits)) ** hashes if inserted else 0.0


def bloom_positions(df: DataFrame, key: str, bits: int, hashes: int, keep: Iterable[str] = (), h: Hash = h32) -> DataFrame:
    each = F.array(*(F.pmod(h(seed, F.col("__k")), F.lit(bits)) for seed in range(hashes)))
    return df.withColumn("__k", trimmed(F.col(key))).select(*keep, F.explode(each).alias("pos"))


def bloom_build(df: DataFrame, key: str, bits: int, hashes: int, h: Hash = h32) -> DataFrame:
    """The set bits: pos."""
    return bloom_positions(df.filter(F.col(key).isNotNull()), key, bits, hashes, h=h).distinct()


#: A filter of up to so many bits (1 MB) travels to every task as one row; a larger one is met by a join on positions.
SENT_BITS = 1 << 23


def bloom_words(built: DataFrame, bits: int) -> DataFrame:
    """One row: the filter as an array of 32 bits a number."""
    words = built.groupBy(F.floor(F.col("pos") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pos % 32 AS INT))")).alias("b"))
    dense = built.sparkSession.range(-(-bits // 32)).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", "b"))).alias("x")).select(F.col("x.b").alias("words"))  # bits / 32 numbers


def bloom_probe(df: DataFrame, key: str, built: DataFrame, bits: int, hashes: int, h: Hash = h32) -> DataFrame:
    """Distinct keys and whether the filter may hold them; never a false no. Up to ``SENT_BITS`` the filter is one row that every
    task tests in place."""
    keys = df.filter(F.col(key).isNotNull()).select(key).distinct()
    if bits > SENT_BITS:
        hit = bloom_positions(keys, key, bits, hashes, [key], h).distinct().join(built.withColumn("hit", F.lit(1)), "pos", "left")
        return hit.groupBy(key).agg((F.count("hit") == F.count("*")).alias("maybe"))
    each = F.array(*(F.pmod(h(seed, F.col("__k")), F.lit(bits)) for seed in range(hashes)))
    held = lambda p: F.col("words")[F.floor(p / 32)].bitwiseAND(F.expr("1L") * F.pow(F.lit(2), F.pmod(p, F.lit(32))).cast("long")) != 0
    both = keys.withColumn("__k", trimmed(F.col(key))).join(F.broadcast(bloom_words(built, bits)))  # one row of bits / 4 bytes
    return both.select(key, F.forall(each, held).alias("maybe"))


# Flajolet-Martin


#: Of each hexadecimal digit: the more trailing zero bits, the smaller the code.
_ZEROS = ("0123456789abcdef", "0434243414342434")


def fm_registers(df: DataFrame, key: str, hashes: int = 32, h: Hash | None = None) -> DataFrame:
    """seed, register. One aggregate of ``hashes`` extremes; the exchange is a row for each task.

    With the md5 family no hash becomes a number: digests are coded so that the least code, read from the end, has the most trailing zeros.
    """
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    if h is None:
        blocks = -(-hashes // 4)
        keys = keys.select(*(F.reverse(F.translate(F.md5(F.concat(F.lit(f"{b}:"), F.col("k").cast("string"))), *_ZEROS)).alias(f"c{b}") for b in range(blocks)))
        row = keys.agg(*(F.min(F.substring(f"c{s // 4}", 25 - 8 * (s % 4), 8)).alias(f"r{s}") for s in range(hashes)))
        rest = lambda s: F.expr(f"trim(LEADING '0' FROM r{s})")
        value = lambda s: F.when(rest(s) == "", 32).otherwise((8 - F.length(rest(s))) * 4 + 4 - F.substring(rest(s), 1, 1).cast("int"))
        row = row.select(*(F.when(F.col(f"r{s}").isNotNull(), value(s)).cast("int").alias(f"r{s}") for s in range(hashes)))
    else:
        row = keys.agg(*(F.max(trailing_zeros(h(s, F.col("k")))).alias(f"r{s}") for s in range(hashes)))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.col(f"r{s}").alias("register")) for s in range(hashes))))
    return row.select(each.alias("x")).select("x.seed", "x.register").filter("register IS NOT NULL")


def fm_estimate(registers: DataFrame, hashes: int = 32, groups: int = 4) -> DataFrame:
    """Median over groups of the mean of 2**R / 0.77351; registers beyond whole groups are left out."""
    per = hashes // groups
    value = F.pow(F.lit(2.0), F.col("register")) / 0.77351
    means = registers.filter(F.col("seed") < per * groups).groupBy((F.col("seed") / per).cast("int").alias("g")).agg(F.avg(value).alias("m"))
    return means.agg(F.bround(F.median("m")).cast("long").alias("estimate"))


# Count-Min


def cms_size(epsilon: float = 0.005, delta: float = 0.01) -> tuple[int, int]:
    """(width, depth)."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def _cells(key: str, width: int, depth: int, h: Hash):
    return F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(h(r, F.col(key)), F.lit(width)).alias("col")) for r in range(depth))))


def cms_build(df: DataFrame, key: str, width: int, depth: int, h: Hash = h32) -> DataFrame:
    """row, col, cnt. Keys are counted first, so a frequent key is hashed once a task."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.select(_cells(key, width, depth, h).alias("x"), "n").groupBy("x.row", "x.col").agg(F.sum("n").alias("cnt"))


def cms_query(keys: DataFrame, key: str, sketch: DataFrame, width: int, depth: int, h: Hash = h32) -> DataFrame:
    """key, estimate: the least of its cells; 0 for a key whose cell is empty."""
    asked = keys.select(key).distinct().select(key, _cells(key, width, depth, h).alias("x")).select(key, "x.row", "x.col")
    return asked.join(sketch, ["row", "col"], "left").groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_top_k(keys: DataFrame, key: str, sketch: DataFrame, width: int, depth: int, k: int, h: Hash = h32) -> DataFrame:
    return cms_query(keys, key, sketch, width, depth, h).orderBy(F.desc("estimate"), key).limit(k)


def cms_merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


# Reservoir


def reservoir(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``k`` rows: those of least random key, so samples of parts merge into one of the whole."""
    return df.withColumn("reservoir_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("reservoir_key", key).limit(k)


# Sliding windows


class Dgim:
    """Counts the ones among the last ``window`` bits in O(log**2 window) space.

    A queue for each power of two holds the ends of its buckets. Of three buckets of a size the older two merge and keep the
    newer end; the oldest bucket counts by half. The estimate is within half of the true count.
    """

    def __init__(self, window: int = 1000, buckets: Iterable[tuple[int, int]] = (), time: int = 0):
        self.window, self.time = max(1, window), time
        self.ends: list[deque[int]] = []  # by power of two, newest first
        for end, size in buckets:
            while len(self.ends) < size.bit_length():
                self.ends.append(deque())
            self.ends[size.bit_length() - 1].append(end)

    @property
    def buckets(self) -> list[tuple[int, int]]:
        """(end, size), newest first."""
        return [(end, 1 << k) for k, queue in enumerate(self.ends) for end in queue]

    def update(self, bit: int) -> None:
        self.time += 1
        while self.ends and (not self.ends[-1] or self.ends[-1][-1] <= self.time - self.window):
            if self.ends[-1]:
                self.ends[-1].pop()
            else:
                self.ends.pop()
        end, k = self.time, 0
        while bit:
            if k == len(self.ends):
                self.ends.append(deque())
            queue = self.ends[k]
            queue.appendleft(end)
            if len(queue) < 3:
                return
            queue.pop()
            end, k = queue.pop(), k + 1

    def count(self, k: int | None = None) -> int:
        """Ones among the last ``k`` bits (the window, if none is given)."""
        since = self.time - min(k or self.window, self.window)
        sizes = [size for end, size in self.buckets if end > since]
        return sum(sizes) - sizes[-1] // 2 if sizes else 0

    def distribution(self) -> dict[int, int]:
        return {1 << k: len(queue) for k, queue in enumerate(self.ends) if queue}


def last_bits(df: DataFrame, order: str, bit: str, window: int) -> DataFrame:
    """The last ``window`` rows: a window never needs more."""
    return df.select(F.col(order).alias("ord"), F.col(bit).cast("int").alias("bit")).orderBy(F.desc("ord")).limit(window)


def dgim_window(df: DataFrame, order: str, bit: str, window: int) -> DataFrame:
    """window, estimate, exact and bucket sizes of the last ``window`` rows; one ordered fold over that many rows."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        d = Dgim(window)
        whole = pd.concat(rows).sort_values("ord") if rows else pd.DataFrame({"bit": []})
        for b in whole["bit"]:
            d.update(int(b))
        yield pd.DataFrame({"window": [window], "estimate": [d.count()], "exact": [int(whole["bit"].sum())], "buckets": [[s for _, s in d.buckets]]})

    ship(df.sparkSession)
    return last_bits(df, order, bit, window).coalesce(1).mapInPandas(fold, "window long, estimate long, exact long, buckets array<long>")


def running_ones(df: DataFrame, order: str, bit: str, block: int = 4096) -> DataFrame:
    """ord, bit, pos (from 1, by the ordinal) and ones up to it. ``order`` is a whole number that doesn't repeat.

    Running sums within blocks of the ordinal, then within blocks of blocks, until one is left: no task orders more
    than ``block`` rows, at any size.
    """
    rows = df.select(F.col(order).cast("long").alias("ord"), F.col(bit).cast("long").alias("bit"))
    low, high = rows.agg(F.min("ord"), F.max("ord")).first()
    rows = rows.withColumn("blk", F.floor((F.col("ord") - F.lit(low or 0)) / block))
    sums, levels, span = rows.groupBy("blk").agg(F.count("*").alias("n"), F.sum("bit").alias("s")), [], ((high or 0) - (low or 0)) // block
    while True:
        sums = sums.withColumn("up", F.floor(F.col("blk") / block))
        before = Window.partitionBy("up").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(sums.select("blk", "up", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0")))
        if not span:
            break
        sums, span = sums.groupBy(F.col("up").alias("blk")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")), span // block
    offsets = levels[-1].select("blk", "n0", "s0")
    for level in reversed(levels[:-1]):
        above = offsets.select(F.col("blk").alias("up"), F.col("n0").alias("n1"), F.col("s0").alias("s1"))
        offsets = level.join(above, "up").select("blk", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("s0") + F.col("s1")).alias("s0"))
    inside = Window.partitionBy("blk").orderBy("ord")
    rows = rows.withColumns({"pos": F.row_number().over(inside), "ones": F.sum("bit").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.join(offsets, "blk").select("ord", "bit", (F.col("pos") + F.col("n0")).alias("pos"), (F.col("ones") + F.col("s0")).alias("ones"))


def exact_window(df: DataFrame, order: str, bit: str, window: int) -> DataFrame:
    """ord and the exact number of ones among the last ``window`` rows up to it: a difference of two running sums."""
    sums = running_ones(df, order, bit)
    back = sums.select((F.col("pos") + window).alias("pos"), F.col("ones").alias("gone"))
    return sums.join(back, "pos", "left").select("ord", (F.col("ones") - F.coalesce("gone", F.lit(0))).alias("ones_in_window"))
