"""Best-fit packing of documents into sequences, with several capacities.

A document becomes its token ids and an end id; only one longer than a sequence is cut. A piece asks
for tokens, for one document place and for attention cost (the square of its length), so its demand
depends on its length alone. That makes the choice of bins small whatever the corpus: the pieces are
counted by length (as many counts as a sequence has tokens), vector best-fit places the longest
lengths first, whole groups of equal bins at a time, and the plan says for the r-th piece of a length
which bin and which place it gets. The r-th piece is found without one task seeing all pieces of a
length: they are dealt over buckets by hash, ranked within, and the buckets' counts are summed up.

Defined results: a null or empty text is a piece of the end id alone; ties are ordered by all columns;
repeated rows each get a place; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import settle, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that one task ranks, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. ``docs`` and ``attention`` (sum of squared lengths) default to what tokens imply."""

    tokens: int = 2048
    docs: int | None = None
    attention: int | None = None
    #: Weights of tokens, documents and attention in the score.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    #: "norm": least weighted norm of what is left; "dot": greatest weighted dot product of demand and rest.
    score: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.docs or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


@dataclass
class Plan:
    """Steps: the pieces of ``length`` with ranks from ``rank`` on go to bins from ``bin`` on, one each, at ``offset``."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def add(self, *step: int) -> None:
        for column, value in zip((self.length, self.rank, self.bin, self.offset), step):
            column.append(value)


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> Plan:
    """Vector best-fit, longest first, over (length -> number of pieces)."""
    limits, weights, out = capacity.limits(), np.array(capacity.weights), Plan()
    rest = np.zeros((0, 3), dtype=np.int64)  # of each group of equal bins
    first, size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for length in sorted(counts, reverse=True):
        need, left, rank = np.array([length, 1, length * length]), counts[length], 0
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((rest >= need).all(axis=1))
            if len(fits):
                after = (rest[fits] - need) / limits
                score = -(weights * after**2).sum(axis=1) if capacity.score == "norm" else (weights * (need / limits) * (rest[fits] / limits)).sum(axis=1)
                g = int(fits[np.argmax(score)])
            else:  # one group of new bins, as many as the rest of this length can fill
                each = int((limits // need).min())
                rest = np.vstack([rest, limits])
                first, size = np.append(first, out.bins), np.append(size, -(-left // each))
                out.bins += int(size[-1])
                g = len(size) - 1
            each = int((rest[g] // need).min())  # the bin just used stays the tightest while it has room
            full, some = min(int(size[g]), left // each), 0
            if full < size[g]:
                some = left - full * each if full * each < left else 0
            used = capacity.tokens - int(rest[g][0])
            for k in range(each if full else 0):
                out.add(length, rank + k * full, int(first[g]), used + k * length)
            rank += full * each
            for k in range(some):
                out.add(length, rank + k, int(first[g]) + full, used + k * length)
            rank += some
            left -= full * each + some
            old, start, n = rest[g].copy(), int(first[g]), int(size[g])
            parts = [(old - each * need, start, full), (old - some * need, start + full, 1 if some else 0), (old, start + full + bool(some), n - full - bool(some))]
            parts = [p for p in parts if p[2] and p[0][0] > 0]
            keep = np.arange(len(size)) != g
            rest = np.vstack([rest[keep], *[p[0][None] for p in parts]])
            first = np.concatenate([first[keep], [p[1] for p in parts]]).astype(np.int64)
            size = np.concatenate([size[keep], [p[2] for p in parts]]).astype(np.int64)
    return out


def pieces(docs: DataFrame, tokens: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and the checksum of the ids of every piece."""

    def cut(e: bpe.ForcedBoundaryEncoder, batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        ids_of = batch.column(0).cast(pa.int64()).to_pylist()
        end = np.array([end_id], dtype="<u4").tobytes()
        doc, piece, start, length, crc = [], [], [], [], []
        for d, t in zip(ids_of, texts):
            raw = e.encode_bytes(t) + end
            for k, at in enumerate(range(0, len(raw), 4 * tokens)):
                part = raw[at : at + 4 * tokens]
                doc.append(d)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bpe.encoded(docs, ["doc_id"], PIECES, cut, path)


def pack(docs: DataFrame, capacity: Capacity = Capacity(), end_id: int = 0, path: str | None = None) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``."""
    found = settle(pieces(docs, capacity.tokens, end_id, path), "pieces")
    total = found.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``tokens`` rows
    made = plan(counts, capacity)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    steps = np.array([made.length, made.rank, made.bin, made.offset], dtype=np.int64).reshape(4, -1)
    steps = steps[:, np.lexsort((steps[1], steps[0]))]
    # One number orders steps by length and rank; ranks stay below the number of pieces.
    span = max(total, 1)
    keys = steps[0] * span + steps[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(steps[2][at] + rank - steps[1][at]), pa.array(steps[3][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": (op9, None)}
