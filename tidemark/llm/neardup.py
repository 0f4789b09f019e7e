"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: a damped term frequency (1 + ln n: a phrase said
a hundred times doesn't outweigh the text around it) times a smooth inverse document frequency.
Document frequencies are counted over all documents in a hashed table of ``BUCKETS``
numbers, whatever the corpus. Consistent weighted sampling gives ``BANDS * ROWS`` samples of a text;
two texts agree in a sample with a probability of their weighted Jaccard similarity. Texts that agree
in all samples of a band are candidates, and a candidate pair is a link when the weighted Jaccard
similarity of the two whole texts is at least ``threshold``. Classes are the connected components.

Texts with the same words are one text from the start (by a 128-bit hash), so groups of exact copies
cost nothing further. In a bucket not all pairs are made: one text from the middle of its group, the
pivot, is compared with all others, and those linked to it share its class. In a bucket of up to
``ALL_PAIRS`` texts, one that isn't linked to the pivot is compared with all others. In larger ones the
texts without a link ask, and only pairs that can be links are compared, which :func:`judged` tells exactly:

    Let M be the weight that two texts share, X, Y, P the weights of a text x without a link to the
    pivot p, of another text y and of p, and T = threshold / (1 + threshold). x and y are a link if and
    only if M(x, y) >= T (X + Y). What they share beyond what p has is at least T (X + Y) - M(x, p), which is
    slack - T (P - Y) with slack = T (X + P) - M(x, p) > 0. So unless y is lighter than p by
    slack / 2T, x and y share shingles that p lacks (or has less often) of a weight of slack / 2, and
    one of them is among the first of those of x, in any fixed order, whose weights add up to more than
    all of them less slack / 2.

So every text of a large bucket is indexed by what it has beyond the pivot, rarest shingles first, and
asks with that prefix. Groups of an index key of up to ``CROWD`` texts give pairs to verify. A text that asks
through a larger group, or has lighter texts to ask, is first compared with a few texts near
the pivot; one that is linked to none of them meets that group in blocks (:func:`crossed`).
So every link between texts that share a bucket joins their classes, whatever the bucket's size.
At 0.8 a pair shares one of the bands with a probability of 0.998.

Defined results: texts without words are copies of each other, a null text counts as empty; a text of
fewer than five words is one shingle; rows with a null id take no part and have a null class; the
class id is the smallest document id of the class; rows with the same id and different texts put these
texts into one class; an empty table gives no rows; extra columns are ignored; very long texts are
read whole; rows with one id and different texts are told apart by row and tied together in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mix, settle, table, text_or_empty
from .shingles import counted, parts

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Hashed document frequencies: 1 MB as weights.
BUCKETS = 1 << 18
#: How far the weight of the rarest shingle exceeds that of one that all documents have. Weights that
#: differ a lot would take the shared shingles of a large group of copies for unimportant.
SPREAD = 0.1
#: In buckets of so many texts, one that isn't linked to the pivot meets all the others; in larger ones those that share an index key.
ALL_PAIRS = 8
#: An index key of more texts is met in blocks, by texts without a link to any of so many texts near the pivot.
CROWD, HELPERS = 64, 4
#: Texts of a block without a link to the pivot, and of a block of those they meet.
ASKING, ASKED = 128, 512

_GRID = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of _GRID equal parts, by Newton steps on 1 - (1 + x) exp(-x) = p."""
    p = (np.arange(_GRID) + 0.5) / _GRID
    low, high = np.zeros(_GRID), np.full(_GRID, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


_tables: list[np.ndarray] = []


def _random_tables() -> list[np.ndarray]:
    if not _tables:
        q = _gamma_quantiles()
        _tables.extend([q.astype(np.float32), (1 / q).astype(np.float32), np.log(q).astype(np.float32)])
    return _tables


def samples(texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Consistent samples of the texts that have shingles: shape (texts that have any, n). Inputs sorted by text.

    For each shingle and sample: r and c from Gamma(2, 1), b uniform, t = floor(ln w / r + b),
    ln a = ln c - r (t - b) - r; the shingle with the least a, with its t, is the sample.
    """
    gamma, inverse, log_gamma = _random_tables()
    first = np.flatnonzero(np.append(True, texts[1:] != texts[:-1])) if len(texts) else np.zeros(0, dtype=np.int64)
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(texts))))
    log_w = np.log(weights).astype(np.float32)
    out = np.zeros((len(first), n), dtype=np.uint64)
    for j in range(n if len(first) else 0):
        u = mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        i = (u & np.uint64(0xFFFF)).astype(np.int32)
        b = ((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / _GRID)
        t = np.floor(log_w * inverse[i] + b)
        a = log_gamma[((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)] - gamma[i] * (t - b + 1)
        least = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == least[which])
        at = at[np.append(True, which[at][1:] != which[at][:-1])]
        out[:, j] = hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted distinct hashes, weights)."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return shared / (total - shared) if total > shared else 1.0


def document_frequencies(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> np.ndarray:
    """Over all rows of (id, text): for each bucket, how many (row, distinct shingle) fall into it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, words in parts(b.column(0)):
                _, h, _ = counted(*words.shingles(size))
                total += np.bincount((h >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    found = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = found.toArrow()  # ``buckets`` rows at most
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def weights_of(frequencies: np.ndarray, rows: int, spread: float = SPREAD) -> np.ndarray:
    """Smooth inverse document frequency of each bucket, from 1 (in all documents) to 1 + spread."""
    share = np.log(max(rows, 1) / np.clip(frequencies, 1, max(rows, 1))) / math.log(rows + 2)
    return (1 + spread * share).astype(np.float32)


def _weighted(words, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, h, times = counted(*words.shingles(size))
    return t, h, (1 + np.log(times)).astype(np.float32) * idf[(h >> np.uint64(20)).astype(np.int64) % len(idf)]


def signatures(docs: DataFrame, idf: np.ndarray, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, d1, d2 (hash of the words) and ``keys`` (a hash for each band; none for a text without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span, words in parts(batch.column(1)):
                d1, d2 = words.digests()
                t, h, w = _weighted(words, idf, size)
                s = samples(t, h, w, bands * rows)
                keys = np.zeros((len(d1), bands), dtype=np.uint64)
                own = np.unique(t)
                for b in range(bands):
                    key = np.full(len(s), np.uint64(b + 1))
                    for r in range(rows):
                        key = mix(key + s[:, b * rows + r])
                    keys[own, b] = key
                size_of = np.zeros(len(d1), dtype=np.int64)
                size_of[own] = bands
                ends = np.concatenate([[0], np.cumsum(size_of)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[own].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(span.start, len(d1)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], ["id", "d1", "d2", "keys"])

    return docs.select("id", "text").mapInArrow(sign, "id long, d1 long, d2 long, keys array<long>")


def _sets(texts: pa.Array, idf: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct hashes, weights) of each text."""
    out: list = []
    for span, words in parts(texts):
        t, h, w = _weighted(words, idf, size)
        cuts = np.searchsorted(t, np.arange(span.stop - span.start + 1))
        out += [(h[x:y], w[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
    return out


def _with_texts(pairs: DataFrame, docs: DataFrame, a: str, b: str) -> DataFrame:
    left, right = docs.select(F.col("id").alias(a), F.col("text").alias("ta")), docs.select(F.col("id").alias(b), F.col("text").alias("tb"))
    # The lists of pairs and ids grow with the corpus, so they are never broadcast, small as they may look.
    return pairs.hint("merge").join(left, a).hint("merge").join(right, b)


def verified(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """a, b and ``linked`` of pairs (a, b), by the weighted Jaccard similarity of the whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            good = [similarity(x, y) >= threshold - 1e-6 for x, y in zip(_sets(batch.column(2), idf, size), _sets(batch.column(3), idf, size))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return _with_texts(pairs, docs, "a", "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, linked boolean")


def beyond(text: tuple[np.ndarray, np.ndarray], pivot: tuple[np.ndarray, np.ndarray], idf: np.ndarray, threshold: float) -> tuple[float, float, np.ndarray, int]:
    """(how much lighter than the pivot, slack, what it has beyond the pivot with the rarest first, how many of these to ask by)."""
    share = (threshold - 2e-6) / (1 + threshold - 2e-6)
    h, w = text[0], text[1].astype(np.float64)
    i = np.searchsorted(pivot[0], h)
    held = np.zeros(len(h))
    if len(pivot[0]):
        same = pivot[0][np.minimum(i, len(pivot[0]) - 1)] == h
        held[same] = pivot[1][i[same]]
    heavy = float(pivot[1].sum(dtype=np.float64))
    slack = share * (float(w.sum()) + heavy) - float(np.minimum(w, held).sum())
    more = w - held
    at = np.flatnonzero(more > 1e-9)
    at = at[np.lexsort((h[at], -idf[(h[at] >> np.uint64(20)).astype(np.int64) % len(idf)]))]
    before = np.cumsum(more[at])
    ask = int(np.searchsorted(before, before[-1] - slack / 2, side="right")) + 1 if len(at) and slack > 0 else 0
    return heavy - float(w.sum()), slack / (2 * share), h[at], min(ask, len(at))


def judged(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """Of pairs (id, p, large) of a text and its pivot: linked, and for large buckets what tells which texts may be
    linked to one that isn't linked to the pivot: ``lighter`` (P - Y), ``reach`` (slack / 2T), ``keys``, ``ask``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            good, lighter, reach, keys, ask = [], [], [], [], []
            for large, x, p in zip(batch.column(2).to_pylist(), _sets(batch.column(3), idf, size), _sets(batch.column(4), idf, size)):
                good.append(similarity(x, p) >= threshold - 1e-6)
                less, far, own, n = beyond(x, p, idf, threshold) if large else (0.0, 0.0, np.zeros(0, np.uint64), 0)
                lighter.append(less)
                reach.append(far)
                keys.append(own.view(np.int64))
                ask.append(n)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(good, pa.bool_()), pa.array(lighter), pa.array(reach), lists, pa.array(ask, pa.int32())], ["id", "p", "large", "linked", "lighter", "reach", "keys", "ask"])

    both = _with_texts(pairs, docs, "id", "p").select("id", "p", "large", "ta", "tb")
    return both.mapInArrow(check, "id long, p long, large boolean, linked boolean, lighter double, reach double, keys array<long>, ask int")


class Block:
    """Texts as rows of a sparse matrix. A shingle said n times takes n columns whose weights add up to its own,
    so the weight that two texts share is that of the columns that both have."""

    def __init__(self, texts: pa.Array, idf: np.ndarray, size: int):
        rows, columns, weights = [], [], []
        for span, words in parts(texts):
            t, h, times = counted(*words.shingles(size))
            of = np.repeat(np.arange(len(h)), times)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            gain = np.where(nth == 0, 1.0, np.log1p(nth) - np.log(np.maximum(nth, 1)))
            rows.append(t[of] + span.start)
            columns.append(mix(h + np.uint64(1))[of] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            weights.append(gain * idf[(h >> np.uint64(20)).astype(np.int64) % len(idf)][of])
        self.n = len(texts)
        row, column, weight = (np.concatenate(x) for x in (rows, columns, weights))
        self.total = np.bincount(row, weight, self.n)
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.weight = row[order], column[order], weight[order]

    def shared(self, other: Block, width: int = 4096) -> np.ndarray:
        """The weight that each text shares with each of the other block's; dense for ``width`` columns at a time."""
        names = np.intersect1d(self.column, other.column)
        out = np.zeros((self.n, other.n))
        for at in range(0, len(names), width):
            some = names[at : at + width]
            dense = []
            for block in (self, other):
                cut = slice(np.searchsorted(block.column, some[0]), np.searchsorted(block.column, some[-1], side="right"))
                i = np.searchsorted(some, block.column[cut])
                held = some[i] == block.column[cut]
                m = np.zeros((block.n, len(some)), dtype=np.float32)
                m[block.row[cut][held], i[held]] = block.weight[cut][held] if block is self else 1
                dense.append(m)
            out += dense[0] @ dense[1].T
        return out

    def exactly(self, i: int, other: Block, j: int) -> float:
        """The shared weight of one text with one of the other block's, without the rounding of single precision."""
        mine, theirs = self.row == i, other.row == j
        return float(self.weight[mine][np.isin(self.column[mine], other.column[theirs])].sum())

    def linked(self, other: Block, threshold: float) -> np.ndarray:
        both = self.total[:, None] + other.total[None, :]
        s = self.shared(other)
        s = s / (both - s)
        out = s >= threshold
        for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-4)):
            exact = self.exactly(i, other, j)
            out[i, j] = exact / (both[i, j] - exact) >= threshold - 1e-6
        return out


def crossed(asking: DataFrame, asked: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """Links (a < b) of each of ``asking`` with any of ``asked`` of the same p, as far as they join classes. Both: (p, id).

    Both are cut into blocks by hash, and every block meets every other in a matrix product. A row moves
    once for each block it meets, never for each text, and a task holds one block of each at a time.
    """

    def cut(texts: DataFrame, most: int, block: str, blocks: str) -> tuple[DataFrame, DataFrame]:
        sizes = texts.groupBy("p").agg(F.ceil(F.count("*") / most).cast("int").alias(blocks))
        return texts.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")), sizes

    q, q_sizes = cut(asking, ASKING, "q", "qs")
    m, m_sizes = cut(asked, ASKED, "m", "ms")
    sizes = settle(q_sizes.hint("merge").join(m_sizes, "p"), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.hint("merge").join(sizes, "p").select("p", (F.col("h") % F.col("qs")).alias("q"), every("ms").alias("m"), F.lit(0).alias("side"), "id")
    m = m.hint("merge").join(sizes, "p").select("p", every("qs").alias("q"), (F.col("h") % F.col("ms")).alias("m"), F.lit(1).alias("side"), "id")
    rows = q.unionByName(m).hint("merge").join(docs.select("id", "text"), "id").select("p", "q", "m", "side", "id", "text")
    rows = rows.repartition("p", "q", "m").sortWithinPartitions("p", "q", "m", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, block, own, group = None, [], None, None, None
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            names = np.stack([batch.column(k).to_numpy() for k in range(4)])
            starts = np.flatnonzero(np.append(True, (names[:, 1:] != names[:, :-1]).any(axis=0)))
            for x, y in zip(starts, np.append(starts[1:], batch.num_rows)):
                ids, texts = batch.column(4).slice(x, y - x), batch.column(5).slice(x, y - x)
                if (this := tuple(names[:3, x].tolist())) != unit:
                    unit, waiting, block = this, [], None
                if not names[3, x]:
                    waiting.append((ids, texts))
                    continue
                if not waiting:
                    continue  # a block that got no texts
                if block is None:
                    own = np.concatenate([i.to_numpy() for i, _ in waiting])
                    block, group = Block(pa.chunked_array([t for _, t in waiting]).combine_chunks(), idf, size), np.arange(len(own))
                a, b = [], []
                linked = block.linked(Block(texts, idf, size), threshold)
                for j, other in enumerate(ids.to_numpy()):
                    # One link to each class of the asking texts so far; then these are one class.
                    at = np.flatnonzero(linked[:, j])
                    labels, first = np.unique(group[at], return_index=True)
                    if len(labels) > 1:
                        group[np.isin(group, labels)] = labels[0]
                    a += own[at[first]].tolist()
                    b += [int(other)] * len(first)
                ends = np.array([a, b], dtype=np.int64).reshape(2, -1)
                ends = np.sort(ends[:, ends[0] != ends[1]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

    return rows.mapInArrow(meet, "a long, b long")


def _ends(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(keys: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """Linked pairs (a < b), enough of them to connect every class. ``keys``: id, band keys and copies of distinct texts."""
    members = keys.select("id", F.posexplode("keys").alias("band", "key"))
    crowd = members.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = settle(members.join(crowd, ["band", "key"]), "members")
    # Only texts with company are compared; the others' texts aren't moved again.
    docs = settle(docs.select("id", "text").join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "company")
    # A text that has company in many bands, or many copies, lies in the middle of its group.
    middle = members.groupBy("id").agg(F.sum("n").alias("score")).join(keys.select("id", "copies"), "id")
    members = members.join(middle, "id").select("band", "key", "id", "n", F.struct("score", "copies", F.xxhash64("id").alias("h"), "id").alias("score"))
    members = settle(members, "members")
    top = members.groupBy("band", "key").agg(F.max("score").alias("top")).select("band", "key", F.col("top.id").alias("p"))
    placed = settle(members.join(top, ["band", "key"]).filter("id <> p").select("band", "key", "id", "n", "p", "score"), "placed")

    met = placed.groupBy("id", "p").agg(F.max(F.col("n") > ALL_PAIRS).alias("large"))
    tested = settle(judged(met, docs, idf, threshold, size), "tested")
    found = tested.filter("linked").select(*_ends("id", "p"))
    few = placed.filter(F.col("n") <= ALL_PAIRS).select("band", "key", "id", "p")
    asking = few.join(tested.filter("NOT linked").select("id", "p"), ["id", "p"]).select("band", "key", "id")
    pairs = asking.join(few.select("band", "key", F.col("id").alias("other")), ["band", "key"]).filter("id <> other").select(*_ends("id", "other"))

    # Large buckets, those of a pivot together.
    large = tested.filter("large")
    asks = settle(large.filter("NOT linked").select("p", "id", F.explode(F.slice("keys", F.lit(1), F.col("ask"))).alias("key")), "asks")
    wanted = asks.select("p", "key").distinct()
    every = large.join(asks.select("p").distinct(), "p", "left_semi").select("p", "id", F.explode("keys").alias("key"))
    index = settle(every.hint("merge").join(wanted, ["p", "key"], "left_semi"), "index")
    crowded = settle(index.groupBy("p", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("p", "key"), "crowded")
    rare = asks.hint("merge").join(crowded, ["p", "key"], "left_anti")
    pairs = pairs.unionByName(rare.join(index.withColumnRenamed("id", "other"), ["p", "key"]).filter("id <> other").select(*_ends("id", "other")))
    pairs = settle(pairs.distinct(), "pairs")
    found = found.unionByName(settle(verified(pairs, docs, idf, threshold, size), "verified").filter("linked").select("a", "b"))

    # Texts that ask through a large group, or have lighter texts to ask: first those near the pivot, then all of the group.
    least = large.groupBy("p").agg(F.max("lighter").alias("most"), F.min(F.when(~F.col("linked"), F.col("reach"))).alias("near"))
    down = settle(large.join(least, "p").filter("(NOT linked AND reach < most) OR lighter > near").select("p", "id", ((~F.col("linked")) & (F.col("reach") < F.col("most"))).alias("asks"), (F.col("lighter") > F.col("near")).alias("asked")), "lighter")
    through = settle(asks.hint("merge").join(crowded, ["p", "key"], "left_semi"), "through")
    open_ = through.select("p", "id").union(down.filter("asks").select("p", "id")).distinct()
    if open_.isEmpty():
        return found
    order = Window.partitionBy("p").orderBy(F.desc("score"))
    near = large.filter("linked").select("p", "id").join(placed.select("id", "p", "score").distinct(), ["id", "p"])
    near = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= HELPERS).select("p", F.col("id").alias("helper"))
    tried = open_.join(near, "p").select("p", "id", "helper")
    helped = settle(verified(tried.select(*_ends("id", "helper")).distinct(), docs, idf, threshold, size), "helped").filter("linked").select("a", "b")
    found = found.unionByName(helped)
    done = settle(tried.withColumns({"a": F.least("id", "helper"), "b": F.greatest("id", "helper")}).join(helped, ["a", "b"], "left_semi").select("p", "id").distinct(), "done")
    through = settle(through.join(done, ["p", "id"], "left_anti"), "through")
    wanted = through.select("p", "key").distinct()
    group = F.xxhash64("p", "key").alias("p")
    asking, asked = through.select(group, "id"), index.join(wanted, ["p", "key"], "left_semi").select(group, "id")
    below = F.xxhash64("p", F.lit("lighter")).alias("p")
    asking = settle(asking.unionByName(down.filter("asks").join(done, ["p", "id"], "left_anti").select(below, "id")), "asking")
    if asking.isEmpty():
        return found
    asked = asked.unionByName(down.filter("asked").select(below, "id"))
    return found.unionByName(settle(crossed(asking, asked, docs, idf, threshold, size), "crossed"))


def components(edges: DataFrame) -> DataFrame:
    """id, class (the smallest id) of every end of an edge (a, b)."""
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class")), "labels")
    last = labels
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(both.a.alias("id")).agg(F.min("class").alias("near"))
        step = labels.join(near, "id").select("id", F.least("class", "near").alias("next"), F.col("class").alias("before"))
        # Pointer jumping: a label's own label.
        jump = labels.select(F.col("id").alias("next"), F.col("class").alias("far"))
        new = settle(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("class"), "before"), "labels")
        discard(last)
        labels, last = new.select("id", "class"), new
        if new.filter("class <> before").isEmpty():
            return labels


def _classes(known: DataFrame, threshold: float, size: int) -> DataFrame:
    """id, class (the smallest id) of rows (id, text) with distinct ids."""
    idf = weights_of(document_frequencies(known, size), known.count())
    signed = settle(signatures(known, idf, size), "signatures")
    first = settle(signed.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "texts")
    copies = settle(signed.join(first, ["d1", "d2"]).select("id", "rep", "copies", "keys"), "copies")
    found = links(copies.filter("id = rep").select("id", "keys", "copies"), known, idf, threshold, size)
    named = components(found).select(F.col("id").alias("rep"), "class")
    return copies.select("id", "rep").join(named, "rep", "left").select("id", F.coalesce("class", "rep").alias("class"))


def repeated(ids: DataFrame) -> bool:
    """Whether an id comes more than once."""
    return not ids.groupBy("id").count().filter("count > 1").isEmpty()


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id and class_id of every row."""
    own = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_or_empty(text).alias("text"))
    known = own.filter("id IS NOT NULL")
    if repeated(known.select("id")):
        rows = settle(known.withColumn("row", F.monotonically_increasing_id()), "rows")
        named = settle(_classes(rows.select(F.col("row").alias("id"), "text"), threshold, size).withColumnRenamed("id", "row").join(rows.select("row", F.col("id").alias("doc_id")), "row"), "named")
        # Texts of one id are tied: its classes become one.
        tied = named.select("doc_id", "class").distinct()
        tied = tied.join(tied.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").filter("class <> a").select("a", F.col("class").alias("b"))
        joined = components(tied).select(F.col("id").alias("class"), F.col("class").alias("joined"))
        named = named.join(joined, "class", "left").select("doc_id", F.coalesce("joined", "class").alias("class"))
        least = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
        out = named.join(least, "class").select("doc_id", "class_id")
    else:
        out = _classes(known, threshold, size).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"))
    return out.unionByName(own.filter("id IS NULL").select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each class, and rows without an id. Of rows with that id the one of the least
    text stays, of those the one whose other columns hash least."""
    named = classes(docs).filter("doc_id = class_id").select("doc_id").distinct()
    out = docs.join(named, "doc_id", "left_semi")
    if repeated(docs.select(F.col("doc_id").alias("id")).filter("id IS NOT NULL")):
        rest = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
        order = Window.partitionBy("id").orderBy(F.col("text").asc_nulls_first(), "rest")  # the rows of one id
        rows = out.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), "text", rest.alias("rest"))
        out = rows.withColumn("first", F.row_number().over(order)).filter("first = 1").select("row.*")
    return out.unionByName(docs.filter("doc_id IS NULL"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


QUERIES = {"op3_minhash": (op3, None)}
