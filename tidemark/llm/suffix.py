"""Removal of long repeated byte strings by bucket-pointer refinement.

A string of ``LENGTH`` bytes goes where it also starts earlier; what is left of a document are the
bytes that no such string covers.

Suffixes are sorted only as far as it matters, in buckets that meet on one task:

1. In every string of ``LENGTH`` bytes one q-gram is its anchor: the one of least hash, the leftmost
   in a tie. Equal strings have equal anchors at the same place, so equal strings meet in the initial
   bucket of their anchor's q-gram. Neighbouring strings with one anchor form a span. Spans with equal
   bytes (by anchor and content hash, 128 bits) are found first; all but the first of them go as a whole.
2. Buckets that hold several different spans are refined. All positions of the spans start in buckets
   of their first 8 bytes; a position's pointer is the place of its bucket in sorted order. A bucket whose positions share
   ``depth`` bytes is sorted by the pointers of the positions ``depth`` further on, and what these share is added
   to the depth of the new buckets. Buckets are sorted part after part, and pointers change at once, so every part already uses
   what the parts before it have found out, and so do later passes; only buckets of several positions that
   share less than ``LENGTH`` bytes are sorted again. Pointers are in byte order, so equal strings are neighbours in the
   end, and all but the first position of each go.
3. A q-gram that very many documents share, in different surroundings, would fill one bucket. Such
   q-grams are found on a bounded sample of documents (the sample decides the way, never the result);
   their strings are keyed one by one by their own 128-bit hash instead, with equal ones of a batch
   merged before the shuffle. A bucket that still has more than ``BUCKET_SPANS`` spans goes the same way.

Defined results: a null text counts as empty; strings never cross documents; order is by document id
(null first), rows with one id and different texts are ordered by a hash of the text, rows with one id
and text are one document and treated alike; a text below ``LENGTH`` bytes stays as it is; an empty
table gives no rows; extra columns are ignored; very long texts are read whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, settle, table, text_or_empty

LENGTH, Q = 100, 24
#: Documents in the sample that looks for crowded q-grams, and the share of them from which one is crowded.
SAMPLE_DOCS, CROWDED = 20_000, 0.001
BUCKET_SPANS = 20_000
#: Bytes of pieces that are refined together, whole buckets of them.
BATCH_BYTES = 2 << 20
#: Bytes taken at once, below 2**20: positions take 20 bits beside a hash.
_CHUNK = 1 << 19
_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def grams8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    g = data.astype(_U)
    for k in (1, 2, 4):
        g = g[: len(g) - k] | (g[k:] << _U(8 * k))
    return g


def _grams(g8: np.ndarray, q: int) -> np.ndarray:
    """A hash of the ``q`` bytes (a multiple of 8) from each position on."""
    n = len(g8) - q + 8
    h = g8[:n] * _C1
    for at in range(8, q, 8):
        h = (h ^ (h >> _U(32))) * _C2 + g8[at : at + n] * _C1
    return mix(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, have = len(keys) - width + 1, 1
    m = keys
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return m[:n] if have == width else np.minimum(m[:n], m[width - have : width - have + n])


def spans_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, anchor hash, content hash, 8-grams) of the spans of some texts laid end to end."""
    g8 = grams8(data)
    h = _grams(g8, q)
    keys = (h >> _U(20) << _U(20)) | np.arange(len(h), dtype=_U)
    anchor = (_least(keys, length - q + 1) & _U(0xFFFFF)).astype(np.int64)
    n = len(anchor)  # strings; string p is data[p : p + length]
    text = np.searchsorted(ends, np.arange(n), side="right")
    whole = np.arange(n) + length <= ends[text]
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new & whole)
    # A span ends before the next one, and at the last whole string of its text.
    bound = np.append(np.flatnonzero(new), n)
    after = bound[np.searchsorted(bound, start, side="right")]
    count = np.minimum(after, ends[text[start]] - length + 1) - start
    content = _content(g8, start, count + length - 1, 2 * length - q, _C2)
    return start, count, h[anchor[start]], content, g8


def _content(g8: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, seed: np.uint64) -> np.ndarray:
    """A hash of the ``size`` bytes (8 to ``most``) from each start on."""
    out = size.astype(_U) * seed
    last = start + size - 8
    for at in range(0, most, 8):
        out = (out ^ (out >> _U(29))) * seed + g8[np.minimum(start + at, last)] * _C3
    return mix(out)


def _words(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers in byte order; zeros beyond the end of the position's piece."""
    g = grams8(np.append(data, np.zeros(7, dtype=np.uint8))).byteswap()
    tail = np.flatnonzero(room < 8)  # at least one byte is left everywhere
    drop = _U(64) - _U(8) * room[tail].astype(_U)
    g[tail] = g[tail] >> drop << drop
    return g


def refine(data: np.ndarray, at: np.ndarray, room: np.ndarray, length: int = LENGTH, parts: int = 4) -> np.ndarray:
    """Bucket numbers of the positions ``at`` by their first ``length`` bytes: equal numbers, equal strings.

    ``room``: for every position of ``data``, the bytes to the end of its piece. Bucket-pointer refinement, see above.
    """
    n = len(data)
    words = _words(data, room)
    if (data == 0).any():  # zeros beyond the end and zeros of the text are told apart
        short = np.minimum(room, 8)
        order = np.lexsort((short, words))
        new = np.append(True, (words[order][1:] != words[order][:-1]) | (short[order][1:] != short[order][:-1]))
    else:
        order = np.argsort(words)
        new = np.append(True, words[order][1:] != words[order][:-1])
    pointer = np.empty(n + 1, dtype=np.int32 if n < 1 << 31 else np.int64)
    pointer[n] = -1
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, n))
    pointer[order] = np.repeat(begins, sizes)
    depth = np.full(n + 1, 8, dtype=np.int16)
    depth[:n][room < 8] = length  # a piece's last bytes are told by themselves
    active = order[np.repeat(sizes > 1, sizes)]
    active = active[depth[active] < length]
    while len(active):
        # ``active`` lies bucket by bucket; parts end where buckets do.
        starts = np.flatnonzero(np.append(True, pointer[active][1:] != pointer[active][:-1]))
        cuts = np.unique(np.append(starts[np.minimum(np.searchsorted(starts, np.arange(parts) * (len(active) // parts + 1)), len(starts) - 1)], len(active)))
        kept = []
        for x, y in zip(np.append(0, cuts[:-1]), cuts):
            some = active[x:y]
            if not len(some):
                continue
            further = np.where(room[some] > depth[some], some + depth[some], n)
            both = pointer[some].astype(np.int64) * (n + 1) + pointer[further] + 1  # bucket, then key: below 2**63
            by = np.argsort(both)
            some, further, both = some[by], further[by], both[by]
            begin = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            size = np.diff(np.append(begin, len(some)))
            old = pointer[some[begin]]
            first = np.append(True, old[1:] != old[:-1])
            bucket = np.flatnonzero(first)  # the first of the new buckets in each old one
            place = begin - np.repeat(begin[bucket], np.diff(np.append(bucket, len(begin))))
            grown = np.where(further[begin] == n, length, np.minimum(depth[some[begin]] + depth[further[begin]], length))
            pointer[some] = np.repeat(old + place, size)
            depth[some] = np.repeat(grown, size)
            kept.append(some[np.repeat((size > 1) & (grown < length), size)])
        active = np.concatenate(kept)
    order = at[np.argsort(pointer[at], kind="stable")]
    apart = np.zeros(max(len(order) - 1, 0), dtype=bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        w = words[order + k]
        apart |= w[1:] != w[:-1]
    number = np.empty(n, dtype=np.int64)
    number[order] = np.append(0, np.cumsum(apart))[: len(order)]
    return number[at]


def _later(order_columns: list[np.ndarray], same: list[np.ndarray]) -> np.ndarray:
    """Whether a row comes after another one with the same key, in the order of the columns (least significant first)."""
    order = np.lexsort((*order_columns, *same))
    again = np.ones(len(order), dtype=bool)
    again[:1] = False
    for s in same:
        t = s[order]
        again[1:] &= t[1:] == t[:-1]
    # The same place twice (a repeated row) isn't later than itself.
    place = np.ones(len(order), dtype=bool)
    for c in order_columns:
        t = c[order]
        place[1:] &= t[1:] == t[:-1]
    start = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    moved = np.maximum.accumulate(np.where(place & again, 0, np.arange(len(order))))
    out = np.empty(len(order), dtype=bool)
    out[order] = again & (moved != start)
    return out


_NULL = -(1 << 63)
_LOW = (1 << 32) - 1


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), offsets


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends of the texts in them, row of each, place of each in its row): short texts together, long ones cut so that no string is lost."""
    row, n = 0, len(offsets) - 1
    while row < n:
        begin = offsets[row]
        size = offsets[row + 1] - begin
        if size > _CHUNK:
            for at in range(0, size - length + 1, _CHUNK - length + 1):
                part = data[begin + at : begin + min(at + _CHUNK, size)]
                yield part, np.array([len(part)]), np.array([row]), np.array([at])
            row += 1
            continue
        to = min(max(row + 1, int(np.searchsorted(offsets, begin + _CHUNK, side="right")) - 1), n)
        yield data[begin : offsets[to]], offsets[row + 1 : to + 1] - begin, np.arange(row, to), np.zeros(to - row, dtype=np.int64)
        row = to


def _strings(g8: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the strings at these places."""
    size = np.full(len(at), length)
    return _content(g8, at, size, length, _C1 | _U(4)), _content(g8, at, size, length, _C2)


def _spans_in(batch: pa.RecordBatch, length: int, q: int, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """(route, content, row, start, strings) of the spans of a batch; strings under crowded anchors one by one."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for data, ends, rows, places in _chunks(*_texts(batch.column(1)), length):
        if len(data) < length:
            continue
        start, count, route, content, g8 = spans_of(data, ends, length, q)
        if len(crowded) and len(start):
            hot = crowded[np.minimum(np.searchsorted(crowded, route), len(crowded) - 1)] == route
            if hot.any():
                reps = count[hot]
                each = np.repeat(start[hot] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
                one, two = _strings(g8, each, length)
                start, count = np.append(start[~hot], each), np.append(count[~hot], np.ones(len(each), dtype=np.int64))
                route, content = np.append(route[~hot], one), np.append(content[~hot], two)
        text = np.searchsorted(ends, start, side="right")
        first = np.append(0, ends[:-1])
        for column, values in zip(out, (route, content, rows[text], start - first[text] + places[text], count)):
            column.append(values)
    kinds = (_U, _U, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=k) for c, k in zip(out, kinds))


def crowded_anchors(docs: DataFrame, rows: int, length: int = LENGTH, q: int = Q) -> np.ndarray:
    """Anchors with many different spans in a sample of documents, sorted. At most as many as a document has anchors / CROWDED."""
    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(rows, 1)), seed=3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            route, content, *_ = _spans_in(b, length, q, np.zeros(0, dtype=_U))
            both = np.unique(np.stack([route, content]), axis=1) if len(route) else np.zeros((2, 0), dtype=_U)
            yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64))], ["route", "content"])

    least = max(8, int(CROWDED * min(rows, SAMPLE_DOCS)))
    found = sample.select("doc", "text").mapInArrow(run, "route long, content long").distinct().groupBy("route").count().filter(F.col("count") >= least)
    return np.sort(found.select("route").toArrow().column(0).to_numpy().astype(np.int64).view(_U))


def anchored(docs: DataFrame, crowded: np.ndarray, length: int = LENGTH, q: int = Q) -> DataFrame:
    """route, content, doc, at: a row for each span, equal ones of a batch merged.

    ``at`` is start << 32 | strings << 1 | gone; a gone row comes after an equal one of its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            route, content, row, start, count = _spans_in(b, length, q, crowded)
            doc = b.column(0).to_numpy()[row]
            late = _later([start, doc], [content, route])
            # Gone spans that follow each other are one.
            g = np.flatnonzero(late)
            g = g[np.lexsort((start[g], doc[g]))]
            gd, gs, ge = doc[g], start[g], start[g] + count[g]
            new = np.append(True, (gd[1:] != gd[:-1]) | (gs[1:] > ge[:-1]))[: len(g)]
            at = np.flatnonzero(new)
            gd, gs = gd[at], gs[at]
            ge = np.maximum.reduceat(ge, at) if len(at) else ge
            scattered = mix(gd.view(_U) * _C1 + gs.astype(_U)).view(np.int64)
            stay = ~late
            columns = (
                np.append(route[stay].view(np.int64), scattered),
                np.append(content[stay].view(np.int64), scattered),
                np.append(doc[stay], gd),
                np.append(start[stay] << 32 | count[stay] << 1, gs << 32 | (ge - gs) << 1 | 1),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["route", "content", "doc", "at"])

    return docs.select("doc", "text").mapInArrow(run, "route long, content long, doc long, at long")


def bucketed(rows: DataFrame) -> DataFrame:
    """doc and ``marks`` (array<struct<kind,at,route>>): 0 gone, 1 a span of a bucket to refine, 2 one of a very large bucket."""
    same = Window.partitionBy("route", "content").orderBy("doc", "at")
    rows = rows.withColumn("gone", F.col("at").bitwiseAND(F.lit(1)) == 1).withColumn("place", F.rank().over(same))
    rows = rows.withColumn("spans", F.sum(F.when((F.col("place") == 1) & ~F.col("gone"), 1).otherwise(0)).over(Window.partitionBy("route")))
    kind = F.when(F.col("gone") | (F.col("place") > 1), 0).when(F.col("spans") > BUCKET_SPANS, 2).when(F.col("spans") > 1, 1)
    marked = rows.withColumn("kind", kind).filter("kind IS NOT NULL")
    return marked.groupBy("doc").agg(F.collect_list(F.struct("kind", F.col("at"), F.when(F.col("kind") == 1, F.col("route")).alias("route"))).alias("marks"))


def refined(joined: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, at of the strings that go, from (doc, text, marks): spans of one bucket meet in one task and are refined there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                for m in marks:
                    if m["kind"] == 1:
                        start, count = m["at"] >> 32, (m["at"] & _LOW) >> 1
                        for column, value in zip(out, (m["route"], doc, start, raw[start : start + count + length - 1])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["route", "doc", "start", "piece"])

    def work(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        room = np.repeat(ends, sizes) - np.arange(ends[-1])
        counts = sizes - length + 1
        first = np.repeat(np.cumsum(counts) - counts, counts)
        within = np.arange(counts.sum()) - first
        bucket = refine(data, np.repeat(ends - sizes, counts) + within, room, length)
        doc, at = np.repeat(docs, counts), np.repeat(starts, counts) + within
        gone = _later([at, doc], [bucket])
        doc, at = doc[gone], at[gone]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))[: len(doc)]
        k = np.flatnonzero(new)
        last = at[np.append(k[1:], len(at)) - 1] if len(k) else at
        return doc[k], at[k] << 32 | (last - at[k] + 1) << 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def finish(rows: pa.Table) -> pa.RecordBatch:
            doc, at = work(rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(3).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], ["doc", "at"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size < BATCH_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            route = rows.column(0).to_numpy()
            whole = int(np.searchsorted(route, route[-1]))  # the last bucket may go on in the next batch
            if whole:
                yield finish(rows.slice(0, whole))
                rows = rows.slice(whole)
            held, size = rows.to_batches(), rows.nbytes
        if held:
            yield finish(pa.Table.from_batches(held))

    pieces = joined.select("doc", "text", "marks").mapInArrow(cut, "route long, doc long, start long, piece binary")
    return pieces.repartition("route").sortWithinPartitions("route").mapInArrow(run, "doc long, at long")


def one_by_one(joined: DataFrame, length: int = LENGTH) -> DataFrame:
    """As :func:`refined` for the spans of very large buckets, each string keyed by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                each = [np.arange(m["at"] >> 32, (m["at"] >> 32) + ((m["at"] & _LOW) >> 1)) for m in marks if m["kind"] == 2]
                if each:
                    at = np.concatenate(each)
                    one, two = _strings(grams8(raw), at, length)
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at << 32 | 2)], ["h1", "h2", "doc", "at"])

    strings = settle(joined.select("doc", "text", "marks").mapInArrow(run, "h1 long, h2 long, doc long, at long"), "strings")
    place = F.struct("doc", "at")
    first = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return strings.join(first, ["h1", "h2"]).filter(place > F.col("first")).select("doc", "at")


def _ordered(docs: DataFrame, text: str, id_column: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with ``doc`` unique for each text and in order, and the ids of ``doc`` where it isn't the id itself."""
    own = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc"), text_or_empty(text).alias("text"))
    if own.filter("doc IS NULL").isEmpty() and own.groupBy("doc").count().filter("count > 1").isEmpty():
        return own, None
    own = own.withColumn("h", F.xxhash64("text"))
    pairs = own.select("doc", "h").distinct().orderBy(F.asc_nulls_first("doc"), "h")
    numbered = settle(pairs.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("id long, h long, number long"), "numbers")
    back = numbered.select(F.col("id").alias("doc_id"), F.col("number").alias("doc"))
    out = own.join(numbered, own.doc.eqNullSafe(numbered.id) & (own.h == numbered.h)).select(F.col("number").alias("doc"), "text")
    return out, back


def dedup_bytes(docs: DataFrame, length: int = LENGTH, q: int = Q, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (array<struct<start,end>> of removed bytes) and kept (binary) of every row."""
    if length < q + 8 or q % 8 or length > 200:
        raise ValueError("q is a multiple of 8, length from q + 8 to 200")
    own, back = _ordered(docs, text, id_column)
    crowded = crowded_anchors(own, own.count(), length, q)
    marks = settle(bucketed(anchored(own, crowded, length, q)), "marks")
    open_marks = marks.filter("exists(marks, m -> m.kind > 0)")
    joined = own.join(open_marks, "doc").select("doc", "text", "marks")
    more = refined(joined, length)
    if not marks.filter("exists(marks, m -> m.kind = 2)").isEmpty():
        more = more.unionByName(one_by_one(joined, length))
    gone = marks.select("doc", F.explode(F.expr("transform(filter(marks, m -> m.kind = 0), m -> m.at)")).alias("at")).unionByName(more)
    gone = gone.groupBy("doc").agg(F.collect_list("at").alias("gone"))
    kept = own.join(gone, "doc", "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, left = [], [], []
            for t, at in zip(b.column(1).to_pylist(), b.column(2)):
                raw = t.encode()
                merged: list[list[int]] = []
                if at.is_valid:
                    values = np.sort(np.asarray(at.values))
                    start = values >> 32
                    end = start + ((values & _LOW) >> 1) + length - 1
                    reach = np.maximum.accumulate(end)
                    new = np.append(True, start[1:] > reach[:-1])
                    k = np.flatnonzero(new)
                    merged = np.stack([start[k], reach[np.append(k[1:], len(reach)) - 1]], axis=1).tolist()
                sizes.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in merged])
                place, pieces = 0, []
                for s, e in merged:
                    pieces.append(raw[place:s])
                    place = e
                left.append(b"".join([*pieces, raw[place:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = kept.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    if back is None:
        return out
    return out.withColumnRenamed("doc_id", "doc").join(back, "doc").select("doc_id", "n_bytes", "spans", "kept")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": (op2, None)}
