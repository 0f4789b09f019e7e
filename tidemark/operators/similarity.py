"""Character shingles, Jaccard, MinHash signatures with banded LSH, and star clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import digests, number, picked
from tidemark.functions.lineage import discard, settle
from tidemark.functions.shipping import ship

Hash = Callable

#: Shingles in a slice of a bucket. A tile is one slice against another, whatever the bucket's size.
SLICE = 1 << 17
#: Rows of a tile that are compared with as many others at a time; small buckets are compared together up to ``SMALL`` rows.
BLOCK, SMALL = 1024, 128
_MIXERS = np.random.default_rng(64).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct character ``k``-grams of the lower-case, stripped text; a shorter text is its own shingle."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (k - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(k)))
    return F.array_distinct(F.when(F.length(t) < k, F.array(t)).otherwise(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _hashed(df: DataFrame, sets: str, hashes: int, h: Hash | None) -> DataFrame:
    """With ``d``: what the hashes of each shingle are picked from. Without a family of its own: md5, four hashes a digest."""
    each = (lambda x: digests(x, hashes)) if h is None else (lambda x: F.array(*(h(seed, x) for seed in range(hashes))))
    return df.withColumn("d", F.transform(sets, each))


def _minima(hashes: int, h: Hash | None) -> Column:
    def least(seed: int) -> Column:
        return number(F.array_min(F.transform("d", lambda x: picked(x, seed)))) if h is None else F.array_min(F.transform("d", lambda x: x[seed]))

    return F.array(*(least(seed) for seed in range(hashes)))


def shingled(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """id, text and sh (shingles)."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("text"), shingles(F.col(text), k).alias("sh"))


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` in sum, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _signed(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[pa.RecordBatch]:
    """Adds ``sig``: the minima of ``h32`` for each seed. A shingle is hashed once in a part of a batch."""
    for batch in batches:
        sets = batch.column("sh")
        for at, to in _parts(np.diff(sets.offsets.to_numpy()), SLICE):
            part = batch.slice(at, to - at)
            sh = part.column("sh")
            coded = sh.flatten().dictionary_encode()
            made = b"".join(hashlib.md5(f"{block}:{x}".encode()).digest() for x in coded.dictionary.to_pylist() for block in range(-(-hashes // 4)))
            table = np.frombuffer(made, dtype=">u4").astype(np.uint32).reshape(len(coded.dictionary), -1)[:, :hashes]
            starts = sh.offsets.to_numpy()[:-1] - sh.offsets[0].as_py()
            least = np.minimum.reduceat(table[coded.indices.to_numpy()], starts, axis=0).astype(np.int64)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, hashes, dtype=np.int32)), pa.array(least.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, sig], [*part.schema.names, "sig"])


def signatures(df: DataFrame, key: str, text: str, k: int = 3, hashes: int = 48, h: Hash | None = None) -> DataFrame:
    """id, text, sh (shingles) and sig (array of ``hashes`` minima); no row is exploded."""
    base = shingled(df, key, text, k)
    if h is not None:
        return _hashed(base, "sh", hashes, h).select("id", "text", "sh", _minima(hashes, h).alias("sig"))
    ship(df.sparkSession)
    return base.mapInArrow(lambda batches: _signed(batches, hashes), T.StructType([*base.schema, T.StructField("sig", T.ArrayType(T.LongType()))]))


def _named(sets: DataFrame) -> DataFrame:
    return sets.withColumn("m", F.md5(F.concat_ws("\x1f", F.sort_array("sh"))))


def members(sets: DataFrame) -> DataFrame:
    """id, rep: texts with the same shingles (``sh``) are one, named by the smallest id."""
    own = _named(sets.select("id", "sh")).select("id", "m")
    return own.join(own.groupBy("m").agg(F.min("id").alias("rep")), "m").select("id", "rep")


def representatives(signed: DataFrame, bands: int = 12, rows: int = 4) -> DataFrame:
    """id, sh (as 64-bit hashes), sig and bands of the representatives that :func:`members` names."""
    keys = F.array(*(F.xxhash64(F.slice("sig", b * rows + 1, rows)) for b in range(bands)))
    one = _named(signed).groupBy("m").agg(F.min_by(F.struct("id", F.transform("sh", lambda x: F.xxhash64(x)).alias("sh"), "sig"), "id").alias("x")).select("x.*").filter("id IS NOT NULL")
    return settle(one.withColumn("bands", keys), "signatures")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, and how many of them each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _compared(rows: pa.Table, width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of one or more whole tiles. ``rows`` are sorted by tile and side."""
    rows = rows.combine_chunks()
    ids, band, side = rows.column("id").combine_chunks(), rows.column("band").to_numpy(), rows.column("side").to_numpy()
    tile = np.cumsum(np.append(0, (np.diff(rows.column("tile").to_numpy()) != 0) | (np.diff(band) != 0)))
    rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    kinds, sig = np.unique(_lists(rows.column("sig").combine_chunks())[0], return_inverse=True)
    sig = sig.astype(np.uint16 if len(kinds) <= 1 << 16 else np.int32).reshape(len(ids), -1)
    values, sizes = _lists(rows.column("sh").combine_chunks())
    code, often = np.unique(values, return_inverse=True, return_counts=True)[1:]
    wide = sizes.astype(np.float32)
    by_band = np.kron(np.eye(sig.shape[1] // width, dtype=np.float32), np.ones((width, 1), dtype=np.float32))
    mixed = (sig.reshape(len(ids), -1, width).astype(np.uint64) * _MIXERS[:width]).sum(axis=2, dtype=np.uint64)
    met = np.ascontiguousarray(np.unique(mixed, return_inverse=True)[1].astype(np.int32).reshape(mixed.shape).T)
    shared = np.cumsum(often > 1) - 1  # a shingle of one row is common to none
    n_shared, of = int(shared[-1]) + 1, np.repeat(np.arange(len(ids)), sizes)
    keep = often[code] > 1
    of, code = of[keep], shared[code[keep]]

    def dense(at: int, to: int, first: int, last: int) -> np.ndarray:
        lo, hi = np.searchsorted(of, [at, to])
        r, c = of[lo:hi] - at, code[lo:hi]
        inside = (c >= first) & (c < last)
        out = np.zeros((to - at, last - first), dtype=np.float32)
        out[r[inside], c[inside] - first] = 1
        return out

    for x in range(0, len(ids), BLOCK):
        xe = min(x + BLOCK, len(ids))
        for y in range(x, len(ids), BLOCK):
            ye = min(y + BLOCK, len(ids))
            if tile[xe - 1] < tile[y] or (tile[x] == tile[ye - 1] and side[x] == side[ye - 1] != 0):
                continue
            common = np.zeros((xe - x, ye - y), dtype=np.float32)
            for first in range(0, n_shared, 4096):
                last = min(first + 4096, n_shared)
                common += dense(x, xe, first, last) @ dense(y, ye, first, last).T
            # A first sieve in 32 bits, with room for their rounding; what passes is measured again.
            ok = common * np.float32((1 + threshold) * (1 + 1e-5)) >= np.float32(threshold) * (wide[x:xe, None] + wide[None, y:ye])
            if x == y:
                ok &= np.arange(x, xe)[:, None] < np.arange(y, ye)
            if tile[x] != tile[ye - 1]:
                ok &= tile[x:xe, None] == tile[None, y:ye]
            if side[x:ye].any():
                ok &= (side[x:xe] == 0)[:, None] | (side[x:xe, None] != side[None, y:ye])
            # A pair is made in the first band that it shares.
            for b in range(band[x:xe].max()):
                other = met[b, x:xe, None] != met[b, None, y:ye]
                ok &= other if band[x:xe].min() > b else other | (band[x:xe] <= b)[:, None]
            found_i, found_j = np.divmod(np.flatnonzero(ok), ye - y)
            for at in range(0, len(found_i), 1 << 14):
                i, j = found_i[at : at + (1 << 14)], found_j[at : at + (1 << 14)]
                c, i, j = common[i, j].astype(np.float64), i + x, j + y
                exact, like = c / (sizes[i] + sizes[j] - c), (sig[i] == sig[j]).astype(np.float32) @ by_band
                take = (exact >= threshold) & (like[np.arange(len(i)), band[i]] == width)
                i, j, exact, alike = i[take], j[take], exact[take], like[take].sum(axis=1, dtype=np.float64) / sig.shape[1]
                swap = rank[i] > rank[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                if len(i):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(exact), pa.array(alike)], ["a", "b", "exact", "estimated"])


def _tiles(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Whole tiles, small ones together, to :func:`_compared`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tile = batch.column("tile").to_numpy()
        starts = np.append(np.flatnonzero(np.append(not held or held[-1].column("tile")[-1].as_py() != tile[0], np.diff(tile) != 0)), len(tile))
        if starts[0] > 0:  # the tile before goes on
            held.append(batch.slice(0, starts[0]))
        for at, to in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if held and sum(h.num_rows for h in held) + to - at > SMALL:
                yield from _compared(pa.Table.from_batches(held), width, threshold)
                held = []
            held.append(batch.slice(at, to - at))
    if held:
        yield from _compared(pa.Table.from_batches(held), width, threshold)


def _met(both: DataFrame, rows: int, threshold: float, spread: int = 1) -> DataFrame:
    """a < b, exact and estimated Jaccard of pairs that share a band and reach the threshold. Rows of side 0 meet each other, those of side 1 meet
    those of side 2.

    A bucket is cut into slices of about ``SLICE`` shingles by a hash of the id, each pair of slices is a tile, and a tile
    is compared by matrix products. Only keys are counted and joined to find the tiles; sets and signatures move with the tile.
    """
    spark = both.sparkSession
    ship(spark)
    keys = both.select("id", "side", F.size("sh").alias("n"), F.posexplode("bands").alias("band", "key"))
    weight = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    slices = [F.ceil(weight(s) / SLICE).cast("int").alias(f"s{s}") for s in range(3)]
    buckets = keys.groupBy("band", "key").agg(*slices, F.count("*").alias("c")).filter((F.col("c") > 1) & ((F.col("s0") > 0) | (F.col("s1") > 0) & (F.col("s2") > 0)))
    mine = F.when(F.col("side") == 0, F.col("s0")).when(F.col("side") == 1, F.col("s1")).otherwise(F.col("s2"))
    others = F.when(F.col("side") == 0, F.col("s0")).when(F.col("side") == 1, F.col("s2")).otherwise(F.col("s1"))
    dealt = keys.join(buckets, ["band", "key"]).withColumn("at", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    low, high = F.least("at", "other"), F.greatest("at", "other")
    tile = F.when(F.col("side") == 0, F.xxhash64("band", "key", low, high)).when(F.col("side") == 1, F.xxhash64("band", "key", "at", "other")).otherwise(F.xxhash64("band", "key", "other", "at"))
    # In a tile of two slices of one side, the lower slice is its side 1 and the upper one its side 2.
    role = F.when((F.col("side") == 0) & (F.col("at") != F.col("other")), F.when(F.col("at") < F.col("other"), 1).otherwise(2)).otherwise(F.col("side"))
    places = dealt.groupBy("id").agg(F.collect_set(F.struct(tile.alias("tile"), "band", role.alias("side"))).alias("places"))
    wide = both.select("id", "sh", "sig").join(places, "id").select("id", "sh", "sig", F.explode("places").alias("p")).select("id", "sh", "sig", "p.*")
    tasks = spread * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = both.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("exact", T.DoubleType()), T.StructField("estimated", T.DoubleType())])
    return wide.repartition(tasks, "tile").sortWithinPartitions("tile", "band", "side").mapInArrow(lambda batches: _tiles(batches, rows, threshold), schema)


def pairs(signed: DataFrame, bands: int = 12, rows: int = 4, threshold: float = 0.55) -> DataFrame:
    """a < b, exact and estimated Jaccard, of pairs that share a band and reach the threshold exactly.

    Texts with the same shingles are one beforehand: pairs are between the representatives that :func:`members` names. A pair
    is made in the first band that it shares only; sets travel as 64-bit hashes.
    Every pair above the threshold is a row of the result, so a family of distinct texts that are all alike has as
    many pairs as it has.
    """
    return _met(representatives(signed, bands, rows).withColumn("side", F.lit(0)), rows, threshold, spread=4)


def query(signed: DataFrame, text: Column, bands: int = 16, rows: int = 4, k: int = 3, threshold: float = 0.5, h: Hash | None = None) -> DataFrame:
    """Documents like one text, itself included, most similar first: a scan that keeps those sharing a band."""
    one = shingles(text, k)
    asked = _hashed(signed.sparkSession.range(1).select(one.alias("qs")), "qs", bands * rows, h).select("qs", _minima(bands * rows, h).alias("qg"))
    hit = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice("sig", b * rows + 1, rows) == F.slice("qg", b * rows + 1, rows))
    same = F.size(F.filter(F.zip_with("sig", "qg", lambda x, y: x == y), lambda x: x)) / (bands * rows)
    # One row is joined to each document: a broadcast of a single row.
    out = signed.join(F.broadcast(asked)).filter(hit).select(F.col("id").alias("matched_id"), F.col("text").alias("matched_document"), jaccard(F.col("sh"), F.col("qs")).alias("exact_jaccard"), same.alias("minhash_estimated_jaccard"))
    return out.filter(F.col("exact_jaccard") >= threshold).orderBy(F.desc("exact_jaccard"), "matched_id")


def _scanned(ids: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id and state (seed or member) of the scan that :func:`star_clusters` says, and the links both ways; both are settled."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    state, last = ids.select("id").distinct().withColumn("state", F.lit("?")), None
    while True:
        near = both.join(state.select(F.col("id").alias("b"), F.col("state").alias("s")), "b").groupBy(F.col("a").alias("id")).agg(
            F.max(F.col("s") == "seed").alias("by_seed"), F.min(F.when(F.col("s") == "?", F.col("b"))).alias("first_open")
        )
        new = F.when(F.col("state") != "?", F.col("state")).when(F.coalesce("by_seed", F.lit(False)), "member").when(F.col("first_open").isNull() | (F.col("id") < F.col("first_open")), "seed").otherwise("?")
        state = settle(state.join(near, "id", "left").select("id", new.alias("state")), "state")
        discard(last)
        last = state
        if state.filter("state = '?'").isEmpty():
            break
    return state, both


def star_clusters(ids: DataFrame, links: DataFrame) -> DataFrame:
    """seed, member: scanning ids in order, each one not yet in a cluster seeds one of itself and all its matches.

    The seeds are the greedy independent set in id order. Each round settles every undecided id whose
    smaller undecided neighbours are gone, so rounds follow the longest ascending chain, not the size.
    ``ids``: id. ``links``: a < b.
    """
    state, both = _scanned(ids, links)
    seeds = state.filter("state = 'seed'").select(F.col("id").alias("seed"))
    return seeds.select("seed", F.col("seed").alias("member")).unionByName(seeds.join(both, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("member")))


#: A round of :func:`clusters` links as many ids as make so many candidates, or so many for each id that is left.
ROUND, SHARE = 1 << 22, 16


def _prefix(left: DataFrame):
    """The largest id of a prefix of those left, in id order, whose buckets make few enough pairs: all of them, half, a quarter and so on."""
    cuts = left.agg(F.percentile_approx("id", [2.0**-k for k in range(13)], 100_000).alias("at"), F.count("*").alias("n"), F.max("id").alias("last")).first()
    at = [cuts["last"], *cuts["at"][1:]]
    keys = left.select("id", F.posexplode("bands").alias("band", "key"))
    counts = keys.groupBy("band", "key").agg(*(F.sum((F.col("id") <= F.lit(x)).cast("double")).alias(f"c{k}") for k, x in enumerate(at)))
    made = counts.agg(*(F.sum(F.col(f"c{k}") * (F.col(f"c{k}") - 1) / 2) for k in range(len(at)))).first()
    return next((x for x, n in zip(at, made) if n <= max(ROUND, SHARE * cuts["n"])), at[-1])


def clusters(signed: DataFrame, bands: int = 12, rows: int = 4, threshold: float = 0.55) -> DataFrame:
    """seed, member: the :func:`star_clusters` of the representatives' ids (numbers) and their :func:`pairs`, without making all pairs.

    Members are linked to a seed, so only seeds' links are needed. A round takes a prefix of the ids that are still left, in
    order: it makes the links within the prefix, finds the seeds there by the scan, and drops from the rest whatever they are linked to.
    That leaves few links between the others, so the next prefix is longer. In the end the seeds meet all representatives once.
    """
    one = representatives(signed, bands, rows)
    left, last, found = one, None, []
    while not left.isEmpty():
        cut = F.lit(_prefix(left))
        near = settle(_met(left.filter(F.col("id") <= cut).withColumn("side", F.lit(0)), rows, threshold).select("a", "b"), "near")
        state, both = _scanned(left.filter(F.col("id") <= cut).select("id"), near)
        seeds = state.filter("state = 'seed'").select("id")
        found.append(seeds)
        rest = left.filter(F.col("id") > cut)
        told = left.join(seeds, "id", "left_semi").withColumn("side", F.lit(1)).unionByName(rest.withColumn("side", F.lit(2)))
        reached = _met(told, rows, threshold).select(F.col("b").alias("id")).distinct()
        left = settle(rest.join(reached, "id", "left_anti"), "left")
        for table in (near, both, last):
            discard(table)
        last = left
    seeds = reduce(DataFrame.unionByName, found) if found else one.select("id").limit(0)
    side = F.when(F.col("seed").isNotNull(), 1).otherwise(2)
    met = _met(one.join(seeds.withColumn("seed", F.col("id")), "id", "left").withColumn("side", side).drop("seed"), rows, threshold)
    # A seed's member may come before it in the order.
    ways = met.select(F.explode(F.array(F.struct(F.col("a").alias("seed"), F.col("b").alias("member")), F.struct(F.col("b").alias("seed"), F.col("a").alias("member")))).alias("x")).select("x.*")
    seeds = seeds.select(F.col("id").alias("seed"))
    return seeds.select("seed", F.col("seed").alias("member")).unionByName(ways.join(seeds, "seed", "left_semi"))
