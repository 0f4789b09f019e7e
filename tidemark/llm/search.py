"""Exact top-k by inner product: columnar branch-and-bound over blocks of vectors.

Candidates are dealt into blocks by hash, queries likewise; each pair of blocks is one group. In a
group the candidates lie dimension by dimension. A tile of queries adds up its products one block of dimensions
at a time, as a matrix product; after each block the mass that remains (product of the norms of the dimensions to come)
bounds every score from above, and the candidates whose bound is below the k-th best score known for every query of the tile are
compacted away. That score is known from the start: all queries first meet ``SAMPLE`` candidates, the ones of least hash, and the k-th best
of these is a lower bound for the query everywhere. Each group gives k rows for a query at most, which are then ranked.

Every vector moves once for each block of queries. A block holds ``QUERIES_IN_BLOCK`` queries, fewer where these
would take more than ``QUERY_BYTES``.

Components are whole numbers, floor(256 * x); sums below 2**53 are exact in doubles, larger ones are
added up in Python integers and kept within 64 bits.

Defined results: a row with a null id, a null vector or a null or non-finite component takes no part;
an empty vector scores 0 with other empty ones; only vectors of one length are compared; rows with the
query's own id are not its candidates; repeated candidate rows are ranked each, repeated query rows
count once; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Vectors of a candidate block, of a query block and of a tile of it; dimensions added between two looks at the bounds.
CANDIDATES, QUERIES_IN_BLOCK, TILE, DIMENSIONS = 4096, 16_384, 128, 16
#: Bytes of a query block at most, and candidates that give the first bounds.
QUERY_BYTES, SAMPLE = 128 << 20, 4096
_FOUND = "query_id long, query_hash long, vec_id long, score long"
_INT64 = (1 << 63) - 1


def quantized(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v (array<double> of whole numbers) of the rows that take part."""
    usable = F.expr(f"`{id_column}` IS NOT NULL AND `{column}` IS NOT NULL AND NOT exists(`{column}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    return vectors.filter(usable).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.expr(f"transform(`{column}`, x -> floor(256D * double(x)))").cast("array<double>").alias("v"))


def best_in_block(queries: np.ndarray, columns: np.ndarray, ids: np.ndarray, norms: np.ndarray, k: np.ndarray, least: np.ndarray, block: int = DIMENSIONS) -> list[list[tuple[int, int]]]:
    """For each query (score, id) of its k best columns, or of those of them that reach its ``least``. ``columns``: (dimensions, vectors);
    ``norms``: of the dimensions from each block on."""
    dims, n = columns.shape
    alive, sums = np.arange(n), np.zeros((len(queries), n))
    least = least.copy()
    for at in range(0, dims, block):
        part = columns[at : at + block]
        sums = sums + queries[:, at : at + block] @ (part if len(alive) == n else part[:, alive])
        if at + block >= dims or not len(alive):
            break
        for i in np.flatnonzero(np.isinf(least) & (len(alive) > k)):  # no bound yet: whole scores of the most promising
            some = alive[np.argpartition(-sums[i], min(4 * k[i], len(alive) - 1))[: 4 * k[i] + 1]]
            least[i] = np.sort(queries[i] @ columns[:, some])[-k[i]]
        rest = np.linalg.norm(queries[:, at + block :], axis=1) * (1 + 1e-9)
        held = (sums + rest[:, None] * norms[at // block + 1][alive] >= least[:, None] - 1e-6).any(axis=0)
        if held.sum() < 0.9 * len(alive):
            alive, sums = alive[held], sums[:, held]
    out = []
    own = ids[alive]
    for scores, most, low in zip(sums, k, least):
        at = np.flatnonzero(scores >= low)
        if len(at) > 4 * most:
            edge = -np.partition(-scores[at], most - 1)[most - 1]
            at = at[scores[at] >= edge]
        order = at[np.lexsort((own[at], -scores[at]))[:most]]
        out.append([(int(scores[i]), int(own[i])) for i in order])
    return out


def _exact(query, rows, ids, k):
    """Scores beyond 2**53: Python integers, kept within 64 bits."""
    q = [int(x) for x in query]
    scored = ((max(-_INT64 - 1, min(_INT64, sum(a * int(b) for a, b in zip(q, r)))), int(i)) for r, i in zip(rows, ids))
    return sorted(scored, key=lambda x: (-x[0], x[1]))[:k]


def _by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (rows, ids, matrix)."""
    ids = t.column("vec_id").to_numpy()
    lists = t.column("v").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    starts = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[int(n)] = rows, ids[rows], values[starts[rows][:, None] + np.arange(n)]
    return out


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query in each pair of blocks (cb, qb)."""

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        pool = _by_length(candidates) if candidates.num_rows else {}
        hashes, bounds = (wanted.column(c).to_numpy() if wanted.num_rows else None for c in ("h", "least"))  # a side without rows has no columns
        for n, (rows, qids, q) in (_by_length(wanted) if wanted.num_rows else {}).items():
            if n not in pool:
                continue
            _, ids, c = pool[n]
            big = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
            exact = big * big * max(n, 1) < 2.0**53
            columns = np.ascontiguousarray(c.T)
            tails = [np.linalg.norm(columns[at:], axis=0) for at in range(0, max(n, 1), DIMENSIONS)] if exact else []
            held = np.sort(ids)
            own = np.searchsorted(held, qids, side="right") - np.searchsorted(held, qids)
            for at in range(0, len(rows), TILE):
                tile = slice(at, at + TILE)
                # k and one more for each row with the query's own id
                if exact:
                    best = best_in_block(q[tile], columns, ids, tails, k + own[tile], bounds[rows[tile]])
                else:
                    best = [_exact(v, c[ids != i], ids[ids != i], k) for i, v in zip(qids[tile], q[tile])]
                for qid, h, some in zip(qids[tile], hashes[rows[tile]], best):
                    found += [(int(qid), int(h), i, s) for s, i in some if i != qid][:k]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "query_hash", "vec_id", "score"), columns)})

    return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(search, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs as :func:`quantized` gives them."""
    vectors, queries = vectors.withColumn("h", F.xxhash64("vec_id", "v")), queries.withColumn("h", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "h"])
    n, wide = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    block = max(1, min(QUERIES_IN_BLOCK, QUERY_BYTES // (8 * max(wide or 1, 1))))
    many, asked = max(1, -(-n // CANDIDATES)), max(1, -(-queries.count() // block))
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    # Written, so that the two sides of a group share no columns: Spark 4.1 mixes them up otherwise.
    dealt = settle(queries.withColumn("qb", F.pmod("h", F.lit(asked)).cast("int")), "queries")
    # All queries against some candidates: the k-th best score is a bound for what follows.
    some = vectors.orderBy("h", "vec_id").limit(SAMPLE).withColumn("cb", F.lit(0)).withColumn("qb", every(asked))
    first = _met(some, dealt.withColumns({"cb": F.lit(0), "least": F.lit(float("-inf"))}), k)
    bounds = first.groupBy(F.col("query_id").alias("vec_id"), F.col("query_hash").alias("h")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    dealt = settle(dealt.join(bounds, ["vec_id", "h"], "left").fillna(float("-inf"), ["least"]), "bounded")
    # Each vector meets each query block once, and each query each block of vectors: blocks against blocks.
    left = vectors.withColumn("cb", F.pmod("h", F.lit(many)).cast("int")).withColumn("qb", every(asked))
    found = _met(left, dealt.withColumn("cb", every(many)), k)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

QUERIES = {"op8_topk": (op8, ORACLE)}
