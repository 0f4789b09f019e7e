"""Scaling, K-means, cluster profiles, DBSCAN, isolation forest and principal components."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.components import components
from tidemark.functions.lineage import settle


def moments(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, in one aggregate; a deviation of zero counts as one."""
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features)).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in features}


def zscored(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as z-scores with the population deviation; nulls count as zero before."""
    df = df.fillna(0, list(features))
    stats = moments(df, features)
    return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in features})


def covariance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """a, b, cov of z-scored features, for a at or before b: one aggregate."""
    cells = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"c{k}") for k, (a, b) in enumerate(cells)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(cells)))).alias("x")).select("x.*")


def pca(df: DataFrame, features: Sequence[str], keep: Sequence[str], n: int = 2) -> tuple[DataFrame, list[float]]:
    """``keep`` and pca_1.. of every row (3 places), and the share of variance in percent (1 place) of each.

    The covariance is one distributed aggregate; only features x features numbers reach the driver. Of
    each component the largest loading is positive.
    """
    z = zscored(df.withColumn("__keep", F.struct(*keep)), features)
    c = np.zeros((len(features), len(features)))
    at = {f: i for i, f in enumerate(features)}
    for r in covariance(z, features).collect():
        c[at[r.a], at[r.b]] = c[at[r.b], at[r.a]] = r["cov"] or 0.0
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[:n]
    parts = vectors[:, order].T
    parts = [v * np.sign(v[np.argmax(np.abs(v))] or 1.0) for v in parts]
    columns = [F.round(sum((F.col(f) * F.lit(float(w)) for f, w in zip(features, v)), F.lit(0.0)), 3).alias(f"pca_{k + 1}") for k, v in enumerate(parts)]
    share = [round(100 * float(values[i]) / max(float(values.sum()), 1e-12), 1) for i in order]
    return z.select("__keep.*", *columns), share


def taken(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (or all, if fewer) of least hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; 0 for one cluster, and for points alone in theirs."""
    names, own = np.unique(labels, return_inverse=True)
    if len(names) < 2 or len(names) >= len(x):
        return 0.0
    sizes, total = np.bincount(own), 0.0
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        away = np.sqrt(np.maximum(((part[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
        sums = np.stack([away[:, own == k].sum(axis=1) for k in range(len(names))], axis=1)
        mine = own[at : at + 256]
        rows = np.arange(len(part))
        a = sums[rows, mine] / np.maximum(sizes[mine] - 1, 1)
        means = sums / sizes
        means[rows, mine] = np.inf
        b = means.min(axis=1)
        total += float(np.where(sizes[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum())
    return total / len(x)


def silhouette_of(df: DataFrame, features: Sequence[str], label: str, key: str, sample: int = 3000) -> float:
    """Euclidean silhouette over at most ``sample`` rows, whatever the table's size."""
    rows = taken(df, key, sample).select(*features, label).toPandas()
    return silhouette(rows[list(features)].to_numpy(dtype=float), rows[label].to_numpy())


def kmeans_search(df: DataFrame, features: Sequence[str], k_range: tuple[int, int] = (3, 7), restarts: int = 2, seed: int = 42, key: str = "row_id", sample: int = 10_000, scored: int = 3000) -> tuple[DataFrame, int, dict[int, float]]:
    """``df`` with ``cluster``, the chosen k and the silhouette of each k.

    Centres are fitted on at most ``sample`` rows of least hash of ``key`` (the method's own sample), for each k the cheapest of some restarts.
    The first k with the strictly best Euclidean silhouette over at most ``scored`` of them wins; every row gets its
    cluster from its centres. Scaling is over all rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    own = df.withColumn("__row", F.struct("*"))
    made = VectorAssembler(inputCols=list(features), outputCol="features").transform(zscored(own, features))
    some = settle(taken(made, key, sample).select(key, "features", *features), "sample").coalesce(1).persist()  # ``sample`` rows, in one part: each fit is some small jobs
    scores, best = {}, None
    for k in range(k_range[0], k_range[1] + 1):
        fits = [KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster").fit(some) for r in range(restarts)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
        scores[k] = round(silhouette_of(model.transform(some), features, "cluster", key, scored), 6)
        if best is None or scores[k] > scores[best[0]]:
            best = (k, model)
    some.unpersist()
    out = best[1].transform(made).select("__row.*", F.col("cluster"))
    return out, best[0], scores


def cluster_profiles(df: DataFrame, label: str = "Label") -> DataFrame:
    """Column names, order and bounds of the risk rules. Size, share, dominant label, purity, means and risk of each cluster."""
    size = df.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("Flow_Duration").alias("d"), (F.avg("Total_Fwd_Packets") + F.avg("Total_Backward_Packets")).alias("p"), F.avg("Packet_Length_Mean").alias("l"), (100 * F.avg((F.col("SYN_Flag_Count") > 0).cast("double"))).alias("syn")
    )
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), label)  # a row for each label
    top = df.groupBy("cluster", label).agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).filter("k = 1").select("cluster", F.col(label).alias("dominant_label"), "n")
    total = Window.partitionBy()  # a row for each cluster
    name = F.col("dominant_label")
    risk = (
        F.when(name.contains("DDoS") | ((F.col("p") > 100) & (F.col("syn") > 50)), "High")
        .when(name.contains("PortScan") | ((F.col("d") < 100) & (F.col("syn") > 50)), "Medium")
        .when(name.contains("Botnet") | (F.col("d") > 10000), "High")
        .when(name.contains("Brute") | name.contains("Patator"), "High")
        .otherwise("Low")
    )
    return size.join(top, "cluster").select(
        F.col("cluster").alias("cluster_id"),
        "size",
        F.round(100.0 * F.col("size") / F.sum("size").over(total), 1).alias("pct_total"),
        "dominant_label",
        F.round(100.0 * F.col("n") / F.col("size"), 1).alias("purity_pct"),
        risk.alias("risk_level"),
        F.round("d", 1).alias("avg_duration_ms"),
        F.round("p", 1).alias("avg_packets"),
        F.round("l", 1).alias("avg_packet_length"),
        F.round("syn", 1).alias("syn_flag_pct"),
        F.concat(F.lit("Mostly "), name, F.lit(" traffic")).alias("interpretation"),
    )


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``column`` (distinct values) and ``number``, from 0 in ascending order. Tasks number ranges of their own; what each must add reaches
    the driver as one number a task."""
    dealt = df.select(column).repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("m", F.monotonically_increasing_id())
    dealt = settle(dealt.select(column, F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "numbers")
    before, starts = 0, []
    for r in sorted(dealt.groupBy("part").count().collect()):
        starts.append((r[0], before))
        before += r[1]
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "part long, first long")
    return dealt.join(F.broadcast(first), "part").select(column, (F.col("at") + F.col("first")).alias("number"))  # a row for each task


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """``key``, cluster: -1 for noise. Neighbourhoods include the point itself.

    Clusters are numbered by their smallest core key, and a border point takes the smallest adjacent number. ``key`` is a whole number
    that doesn't repeat; null features count as zero.

    Up to three features, points lie in grid cells whose diagonal is eps. A cell of ``min_samples`` points is dense: all its points are core and
    of one cluster, so it stands as one node and its points are never paired. Pairs are made between a point of a sparse cell
    and what is near it, at most ``min_samples`` of them to a cell, so they grow with the points, however dense these
    lie. Two dense cells are joined by the boxes around the points of their parts: boxes within eps of each other at the
    far ends join them, boxes that are further apart never do, and points are compared only where boxes leave it open
    and nothing else has joined the cells. With more features, cells of eps on the first two features only make candidates, and
    every pair of neighbours is made.
    """
    d = len(features)
    dims = d if d <= 3 else 2
    side = eps / math.sqrt(d) if d <= 3 else eps
    reach = math.ceil(math.sqrt(d)) if d <= 3 else 1
    f, g = [f"f{i}" for i in range(d)], [f"g{i}" for i in range(dims)]
    p = df.select(F.col(key).alias("id"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, f)))
    # A hair narrower than the side, so that rounding never puts two points of a cell beyond eps.
    p = p.withColumns({c: F.floor(F.col(f"f{i}") / (side * (1 - 1e-9))) for i, c in enumerate(g)})
    dense = p.groupBy(*g).agg(F.count("*").alias("n"), F.min("id").alias("cell")).filter(F.lit(d <= 3) & (F.col("n") >= min_samples)).select(*g, "cell")
    p = settle(p.join(dense, g, "left"), "points")

    steps = [F.explode(F.array(*(F.lit(s) for s in range(-reach, reach + 1)))).alias(f"s{i}") for i in range(dims)]

    def spread(rows: DataFrame) -> DataFrame:
        for i in range(dims):
            rows = rows.select("*", steps[i]).withColumn(g[i], F.col(g[i]) + F.col(f"s{i}")).drop(f"s{i}")
        return rows

    near = spread(p.filter("cell IS NULL").select("id", *f, *g))
    other = p.select(F.col("id").alias("b"), F.col("cell").alias("b_cell"), *g, *(F.col(c).alias(f"o{i}") for i, c in enumerate(f)))
    distance = sum(((F.col(c) - F.col(f"o{i}")) * (F.col(c) - F.col(f"o{i}")) for i, c in enumerate(f)), F.lit(0.0))
    pairs = settle(near.join(other, g).filter(distance <= eps * eps).select(F.col("id").alias("a"), "b", "b_cell"), "pairs")
    sparse = settle(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select(F.col("a").alias("id")), "core")

    # Nodes: dense cells by their smallest key, core points of sparse cells by their own.
    from_core = pairs.join(sparse.select(F.col("id").alias("a")), "a", "left_semi")
    to_cells = from_core.filter("b_cell IS NOT NULL").select("a", F.col("b_cell").alias("b"))
    to_points = from_core.filter("b_cell IS NULL").select("a", "b").join(sparse.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    joined = _joined_cells(p.filter("cell IS NOT NULL"), f, g, spread, eps, side)
    nodes = settle(dense.select(F.col("cell").alias("id")).unionByName(sparse), "nodes")
    one = to_cells.unionByName(to_points).unionByName(joined)
    labels = components(one.select("a", "b").unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    named = settle(labels.join(numbered(labels.select("root").distinct(), "root"), "root").select("id", F.col("number").alias("cluster")), "named")
    of_node = named.select(F.col("id").alias("node"), "cluster")
    border = pairs.select("a", F.coalesce("b_cell", "b").alias("node")).join(of_node, "node").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("border"))
    own = p.select("id", F.coalesce("cell", "id").alias("node")).join(of_node, "node", "left").select("id", "cluster")
    out = own.join(border, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", "border", F.lit(-1)).alias("cluster"))


def _joined_cells(points: DataFrame, f: list[str], g: list[str], spread, eps: float, side: float, cuts: int = 4) -> DataFrame:
    """a < b: dense cells (by their smallest key) that have points within eps of each other."""
    part = {f"k{i}": F.floor(F.col(f[i]) / (side * (1 - 1e-9)) * cuts) for i in range(len(g))}
    points = points.withColumns(part)
    boxes = settle(points.groupBy("cell", *g, *part).agg(*(F.min(c).alias(f"l{i}") for i, c in enumerate(f)), *(F.max(c).alias(f"h{i}") for i, c in enumerate(f))), "boxes")
    ends = [x for i in range(len(f)) for x in (f"l{i}", f"h{i}")]
    mine = spread(boxes.select("cell", *g, *part, *ends))
    theirs = boxes.select(F.col("cell").alias("b"), *g, *(F.col(k).alias(f"b{k}") for k in part), *(F.col(x).alias(f"b{x}") for x in ends))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"l{i}") - F.col(f"bh{i}"), F.col(f"bl{i}") - F.col(f"h{i}")), F.lit(2)) for i in range(len(f))), F.lit(0.0))
    span = sum((F.pow(F.greatest(F.abs(F.col(f"h{i}") - F.col(f"bl{i}")), F.abs(F.col(f"bh{i}") - F.col(f"l{i}"))), F.lit(2)) for i in range(len(f))), F.lit(0.0))
    met = settle(mine.join(theirs, g).filter(F.col("cell") < F.col("b")).select(F.col("cell").alias("a"), "b", *part, *(f"b{k}" for k in part), (span <= eps * eps * (1 - 1e-12)).alias("sure"), (gap <= eps * eps * (1 + 1e-12)).alias("open")).filter("open"), "met")
    sure = met.filter("sure").select("a", "b").distinct()
    left = met.join(sure, ["a", "b"], "left_anti")
    one = points.select(F.col("cell").alias("a"), *part, *f)
    two = points.select(F.col("cell").alias("b"), *(F.col(k).alias(f"b{k}") for k in part), *(F.col(c).alias(f"o{i}") for i, c in enumerate(f)))
    distance = sum(((F.col(c) - F.col(f"o{i}")) * (F.col(c) - F.col(f"o{i}")) for i, c in enumerate(f)), F.lit(0.0))
    close = left.join(one, ["a", *part]).join(two, ["b", *(f"b{k}" for k in part)]).filter(distance <= eps * eps).select("a", "b").distinct()
    return settle(sure.unionByName(close), "joined")


def dbscan_summary(found: DataFrame) -> DataFrame:
    noise = F.sum(F.when(F.col("cluster") == -1, 1).otherwise(0))
    return found.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.coalesce(noise, F.lit(0)).alias("noise"), F.round(100.0 * F.coalesce(noise, F.lit(0)) / F.greatest(F.lit(1), F.count("*")), 2).alias("noise_pct"))


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n: 2 (ln(n - 1) + gamma) - 2 (n - 1) / n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_trees(sample: np.ndarray, trees: int, size: int, seed: int) -> list[np.ndarray]:
    """Each tree as rows of (feature or -1, cut or path length, left, right)."""
    rnd = np.random.default_rng(seed)
    out, limit = [], math.ceil(math.log2(max(size, 2)))
    for _ in range(trees):
        rows = sample[rnd.choice(len(sample), min(size, len(sample)), replace=False)]
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int, nodes=nodes) -> int:
            at = len(nodes)
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if depth >= limit or not len(spread):
                nodes.append([-1, depth + average_path(len(part)), 0, 0])
                return at
            f = int(rnd.choice(spread))
            cut = float(rnd.uniform(part[:, f].min(), part[:, f].max()))
            nodes.append([f, cut, 0, 0])
            left = part[:, f] < cut
            nodes[at][2:] = [grow(part[left], depth + 1), grow(part[~left], depth + 1)]
            return at

        grow(rows, 0)
        out.append(np.array(nodes))
    return out


def forest_scores(trees: list[np.ndarray], x: np.ndarray, size: int) -> np.ndarray:
    """Anomaly score of each row, from 0 to 1."""
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = t[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            left = x[np.arange(len(x)), np.maximum(f, 0)] < t[at, 1]
            at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
        total += t[at, 1]
    return 2.0 ** (-total / len(trees) / max(average_path(size), 1e-9))


def anomalies(df: DataFrame, features: Sequence[str], key: str, keep: Sequence[str] = (), contamination: float = 0.05, trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """``key``, ``keep``, anomaly_label (-1 or 1), anomaly_score (4 places; below 0 is anomalous) and is_anomaly.

    Trees grow on a sample of at most trees * size rows (the method's own subsample); every row is scored
    by an Arrow function, and the cut is the distributed percentile of the scores.
    """
    z = zscored(df, features)
    order = F.xxhash64(F.col(key), F.lit(seed))
    sample = z.orderBy(order, key).limit(trees * size).select(*features).toPandas().to_numpy(dtype=float).reshape(-1, len(features))
    if not len(sample):
        return df.select(key, *keep).withColumns({"anomaly_label": F.lit(1), "anomaly_score": F.lit(0.0), "is_anomaly": F.lit(0)})
    forest = isolation_trees(sample, trees, min(size, len(sample)), seed)
    n, names = min(size, len(sample)), list(features)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(forest_scores(forest, x[names].to_numpy(dtype=float), n))

    scored = settle(z.select(key, *keep, score(F.struct(*names)).alias("s")), "scores")
    cut = scored.agg(F.percentile_approx("s", 1 - contamination, 10000)).first()[0]
    out = scored.withColumn("is_anomaly", (F.col("s") > cut).cast("int"))
    return out.select(key, *keep, F.when(F.col("is_anomaly") == 1, -1).otherwise(1).alias("anomaly_label"), F.round(F.lit(cut) - F.col("s"), 4).alias("anomaly_score"), "is_anomaly")


def anomaly_metrics(found: DataFrame, attack: str = "is_attack") -> DataFrame:
    hits = F.coalesce(F.sum(F.when((F.col("is_anomaly") == 1) & (F.col(attack) == 1), 1)), F.lit(0))
    n = F.coalesce(F.sum("is_anomaly"), F.lit(0))
    return found.agg(F.count("*").alias("rows"), n.alias("anomalies"), hits.alias("attacks_among_anomalies"), F.round(100.0 * hits / F.greatest(F.lit(1), n), 1).alias("purity_pct"))
