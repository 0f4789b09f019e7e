import random
from math import floor, inf, isfinite, nan

import pytest

from tidemark.llm import search


def brute(rows, divisor=50, k=5):
    good = [(i, [floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for qid, qv in {(i, tuple(v)) for i, v in good if i % divisor == 0}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != qid and len(v) == len(qv))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    v = search.quantized(df)
    return sorted(map(tuple, search.top_k(v, v.filter("vec_id % 50 = 0")).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 60)
    monkeypatch.setattr(search, "QUERIES_IN_BLOCK", 4)
    monkeypatch.setattr(search, "SAMPLE", 30)
    monkeypatch.setattr(search, "TILE", 2)
    rnd = random.Random(seed)
    dims = rnd.choice([3, 16, 40])
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.25, 0.0]) for _ in range(dims)]) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(8)] + [(9, rows[9][1])]
    rows += [(600, None), (601, [None] * dims), (602, [nan] * dims), (650, [inf] * dims), (None, rows[0][1]), (700, [1.0, 2.0]), (701, [3.0, 2.0])]
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_large_numbers(spark):
    assert found(spark, []) == []
    rows = [(0, [1e6, -3.0]), (1, [1e5, 2.0]), (2, [-1e6, 0.1])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == []
