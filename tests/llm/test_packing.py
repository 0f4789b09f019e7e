import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import bpe, packing


def lay_out(counts, made):
    """(bin, offset, length) of every piece, by the plan's steps."""
    steps = sorted(zip(made.length, made.rank, made.bin, made.offset))
    out = []
    for i, (length, rank, first, offset) in enumerate(steps):
        end = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == length else counts[length]
        out += [(first + k, offset, length) for k in range(end - rank)]
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(seed, score):
    rnd = random.Random(seed)
    counts = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, 65), 40)}
    capacity = packing.Capacity(64, docs=rnd.choice([None, 3]), attention=rnd.choice([None, 64 * 50 + 64 * 64 // 2]), score=score)
    if capacity.attention:
        counts = {n: c for n, c in counts.items() if n * n <= capacity.attention}
    bins = defaultdict(list)
    for b, offset, length in lay_out(counts, packing.plan(counts, capacity)):
        bins[b].append((offset, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    tokens, docs, attention = capacity.limits()
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= tokens and len(rows) <= docs and sum(n * n for _, n in rows) <= attention


def best_fit(counts, size):
    rest = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [i for i, r in enumerate(rest) if r >= n]
        if fits:
            rest[min(fits, key=lambda i: rest[i])] -= n
        else:
            rest.append(size - n)
    return len(rest)


@pytest.mark.parametrize("seed", range(4))
def test_as_few_bins_as_one_by_one(seed):
    rnd = random.Random(seed)
    counts = {n: rnd.randint(1, 20) for n in rnd.sample(range(1, 101), 60)}
    assert packing.plan(counts, packing.Capacity(100, weights=(1, 0, 0))).bins <= best_fit(counts, 100)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    df = df.unionByName(spark.createDataFrame([(10_000, None, "a"), (10_001, "", "b"), (10_002, "same", "c"), (10_002, "same", "c"), (None, "no id", "d"), (None, "no id", "d")], "doc_id long, text string, lang string"))
    e = bpe.encoder(bpe.vocabulary_path())
    want = []
    for r in df.collect():
        ids = [*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = packing.pack(df).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(w[3] for w in want) / 2048 + 1
    assert packing.pack(df.filter("false")).count() == 0
