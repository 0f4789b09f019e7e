import random

import numpy as np
import pytest

from tidemark.llm import suffix


def brute(rows, length):
    """rows: (id, text). Returns id -> (bytes, spans, kept)."""
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = set()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in first:
                gone.update(range(i, i + length))
            else:
                first[s] = (doc, i)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = [i for i in sorted(gone) if i - 1 not in gone]
        out[doc] = (len(raw), len(gone), len(spans), kept)
    return out


def found(df, length, q):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix.dedup_bytes(df, length, q).collect()}


def sample(rnd, alphabet, n=40):
    pool = ["".join(rnd.choices(alphabet, k=rnd.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = "".join(rnd.choice([rnd.choice(pool), "".join(rnd.choices(alphabet, k=rnd.randint(1, 30)))]) for _ in range(rnd.randint(0, 8)))
        rows.append((3 * i, t))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = sample(rnd, ["ab", "abcdefgh é日", "abcdefghijklmnop "][seed])
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab" * 300), (1004, rows[5][1]), (1005, rows[5][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, at string").repartition(5)
    assert found(df, 32, 16) == brute(rows, 32)


def test_very_large_buckets_and_long_texts(spark, monkeypatch):
    rnd = random.Random(5)
    common = "".join(rnd.choices("abcdefgh", k=70))
    rows = [(i, "".join(rnd.choices("abcdefgh", k=60)) + common + "".join(rnd.choices("abcdefgh", k=60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 100)
    assert found(df, 100, 24) == want
    monkeypatch.setattr(suffix, "BUCKET_SPANS", 2)
    monkeypatch.setattr(suffix, "crowded_anchors", lambda *a: np.zeros(0, dtype=np.uint64))
    assert found(df, 100, 24) == want
    short = brute(rows, 64)
    assert found(df, 64, 24) == short and any(x[1] for x in short.values())
    monkeypatch.setattr(suffix, "BUCKET_SPANS", 20_000)
    assert found(df, 64, 24) == short


def test_pieces_of_long_texts():
    rnd = random.Random(2)
    old = suffix._CHUNK
    try:
        suffix._CHUNK = 300
        data = np.frombuffer("".join(rnd.choices("abc", k=2000)).encode(), dtype=np.uint8)
        offsets = np.array([0, 100, 1500, 1500, 2000])
        seen = set()
        for part, ends, rows, places in suffix._chunks(data, offsets, 40):
            begin = 0
            for e, row, place in zip(ends, rows, places):
                for i in range(e - begin - 39):
                    assert bytes(part[begin + i : begin + i + 40]) == bytes(data[offsets[row] + place + i :][:40])
                    seen.add((int(row), int(place + i)))
                begin = e
        assert seen == {(r, i) for r in range(4) for i in range(offsets[r + 1] - offsets[r] - 39)}
    finally:
        suffix._CHUNK = old


def test_repeated_and_null_ids(spark):
    t = "".join(random.Random(1).choices("abcdef", k=150))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[20:]), (2, t[:120] + "zzz"), (2, "other")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept).decode()) for r in suffix.dedup_bytes(df).collect()), key=str)
    # The null id is first; both rows of id 1 are one document.
    assert got == sorted([(1, 150, t[:20]), (1, 150, t[:20]), (None, 130, t[20:]), (2, 123, "zzz"), (2, 5, "other")], key=str)
    assert suffix.dedup_bytes(df.filter("false")).count() == 0


def test_refinement_numbers_equal_strings():
    rnd = random.Random(3)
    data = np.frombuffer(("".join(rnd.choices("ab", k=400)) * 2).encode(), dtype=np.uint8)
    at = np.arange(len(data) - 99)
    bucket = suffix.refine(data, at, len(data) - np.arange(len(data)))
    names = {}
    for i, b in zip(at, bucket):
        assert names.setdefault(int(b), bytes(data[i : i + 100])) == bytes(data[i : i + 100])
    assert len(names) == len({bytes(data[i : i + 100]) for i in at})


@pytest.mark.parametrize("seed", range(6))
def test_refinement_of_pieces(seed):
    """Pieces of all lengths, much repetition: equal numbers for equal strings, however buckets are parted."""
    rnd = random.Random(seed)
    base = "".join(rnd.choices("ab", k=150)) if seed % 2 else "ab" * 80
    pieces = []
    for _ in range(60):
        at = rnd.randrange(len(base) - 40)
        t = list(base[at : at + rnd.randint(32, 110)] + "".join(rnd.choices("abc", k=rnd.choice([0, 3, 30]))))
        if rnd.random() < 0.4:
            t[rnd.randrange(len(t))] = "\0z"[rnd.randrange(2)]
        pieces.append("".join(t).encode())
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    at = np.flatnonzero(room >= 32)
    for parts in (1, 4, 50):
        bucket = suffix.refine(data, at, room, 32, parts)
        names = {}
        for i, b in zip(at, bucket):
            assert names.setdefault(int(b), bytes(data[i : i + 32])) == bytes(data[i : i + 32])
        assert len(names) == len({bytes(data[i : i + 32]) for i in at})
