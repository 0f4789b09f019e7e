import random

import pytest

from tidemark.llm import linededup


def brute(rows, size=3):
    """rows: (id, text), unique ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if not "".join(w).strip(" \t\r"):
                continue
            if w in seen:
                gone.update(range(i, i + size))
            seen.add(w)
        out[doc] = (len(lines), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", " ", "dé"]) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "same\n" * 3000), (104, "x\ny\nz"), (105, "x\ny\nz")]
    df = spark.createDataFrame([(t, i, "k") for i, t in rows], "text string, doc_id long, kept string")
    got = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept) for r in linededup.dedup_lines(df).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_columns(spark):
    rows = [(1, "a\nb\nc", "x", 5), (1, "a\nb\nc", "x", 5), (2, "a\nb\nc\nd", "y", 7), (None, "q", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts string, n_chars long")
    got = sorted(map(tuple, linededup.clean_documents(df).collect()), key=str)
    assert got == sorted([(1, "a\nb\nc", "x", 5), (1, "a\nb\nc", "x", 5), (2, "d", "y", 1), (None, "q", "z", 1)], key=str)
    assert linededup.clean_documents(df.filter("false")).count() == 0
