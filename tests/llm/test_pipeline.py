from collections import defaultdict

import corpus_pipeline
import numpy as np

from tests.llm import test_linededup, test_neardup, test_pii, test_quality
from tidemark.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), "test-stage")
        steps.append(docs)
    for d in steps[:-1]:
        assert d.columns == columns and all(r.n_chars == len(r.text) for r in d.collect())
    of = lambda d: {r.doc_id: r.text for r in d.collect()}
    start = of(spark.read.parquet(f"{SF}/documents.parquet"))
    one, two, three, four = map(of, steps[:-1])

    def kept(text):
        n, chars, symbols, dups, repeats = test_quality.brute(text)
        lines = sum(bool(test_quality.WORD.search(x)) for x in text.split("\n"))
        capitals = sum(c.isupper() for c in text)
        return not (n < 10 or 100 * repeats > 20 * n or symbols > 0.1 * n or (dups > 2 and dups > 0.3 * lines) or chars < 2.5 * n or chars > 12 * n or text.count("!") > 0.5 * n or capitals > 0.5 * chars)

    assert one == {d: t for d, t in start.items() if kept(t)}
    assert two == {d: t for d, (_, _, t) in test_linededup.brute(list(one.items())).items()}
    named = test_neardup.brute(sorted(two.items()))
    assert three == {d: two[d] for d in set(named.values())}
    assert four.keys() == three.keys()
    for d, t in four.items():
        assert not test_pii.brute(t)
        if not test_pii.brute(three[d]) and "token" not in three[d]:
            assert t == three[d]
    e = bpe.encoder(bpe.vocabulary_path())
    bins, length = defaultdict(list), defaultdict(int)
    for r in steps[-1].collect():
        bins[r.sequence_id].append((r.offset, r.length))
        length[r.doc_id] += r.length
    assert length == {d: len(e.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in four.items()}
    for rows in bins.values():
        assert np.cumsum([0] + [n for _, n in sorted(rows)]).tolist()[:-1] == [o for o, _ in sorted(rows)] and sum(n for _, n in rows) <= 2048


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
    assert quality.RULES and len(corpus_pipeline.STAGES) == 5


def test_odd_documents_and_clashing_names(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that the stages use themselves."""
    words = lambda k, n: " ".join(f"word{k}x{i}" for i in range(n))
    base = [(i, words(i, 60) + ".", "en", "s", None) for i in range(12)]
    odd = [(20, None, "en", "s", 0), (21, "", None, None, 0), (None, words(50, 60) + ".", "en", "s", 1), (22, base[3][1], "en", "s", 1), (23, base[4][1], "en", "s", 1), (4, base[4][1], "en", "s", None), (24, words(70, 40000) + ".", "en", "s", 1), (25, "mail jo@x.org " + words(80, 60) + ".", "en", "s", 1)]
    names = ["kept", "row", "class", "id", "band", "key", "n_words", "base_failed", "starts", "copy", "h", "found", "spans", "ids", "sequence_id", "__first"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *(f"own {n}" for n in names)) for r in base + odd], schema)
    columns, tables = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), "odd-stage")
        assert docs.columns == columns and all(r[n] == f"own {n}" for r in docs.collect() for n in names)
        tables.append(sorted((str(r.doc_id), r.text) for r in docs.collect()))
    kept = dict(tables[2])
    assert {d for d, _ in tables[0]} == {str(i) for i in [*range(12), 22, 23, 24, 25]} | {"None"}
    assert set(kept) == {str(i) for i in [*range(12), 24, 25]} | {"None"} and len(tables[2]) == 15 and kept["24"].count(" ") == 39999
    assert dict(tables[3])["25"].startswith("mail [EMAIL] word80x0")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {*range(12), 24, 25, None}
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
