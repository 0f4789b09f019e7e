import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokencount as tc


def brute(spans, sections, rule):
    count, crossing, rest = [0.0] * len(sections), [0] * len(sections), 0
    for s, e in spans:
        over = [max(0, min(e, y) - max(s, x)) for x, y in sections]
        held = [i for i, o in enumerate(over) if o]
        if not held:
            rest += 1
        elif len(held) == 1:
            count[held[0]] += 1
        elif rule == "share":
            for i in held:
                count[i] += over[i] / sum(over)
                crossing[i] += 1
        else:
            k = held[0] if rule == "first" else held[-1] if rule == "last" else max(held, key=lambda i: (over[i], -i))
            count[k] += 1
            crossing[k] += 1
    return count, crossing, rest


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=20), st.lists(st.integers(0, 6), max_size=12), st.sampled_from(tc.RULES))
def test_allocation(tokens, cuts, rule):
    ends = np.cumsum(np.array(tokens, dtype=np.int64))
    spans = np.stack([ends - np.array(tokens, dtype=np.int64), ends], axis=1) if tokens else np.zeros((0, 2), dtype=np.int64)
    bounds = np.cumsum([0, *cuts])
    sections = [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])][::2] if len(cuts) % 2 else [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])]
    sections = [s for s in sections if s[1] > s[0]]
    got = tc.allocate(spans, np.array(sections, dtype=np.int64).reshape(-1, 2), rule)
    want = brute(spans.tolist(), sections, rule)
    assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1] and got[2] == want[2]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).select("doc_id", "text", "source")
    odd = [(-2, None, "x"), (-3, "", "x"), (-4, "a\n\n\n  b\n日本\n語🎉\n\n", "x"), (-5, "y" * 40000, "x")]
    df = df.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    sums, spans = {}, {}
    for r in tc.attribute(df).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    for d, t in texts.items():
        assert sums[d] == len(whole.encode(t, add_special_tokens=False).ids)
        assert "".join(t[a:b] for a, b in sorted(spans[d])) == t
        assert len(spans[d]) == len(t.splitlines(keepends=True) if "\n" not in t else t.removesuffix("\n").split("\n")) or not t
    assert tc.attribute(df.filter("false")).count() == 0


def test_every_line_of_the_query_against_brute_force(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text")
    odd = [(None, "null id\n  two\n"), (-1, "a real -1"), (-4, "a\n\n\n  b\n日本\n語🎉\n\n"), (-5, None), (-6, "\n"), (-7, "x  \n  \n   y")]
    df.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    enc, _ = tc.encoding()
    want = []
    for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect():
        text = r.text or ""
        cuts = [i + 1 for i, c in enumerate(text) if c == "\n"]
        bounds = [0, *cuts] if cuts and cuts[-1] == len(text) else [0, *cuts, len(text)]
        lines = list(zip(bounds[:-1], bounds[1:])) or [(0, 0)]
        raw = [len(text[:b].encode()) for b in bounds]
        sections = list(zip(raw[:-1], raw[1:])) or [(0, 0)]
        spans, at = [], 0
        for t in enc.encode_ordinary(text):
            n = len(enc.decode_single_token_bytes(t))
            spans.append((at, at + n))
            at += n
        count, crossing, rest = brute(spans, sections, "majority")
        assert not rest
        want += [(r.doc_id, i, a, b, int(n), c) for i, ((a, b), n, c) in enumerate(zip(lines, count, crossing))]
    got = [tuple(r) for r in tc.op1(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[5] for x in want)


def test_rule_names():
    with pytest.raises(ValueError):
        tc.attribute(None, rule="none")
