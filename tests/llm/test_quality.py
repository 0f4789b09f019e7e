import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def judged(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in quality.judge(df).collect()}


def test_metrics_follow_brute_force(spark):
    found = []

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet="ab \n\t\r\x0b\x0cé#| ", max_size=60), min_size=60, max_size=60))
    def run(texts):
        texts = [*texts, None, "", "a b c d e f\n" * 40, "x " * 30000]
        for i, r in judged(spark, texts).items():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[i]), texts[i]
        found.append(1)

    run()
    assert found


def test_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(50)) + "."
    got = judged(spark, [clean, clean, "short text", " ".join(f"w{i} |" for i in range(40)), " ".join(f"W{i}ORD!!" for i in range(40)), None])
    assert [got[i].kept for i in range(6)] == [True, True, False, False, False, False]
    assert [got[i].base_failed for i in range(6)] == [False, False, True, False, False, True]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string, n_words string, __q_text string")
    assert quality.judge(df).count() == 0
    row = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(50)), "no", "many", "x")], "doc_id long, text string, kept string, n_words string, __q_text string")
    assert quality.filter_documents(row).collect()[0].n_words == "many"


def test_order_does_not_change_the_verdict(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    other = {r.doc_id: r.kept for r in quality.judge(df, rules=tuple(reversed(quality.RULES))).collect()}
    assert one == other


def test_a_filter_stays_above_the_metrics(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.filter_documents(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter kept") < plan.index("Generate") and "rand(" not in plan and "xxhash64" not in plan[: plan.index("Generate")]
