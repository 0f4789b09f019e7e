"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean expression over the whole text. Its rejection rate and its cost are
estimated on a bounded sample; the rules then stand in one ``CASE`` in the order of rejection per
cost, so that most bad documents leave after a cheap test. The order changes the work, never the
verdict. The query returns the base metrics of every document, so these are computed whatever a rule says;
what the cascade spares are the scans of the rules that read the text themselves (exclamations, capitals).

Defined results: a null text counts as empty; an empty text has no words and fails the base rule;
very long texts are read whole; repeated rows are judged alike; an empty table gives an empty
table; other columns are ignored, whatever their names (computed names start with ``__q``).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and rejection rates are estimated.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``reject``: SQL over ``__q_text`` and the metrics of :func:`measured`, true for a document to drop."""

    name: str
    reject: str


#: The method's own rules, beside the base rule. A clean text has almost no markup symbols, few
#: capitals or exclamation marks, and no line that comes again and again.
RULES = (
    Rule("symbols", "n_symbols > 0.1D * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 2 AND n_dup_lines > 0.3D * __q_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2.5D * n_words OR word_chars > 12D * n_words)"),
    Rule("exclamations", "length(__q_text) - length(translate(__q_text, '!', '')) > 0.5D * n_words"),
    Rule("capitals", "n_words > 0 AND length(regexp_replace(__q_text, r'[^\\p{Lu}]', '')) > 0.5D * word_chars"),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the helpers ``__q_*``.

    Five-word windows are compared by 64-bit hashes inside one document.
    """
    clash = [c for c in docs.columns if c in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"} or c.startswith("__q")]
    out = docs.drop(*clash).withColumn("__q_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn("__q_words", F.expr(f"filter(split(__q_text, r'{_BLANK}+'), w -> w <> '')"))
    out = out.withColumn("__q_hashes", F.expr("transform(__q_words, w -> xxhash64(w))"))
    out = out.withColumn(
        "__q_windows",
        F.expr(
            "CASE WHEN size(__q_hashes) < 5 THEN array() ELSE transform(sequence(0, size(__q_hashes) - 5), i -> "
            "xxhash64(__q_hashes[i], __q_hashes[i + 1], __q_hashes[i + 2], __q_hashes[i + 3], __q_hashes[i + 4])) END"
        ).cast("array<bigint>"),
    )
    # Only texts with a window that comes again pay for the sort.
    out = out.withColumn(
        "__q_sorted",
        F.expr("CASE WHEN size(array_distinct(__q_windows)) = size(__q_windows) THEN NULL ELSE sort_array(transform(__q_windows, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    out = out.withColumn(
        "__q_places",
        F.expr("sort_array(transform(filter(__q_sorted, (x, k) -> (k > 0 AND __q_sorted[greatest(k - 1, 0)].h = x.h) OR (k < size(__q_sorted) - 1 AND __q_sorted[least(k + 1, size(__q_sorted) - 1)].h = x.h)), x -> x.i))"),
    )
    return out.withColumns(
        {
            "n_words": F.expr("CAST(size(__q_words) AS BIGINT)"),
            "word_chars": F.length(F.translate("__q_text", " \t\n\x0b\x0c\r", "")).cast("bigint"),
            "n_symbols": F.expr(f"CAST(length(__q_text) - length(translate(__q_text, '{_SYMBOLS}', '')) AS BIGINT)"),
            "__q_kept_lines": F.expr(f"filter(split(__q_text, '\\n'), l -> l RLIKE r'{_WORD}')"),
            "n_repeat_words": F.expr(
                "coalesce(aggregate(__q_places, named_struct('n', 0L, 'e', 0), (a, i) -> named_struct('n', a.n + i + 5 - greatest(i, a.e), 'e', i + 5), a -> a.n), 0L)"
            ),
        }
    ).withColumns({"__q_lines": F.expr("size(__q_kept_lines)"), "n_dup_lines": F.expr("CAST(size(__q_kept_lines) - size(array_distinct(__q_kept_lines)) AS BIGINT)")})


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, times: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, share rejected) for each rule, best rejection per cost first.

    The sample has at most about ``rows`` rows at every input size; it decides the order only. Its metrics are computed
    once; a rule's seconds are the least of some runs of it alone over them, less those of a rule that rejects nothing.
    """
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, rows / max(total, 1)), seed=11).limit(rows)
    scored = measured(sample).select("__q_text", "__q_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").persist()

    def timed(reject: str) -> tuple[float, int]:
        job = scored.agg(F.sum(F.expr(f"CASE WHEN {reject} THEN 1 ELSE 0 END")))
        seconds = []
        for _ in range(times + 1):  # the first run compiles
            began = time.perf_counter()
            hits = job.first()[0] or 0
            seconds.append(time.perf_counter() - began)
        return min(seconds[1:]), hits

    try:
        n = max(scored.count(), 1)
        empty, _ = timed("n_words < 0")
        found = []
        for rule in rules:
            seconds, hits = timed(rule.reject)
            found.append((rule, max(seconds - empty, 1e-4), hits / n))
    finally:
        scored.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule]) -> Column:
    """True for a document that no rule rejects; later rules aren't evaluated once one has rejected."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.reject} THEN false" for r in rules) + " ELSE true END")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the metrics, ``base_failed`` and ``kept``. One pass without a shuffle."""
    order = [r for r, _, _ in estimate(docs, rules, sample_rows)]
    own = [c for c in docs.columns if c in {"base_failed", "kept"}]
    out = measured(docs.drop(*own)).withColumn("base_failed", base_failed())
    # The verdict comes out of a generator of one row each, which keeps a later filter above this projection: pushed below, the
    # filter would put the arrays into the lambdas that read them, and build them again for each element.
    verdict = F.explode(F.array(F.expr("NOT base_failed") & cascade(order)))
    return out.select(*(F.col(f"`{c}`") for c in out.columns if not c.startswith("__q")), verdict.alias("kept"))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    columns = docs.columns
    return judge(docs.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in columns))), rules).filter("kept").select("__row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
    CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END AS g FROM a
), u AS (
  SELECT doc_id, unnest(g) AS s, unnest(range(0, len(g))) AS i FROM b WHERE len(list_distinct(g)) < len(g)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM u) WHERE c > 1
), rw AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT b.doc_id, t, ls, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN rw USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR (n_dup_lines > 2 AND n_dup_lines > 0.3 * len(ls))
    OR (n_words > 0 AND (word_chars < 2.5 * n_words OR word_chars > 12 * n_words))
    OR (length(t) - length(replace(t, '!', '')) > 0.5 * n_words)
    OR (n_words > 0 AND length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 0.5 * word_chars)) AS kept
FROM f
"""

QUERIES = {"op6_quality": (op6, ORACLE)}
