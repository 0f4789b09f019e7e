"""Line dedup by overlapping three-line windows.

Each window of three consecutive lines has a 128-bit hash. A window that comes again anywhere in the
corpus stays where it comes first (smaller document id, then smaller line) and is removed everywhere
else; the lines to remove are the union of the removed windows. Counting is done with partial
aggregates, so a window of a third of all documents is one row from each task; only windows that come
again are joined back, by a plain equi-join whose large keys Spark splits.

Defined results: a null text has one empty line and stays null; a text of fewer than three lines has
no window; blank lines count as lines, but a window of blank lines alone stays; rows with the same id
and text are one document and are treated alike, rows with the same id and other texts are ordered by
a hash of the text; a null id orders first; an empty table gives no rows; very long texts are read
whole; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """id, copy, i, h1, h2: a row for each window that isn't blank. ``docs`` has id, copy and text."""
    lines = docs.select("id", "copy", F.split("text", "\n").alias("ls")).filter(F.size("ls") >= size)
    parts = ", ".join(f"ls[i + {k}]" for k in range(size))
    each = F.expr(f"transform(sequence(0, size(ls) - {size}), i -> struct(i AS i, xxhash64({parts}) AS h1, xxhash64(7L, {parts}) AS h2, trim(BOTH ' \\t\\r' FROM concat({parts})) = '' AS blank))")
    return lines.select("id", "copy", F.inline(each)).filter("NOT blank").drop("blank")


def removed_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """id, copy and ``starts`` (sorted: the first lines of the windows to remove), for documents that lose lines."""
    found = windows(docs, size)
    at = F.struct("id", "copy", "i")
    again = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(again, ["h1", "h2"]).filter(at > F.col("first"))
    return later.groupBy("id", "copy").agg(F.sort_array(F.collect_set("i")).alias("starts"))


def dedup_lines(docs: DataFrame, size: int = WINDOW, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``row`` (a struct: the columns of ``docs``), ``kept`` (the text that stays), ``n_lines`` and ``n_removed``."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("copy"))
    gone = removed_windows(keyed.select("id", "copy", F.col("row").getField(text).alias("text")), size)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("copy").alias("gone_copy"), "starts")
    both = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("copy") == F.col("gone_copy")), "left")
    both = both.select("row", "starts", F.col("row").getField(text).alias("text")).withColumn("ls", F.split("text", "\n"))
    # Runs of removed windows that touch are one span of lines; what lies between the spans stays.
    both = both.withColumns(
        {
            "begins": F.expr(f"filter(starts, (x, k) -> k = 0 OR starts[greatest(k - 1, 0)] + {size} < x)"),
            "ends": F.expr(f"transform(filter(starts, (x, k) -> k = size(starts) - 1 OR x + {size} < starts[least(k + 1, size(starts) - 1)]), x -> x + {size})"),
        }
    )
    spans = "zip_with(concat(array(0), ends), concat(begins, array(size(ls))), (a, b) -> slice(ls, a + 1, b - a))"
    return both.select(
        "row",
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.expr(f"array_join(flatten({spans}), '\\n')")).alias("kept"),
        F.when(F.col("text").isNull(), 1).otherwise(F.size("ls")).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(zip_with(begins, ends, (a, b) -> b - a), 0, (s, x) -> s + x)"), F.lit(0)).cast("long").alias("n_removed"),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines gone from ``text``, and ``n_chars`` to match."""
    out = dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(ls) - 1)) AS i, ls FROM l WHERE len(ls) >= 3
), v AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS s FROM w WHERE trim(ls[i] || ls[i + 1] || ls[i + 2], ' ' || chr(9) || chr(13)) <> ''
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM v) WHERE k > 1
), g AS (
  SELECT DISTINCT doc_id, i + k AS j FROM r, (SELECT unnest(range(0, 3)) AS k)
), e AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS j FROM l
), k AS (
  SELECT e.doc_id, count(*)::BIGINT AS n_lines, count(g.j)::BIGINT AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY e.j) FILTER (WHERE g.j IS NULL), '') AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""

QUERIES = {"op4_line_dedup": (op4, ORACLE)}
