"""Token counts of sections by offsets.

A document is encoded once, whole. A byte-level token covers a known number of bytes, so the running
sum of token lengths gives every token's span. The spans are joined to the sections' spans by binary
search over the sorted section bounds, and a token that lies in several sections is given out by an
explicit rule:

``majority``  to the section with most of its bytes, the earlier one in a tie (the default)
``first``     to the section where it begins
``last``      to the section where it ends
``share``     to each section by its share of the bytes (counts are then fractions)

Bytes of a token outside every section count for none; a token in no section is left over
(``section`` -1). Sections are half-open spans of code points, sorted, without overlap.

Defined results: a null id stays null; a null text counts as empty; an empty text has one empty line, with no tokens; very
long texts are encoded whole; repeated rows are counted each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table, text_or_empty

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("majority", "first", "last", "share")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long"

_made: dict = {}


def encoding(path: str | None = None):
    """(encoder, byte length of each token)."""
    if path not in _made:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _made[path] = tiktoken.Encoding("tokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _made[path]


def lines(text: str) -> np.ndarray:
    """Spans of the lines, each with its line feed: shape (n, 2)."""
    points = np.frombuffer(text.encode() if text.isascii() else text.encode("utf-32-le", "surrogatepass"), dtype=np.uint8 if text.isascii() else "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if not len(ends) or ends[-1] < len(points):
        ends = np.append(ends, len(points))
    return np.stack([np.append(0, ends[:-1]), ends], axis=1).astype(np.int64)


def allocate(spans: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, how many of them cross a bound between sections, and the tokens in no section.

    ``spans`` and ``sections``: shape (n, 2), half-open, sorted, in the same unit.
    """
    n = len(sections)
    count, crossing = np.zeros(n), np.zeros(n, dtype=np.int64)
    if not len(spans) or not n:
        return count, crossing, float(len(spans))
    start, end = spans[:, 0], spans[:, 1]
    a = np.searchsorted(sections[:, 1], start, side="right")
    b = np.searchsorted(sections[:, 0], end, side="left") - 1
    inside, many = a == b, b > a
    count += np.bincount(a[inside], minlength=n)
    if t := np.flatnonzero(many).tolist():
        reps = (b - a + 1)[t]
        first = np.cumsum(reps) - reps
        token = np.repeat(t, reps)
        section = a[token] + np.arange(len(token)) - np.repeat(first, reps)
        part = np.maximum(np.minimum(sections[section, 1], end[token]) - np.maximum(sections[section, 0], start[token]), 0)
        if rule == "share":
            count += np.bincount(section, part / np.repeat(np.add.reduceat(part, first), reps), n)
            crossing += np.bincount(section[part > 0], minlength=n)
        else:
            # Of a token's sections, the one that ranks first: most bytes, or first or last with any; the earlier one in a tie.
            at = np.arange(len(token))
            rank = {"majority": part, "first": (part > 0).astype(np.int64), "last": np.where(part > 0, at + 1, 0)}[rule]
            held = at[rank == np.repeat(np.maximum.reduceat(rank, first), reps)]
            chosen = section[held[np.append(True, token[held][1:] != token[held][:-1])]]
            count += np.bincount(chosen, minlength=n)
            crossing += np.bincount(chosen, minlength=n)
    return count, crossing, float(len(spans) - inside.sum() - many.sum())


def attribute(docs: DataFrame, sections: Callable[[str], np.ndarray] = lines, rule: str = "majority", path: str | None = None, text: str = "text") -> DataFrame:
    """One row for each section of each document: its span in code points, tokens and crossing tokens. No shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(path)
        for batch in batches:
            ids: list[int | None] = []
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, t in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist()):
                ends = np.cumsum(lengths[np.array(enc.encode_ordinary(t), dtype=np.int64)]) if t else np.zeros(0, dtype=np.int64)
                found = sections(t)
                at = found
                if not t.isascii():  # spans in code points -> in bytes
                    raw = np.frombuffer(t.encode(), dtype=np.uint8)
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[found]
                count, crossing, rest = allocate(np.stack([ends - np.diff(ends, prepend=0), ends], axis=1), at, rule)
                order = np.arange(len(found))
                if rest:
                    order, found = np.append(order, -1), np.vstack([found, [[0, 0]]])
                    count, crossing = np.append(count, rest), np.append(crossing, 0)
                ids += [doc] * len(found)
                for column, values in zip(out, (order, found[:, 0], found[:, 1], count, crossing)):
                    column.append(values)
            if ids:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c), kind) for c, kind in zip(out, kinds))], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    ship(docs.sparkSession)
    return docs.select("doc_id", text_or_empty(text)).mapInArrow(run, SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, whole tokens by majority."""
    out = attribute(table(spark, sf_dir, "documents"))
    return out.withColumn("n_tokens", out.n_tokens.cast("long"))


QUERIES = {"op1_token_counts": (op1, None)}
