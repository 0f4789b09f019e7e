"""The queries of this subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from . import bpe, html_text, linededup, neardup, packing, pii, quality, search, suffix, tokencount

QUERIES = {**tokencount.QUERIES, **bpe.QUERIES, **suffix.QUERIES, **neardup.QUERIES, **linededup.QUERIES, **quality.QUERIES, **pii.QUERIES, **search.QUERIES, **packing.QUERIES, **html_text.QUERIES}
