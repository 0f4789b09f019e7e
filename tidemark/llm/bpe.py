"""Byte-pair encoding with forced boundaries, and decoding.

Two neighbouring bytes that stand next to each other in no vocabulary token can never end up in one
token, so a cut between them is certain. A text is normalised and split into words as the tokenizer
says; every word is cut at all such places; each fragment is encoded by itself, once for each worker
and batch of texts at most, and the results are concatenated. Merges never cross a certain cut, so
the ids are those of the whole word. Only the last fragment of a word carries the end-of-word mark.

Words are looked up in a bounded table of encoded words first.

Defined results: a null text counts as empty; an empty text has no ids; special tokens written out in
a text are those tokens, as in the tokenizers library; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table, text_or_empty

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "word_bpe_49k.json"
#: Encoded words that a worker keeps in each of two generations, so memory doesn't grow with the corpus.
CACHE_WORDS = 250_000
#: What str.split takes for white space and the tokenizer doesn't.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: A text of other characters than these, once in lower case, is split by the tokenizer itself. In the
#: others each character has one lower case and none composes.
_UNKNOWN = re.compile(r"[^\t-\r !-~ß-öø-ÿ]")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_alphabet() -> dict[int, str]:
    """Byte -> character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Table:
    """A bounded dictionary in two generations: when the young one is full, it takes the place of the old one."""

    def __init__(self, limit: int, make):
        self.limit, self.make = limit, make
        self.young: dict = {}
        self.old: dict = {}

    def miss(self, key):
        found = self.young.get(key) or self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = found
        return found

    def of(self, keys: list) -> bytes:
        """The values of all keys, one after the other."""
        found = list(map(self.young.get, keys))
        if None in found:
            miss = self.miss
            found = [x if x is not None else miss(k) for x, k in zip(found, keys)]
        return b"".join(found)

    def __len__(self) -> int:
        return len(self.young) + len(self.old)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ForcedBoundaryEncoder:
    """``encode(text)`` -> ids; ``decode(ids)`` -> text. ``path``: a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.final = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        inner = {**spec, "model": {**spec["model"], "end_of_word_suffix": None}}
        self._inner_tokenizer = Tokenizer.from_str(json.dumps(inner))
        self.inner = self._inner_tokenizer.model
        suffix = spec["model"]["end_of_word_suffix"]
        self.vocab = spec["model"]["vocab"]
        pairs: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(suffix)
            pairs.update(body[i : i + 2] for i in range(len(body) - 1))
        self.pairs = pairs
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.alphabet = _byte_alphabet()
        self.words = Table(cache_words, self._word)
        self.pieces = Table(cache_words, self._piece)

    def cuts(self, word: str) -> list[str]:
        """``word`` (in the byte alphabet) split at every certain cut."""
        pairs, rest = self.pairs, word[1:]
        if pairs.issuperset(map(add, word, rest)):
            return [word]
        out, start = [], 0
        for i, pair in enumerate(map(add, word, rest), 1):
            if pair not in pairs:
                out.append(word[start:i])
                start = i
        return [*out, word[start:]]

    def _mapped(self, word: str) -> bytes:
        """The ids of one word in the byte alphabet: its fragments are encoded by themselves."""
        *inner, last = self.cuts(word)
        ids = [t.id for part in inner for t in self.inner.tokenize(part)]
        ids += [t.id for t in self.final.tokenize(last)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """The ids of one word of lower-case text, as little-endian unsigned 32-bit numbers."""
        return self._mapped(word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))

    def _piece(self, piece: str) -> bytes:
        """The ids of any text without white space, split into words by the tokenizer."""
        return b"".join([self._mapped(w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))])

    def encode_bytes(self, text: str) -> bytes:
        if "<|" in text and self._special.search(text):
            return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if x in self.special else self._plain(x) for x in self._special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        low = text.lower()
        if not _UNKNOWN.search(low) and len(low) == len(text):
            return self.words.of(_WORDS.findall(low))
        return self.pieces.of(text.split() if not _ODD_SPACE.search(text) else [x for x in _SPACE.split(text) if x])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False) without a decoder: the tokens joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


_made: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder for each worker and vocabulary."""
    if path not in _made:
        _made[path] = ForcedBoundaryEncoder(path)
    return _made[path]


def encoded(docs: DataFrame, columns: list[str], schema: str, digest, path: str | None = None, text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and what ``digest(encoder, [text])`` gives for them: a dict of Arrow-compatible columns in a batch."""
    name = os.path.basename(path) if path else VOCABULARY
    own = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(own or vocabulary_path(name))
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            yield from digest(e, batch, texts)

    source = docs.select(*columns, text_or_empty(text).alias("__text"))
    ship(docs.sparkSession)
    return source.mapInArrow(run, schema)


def _digest(e: ForcedBoundaryEncoder, batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    names, tokens = _numbers(len(e.tokens)), e.tokens
    n, ids_sha, text_sha = [], [], []
    for t in texts:
        ids = e.encode(t).tolist()
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
        text_sha.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


_decimal: list[str] = []


def _numbers(n: int) -> list[str]:
    if len(_decimal) < n:
        _decimal[:] = map(str, range(n))
    return _decimal


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for every row. No shuffle."""
    return encoded(docs, ["doc_id"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest, path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and the decoded text of every row."""

    def rows(e: ForcedBoundaryEncoder, batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        ids = [e.encode(t).astype(np.int32) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded(docs, ["doc_id"], "doc_id long, ids array<int>, decoded string", rows, path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": (op5, None)}
