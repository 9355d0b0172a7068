"""Token counts of texts under a byte-level BPE vocabulary in a tokenizers JSON file.

Which vocabulary strings encode alone as one token is proved once for a file, by running the merges
on each of them. A pre-token in that proved set counts 1 without merging; only the rest is merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gridfold.llm.pretokens import compiled, merge, pretokens

#: The pattern that byte-level pre-tokenizers of this file format use.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED, CACHED_CHARS = 500_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary: pairs with their ranks, proved whole tokens, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        letters = byte_letters()
        raw = lambda token: bytes(map(letters.__getitem__, token))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.pairs = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        specials = [t["content"] for t in spec.get("added_tokens", []) if not (t.get("lstrip") or t.get("rstrip") or t.get("single_word"))]
        if len(specials) != len(spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word ends aren't supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.specials = specials
        self.letters = {b: c for c, b in letters.items()}
        self.merges = Tokenizer.from_file(path).model.tokenize
        self.whole = {token for t in model["vocab"] if t not in specials and len(merge(self.rank, token := raw(t))) == 1}

    def rank(self, a: bytes, b: bytes) -> int | None:
        return self.pairs.get((a, b))


class _Counts(dict):
    """Pre-token to its number of tokens; proved whole tokens are there from the start."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        super().__init__(self.proved())

    def proved(self) -> Iterator[tuple[str, int]]:
        for token in self.vocabulary.whole:
            try:
                yield token.decode("utf-8"), 1
            except UnicodeDecodeError:
                continue  # part of a code point: no pre-token of a text

    def __missing__(self, piece: str) -> int:
        n = len(self.vocabulary.merges(piece.encode("latin-1" if piece.isascii() else "utf-8").decode("latin-1").translate(self.vocabulary.letters)))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED + len(self.vocabulary.whole):
                self.clear()
                self.update(self.proved())
            self[piece] = n
        return n


class Counter:
    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special, self.counts = vocabulary.special, _Counts(vocabulary)
        self.specials = vocabulary.specials

    def count(self, text: str) -> int:
        pattern, get = compiled(BYTE_LEVEL_PATTERN), self.counts.__getitem__
        parts, special = [text], 0
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            special = len(parts) - 1
        return special + sum(sum(map(get, pieces)) for part in parts if part for pieces in pretokens(pattern, part))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each Python worker and file."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """`df` with n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit) of each whole text.

    No begin, end or added special tokens; the strings of special tokens inside a text count as that
    token. A null or empty text has 0 of both. Input columns with those names are replaced; other
    columns, `text_col` included, pass through; rows are independent of each other.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in made))
    schema = T.StructType([*df.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            n_bytes, n_tokens = [], []
            for x in texts:
                text = x.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(own.count(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*batch.schema.names, "n_bytes", "n_tokens"])

    return df.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
