"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by overlapping chunks that are stitched where their cuts
resynchronise (see pretokens); each pre-token is encoded by itself, and decoding concatenates the
raw bytes of the ids. The chunks of a text are cut in parallel: they are rows of their
own, dealt over the cluster, and only the cuts come back to the text's row. A text of one chunk is cut where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm.common import replace_columns
from gridfold.llm.pretokens import CHUNK, OVERLAP, compiled, cuts, load_ranks, pretokens, stitch

#: Texts of more code points have several chunks.
LONG_CHARS = CHUNK
#: Pre-tokens whose ids a Python worker remembers, and the longest that it remembers, in code points.
CACHED, CACHED_CHARS = 150_000, 64


class Encoder:
    """Encodes texts by the ranks of a file and the pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = compiled(pattern)
        self.known = _Known(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))

    def encode(self, text: str) -> np.ndarray:
        return self.join(pretokens(self.pattern, text))

    def join(self, lists) -> np.ndarray:
        """Ids of lists of pre-tokens, as int32."""
        get = self.known.__getitem__
        return np.frombuffer(b"".join(b"".join(map(get, pieces)) for pieces in lists), np.int32)


class _Known(dict):
    """Pre-token to its ids, as the bytes of int32."""

    def __init__(self, merges: tiktoken.Encoding):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        # A pre-token is by itself one match of the pattern, so the library merges it as a whole.
        ids = np.array(self.merges.encode_ordinary(piece), np.int32).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


#: Ids of one Arrow batch that goes back to Spark, and rows of one that is decoded.
BATCH_IDS, BATCH_ROWS = 1_000_000, 512


def _in_batches(batch: pa.RecordBatch, column: str, arrays: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """The batch without `column` and with lists of ids, cut where the ids get many."""
    rest = [c for c in batch.schema.names if c != column]
    start, held, size = 0, [], 0

    def out() -> pa.RecordBatch:
        part = batch.slice(start, len(held))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), _lists(held)], names=[*rest, name])

    for ids in arrays:
        held.append(ids)
        size += len(ids)
        if size >= BATCH_IDS:
            yield out()
            start, held, size = start + len(held), [], 0
    if held or not batch.num_rows:
        yield out()


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", long_chars: int = LONG_CHARS) -> DataFrame:
    """`df` with `ids_col`, the ids (array of int) of each whole text in place of `text_col`.

    Special tokens aren't used: their strings are ordinary text. A null text counts as empty, and an
    empty text has an empty array. Repeated rows and rows with null in other columns are encoded
    as any other. An input column named `ids_col` is replaced; other columns pass through.
    """
    if ids_col.lower() == text_col.lower():
        raise ValueError("ids_col must differ from text_col")
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in (ids_col.lower(), text_col.lower())), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_gf_text"))
    fields = [f for f in df.schema.fields if f.name != "_gf_text"]
    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_gf_text"))
            yield from _in_batches(batch, "_gf_text", (own.encode(x.as_py()) for x in texts), ids_col)

    is_long = F.char_length("_gf_text") > long_chars
    short = df.filter(~is_long).mapInArrow(run, schema)
    return short.unionByName(_encode_long(df.filter(is_long), path, pattern, ids_col, schema))


def _encode_long(df: DataFrame, path: str, pattern: str, ids_col: str, schema: T.StructType) -> DataFrame:
    """Three steps over the chunks of long texts: cut each chunk, stitch a text's cuts, encode the pieces."""
    # The row's key is its content, so that it is the same when a lost task runs again; repeated rows count once and return as often.
    rest = [f.name for f in schema.fields if f.name != ids_col]
    keyed = df.withColumn("_gf_key", F.sha2(F.col("_gf_text"), 256))
    texts = keyed.groupBy("_gf_key").agg(F.first("_gf_text").alias("text"))
    n, step = F.char_length("text"), CHUNK - OVERLAP
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - CHUNK) / step).cast("int")))
    chunks = texts.select("_gf_key", F.explode(F.transform(starts, lambda k: F.struct((k * step).alias("start"), F.substring(F.col("text"), k * step + 1, F.lit(CHUNK)).alias("part"), (k * step + CHUNK >= n).alias("final")))).alias("c"))
    chunks = chunks.select("_gf_key", "c.*").repartition(F.col("_gf_key"), F.col("start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(pattern)
        for batch in batches:
            rows = batch.to_pylist()
            found = [np.array(cuts(own, r["part"], 0, len(r["part"]), r["final"]), np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(found)], names=["_gf_key", "start", "cuts"])

    found = chunks.mapInArrow(cut, "_gf_key string, start int, cuts array<int>")
    whole = texts.join(found.groupBy("_gf_key").agg(F.sort_array(F.collect_list(F.struct("start", "cuts"))).alias("chunks")), "_gf_key")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                text, at = row["text"], stitch([[c["start"] + x for x in c["cuts"]] for c in row["chunks"]])
                lists = pretokens(own.pattern, text) if at is None else ([text[a:b] for a, b in zip(at[k : k + 65536], at[k + 1 : k + 65537], strict=False)] for k in range(0, len(at) - 1, 65536))
                yield pa.RecordBatch.from_arrays([pa.array([row["_gf_key"]]), _lists([own.join(lists)])], names=["_gf_key", ids_col])

    ids = whole.mapInArrow(join, T.StructType([T.StructField("_gf_key", T.StringType()), T.StructField(ids_col, T.ArrayType(T.IntegerType(), True))]))
    return keyed.drop("_gf_text").join(ids, "_gf_key").select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{ids_col}`"))


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`df` with `bytes_col` (binary), the concatenated bytes of the ids; null ids give null.

    An id that the vocabulary lacks, or a null one, raises. An input column named `bytes_col` is replaced.
    """
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != bytes_col.lower()))
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = token_bytes(path).__getitem__
        for whole in batches:
            for start in range(0, max(1, whole.num_rows), BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                lists = batch.column(batch.schema.get_field_index(ids_col))
                raw = pa.array([None if not v.is_valid else b"".join(map(get, v.values.to_numpy(zero_copy_only=False).tolist())) for v in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")


def with_digests(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the bytes."""
    made = replace_columns(
        df,
        {
            "n_tokens": F.size(ids_col).cast("long"),
            "ids_sha256": F.sha2(ids_text(F.col(ids_col)), 256),
            "decoded_sha256": F.sha2(F.col(bytes_col), 256),
        },
    )
    return made.drop(ids_col, bytes_col)
