"""Alignment of two tokenizers' tokens by elementary intervals, and corpus-wide counts of the aligned ids.

A is a byte-level BPE file of the library `tokenizers`, B a piece model of `sentencepiece` that puts a
space in front; both encode space + text. The union of both end arrays cuts the bytes into elementary
intervals, each of which has one owner in A and one in B: one overlap. Ends that both share close a group.

A text is cut where a space follows anything but white space. No pre-token of A and no piece of B goes over
such a cut (B's vocabulary is looked through for that when it is loaded), so that a chunk's
tokens and intervals don't depend on its neighbours; each worker keeps those that it has met, in arrays.

Texts are encoded once; each one's links are kept as packed distinct pairs with how often they are linked. Counts of pairs are made over the whole corpus. The most frequent pairs, at most BROADCAST_PAIRS of
them, go to all workers; the others, none of which is in many documents, are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint, keyed, replace_columns
from gridfold.llm.token_counts import BYTE_LEVEL_PATTERN, byte_letters

#: A space, what white space follows, and on to the next space that follows anything but white space.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: Chunks and characters of chunks that a worker keeps (some 300 bytes a chunk).
CACHED, CACHED_CHARS = 300_000, 8_000_000
#: Characters of texts that are encoded together; a longer text is one by itself.
TOGETHER = 2_000_000
#: Pairs that a worker counts before it hands counts on (16 bytes each, and as much again to sort them).
WINDOW = 2_000_000
#: Pairs with their counts that are broadcast (16 bytes each).
BROADCAST_PAIRS = 1 << 20
#: A pair is one long: A's id times this, plus B's.
SHIFT = 32


class Tokens:
    """Both tokenizers, and the bytes that each of their ids stands for.

    A's file is run by tiktoken, on the file's own vocabulary: its merges have to be in the order of their results' ids, after the single
    bytes, so that the least id is the first merge.
    """

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, letters = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
        vocabulary = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if not plain or {vocabulary.get(c) for c in letters} != set(range(256)) or any(vocabulary.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)):
            raise ValueError(f"not a byte-level BPE file with its merges in order: {path_a}")
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(merges)}
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_length = np.zeros(256 + len(merges), np.int64)
        self.a_length[list(ranks.values())] = list(map(len, ranks))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or self.b.normalize(" a  b ") != "▁▁a▁▁b▁":
            raise ValueError(f"a piece holds a space after another letter, or spaces are changed: {path_b}")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids in A and B of chunks that begin with a space."""
        return list(map(self.a.encode_ordinary, chunks)), self.b.encode([c[1:] for c in chunks], num_threads=1)


def intervals(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval the place of its owner in A and in B, and whether it ends a group. Both sum to one length."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


class Aligned:
    """Chunks one after the other: A's and B's tokens, groups and links of each, all links in order, and groups as text.

    `right` is false where B's bytes aren't the chunk's; such a chunk has no tokens here. A's bytes are always the chunk's, since A has all single bytes.
    """

    def __init__(self, tokens: Tokens, chunks: list[str]):
        all_a, all_b = tokens.encode(chunks)
        of_b = tokens.b_bytes.__getitem__
        self.right = np.array([b"".join(map(of_b, b)) == c.encode() for c, b in zip(chunks, all_b, strict=True)], bool)
        if not self.right.all():
            all_a, all_b = ([x if r else [] for x, r in zip(ids, self.right.tolist(), strict=True)] for ids in (all_a, all_b))
        self.n_a, self.n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (all_a, all_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((all_a, self.n_a), (all_b, self.n_b)))
        # All chunks' bytes are one line, on which each chunk ends a group; so they are cut at once.
        at_a, at_b, closes = intervals(tokens.a_length[a], tokens.b_length[b])
        self.links = (a[at_a] << SHIFT) | b[at_b]
        close = np.flatnonzero(closes)
        a_to = at_a[close] + 1
        last = np.searchsorted(a_to, np.cumsum(self.n_a))  # the group that ends a chunk, or the one that ended the chunk before it
        groups_to = np.where(np.cumsum(self.n_a) > 0, last + 1, 0)
        links_to = np.concatenate([[0], close + 1])[groups_to]
        self.n_groups, self.n_links = np.diff(groups_to, prepend=0), np.diff(links_to, prepend=0)
        self.texts = self._texts(a, b, a_to, at_b[close] + 1, groups_to)

    @staticmethod
    def _texts(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, groups_to: np.ndarray) -> list[str]:
        """A group's tokens are those between the ends of the group before it and its own."""
        ids_a, ids_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        run = lambda ids, i, j: ids[i] if j == i + 1 else ",".join(ids[i:j])
        ends_a, ends_b = a_to.tolist(), b_to.tolist()
        groups = [f"{run(ids_a, i, j)}|{run(ids_b, k, m)}" for i, j, k, m in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)]
        ends = groups_to.tolist()
        return [";".join(groups[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def chunks_of(text: str) -> list[str]:
    """Space + text in chunks. One space at the end stays with the chunk before it, since B would take it as the one that it adds itself."""
    found = CHUNK.findall(" " + text)
    if len(found) > 1 and found[-1] == " ":
        found[-2:] = [found[-2] + " "]
    return found


class _Column:
    """An array that grows."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + 2 * len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def of(self) -> np.ndarray:
        return self.data[: self.n]


def _gathered(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ..., n of each, one after the other."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that end before `ends`."""
    upto = np.concatenate([[0], np.cumsum(values)])[ends]
    return np.diff(upto, prepend=0)


class Aligner:
    """Chunks that a worker has met, with their alignment in arrays."""

    def __init__(self, tokens: Tokens, most: int, most_chars: int):
        self.tokens, self.most, self.most_chars = tokens, most, most_chars
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.numbers = {k: _Column(np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "start")}
        self.right, self.links = _Column(np.bool_), _Column(np.int64)

    def _add(self, chunks: list[str]) -> None:
        made = Aligned(self.tokens, chunks)
        self.numbers["start"].extend(self.links.n + np.cumsum(made.n_links) - made.n_links)
        for k in ("n_a", "n_b", "n_groups", "n_links"):
            self.numbers[k].extend(getattr(made, k))
        self.right.extend(made.right)
        self.links.extend(made.links)
        self.texts += made.texts
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' places for all texts, one after the other, and where each text's end; none for a text without tokens."""
        if len(self.index) > self.most or self.chars > self.most_chars:
            self.forget()
        cut = [chunks_of(t) if t else [] for t in texts]
        if new := [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self.index]:
            self._add(new)
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        wrong = ~self.right.of()[at]
        if wrong.any():
            text = np.repeat(np.arange(len(cut)), n)
            without = np.unique(text[wrong])
            at, n = at[~np.isin(text, without)], np.where(np.isin(np.arange(len(cut)), without), 0, n)
        return at, np.cumsum(n)

    def of(self, name: str, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _sums(self.numbers[name].of()[at], ends)

    def links_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the links of chunks, and how many each has."""
        n = self.numbers["n_links"].of()[at]
        return _gathered(self.numbers["start"].of()[at], n), n

    def texts_of(self, at: np.ndarray, ends: np.ndarray) -> list[str]:
        own, to = list(map(self.texts.__getitem__, at.tolist())), ends.tolist()
        return [";".join(own[i:j]) for i, j in zip([0, *to], to, strict=False)]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str, most: int, most_chars: int) -> Aligner:
    """One for each Python worker and pair of files."""
    return Aligner(Tokens(path_a, path_b), most, most_chars)


def _runs(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with their texts (column 1), about `together` characters at once."""
    for batch in batches:
        texts = [x.as_py() or "" for x in batch.column(1)]
        start, held = 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= together or k == len(texts) - 1:
                yield batch.slice(start, k + 1 - start), texts[start : k + 1]
                start, held = k + 1, 0


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """`df` with n_a, n_b, n_groups (long), groups (`a1,a2|b1;a3|b2,b3`) and links (the pairs in order, A's id << 32 | B's).

    A text that is null or empty, or whose joined bytes in A or B aren't those of space + text, has no tokens: zeros, '' and no links.
    Rows are independent of each other; input columns with those names give way, others pass through.
    """
    made = ("n_a", "n_b", "n_groups", "groups", "links")
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in made))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"), F.col(f"`{text_col}`").alias("text"))
    schema = f"own {rows.schema['own'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups string, links array<long>"
    limits, together = (CACHED, CACHED_CHARS), TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b, *limits)
        for batch, texts in _runs(batches, together):
            at, ends = own(texts)
            places, n = own.links_of(at)
            links = _lists(np.concatenate([[0], np.cumsum(n)])[ends], pa.array(own.links.of()[places]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(own.of(k, at, ends)) for k in made[:3]), pa.array(own.texts_of(at, ends), pa.string()), links], names=["own", *made])

    return rows.mapInArrow(run, schema).select("own.*", *made)


def group_products(groups: DataFrame) -> DataFrame:
    """Each (A's id, B's id) of a row's groups: the columns of `groups` (with groups, as of `align`), then group (from 0), a_id and b_id."""
    split = replace_columns(groups, {"_gf_groups": F.filter(F.split("groups", ";"), lambda g: g != "")})
    split = split.select("*", F.posexplode("_gf_groups").alias("group", "_gf_group")).drop("_gf_groups")
    for k, name in enumerate(("a_id", "b_id")):
        split = split.withColumn(name, F.explode(F.split(F.split("_gf_group", r"\|")[k], ",").cast("array<int>")))
    return split.drop("_gf_group")


def _packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """A text's distinct sorted pairs with their numbers, in some 4 bytes each."""
    a, b = (pairs >> SHIFT).astype(np.uint32), pairs.astype(np.uint32)
    return zstandard.compress(np.concatenate([np.diff(a, prepend=np.uint32(0)), b, n.astype(np.uint32)]).tobytes(), 1)


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and numbers of many texts, one after the other, and how many pairs each has."""
    texts = [np.frombuffer(zstandard.decompress(x.as_py()), np.uint32).reshape(3, -1) for x in packed]
    if not texts:
        return (np.empty(0, np.int64),) * 3
    pairs = [(np.cumsum(a, dtype=np.int64) << SHIFT) | b for a, b, _ in texts]
    return np.concatenate(pairs), np.concatenate([n for *_, n in texts]).astype(np.int64), np.array(list(map(len, pairs)), np.int64)


def _held(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each (key, text, doc) the alignment's counts, its groups' hash, and its links, packed."""
    names = ("n_a", "n_b", "n_groups", "n_links")
    limits, together = (CACHED, CACHED_CHARS), TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b, *limits)
        for batch, texts in _runs(batches, together):
            at, ends = own(texts)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in own.texts_of(at, ends)]
            places, n = own.links_of(at)
            found, code = np.unique(own.links.of()[places], return_inverse=True)
            text = np.repeat(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), n)
            held, times = np.unique(text * max(len(found), 1) + code, return_counts=True)
            text, pairs = held // max(len(found), 1), found[held % max(len(found), 1)] if len(found) else held
            cuts = np.searchsorted(text, np.arange(len(ends) + 1)).tolist()
            links = [_packed(pairs[i:j], times[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(own.of(k, at, ends)) for k in names), pa.array(digests, pa.string()), pa.array(links, pa.binary())], names=["key", "doc", *names, "groups_sha256", "links"])

    doc = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"key long, doc {doc}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _pair_counts(held: DataFrame) -> DataFrame:
    """(pair, docs): how many texts hold each linked pair of ids. Workers count windows of pairs before these are shuffled."""
    window = WINDOW

    def counted(pairs: list[np.ndarray]) -> pa.RecordBatch:
        found, docs = np.unique(np.concatenate(pairs or [np.empty(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(docs.astype(np.int64))], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                pairs.append(_unpacked(batch.column(0).slice(start, 500))[0])
                size += len(pairs[-1])
                if size >= window:
                    yield counted(pairs)
                    pairs, size = [], 0
        yield counted(pairs)

    return held.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("docs"))


def _rated(held: DataFrame, frequent: tuple) -> DataFrame:
    """`held` with the numbers of its links that are best by the frequent pairs, the sum of their counts, and the other pairs with how often each is linked."""
    shared = held.sparkSession.sparkContext.broadcast(frequent)  # at most BROADCAST_PAIRS of 16 bytes, and 8 for each of A's ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = (np.frombuffer(x, np.int64) for x in shared.value)
        for batch in batches:
            pairs, n, sizes = _unpacked(batch.column(1))
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
            same = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            count = np.where(same, docs[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
            ends = np.cumsum(sizes)
            is_best = same & (count == best[pairs >> SHIFT])
            rest = pa.StructArray.from_arrays([pa.array(pairs[~same]), pa.array(n[~same])], names=["pair", "n"])
            rest = _lists(np.concatenate([[0], np.cumsum(~same)])[ends], rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sums(n * is_best, ends)), pa.array(_sums(n * count, ends)), rest], names=["own", "best", "total", "rest"])

    own = F.struct(*(c for c in held.columns if c != "links")).alias("own")
    rows = held.select(own, "links")
    return rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, best long, total long, rest array<struct<pair:long,n:long>>").select("own.*", "best", "total", "rest")


def score(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of `df`.

    A pair's count is the number of rows that hold it linked, each row being a document of its own, also under a repeated or null id.
    n_best counts the links whose pair has the highest count of its A id, ties included; count_sum adds the counts of all links. Rows without tokens (see `align`) have zeros and ''. Columns other
    than the two aren't read. An empty table gives no rows.
    """
    own = keyed(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", "key")
    held = checkpoint(_held(own.select("key", "text", F.col("id").alias("doc")), path_a, path_b))
    counts = checkpoint(_pair_counts(held))
    a_id = F.shiftright("pair", SHIFT)
    best = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("best"))  # no more rows than A has ids
    most = counts.orderBy(F.desc("docs"), "pair").limit(BROADCAST_PAIRS)
    bests, known = best.toArrow(), most.toArrow().sort_by("pair")
    by_id = np.zeros(int(np.max(bests["a_id"].to_numpy(), initial=-1)) + 1, np.int64)
    by_id[bests["a_id"].to_numpy()] = bests["best"].to_numpy()
    arrays = tuple(x.tobytes() for x in (known["pair"].to_numpy(), known["docs"].to_numpy(), by_id))
    found = checkpoint(_rated(held, arrays))
    links = found.select("key", F.explode("rest").alias("link")).select("key", "link.pair", "link.n")
    rated = links.join(counts, "pair").withColumn("a_id", a_id).join(F.broadcast(best), "a_id")
    rest = rated.groupBy("key").agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(0)).alias("rest_best"), F.sum(F.col("n") * F.col("docs")).alias("rest_total"))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return found.join(rest, "key", "left").select("doc", "n_a", "n_b", "n_groups", "n_links", more("best", "rest_best").alias("n_best"), more("total", "rest_total").alias("count_sum"), "groups_sha256")
