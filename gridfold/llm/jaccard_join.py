"""N-gram Jaccard join of documents, size-aware: subsets for small sets, inverted lists for large ones.

Two sets of Jaccard similarity t or more share at least ceil(t * n) elements of each, n being its
size. So under one order of all elements they share k of the first n - ceil(t * n) + k of each.

- Light sets (at most `boundary` elements) enumerate the subsets of SUBSET elements of that prefix
  with k = SUBSET; two light sets that link share such a subset as a key.
- Heavy sets post the single elements of the prefix with k = 1 to inverted lists, and scan those. Light sets
  that are large enough to link with a heavy one post their elements as well.

The boundary is where the measured cost of enumerating gets higher than that of scanning. Elements
that many sets hold come last in the order, the most frequent of them at the very end, so that a passage that many
documents share makes no long lists. Equal sets are one class from the start. Then, so that a group of near
copies doesn't make all its pairs:

1. Each list compares its members with its first; links are verified exactly, and connected components
   are formed.
2. Lists whose members are all in one component are done. In the others, the lists that two components share are
   counted: with the count the overlap of any two of their documents has a bound. Between the components
   that the bound lets through, all pairs are compared exactly. All lists that two documents of different
   components share are among these, so that no link between components is lost.

What isn't compared would only join documents that are in one component already.

Pairs are dealt over boxes by their second document, which is the first of a list; one with very many partners has several
boxes. A set is sent once to each box that has a pair of it, so its copies don't grow with the number of boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint, free_shuffles, ids_are_keys, keyed, numbered
from gridfold.llm.components import components
from gridfold.llm.shingles import set_key, shingle_set

#: Longs of a set's parities (512 bits): two sets differ in as many elements at least as their parities differ in bits.
PARITIES = 8
#: Elements in a subset that light sets enumerate.
SUBSET = 2
#: The boundary is sought up to this size; beyond, subsets outnumber elements far too much.
MOST_LIGHT = 128
#: Different sets from which an element counts as common, and bound on the elements that are put last.
#: Both only order the elements: whatever comes last, no link is lost.
COMMON, MOST_COMMON = 8, 1 << 20
#: Elements are counted by their upper 48 bits.
DROPPED = np.uint64(16)
#: Hashes that are counted together by a Python worker (32 MB), and those of a range that one task adds up.
WINDOW, RANGE = 4_000_000, 1 << 21
#: Elements of the sets in one box of pairs to verify (2 MB). A document whose partners have more gets several boxes.
BOX = 1 << 18
#: Up to so many ids are broadcast (16 bytes each); with more the plan does without.
BROADCAST_IDS = 500_000
#: Bits of the map that tells which documents are certainly not needed; 8 MB at any size of the corpus.
MAP_BITS = 1 << 26


_ODD = [f"odd{k}" for k in range(PARITIES)]


def least_common(n: int | np.ndarray, percent: int):
    """Elements that a set of n shares at least with one that it links with."""
    return -(-percent * n // 100)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class _Window:
    """The distinct sets of a window by size, with what their postings would meet in it."""

    def __init__(self):
        self.sets: dict[tuple[int, int], np.ndarray] = {}
        self.held = 0

    def add(self, key: tuple[int, int], hashes: np.ndarray) -> bool:
        if key not in self.sets:
            self.sets[key] = hashes
            self.held += len(hashes)
        return self.held >= WINDOW

    def drain(self, percent: int) -> dict[int, list[int]]:
        """By size of the light sets: sets, and what their postings meet."""
        sizes: dict[int, list[int]] = {}
        if not self.sets:
            return sizes
        elements, counts = np.unique(np.concatenate(list(self.sets.values())), return_counts=True)
        for h in self.sets.values():
            if 2 <= (n := len(h)) <= MOST_LIGHT:
                prefix = h[: n - least_common(n, percent) + 1]
                one = sizes.setdefault(n, [0, 0])
                one[0] += 1
                one[1] += int(np.minimum(counts[np.searchsorted(elements, prefix)] - 1, COMMON).sum())
        self.sets, self.held = {}, 0
        return sizes


def parities(hashes: np.ndarray) -> bytes:
    """Whether the number of elements is odd, for each of the values of their upper bits."""
    return np.packbits(np.bincount(hashes >> np.uint64(55), minlength=64 * PARITIES) & 1).tobytes()


def _sketched(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of two kinds: 0 (doc, n, key, parities), 2 (size, sets, postings met)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = _Window()

        def rows(kind: int, *columns, odd: np.ndarray | None = None) -> pa.RecordBatch:
            columns = [np.asarray(c, np.int64) for c in columns]
            columns += [np.zeros(len(columns[0]), np.int64)] * (4 - len(columns))
            odd = np.zeros((len(columns[0]), PARITIES), np.int64) if odd is None else odd
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(PARITIES))], names=["kind", "a", "b", "c", "d", *_ODD])

        def drained() -> Iterator[pa.RecordBatch]:
            sizes = window.drain(percent)
            yield rows(2, list(sizes), [s[0] for s in sizes.values()], [s[1] for s in sizes.values()])

        for batch in batches:
            ids, ns, first, second, odd = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_set(text.as_py(), width)
                key = set_key(hashes)
                odd.append(parities(hashes))
                ids.append(doc)
                ns.append(len(hashes))
                first.append(key[0])
                second.append(key[1])
                if len(hashes) > 1 and window.add(key, hashes):
                    yield from drained()
            yield rows(0, ids, ns, first, second, odd=np.frombuffer(b"".join(odd), np.int64).reshape(-1, PARITIES))
        yield from drained()

    return docs.mapInArrow(run, "kind int, a long, b long, c long, d long, " + ", ".join(f"{c} long" for c in _ODD))


def _boundary(sketch: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, by counts of the sets at each size.

    A key costs 1 to post, and a met posting 1 to compare. The sum over sizes up to the boundary of
    the first, and over those above of the second, is least.
    """
    sizes = {r[0]: (r[1], r[2]) for r in sketch.filter("kind = 2").groupBy("a").agg(F.sum("b"), F.sum("c")).collect()}  # at most MOST_LIGHT rows
    best, at, gain = 0, 0, 0
    for n in sorted(sizes):
        sets, met = sizes[n]
        p = n - least_common(n, percent)
        gain += sets * (p + 1) + met - sets * (p + SUBSET) * (p + SUBSET - 1) // 2
        if gain > best:
            best, at = gain, n
    return at


def _deltas(values: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(values, prepend=np.uint64(0)).tobytes(), 1)


def _common(docs: DataFrame, width: int) -> DataFrame:
    """(element, n): the upper bits of the elements that COMMON documents or more hold, and how many hold them.

    Each worker counts windows of sets, and sends their sorted elements in a row for each range of hashes; a range's elements are added up in one task.
    """
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-octets // (6 * RANGE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            elements, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            places = np.searchsorted(((elements >> DROPPED) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            own = np.flatnonzero(places[1:] > places[:-1])
            packed = [[_deltas(elements[places[p] : places[p + 1]]) for p in own], [zstandard.compress(n[places[p] : places[p + 1]].astype(np.uint32).tobytes(), 1) for p in own]]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "elements", "n"])

        for batch in batches:
            for text in batch.column(0):
                # Different elements with the same upper bits count once.
                held.append(np.unique(shingle_set(text.as_py(), width) >> DROPPED))
                size += len(held[-1])
                if size >= WINDOW:
                    yield counted()
                    held.clear()
                    size = 0
        yield counted()

    def added(table: pa.Table) -> pa.Table:
        elements = [np.cumsum(np.frombuffer(zstandard.decompress(x.as_py()), np.uint64), dtype=np.uint64) for x in table["elements"]]
        found, at = np.unique(np.concatenate(elements), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, at, np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.uint32) for x in table["n"]]))
        return pa.table({"element": found[n >= COMMON].astype(np.int64), "n": n[n >= COMMON]})

    rows = docs.select("text").mapInArrow(run, "part int, elements binary, n binary")
    return rows.groupBy("part").applyInArrow(added, "element long, n long")


class Order:
    """The upper bits of the common elements in order, with the place of each in the order of frequency."""

    def __init__(self, elements: np.ndarray, counts: np.ndarray):
        by_hash = np.argsort(elements)
        self.elements = elements[by_hash]
        place = np.empty(len(elements), np.int32)
        place[np.lexsort((self.elements, counts[by_hash]))] = np.arange(len(elements), dtype=np.int32)
        self.place = place

    def prefix(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The first elements of a set: common ones last, from rare to frequent; the others by hash."""
        if len(self.elements):
            upper = hashes >> DROPPED
            at = np.minimum(np.searchsorted(self.elements, upper), len(self.elements) - 1)
            last = self.elements[at] == upper
            if last.any():
                rare, often = hashes[~last], hashes[last]
                return np.concatenate([rare, often[np.argsort(self.place[at[last]], kind="stable")]])[:length]
        return hashes[:length]


def keys_of(hashes: np.ndarray, order: Order, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each its set's size, the position of its last element, and flags, packed as by `packed`.

    A light set's subsets come first. Its single elements follow if a heavy set can link with it.
    """
    n = len(hashes)
    least = least_common(n, percent)
    single = order.prefix(hashes, n - least + 1)
    if n > boundary:
        return single, packed(n, np.arange(len(single)), False, True)
    prefix = order.prefix(hashes, n - least + SUBSET)
    i, j = np.triu_indices(len(prefix), 1)
    pairs = (prefix[i] ^ (prefix[i] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + prefix[j]
    pairs, at = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), packed(n, j - 1, True, False)
    if 100 * n >= percent * (boundary + 1):
        return np.concatenate([pairs, single]), np.concatenate([at, packed(n, np.arange(len(single)), True, True)])
    return pairs, at


def packed(n: int, pos: np.ndarray, light: bool, single: bool) -> np.ndarray:
    """Size, position and flags in one long."""
    return (np.int64(n) << 32) | (pos.astype(np.int64) << 2) | (int(light) << 1) | int(single)


def _size(at: str) -> Column:
    return F.shiftright(at, 32)


def _position(at: str) -> Column:
    return F.shiftright(F.col(at).bitwiseAND(F.lit(0xFFFFFFFF)), 2)


def _light(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(2)) != 0


def _meet(a: str, b: str, percent: int) -> Column:
    """Whether two members of a list can link by their sizes. Two light sets meet by their subsets, any others by single elements."""
    n, m = _size(a), _size(b)
    single = F.col(a).bitwiseAND(F.col(b)).bitwiseAND(F.lit(1)) != 0
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (single != (_light(a) & _light(b)))


def _need(n: Column, m: Column, percent: int) -> Column:
    """Elements that two sets that link share at least."""
    return F.ceil((n + m) * percent / (100 + percent))


def _near(a: str, b: str, percent: int) -> Column:
    """_meet, and what is left of the shorter rest suffices if the key is the first that they share."""
    n, m = _size(a), _size(b)
    rest = F.least(n - _position(a), m - _position(b)) + F.when(_light(a) & _light(b), SUBSET - 1).otherwise(0)
    return _meet(a, b, percent) & (rest >= _need(n, m, percent))


def _postings(docs: DataFrame, order: Order, boundary: int, width: int, percent: int) -> DataFrame:
    """(key, doc, at) of the sets of two elements or more; smaller ones link with equal sets alone.

    A window's copies of a set are posted once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((order.elements.tobytes(), order.place.tobytes()))  # at most MOST_COMMON of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Order(np.empty(0, np.uint64), np.empty(0, np.int64))
        own.elements, own.place = (np.frombuffer(raw, t) for raw, t in zip(shared.value, (np.uint64, np.int32), strict=True))
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.empty(0, np.int64)] * 3
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["key", "doc", "at"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_set(text.as_py(), width)
                if len(hashes) <= 1:
                    continue
                key = set_key(hashes)
                if key in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                keys, at = keys_of(hashes, own, boundary, percent)
                held.append((_signed(keys), np.full(len(keys), doc), at))
                size += len(keys)
                if size >= 200_000:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "key long, doc long, at long")


def _listed(posted: DataFrame) -> DataFrame:
    """(key, doc, at, hub, hub_at) of the members that have company in their list, beside the list's first member.

    One shuffle by key, and a sorted stream of each list.
    """
    by_key = Window.partitionBy("key").orderBy("doc")
    beside = {"_before": F.lag("doc").over(by_key), "_next": F.lead("doc").over(by_key), "hub": F.first("doc").over(by_key), "hub_at": F.first("at").over(by_key)}
    held = posted.withColumns(beside).filter("_before is not null or _next is not null")
    return held.select("key", "doc", "at", "hub", "hub_at")


def _possible(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """`docs` without most of those that `needed` lacks, by a map of MAP_BITS bits of hashed ids, so that their texts aren't shuffled."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    words = needed.select(F.shiftright(bit("doc"), 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {MAP_BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MAP_BITS / 64 rows, 16 MB
    bits = np.zeros(MAP_BITS >> 6, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            at = batch.column(2).to_numpy()
            set_ = (own[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(set_ == 1)).select(["doc", "text"])

    return docs.select("doc", "text", bit("doc").alias("bit")).mapInArrow(run, "doc long, text string")


def _shipped(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(box, doc, hashes): the set of each needed document (doc, boxes), hashes as bytes, once for each of its boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = batch.column(2).to_pylist()
            at = np.repeat(np.arange(len(boxes)), [len(x) for x in boxes])
            sets = pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x for own in boxes for x in own], pa.int64()), batch.column(0).take(pa.array(at)), sets.take(pa.array(at))], names=["box", "doc", "hashes"])

    few = (needed.agg(F.sum(1 + F.size("boxes"))).first()[0] or 0) <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(needed), "doc") if few else _possible(docs, needed).join(needed, "doc")
    return chosen.select("doc", "text", "boxes").mapInArrow(run, "box long, doc long, hashes binary")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b, n, m), of sets of n and m elements, whose sets link."""
    load = pairs.agg(F.sum("n")).first()[0] or 0
    boxes = max(1, -(-load // BOX))
    heavy = checkpoint(pairs.groupBy("b").agg(F.sum("n").alias("load")).filter(F.col("load") > BOX).select("b", F.ceil(F.col("load") / BOX).alias("parts")))
    few = heavy.count() <= BROADCAST_IDS
    split = pairs.join(F.broadcast(heavy) if few else heavy, "b", "left")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))
    dealt = split.select("a", "b", F.pmod(F.xxhash64("b", part), F.lit(boxes)).alias("box"))
    ends = F.explode(F.array("a", "b")).alias("doc")
    needed = checkpoint(dealt.select("box", ends).groupBy("doc").agg(F.collect_set("box").alias("boxes")))
    shipped = _shipped(docs, needed, width)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(left["doc"].to_pylist(), (np.frombuffer(x.as_py(), np.uint64) for x in left["hashes"]), strict=True))
        a, b = right["a"].to_pylist(), right["b"].to_pylist()
        keep = []
        for x, y in zip(a, b, strict=True):
            s, t = (held[x], held[y]) if len(held[x]) <= len(held[y]) else (held[y], held[x])
            at = np.searchsorted(t, s)
            shared = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
        return right.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return shipped.groupBy("box").cogroup(dealt.groupBy("box")).applyInArrow(run, "a long, b long")


def _shared_lists(rest: DataFrame, percent: int) -> DataFrame:
    """(key, r, s) of two components in one list (key, doc, at, root) whose documents could link, the one with fewer members there first.

    Of the elements up to where the prefix of one of them ends, two sets share at most as many as they share keys, and
    after it at most the rest of that set. What is needed beyond the rest is least at a corner of the two ranges of sizes.
    Components with light sets, whose keys aren't elements, are all let through. Of two that have one document each in a list, the
    documents' parities tell how many elements they differ in at least; that list is left out if they can't link. Of their lists those are given where
    what is left after the key suffices for some two of their documents, as at the first key that two sets share.
    """
    size = _size("at")
    own = rest.groupBy("key", "root").agg(F.min(size).alias("low"), F.max(size).alias("high"), F.bool_or(_light("at")).alias("light"), F.count("*").alias("held"), F.max(size - _position("at")).alias("room"), *(F.max(c).alias(c) for c in _ODD))
    x, y = (own.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("root", "low", "high", "light", "held", "room", *_ODD))) for side in "xy")
    comparable = (100 * F.col("x_high") >= percent * F.col("y_low")) & (100 * F.col("y_high") >= percent * F.col("x_low"))
    differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _ODD), F.lit(0))
    alone = (F.col("x_held") == 1) & (F.col("y_held") == 1)
    near = ~alone | (F.col("x_low") + F.col("y_low") - differ >= 2 * _need(F.col("x_low"), F.col("y_low"), percent))
    met = x.join(y, "key").filter((F.col("x_root") < F.col("y_root")) & comparable & near)
    ends = [F.min("x_low").alias("x_low"), F.max("x_high").alias("x_high"), F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high")]
    counted = met.groupBy("x_root", "y_root").agg(F.count("*").alias("keys"), *ends, F.bool_or(F.col("x_light") | F.col("y_light")).alias("light"))
    beyond = lambda n, m: _need(n, m, percent) - F.ceil(F.greatest(n, m) * percent / 100)
    needed = F.least(*(beyond(F.col(f"x_{p}"), F.col(f"y_{q}")) for p in ("low", "high") for q in ("low", "high")))
    possible = counted.filter(F.col("light") | (F.col("keys") >= needed)).select("x_root", "y_root")
    room = F.least("x_room", "y_room") + F.when(F.col("x_light") & F.col("y_light"), SUBSET - 1).otherwise(0)
    kept = met.filter(room >= _need(F.col("x_low"), F.col("y_low"), percent)).select("key", "x_root", "y_root", (F.col("x_held") <= F.col("y_held")).alias("first")).join(possible, ["x_root", "y_root"])
    either = lambda u, v: F.when(F.col("first"), F.col(u)).otherwise(F.col(v))
    return kept.select("key", either("x_root", "y_root").alias("r"), either("y_root", "x_root").alias("s"))


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, m) of the pairs of different components that could link, a > b, from the lists that hold several components."""
    lists = checkpoint(_shared_lists(rest, percent))
    x, y = (rest.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("doc", "at")), F.col("root").alias(end)) for side, end in (("x", "r"), ("y", "s")))
    near = lists.join(x, ["key", "r"]).join(y, ["key", "s"]).filter(_near("x_at", "y_at", percent))
    last = F.col("x_doc") > F.col("y_doc")
    either = lambda u, v, name: F.when(last, u).otherwise(v).alias(name)
    doc, at = [F.col("x_doc"), F.col("y_doc")], [_size("x_at"), _size("y_at")]
    return near.select(either(*doc, "a"), either(*doc[::-1], "b"), either(*at, "n"), either(*at[::-1], "m")).distinct()


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n_shingles, component): for each row of `df` its id, the size of its set, and the smallest id it reaches by links.

    Two sets link when 100 * intersection >= percent * union; `percent` is over 50. A null or empty text, or one of blanks
    only, has no set and links with nothing. Documents with fewer words than `width` have one
    shingle. Each row is a document of its own, also under a repeated or null id. Null ids come after all others, so
    that a component is null only if all its ids are. An empty table gives no rows. Columns other than the two aren't read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if ids_are_keys(rows, "id"):
        return _joined(rows.select(F.col("id").cast("long").alias("doc"), "text"), width, percent)
    own = numbered(rows, "id", "text", "doc")
    ids = own.select("doc", "id")
    found = _joined(own.select("doc", "text"), width, percent)
    found = found.join(ids, "doc").join(ids.select(F.col("doc").alias("component"), F.col("id").alias("least")), "component")
    return found.select(F.col("id").alias("doc"), "n_shingles", F.col("least").alias("component"))


def _joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`join` of rows (doc, text) with keys that no two share."""
    sketch = checkpoint(_sketched(docs, width, percent))
    own = sketch.filter("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("k1"), F.col("d").alias("k2"))
    odd = sketch.filter("kind = 0").select(F.col("a").alias("doc"), *_ODD)
    boundary = _boundary(sketch, percent)

    # Equal sets are a class, named by its smallest document. Its rows are summed before they are shuffled.
    first = own.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("class"))
    classes = checkpoint(own.join(first, ["k1", "k2"], "left").select("doc", "n", F.coalesce("class", "doc").alias("class")))
    copies = classes.filter("doc <> class").select("doc")
    # With few copies only a class's first document is counted and posted. Otherwise all are, and the lists are brought down to classes.
    few = copies.count() <= BROADCAST_IDS
    firsts = docs.join(F.broadcast(copies), "doc", "left_anti") if few else docs
    common = checkpoint(_common(firsts, width))
    free_shuffles(docs.sparkSession)
    most = common.orderBy(F.desc("n"), "element").limit(MOST_COMMON).toArrow()  # 16 MB at most
    order = Order(most["element"].to_numpy().astype(np.int64).view(np.uint64), most["n"].to_numpy())
    if few:
        lists = _listed(_postings(firsts, order, boundary, width, percent))
    else:
        posted = _listed(_postings(docs, order, boundary, width, percent)).select("key", "doc", "at")
        of = classes.filter("n > 1").select("doc", "class")
        lists = _listed(posted.join(of, "doc").select("key", F.col("class").alias("doc"), "at").distinct())
    lists = checkpoint(lists)
    free_shuffles(docs.sparkSession)

    near = lists.filter((F.col("doc") != F.col("hub")) & _near("at", "hub_at", percent))
    pairs = checkpoint(near.select(F.col("doc").alias("a"), F.col("hub").alias("b"), _size("at").alias("n"), _size("hub_at").alias("m")).distinct())
    links = checkpoint(_verified(pairs, docs, width, percent))
    free_shuffles(docs.sparkSession)

    roots = checkpoint(components(links))
    labelled = lists.select("key", "doc", "at").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    open_lists = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rest = checkpoint(labelled.join(open_lists, "key", "left_semi").select("key", "doc", "at", "root").join(odd, "doc"))
    free_shuffles(docs.sparkSession)
    more = checkpoint(_across(rest, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    links = checkpoint(links.union(_verified(more, docs, width, percent)))

    roots = components(links).withColumnRenamed("node", "class")
    found = classes.join(roots, "class", "left")
    return found.select("doc", F.col("n").alias("n_shingles"), F.coalesce("root", "class").alias("component"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` that are the smallest of their component. Each row is a document of its own, also under a repeated or null id."""
    rows = keyed(df, id_col, text_col, "_gf_key")
    docs = rows.select(F.col("_gf_key").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kept = _joined(docs, width, percent).filter("doc = component").select(F.col("doc").alias("_gf_doc"))
    return rows.join(kept, F.col("_gf_key") == F.col("_gf_doc"), "left_semi").drop("_gf_key")
