"""An interpolated modified Kneser-Ney model of words, counted in Spark and looked up in mapped files.

N-grams are 64-bit hashes of their words. Of each window of tokens a worker hands on the sorted
distinct n-grams of the highest order with their counts, cut into ranges of (context, word) whose bounds come from a sample
of the texts, so that a frequent context is in several of them. A range is one group: its counts are merged and
written as sorted arrays, contexts with their totals beside them. Lower orders are made from those files: an
n-gram counts once for each word that it follows. The bounds only deal the work; counts cover all texts.

Scoring maps the files. A worker gathers the distinct n-grams of many texts, sorts them, and so reads each file in one direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint
from gridfold.llm.hash_arrays import cuts, map_arrays, remove, shared_folder, within, write_arrays
from gridfold.llm.shingles import word_hashes

#: Tokens that a worker counts at once when it counts and when it scores (some 40 bytes each); a longer text is one by itself.
WINDOW, TOGETHER = 3_000_000, 400_000
#: Tokens of a range, which is one task's group, and the fewest for which one is made.
RANGE, LEAST_RANGE = 1 << 21, 1 << 17
#: Bytes of texts in the sample by which n-grams are dealt, and the part of its n-grams that comes to the driver.
SAMPLE_BYTES, SAMPLE_PART = 1 << 25, 64
#: Counts up to here are kept in a byte; larger ones stand beside them.
BYTE = 255
_ODD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(31), np.uint64(32)


def _own_hash(name: bytes) -> np.uint64:
    return np.frombuffer(xxhash.xxh3_128_digest(name), np.uint64)[0]


#: They hold a space, so that no word is like them.
BEGIN, END = _own_hash(b" begin"), _own_hash(b" end")
Bounds = tuple[np.ndarray, np.ndarray]


def mixed(nearer: np.ndarray, older: np.ndarray) -> np.ndarray:
    h = (nearer ^ (nearer >> _A)) * _ODD + older
    return (h ^ (h >> _B)) * _ODD


def tokens_of(text: str | None) -> np.ndarray:
    """The hashes of a text's words, A-Z lower-cased, and of one end."""
    return np.append(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), END)


def grams(texts: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For each token of the texts its contexts of order - 1 words down to one, then the token. Texts begin with as many `BEGIN`."""
    start = np.full(order - 1, BEGIN)
    line = np.concatenate([x for t in texts for x in (start, t)]) if texts else np.empty(0, np.uint64)
    n = np.array([len(t) for t in texts], np.int64)
    at = np.arange(n.sum()) + np.repeat(np.arange(1, len(texts) + 1) * (order - 1), n)
    contexts: list[np.ndarray] = []
    for k in range(1, order):
        older = line[at - k]
        contexts.insert(0, mixed(contexts[0], older) if contexts else older)
    return [*contexts, line[at]]


def summed(columns: list[np.ndarray], weights: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows in the order of the first and last column, which make out the others, one for each; weights are added."""
    by = np.lexsort((columns[-1], columns[0])) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    first, last = columns[0][by], columns[-1][by]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])) if len(by) else np.empty(0, np.int64)
    return [c[by][new] for c in columns], [np.add.reduceat(w[by], new) if len(new) else w[by] for w in weights]


@dataclass
class Model:
    """What all workers need besides the files. `edges` has the contexts that bounds cut, with their totals over all ranges."""

    folder: str
    order: int
    tokens: int = 0
    words: int = 0
    word_files: int = 1
    bounds: dict[int, Bounds] = field(default_factory=dict)
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    unigrams: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))  # total, those of 1, 2, and all

    def path(self, level: int, part: int) -> str:
        return f"{self.folder}/{level}-{part}"

    def delete(self) -> None:
        remove(self.folder)


def discounts_of(n: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and more, by the number of n-grams with counts of 1 to 4; 0.5, 1 and 1.5 where those don't serve."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if (found[1:] > 0).all() and (found <= np.arange(4)).all():
            return found
    return np.array([0, 0.5, 1, 1.5])


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """The tokens of whole texts (the last column), about `most` at once, with their rows."""
    held, rows, size = [], [], 0
    for batch in batches:
        start = 0
        for k, text in enumerate(batch.column(batch.num_columns - 1)):
            held.append(tokens_of(text.as_py()))
            size += len(held[-1])
            if size >= most:
                yield held, [*rows, batch.slice(start, k + 1 - start)]
                held, rows, size, start = [], [], 0, k + 1
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if held:
        yield held, rows


def _blobs(columns: list[np.ndarray], weights: list[np.ndarray], places: np.ndarray) -> pa.RecordBatch:
    """A row (part, columns, weights) for each part that has rows; all arrays are bytes, one after the other."""
    parts = np.flatnonzero(places[1:] > places[:-1])
    packed = [b"".join(a[places[p] : places[p + 1]].tobytes() for a in columns) for p in parts]
    heavy = [b"".join(w[places[p] : places[p + 1]].astype(np.int64).tobytes() for w in weights) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(heavy, pa.binary())], names=["part", "columns", "weights"])


BLOB = "part int, columns binary, weights binary"


def _unpacked(table: pa.Table, n_columns: int, n_weights: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    columns = [np.frombuffer(x.as_py(), np.uint64).reshape(n_columns, -1) for x in table["columns"]]
    weights = [np.frombuffer(x.as_py(), np.int64).reshape(n_weights, -1) for x in table["weights"]]
    return [np.concatenate([c[k] for c in columns]) for k in range(n_columns)], [np.concatenate([w[k] for w in weights]) for k in range(n_weights)]


def _counted(docs: DataFrame, order: int, bounds: Bounds) -> DataFrame:
    window = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _texts(batches, window):
            columns = grams(texts, order)
            columns, (n,) = summed(columns, [np.ones(len(columns[0]), np.int64)])
            yield _blobs(columns, [n], cuts(columns[0], columns[-1], bounds))

    return docs.mapInArrow(run, BLOB)


def _lowered(spark: SparkSession, model: Model, level: int) -> DataFrame:
    """The n-grams of a level without their oldest word, from the files: counted once for each, and with the counts of their tokens."""
    parts, to = len(model.bounds[level][0]) + 1, level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                held = map_arrays(model.path(level, part))
                if not held:
                    continue
                n = held["n"].astype(np.int64)
                n[held["big_at"]] = held["big"]
                columns = [np.asarray(held[f"lower{j}"]) for j in range(to - 1)] + [np.asarray(held["word"])]
                columns, weights = summed(columns, [np.ones(len(n), np.int64), np.asarray(held["raw"]) if "raw" in held else n])
                yield _blobs(columns, weights, cuts(columns[0], columns[-1], model.bounds[to]) if to > 1 else _word_places(columns[0], model.word_files))
        map_arrays.cache_clear()  # removed files stay on disk while they are mapped

    slices = min(parts, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, parts, 1, slices).mapInArrow(run, BLOB)


def _word_places(words: np.ndarray, files: int) -> np.ndarray:
    """Sorted words are cut by even ranges of their hashes."""
    return np.searchsorted(((words >> _B) * np.uint64(files)) >> _B, np.arange(files + 1, dtype=np.uint64))


def _merged(blobs: DataFrame, model: Model, level: int, weighted: int) -> DataFrame:
    """Writes each range of a level of two words or more. (rows, counts of 1 to 4, and the totals of the contexts that its two bounds cut)."""
    bounds, byte = model.bounds[level], BYTE

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        columns, (n, *raw) = summed(*_unpacked(table, level, weighted))
        contexts, words = columns[0], columns[-1]
        new = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        ends = np.append(new[1:], len(contexts))
        about = np.array([np.add.reduceat(x, new) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64))] + [ends - new])
        big = np.flatnonzero(n >= byte)
        arrays = {"context": contexts[new], "offset": np.append(new, len(contexts)).astype(np.uint32), "total": about[0], "n1": about[1].astype(np.uint32), "n2": about[2].astype(np.uint32)}
        arrays |= {"word": words, "n": np.minimum(n, byte).astype(np.uint8), "big_at": big.astype(np.uint32), "big": n[big]}
        arrays |= {f"lower{j}": c for j, c in enumerate(columns[1:-1])}
        write_arrays(model.path(level, part), arrays | ({"raw": raw[0]} if raw else {}))
        edge = dict.fromkeys(bounds[0][max(0, part - 1) : part + 1].tolist())
        held = [(b, k) for b in edge if (k := int(np.searchsorted(arrays["context"], np.uint64(b)))) < len(new) and int(arrays["context"][k]) == b]
        counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        return pa.table({"rows": [len(n)], "counts": [counts.tolist()], "edges": pa.array([[np.uint64(b).astype(np.int64) for b, _ in held]], pa.list_(pa.int64())), "about": pa.array([[about[j, k] for _, k in held for j in range(4)]], pa.list_(pa.int64()))})

    return blobs.groupBy("part").applyInArrow(run, "rows long, counts array<long>, edges array<long>, about array<long>")


def _merged_words(blobs: DataFrame, model: Model) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        (words,), (n, raw) = summed(*_unpacked(table, 1, 2))
        write_arrays(model.path(1, key[0].as_py()), {"word": words, "n": n.astype(np.uint32), "raw": raw})
        return pa.table({"rows": [len(n)], "counts": [np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()], "total": [int(n.sum())], "tokens": [int(raw.sum())]})

    return blobs.groupBy("part").applyInArrow(run, "rows long, counts array<long>, total long, tokens long")


def _bounds(docs: DataFrame, order: int, size: int, parts: int) -> dict[int, Bounds]:
    """Places that cut the n-grams of each level into about `parts` equal ranges, from a sample of the texts."""
    together, part = TOGETHER, np.uint64(SAMPLE_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _texts(batches, together):
            columns = grams(texts, order)
            for level in range(2, order + 1):
                first, last = columns[order - level], columns[-1]
                taken = (mixed(last, first) >> _B) % part == 0
                pair = np.unique(np.stack([first[taken], last[taken]], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), level, np.int32)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["level", "first", "last"])

    sample = docs.sample(min(1.0, SAMPLE_BYTES / max(1, size)), seed=13).mapInArrow(run, "level int, first long, last long").distinct().toArrow()  # about SAMPLE_BYTES / 400 rows a level
    level, first, last = (sample[c].to_numpy() for c in ("level", "first", "last"))
    found = {}
    for k in range(2, order + 1):
        own = [x[level == k].astype(np.int64).view(np.uint64) for x in (first, last)]
        (a, b), _ = summed(own, [])
        at = np.unique((np.arange(1, parts) * len(a)) // parts) if len(a) else np.empty(0, np.int64)
        found[k] = (a[at], b[at])
    return found


def train(df: DataFrame, order: int = 2, text_col: str = "text", folder: str | None = None) -> Model:
    """Counts the texts of `df`. The model's files are in `folder`, a new one in the session's checkpoint folder by default; `Model.delete` removes them.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; each text ends with one end, also a null or empty one. No texts make a model of one unknown word.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{text_col}`").alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    tokens = size // 6
    parts = max(-(-tokens // RANGE), min(2 * spark.sparkContext.defaultParallelism, -(-tokens // LEAST_RANGE)), 1)
    model = Model(folder or shared_folder(spark, "kneser-ney"), order, word_files=parts)
    model.bounds = _bounds(docs, order, size, parts)
    blobs = _counted(docs, order, model.bounds[order])
    for level in range(order, 1, -1):
        weighted = 1 if level == order else 2
        found = checkpoint(_merged(blobs, model, level, weighted)).collect()  # a row for each range
        model.discounts[level] = discounts_of(np.sum([r["counts"] for r in found] or [np.zeros(4)], axis=0))
        edges: dict[int, np.ndarray] = {}
        for r in found:
            for k, context in enumerate(r["edges"]):
                edges[context] = edges.get(context, np.zeros(4, np.int64)) + np.array(r["about"][4 * k : 4 * k + 4])
        keys = np.array(sorted(edges), np.int64)
        by = np.argsort(keys.view(np.uint64))
        model.edges[level] = (keys[by].view(np.uint64), np.array([edges[k] for k in keys[by].tolist()]).reshape(-1, 4))
        blobs = _lowered(spark, model, level)
    words = checkpoint(_merged_words(blobs, model)).collect()
    counts = np.sum([r["counts"] for r in words] or [np.zeros(4, np.int64)], axis=0)
    model.discounts[1] = discounts_of(counts)
    model.words, model.tokens = sum(r["rows"] for r in words), sum(r["tokens"] for r in words)
    model.unigrams = np.array([sum(r["total"] for r in words), counts[0], counts[1], model.words])
    return model


def _looked_up(model: Model, level: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted (context, word): the count, and the context's total, words of count 1, of 2, and all (4 rows)."""
    n, about = np.zeros(len(contexts), np.int64), np.zeros((4, len(contexts)), np.int64)
    places = cuts(contexts, words, model.bounds[level])
    for part in np.flatnonzero(places[1:] > places[:-1]).tolist():
        at = slice(places[part], places[part + 1])
        held = map_arrays(model.path(level, part))
        if not held:
            continue
        k = np.minimum(np.searchsorted(held["context"], contexts[at]), len(held["context"]) - 1)
        known = held["context"][k] == contexts[at]
        low, high = held["offset"][k].astype(np.int64), held["offset"][k + 1].astype(np.int64)
        about[:, at] = np.where(known, [held["total"][k], held["n1"][k], held["n2"][k], high - low], 0)
        row = within(held["word"], np.where(known, low, 0), np.where(known, high, 0), words[at])
        found = known & (row < high)
        row = np.minimum(row, len(held["word"]) - 1)
        found &= held["word"][row] == words[at]
        count = held["n"][row].astype(np.int64)
        if len(held["big"]):
            big = np.minimum(np.searchsorted(held["big_at"], row), len(held["big"]) - 1)
            count = np.where(held["big_at"][big] == row, held["big"][big], count)
        n[at] = np.where(found, count, 0)
    edges, totals = model.edges[level]
    if len(edges):
        k = np.minimum(np.searchsorted(edges, contexts), len(edges) - 1)
        cut = edges[k] == contexts
        about[:, cut] = totals[k[cut]].T
    return n, about


def _weighted(n: np.ndarray, about: np.ndarray, lower: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """The interpolated probability; that of the lower order where the context is unknown."""
    total, n1, n2, n_all = about
    safe = np.maximum(total, 1)
    left = discounts[1] * n1 + discounts[2] * n2 + discounts[3] * (n_all - n1 - n2)
    found = np.maximum(n - discounts[np.minimum(n, 3)], 0) / safe + left / safe * lower
    return np.where(total > 0, found, lower)


def probabilities(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each token of the texts, and how often it was in training."""
    columns = grams(texts, model.order)
    words, at = np.unique(columns[-1], return_inverse=True)
    n, raw = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    places = _word_places(words, model.word_files)
    for part in np.flatnonzero(places[1:] > places[:-1]).tolist():
        held, own = map_arrays(model.path(1, part)), slice(places[part], places[part + 1])
        if held:
            k = np.minimum(np.searchsorted(held["word"], words[own]), len(held["word"]) - 1)
            same = held["word"][k] == words[own]
            n[own], raw[own] = np.where(same, held["n"][k], 0), np.where(same, held["raw"][k], 0)
    about = np.repeat(model.unigrams[:, None], len(words), axis=1)
    p = _weighted(n, about, np.full(len(words), 1 / (model.words + 1)), model.discounts[1])[at]
    raw = raw[at]
    for level in range(2, model.order + 1):
        first, last = columns[model.order - level], columns[-1]
        by = np.lexsort((last, first))
        a, b = first[by], last[by]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(by) else np.empty(0, bool)
        n, about = _looked_up(model, level, a[new], b[new])
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(new) - 1
        p = _weighted(n[of], about[:, of], p, model.discounts[level])
    return p, raw


def score(model: Model, df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df`, or those of its columns that are in `keep`, with n_tokens, n_known (those in training), train_tokens (long), base_score and score (double) of each whole text.

    base_score is the log10 probability under add-one counts of single tokens, score under the model; a text's perplexity is 10 ^ (-score / n_tokens).
    A null or empty text is one end. Input columns with those names give way, others pass through; rows are independent.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own"), F.col(f"`{text_col}`").alias("text"))
    schema = f"own {rows.schema['own'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    together = TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, held in _texts(batches, together):
            p, raw = probabilities(model, texts)
            ends = np.cumsum([len(t) for t in texts])
            base = np.log10((raw + 1) / (model.tokens + model.words + 1))
            sums = lambda x: [x[i:j].sum() for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]  # noqa: B023, E731
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(sums((raw > 0).astype(np.int64)), pa.int64()), pa.array([model.tokens] * len(texts), pa.int64()), pa.array(sums(base), pa.float64()), pa.array(sums(np.log10(p)), pa.float64())]
            own = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays([own, *columns], names=["own", *made])
        map_arrays.cache_clear()

    return rows.mapInArrow(run, schema).select("own.*", *made)


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2):
    """Whether a row's id falls into the part that isn't learned from; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def score_held_out(df: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, held_out) and the columns of `score` of each row of `df`, from a model of those that aren't held out. The model's files are removed once all are scored."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")), order)
    scored = checkpoint(score(model, rows, keep=["doc", "held_out"]))
    model.delete()
    return scored
