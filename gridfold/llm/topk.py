"""Exact top-k search by distributed histogram selection.

Candidates and queries are dealt over a grid of cells by salts, so that each query meets each candidate in one cell;
a cell's scores are matrix products in blocks, and none are kept. A first pass counts each query's scores in wide
bins, which are summed over all cells; the bin that holds the k-th highest score is cut again in
the next pass, until bins are one integer wide and the k-th value is known. A last pass emits the
candidates above that value, and of those equal to it the smallest ids. From each cell a pass gets
at most k counts for a query, since a bin under the cell's own k-th score can't hold the k-th of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint

#: Most candidates and queries of a cell, where the memory of a Python worker is bounded: 16 MB of 2-byte components with 64 of them.
CELL_CANDIDATES, CELL_QUERIES = 1 << 16, 1 << 14
#: Fewest candidates for which a cell is made, where there are cores to spare.
LEAST_CELL = 1 << 10
#: Scores of a block are a matrix of so many queries and candidates (32 MB).
QUERY_BLOCK, CANDIDATE_BLOCK = 1 << 10, 1 << 12
#: Each pass cuts the bin of the k-th value into so many.
SPLIT_BITS = 12
#: Inner products up to the first bound are exact in doubles, up to the second in 64-bit integers; beyond it in integers of any size.
EXACT, LONG = 2**53, 2**63
LOWEST = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): v has floor(scale * x) of each component; rows with a null id or vector, or with a null or non-finite component, are left out."""
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & finite)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def _salts(n: int, most: int) -> int:
    return max(1, -(-n // most))


class _Grid:
    """How candidates and queries are dealt: `across` salts of candidates, `down` salts of queries, and cells for each pair and length."""

    def __init__(self, candidates: int, queries: int, cores: int):
        self.down = _salts(queries, CELL_QUERIES)
        spread = min(2 * cores // self.down, _salts(candidates, LEAST_CELL))
        self.across = max(_salts(candidates, CELL_CANDIDATES), spread, 1)

    def candidates(self, rows: DataFrame) -> DataFrame:
        # Rows are salted by their place, so that copies of one row spread as well.
        salted = rows.select(F.size("v").alias("dim"), "id", "v", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(self.across)).alias("across"))
        return salted.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(self.down - 1))))

    def queries(self, rows: DataFrame) -> DataFrame:
        salted = rows.select(F.size("v").alias("dim"), "id", "v", "low", "width", F.pmod(F.xxhash64("id"), F.lit(self.down)).alias("down"))
        return salted.withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.across - 1).cast("long"))))

    def map(self, rows: DataFrame, queries: DataFrame, run: Callable, schema: str) -> DataFrame:
        keys = ("dim", "across", "down")
        same = lambda df: df.withColumns({"across": F.col("across").cast("long"), "down": F.col("down").cast("long")})
        return same(self.candidates(rows)).groupBy(*keys).cogroup(same(self.queries(queries)).groupBy(*keys)).applyInArrow(run, schema)


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _product(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; those that don't fit raise."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = max(map(abs, (int(queries.min()), int(queries.max())))) * max(map(abs, (int(candidates.min()), int(candidates.max())))) * queries.shape[1]
    if most < EXACT:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if most < LONG:
        return queries.astype(np.int64) @ candidates.astype(np.int64).T
    return (queries.astype(object) @ candidates.astype(object).T).astype(np.int64)


def _blocks(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Of a cell's table of candidates and of queries: each block's slice of queries, its candidate ids, and its scores, a query's own row far below all."""
    if not left.num_rows or not right.num_rows:
        return
    dim = left["dim"][0].as_py()
    ids, asked = left["id"].to_numpy(), right["id"].to_numpy()
    vectors, queries = _matrix(left, dim), _matrix(right, dim)
    for j in range(0, len(asked), QUERY_BLOCK):
        own = slice(j, min(j + QUERY_BLOCK, len(asked)))
        for i in range(0, len(ids), CANDIDATE_BLOCK):
            part = ids[i : i + CANDIDATE_BLOCK]
            scores = _product(queries[own], vectors[i : i + CANDIDATE_BLOCK])
            scores[asked[own][:, None] == part[None, :]] = LOWEST
            yield own, part, scores


def _counts(k: int) -> Callable:
    """(id, bin, n): for each query, counts of the cell's k highest scores at or over its low, in bins of its width; those from its high on go into the last bin."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked, low, width = (right[c].to_numpy() for c in ("id", "low", "width"))
        top = np.full((len(asked), k), LOWEST)
        for own, _, scores in _blocks(left, right):
            both = np.concatenate([top[own], scores], axis=1)
            top[own] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        at = np.nonzero((top > LOWEST) & (top >= low[:, None]))
        # The difference of two longs is right as an unsigned one.
        above = (top[at].view(np.uint64) - low[at[0]].view(np.uint64)) // width[at[0]].view(np.uint64)
        bins = np.minimum(above, np.uint64(1 << SPLIT_BITS)).astype(np.int64)
        keys, counts = np.unique(np.stack([at[0], bins]), axis=1, return_counts=True)
        return pa.table({"id": asked[keys[0]], "bin": keys[1].astype(np.int64), "n": counts.astype(np.int64)})

    return run


def _refined(counts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`queries` with low and width of the bin that holds the k-th score."""
    summed = counts.groupBy("id", "bin").agg(F.sum("n").alias("n"))
    upto = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bin"))))
    found = upto.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("bin"))), F.min("bin")).alias("bin"))
    joined = queries.join(found, "id")
    width = F.greatest(F.lit(1).cast("long"), F.expr(f"(width - 1) div {1 << SPLIT_BITS} + 1"))
    return joined.select("id", "v", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), width.alias("width"))


def _emitted(k: int) -> Callable:
    """(query_id, id, score): candidates at or over each query's k-th value, of a block the k best with ties to smaller ids."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked, low = right["id"].to_numpy(), right["low"].to_numpy()
        found = [np.empty((3, 0), np.int64)]
        for own, ids, scores in _blocks(left, right):
            least = np.maximum(low[own], LOWEST + 1)
            for j in np.nonzero((scores >= least[:, None]).any(axis=1))[0]:
                at = np.nonzero(scores[j] >= least[j])[0]
                best = at[np.lexsort((ids[at], -scores[j, at]))][:k]
                found.append(np.stack([np.full(len(best), asked[own][j]), ids[best], scores[j, best]]))
        return pa.table(dict(zip(("query_id", "id", "score"), np.concatenate(found, axis=1), strict=True)))

    return run


def _element(largest: int) -> str:
    """The narrowest type of the components."""
    return next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if largest < 1 << bits)


def _magnitude(v: str) -> Column:
    return F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0).cast("long"))


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those under the
    query's own id. With fewer than k candidates all are returned. Null ids, null vectors and
    vectors with null or non-finite components take no part. Vectors of another length than the
    query's have no score with it. Repeated ids count as candidates each; of repeated query ids the
    smallest vector asks. An empty table gives no rows. Other columns aren't read. Scores are exact as far as a long holds them;
    a component times `scale`, or a score, that a long doesn't hold raises.
    """
    rows = quantised(df, id_col, vector_col, scale)
    n, asking, largest, dim = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(_magnitude("v")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rows = rows.withColumn("v", F.col("v").cast(f"array<{_element(largest)}>"))
    grid = _Grid(n, asking, df.sparkSession.sparkContext.defaultParallelism)
    # Any score is within the product of the largest components; the first bins span that range.
    reach = min(largest * largest * dim + 1, LONG - 1)
    width = -(-2 * reach // (1 << SPLIT_BITS))
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = checkpoint(asked.select("id", "v", F.lit(-reach).cast("long").alias("low"), F.lit(width).cast("long").alias("width")))
    while True:
        counts = grid.map(rows, queries, _counts(k), "id long, bin long, n long")
        queries = checkpoint(_refined(counts, queries, k))
        if width == 1:
            break
        width = max(1, -(-width // (1 << SPLIT_BITS)))
    emitted = grid.map(rows, queries, _emitted(k), "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return emitted.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
