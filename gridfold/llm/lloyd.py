"""Exact Lloyd clustering of integer vectors by two trees.

Vectors are dealt over blocks, and each block gets a cover tree once: a node's radius holds all its
vectors, its children lie more than half of that radius apart and hold theirs within that half. In each
round a cover tree over the centroids goes to all tasks, and both trees are descended together,
a level at a time. A pair of nodes is dropped where every vector of the one is nearer to
the centre of another centroid node than to any centroid of it; a node left with one centroid is assigned as a whole, by its sum. Pairs of
leaves are compared exactly. What a task returns is a sum for each centroid and component.

Distances and means are exact integers: in 64 bits where the largest component allows that, otherwise in Python's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint

#: Vectors in a block (512 kB of 64 components), and of a leaf.
BLOCK, LEAF = 2048, 8
#: Bounds are computed in doubles from exact squares; a pair isn't dropped for less than this part of them.
SLACK = 1e-9
LONG = 2**63


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component as a long; vectors of other sizes than `dim`, or with a null or non-finite component, are left out."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(vector.isNotNull() & (F.size(vector) == dim) & finite)
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    d = x - y
    return (d * d).sum(axis=-1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(x, y).astype(np.float64))


class Tree:
    """A cover tree over points, which are put in its order: node i holds points start[i]:end[i], its children are the nodes first[i]:first[i] + children[i]."""

    def __init__(self, points: np.ndarray, leaf: int):
        start, end, centre, radius, first, children = [], [], [], [], [], []

        def node(at: int, size: int, middle: int, r: float) -> None:
            start.append(at)
            end.append(at + size)
            centre.append(middle)
            radius.append(r)
            first.append(0)
            children.append(0)

        order = np.arange(len(points))
        members = {0: (np.arange(len(points)), _apart(points, points[:1]))} if len(points) else {}
        if members:
            node(0, len(points), 0, float(members[0][1].max()))
        here = 0
        while here < len(start):
            own, away = members.pop(here)
            half = radius[here] / 2
            if len(own) <= leaf or half == 0:
                order[start[here] : end[here]] = own
                here += 1
                continue
            first[here], at = len(start), start[here]
            rest, far, middle = own, away, centre[here]
            while len(rest):
                near = _apart(points[rest], points[middle : middle + 1])
                inside = near <= half
                members[len(start)] = (rest[inside], near[inside])
                node(at, int(inside.sum()), middle, float(near[inside].max()))
                at += int(inside.sum())
                rest, far = rest[~inside], far[~inside]
                if len(rest):
                    middle = int(rest[np.argmax(far)])
            children[here] = len(start) - first[here]
            here += 1
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        self.order, self.points = order, points[order]
        self.start, self.end, self.first, self.children = (np.array(x, np.int64) for x in (start, end, first, children))
        self.centre, self.radius = place[np.array(centre, np.int64)] if centre else np.empty(0, np.int64), np.array(radius)

    def packed(self) -> tuple[bytes, bytes]:
        return np.array([self.start, self.end, self.first, self.children, self.centre]).tobytes(), self.radius.tobytes()

    @classmethod
    def unpacked(cls, points: np.ndarray, nodes: bytes, radius: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.radius = points, np.frombuffer(radius)
        tree.start, tree.end, tree.first, tree.children, tree.centre = np.frombuffer(nodes, np.int64).reshape(5, -1)
        return tree


def _expanded(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, and for each its place in `nodes`."""
    n = tree.children[nodes]
    at = np.repeat(np.arange(len(nodes)), n)
    return np.repeat(tree.first[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum()), at


def _ranges(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of nodes, and for each the place of its node."""
    n = tree.end[nodes] - tree.start[nodes]
    return np.repeat(tree.start[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(nodes)), n)


class Assigned:
    """Whole nodes (start, end, centroid) and single points with their centroids."""

    def __init__(self, tree: Tree, centroids: Tree):
        """`centroids.order` has the numbers of the centroids; among equally near ones the smallest is taken."""
        numbers = centroids.order
        alone = centroids.end - centroids.start == 1
        q, r = np.zeros(min(1, len(tree.start)), np.int64), np.zeros(min(1, len(tree.start)), np.int64)
        whole, points, closest = [], [], []
        self.compared = 0
        while len(q):
            away = _apart(tree.points[tree.centre[q]], centroids.points[centroids.centre[r]])
            most = np.full(len(tree.start), np.inf)
            np.minimum.at(most, q, away + tree.radius[q])
            around = tree.radius[q] + centroids.radius[r]
            near = away - around - SLACK * (away + around) <= most[q]
            q, r = q[near], r[near]
            single = (np.bincount(q, minlength=len(tree.start))[q] == 1) & alone[r]
            whole.append((q[single], r[single]))
            q, r = q[~single], r[~single]
            inner_q, inner_r = tree.children[q] > 0, centroids.children[r] > 0
            # A node that still has a centroid node to open keeps all its pairs together: either all of them go down in Q or none.
            waits = np.zeros(len(tree.start), bool)
            waits[q[inner_r & (~inner_q | (centroids.radius[r] > tree.radius[q]))]] = True
            leaves = ~inner_q & ~waits[q]
            if leaves.any():
                found = self._exact(tree, centroids, q[leaves], r[leaves], numbers)
                points.append(found[0])
                closest.append(found[1])
            stay = waits[q]
            opened, at = _expanded(centroids, r[stay & inner_r])
            down, of = _expanded(tree, q[~stay & inner_q])
            q, r = np.concatenate([q[stay & inner_r][at], q[stay & ~inner_r], down]), np.concatenate([opened, r[stay & ~inner_r], r[~stay & inner_q][of]])
        nodes = np.concatenate([w[0] for w in whole]) if whole else np.empty(0, np.int64)
        self.nodes, self.node_of = nodes, numbers[centroids.start[np.concatenate([w[1] for w in whole])]] if whole else np.empty(0, np.int64)
        self.points = np.concatenate(points) if points else np.empty(0, np.int64)
        self.point_of = np.concatenate(closest) if closest else np.empty(0, np.int64)
        self.tree = tree

    def _exact(self, tree: Tree, centroids: Tree, q: np.ndarray, r: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of the leaves q with the nearest of the centroids in the leaves r."""
        point, at = _ranges(tree, q)
        centroid, of = _ranges(centroids, r[at])
        point = point[of]
        self.compared += len(point)
        away = squares(tree.points[point], centroids.points[centroid])
        best = np.lexsort((numbers[centroid], away, point))
        first = np.concatenate([[True], point[best][1:] != point[best][:-1]])
        return point[best][first], numbers[centroid[best][first]]

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors each centroid has, and their sums."""
        points = self.tree.points
        total, n = np.zeros((k, points.shape[1]), points.dtype), np.zeros(k, np.int64)
        upto = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points, axis=0)])
        np.add.at(total, self.node_of, upto[self.tree.end[self.nodes]] - upto[self.tree.start[self.nodes]])
        np.add.at(n, self.node_of, self.tree.end[self.nodes] - self.tree.start[self.nodes])
        np.add.at(total, self.point_of, points[self.points])
        np.add.at(n, self.point_of, 1)
        return n, total

    def labels(self) -> np.ndarray:
        found = np.empty(len(self.tree.points), np.int64)
        points, at = _ranges(self.tree, self.nodes)
        found[points] = self.node_of[at]
        found[self.points] = self.point_of
        return found


def _blocks(rows: DataFrame, n: int, kind: type) -> DataFrame:
    """Blocks of vectors with their trees, in rows (ids, vectors, nodes, radius). Rows are dealt by their place, so that copies spread."""
    blocks = max(1, -(-n // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(blocks)))
    of = rows.schema["id"].dataType.simpleString()

    def run(held: pa.Table) -> pa.Table:
        own = held["v"].combine_chunks()
        points = own.flatten().to_numpy().reshape(len(own), -1)
        tree = Tree(points.astype(kind), LEAF)
        nodes, radius = tree.packed()
        size = np.int32 if kind is np.int64 else np.int64  # where 64 bits hold the squares, 32 hold the components
        ids = held["id"].combine_chunks().take(pa.array(tree.order))
        return pa.table({"ids": pa.array([ids.to_pylist()], pa.list_(ids.type)), "vectors": [points[tree.order].astype(size).tobytes()], "nodes": [nodes], "radius": [radius]})

    return dealt.groupBy("block").applyInArrow(run, f"ids array<{of}>, vectors binary, nodes binary, radius binary")


def _trees(batch: pa.RecordBatch, dim: int, kind: type) -> Iterator[tuple[pa.Array, Tree]]:
    for ids, vectors, nodes, radius in zip(*(batch.column(k) for k in range(4)), strict=True):
        points = np.frombuffer(vectors.as_py(), np.int32 if kind is np.int64 else np.int64).reshape(-1, dim).astype(kind)
        yield ids.values, Tree.unpacked(points, nodes.as_py(), radius.as_py())


def _moved(blocks: DataFrame, centroids: list[list[int]], dim: int, kind: type) -> list[list[int]]:
    """The centroids after a round. k * dim sums come to the driver, whatever the number of vectors."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(np.array(centroids, kind), 1)
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            for _, block in _trees(batch, dim, kind):
                more, sums = Assigned(block, tree).sums(k)
                n, total = n + more, total + sums.astype(object)
        at = np.flatnonzero(n)
        columns = [np.repeat(at, dim), np.tile(np.arange(dim), len(at)), np.repeat(n[at], dim)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array([Decimal(int(x)) for x in total[at].reshape(-1)], pa.decimal128(38, 0))], names=["cluster", "at", "n", "total"])

    sums = blocks.mapInArrow(run, "cluster long, at long, n long, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    moved = [list(c) for c in centroids]
    for cluster, at, n, total in sums.collect():
        moved[cluster][at] = int(total) // n
    return moved


def _labelled(blocks: DataFrame, of: str, centroids: list[list[int]], dim: int, kind: type) -> DataFrame:
    """(id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(centroids, kind)
        tree = Tree(own, 1)
        for batch in batches:
            for ids, block in _trees(batch, dim, kind):
                label = Assigned(block, tree).labels()
                away = squares(block.points, own[label])
                fits = [int(x) if x < LONG else None for x in away.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(fits, pa.int64())], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(run, f"id {of}, cluster int, distance long")


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    The first centroids are the kept vectors with the smallest sha256 of `seed:id`, in that order; of rows with one id the smaller vector comes first. Fewer
    than k kept vectors make as many centroids. Null ids are clustered, but are no first centroids while there are others.
    An empty centroid stays where it is; equal distances go to the smaller number. Repeated rows are vectors of their own. Components that
    don't fit a long are taken as the nearest that do; distances and inertias that don't fit are null. An empty table
    gives no rows. Columns other than the two aren't read.
    """
    spark = df.sparkSession
    rows = kept_vectors(df, id_col, vector_col, dim, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.withColumn("h", hashed).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    of = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v") - 1)).alias("most")).first()
    # Differences have at most twice the components, and `dim` of their squares are summed.
    kind = np.int64 if size["n"] and dim * (2 * size["most"] + 2) ** 2 < LONG and size["most"] < 2**31 else object
    centroids = [list(r["v"]) for r in first]
    schema = f"id {of}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    blocks = checkpoint(_blocks(rows, size["n"], kind))
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, dim, kind)
    found = checkpoint(_labelled(blocks, of, centroids, dim, kind))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")).collect()}  # at most k rows
    fits = lambda x: int(x) if x is not None and x < LONG else None
    total = fits(sum(sums.values())) if None not in sums.values() else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(c, fits(s), total, digest(centroids[c])) for c, s in sums.items()]
    beside = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(beside), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
