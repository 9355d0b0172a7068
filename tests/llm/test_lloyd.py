"""Lloyd clustering by two trees against plain rounds over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridfold.llm import lloyd


def plain(rows, k=8, rounds=10, dim=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            if mine := [v for (_, v), c in zip(kept, own, strict=True) if c == i]:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in found)
    by = {c: sum(d for _, x, d in found if x == c) for c in {c for _, c, _ in found}}
    return [(i, c, d, by[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def vectors(kind, n=400, dim=64):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        middle = rng.normal(size=(6, dim)) * 3
        return [(k, (middle[k % 6] + rng.normal(size=dim) * 0.05).tolist()) for k in range(n)]
    if kind == "ties":
        return [(k, [float(x) for x in rng.integers(-1, 2, dim) * (np.arange(dim) < 3)]) for k in range(n)]
    if kind == "copies":
        return [(k, [0.25] * dim if k % 3 else rng.normal(size=dim).tolist()) for k in range(n)]
    return [(k, rng.normal(size=dim).tolist()) for k in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "noise"])
@pytest.mark.parametrize("block", [50, 2048])
def test_against_plain_rounds(spark, monkeypatch, kind, block):
    monkeypatch.setattr(lloyd, "BLOCK", block)
    rows = vectors(kind)
    found = lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows))


def test_odd_rows(spark):
    """Other sizes, nulls and non-finite components are left out; repeated rows are vectors of their own."""
    good = [(k, v[:4]) for k, v in vectors("noise", 40)]
    odd = [(50, None), (51, []), (52, [1.0] * 5), (53, [1.0, None, 0.0, 0.0]), (54, [float("nan"), 0.0, 0.0, 0.0]), (55, [0.0, float("-inf"), 0.0, 0.0])]
    rows = good + odd + [good[0], good[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, Cluster string")
    assert sorted(map(tuple, lloyd.cluster(df, dim=4).collect())) == sorted(plain(rows, dim=4))
    few = lloyd.cluster(spark.createDataFrame(good[:3], "vec_id long, embedding array<double>"), dim=4).collect()
    assert sorted(map(tuple, few)) == sorted(plain(good[:3], dim=4)) and {r["distance"] for r in few} == {0}
    assert lloyd.cluster(df.filter("vec_id >= 50"), dim=4).count() == 0
    assert lloyd.cluster(df.limit(0), dim=4).columns[0] == "id"
    nulls = lloyd.cluster(spark.createDataFrame([(None, v) for _, v in good], "vec_id long, embedding array<double>"), k=2, dim=4)
    assert nulls.count() == len(good) and nulls.select("id").distinct().count() == 1


@pytest.mark.parametrize("size", [2.0**17, 2.0**25, 2.0**45])
def test_large_components(spark, size):
    """Exact beyond what 64 bits hold of squares; distances that a long doesn't hold are null."""
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-size, size) for _ in range(4)]) for k in range(60)]
    found = {r["id"]: tuple(r)[1:] for r in lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=3, dim=4).collect()}
    fits = lambda x: x if x < 2**63 else None
    for i, c, d, own, total, digest in plain(rows, k=3, rounds=3, dim=4):
        if size == 2.0**45:
            assert (found[i][0], found[i][1], found[i][4]) == (c, fits(d), digest)
        else:
            assert found[i] == (c, fits(d), fits(own), fits(total), digest)


def test_trees_cover_and_prune():
    """Radii hold their points, siblings lie apart, and whole nodes are assigned where clusters are."""
    points = (np.array([v for _, v in vectors("clusters", 600)]) * 1024).astype(np.int64)
    tree = lloyd.Tree(points, lloyd.LEAF)
    assert sorted(tree.order) == list(range(600))
    for i in range(len(tree.start)):
        own, middle = tree.points[tree.start[i] : tree.end[i]], tree.points[tree.centre[i]]
        assert lloyd._apart(own, middle).max() <= tree.radius[i] + 1e-9
        centres = tree.points[tree.centre[tree.first[i] : tree.first[i] + tree.children[i]]]
        for k in range(len(centres)):
            assert (lloyd._apart(np.delete(centres, k, axis=0), centres[k]) > tree.radius[i] / 2).all()
    assigned = lloyd.Assigned(tree, lloyd.Tree(points[:6].copy(), 1))
    assert len(assigned.points) == 0 and len(assigned.nodes) < 20 and assigned.compared == 0
