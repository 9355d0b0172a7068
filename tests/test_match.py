"""Matching on tiles and by bounds against all candidates, scored one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.operators import evidence, match, traverse
from gridfold.params import Grid, SearchWindow

GRID = Grid(0.25, 90, 110, -3.0, 2.0)


def field_of(rng):
    """Walls of two rooms, blurred a little, in a dense array."""
    v = np.zeros((GRID.rows, GRID.cols))
    v[10, 12:95] = v[70, 12:95] = v[10:71, 12] = v[10:71, 94] = 1.0
    v[30:45, 50] = v[45, 50:70] = 1.0
    for _ in range(40):
        v[rng.randrange(90), rng.randrange(110)] = rng.random()
    return v


def value(v, x, y):
    c, r = (x - GRID.origin_x) / GRID.resolution - 0.5, (y - GRID.origin_y) / GRID.resolution - 0.5
    if not (0 <= c <= GRID.cols - 1 and 0 <= r <= GRID.rows - 1):
        return 0.0
    c0, r0 = min(math.floor(c), GRID.cols - 2), min(math.floor(r), GRID.rows - 2)
    fc, fr = c - c0, r - r0
    return (1 - fr) * ((1 - fc) * v[r0, c0] + fc * v[r0, c0 + 1]) + fr * ((1 - fc) * v[r0 + 1, c0] + fc * v[r0 + 1, c0 + 1])


def score(v, points, pose):
    x, y, theta = pose
    return sum(value(v, math.cos(theta) * px - math.sin(theta) * py + x, math.sin(theta) * px + math.cos(theta) * py + y) for px, py in points)


def exhaustive(v, points, pose, search):
    best, total = score(v, points, pose), 0
    tr, hr, ts, hs = search.translation_radius, search.heading_radius, search.translation_step, search.heading_step
    for _ in range(search.refinements + 1):
        found = []
        n, h = match.span(tr, ts), match.span(hr, hs)
        for i in range(n):
            for j in range(n):
                for k in range(h):
                    d = (-tr + i * ts, -tr + j * ts, -hr + k * hs)
                    cost = (d[0] / ts) ** 2 + (d[1] / ts) ** 2 + (d[2] / hs) ** 2
                    tried = (pose[0] + d[0], pose[1] + d[1], pose[2] + d[2])
                    found.append((score(v, points, tried), cost, len(found), tried))
        total += len(found)
        top = max(f[0] for f in found)
        pick = min((f for f in found if f[0] >= top - 1e-12), key=lambda f: f[1:3])
        if pick[0] > best:
            best, pose = pick[0], pick[3]
        tr, hr, ts, hs = tr / 2, hr / 2, ts / 2, hs / 2
    return pose, best, total


def sweep(rng, v, pose, n=25):
    """Points that lie on walls as seen from the pose, and a few that don't."""
    rows, cols = np.nonzero(v >= 1.0)
    points = []
    for k in rng.sample(range(len(rows)), n):
        x, y = GRID.origin_x + (cols[k] + 0.5) * GRID.resolution, GRID.origin_y + (rows[k] + 0.5) * GRID.resolution
        dx, dy, c, s = x - pose[0], y - pose[1], math.cos(pose[2]), math.sin(pose[2])
        points.append((float(c * dx + s * dy), float(-s * dx + c * dy)))
    return points + [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(3)]


@pytest.mark.parametrize("search", [SearchWindow(0.5, 0.04, 0.125, 0.01, 1), SearchWindow(0.4, 0.03, 0.2, 0.03, 0)])
def test_search_by_bounds_equals_all_candidates(spark, search):
    rng = random.Random(7)
    v = field_of(rng)
    true = [(9.0, 12.0, 0.1), (14.2, 9.1, -1.3), (5.5, 16.0, 2.9), (-2.8, 2.1, 0.4)]
    sweeps = {k: sweep(rng, v, p) for k, p in enumerate(true)} | {4: [(0.0, 0.0)], 5: []}
    start = {k: (p[0] + rng.uniform(-0.3, 0.3), p[1] + rng.uniform(-0.3, 0.3), p[2] + rng.uniform(-0.03, 0.03)) for k, p in enumerate([*true, (40.0, 3.0, 0.0), (1.0, 1.0, 1.0)])}
    field = spark.createDataFrame([(int(r), int(c), float(v[r, c])) for r, c in zip(*np.nonzero(v), strict=True)], "row int, col int, v double")
    points = spark.createDataFrame([(k, *p) for k, own in sweeps.items() for p in own], "scan_idx int, px double, py double")
    predicted = spark.createDataFrame([(k, *p) for k, p in start.items()], "scan_idx int, x double, y double, theta double")
    found = {r.scan_idx: r for r in match.match_sweeps(points, predicted, field, GRID, search).collect()}
    scored = total = 0
    for k, own in sweeps.items():
        pose, best, n = exhaustive(v, own, start[k], search)
        assert (found[k].x, found[k].y, found[k].theta) == pytest.approx(pose, abs=1e-9) and found[k].score == pytest.approx(best, abs=1e-9), k
        if k < 3:
            scored, total = scored + found[k].scored, total + n
    if search.refinements:
        assert scored < total / 3


def test_tiles_hold_their_cells_and_halo(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(-40, 70), rng.randrange(-40, 70)): rng.random() for _ in range(400)} | {(0, 0): 0.5, (31, 32): 0.25, (32, 31): 0.75}
    field = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, v double")
    for halo in (0, 1):
        side, got = match.TILE + halo, {}
        for t in match.tiled(field, halo).collect():
            assert len(t.field) == side * side
            for k, v in enumerate(t.field):
                at = (t.tile_row * match.TILE + k // side, t.tile_col * match.TILE + k % side)
                assert v == cells.get(at, 0.0)
                got.setdefault(at, []).append(v)
        assert all(len(got[at]) >= 1 for at in cells)
    wide = {(r.row, r.col): r.v for r in match.pooled(field, 3).collect()}
    assert all(v == max(cells.get((r + i, c + j), 0.0) for i in range(3) for j in range(3)) for (r, c), v in wide.items()) and len(wide) > len(cells)


def test_scores_of_nothing(spark):
    tiles = match.tiled(spark.createDataFrame([], "row int, col int, v double"))
    poses = spark.createDataFrame([(0, 0, 1.0, 1.0, 0.0)], "scan_idx int, idx int, x double, y double, theta double")
    points = spark.createDataFrame([(0, 1.0, 1.0)], "scan_idx int, px double, py double")
    assert match.scores(points, poses, tiles, GRID, ("scan_idx",)).first()["score"] == 0.0
    assert match.scores(points.filter("false"), poses, tiles, GRID, ("scan_idx",)).select(F.sum("score")).first()[0] == 0.0


def test_scores_of_many_points_are_exact_sums(spark):
    """A plain sum of these is off by some 6e-10, and differs with the order of its rows."""
    rng = random.Random(3)
    v = np.full((GRID.rows, GRID.cols), 0.9) + np.arange(GRID.cols) / 1100.0
    field = spark.createDataFrame([(r, c, float(v[r, c])) for r in range(GRID.rows) for c in range(GRID.cols)], "row int, col int, v double")
    own = [(rng.uniform(0.0, 20.0), rng.uniform(5.0, 20.0)) for _ in range(40_000)]
    points = spark.createDataFrame([(0, *p) for p in own], "scan_idx int, px double, py double").crossJoin(spark.range(7).select("id")).drop("id").repartition(7)
    poses = spark.createDataFrame([(0, 0, 1.0, 0.5, 0.0)], "scan_idx int, idx int, x double, y double, theta double")
    want = 7 * math.fsum(value(v, px + 1.0, py + 0.5) for px, py in own)
    for given in (points, match.weighed(points)):
        assert match.scores(given, poses, match.tiled(field), GRID, ("scan_idx",)).first()["score"] == pytest.approx(want, abs=2e-10, rel=0)


def test_equal_points_and_rays_are_one_row(spark):
    points = spark.createDataFrame([(0, 1.0, 2.0)] * 5 + [(0, 1.0, 3.0), (1, 1.0, 2.0)], "scan_idx int, px double, py double")
    assert sorted(map(tuple, match.weighed(points).collect())) == [(0, 1.0, 2.0, 5), (0, 1.0, 3.0, 1), (1, 1.0, 2.0, 1)]
    rays = [(0, 1.1, 4.1, 6.3, 5.2, k == 3) for k in range(6)] + [(0, 1.1, 4.1, 6.3, 5.3, True), (1, 1.1, 4.1, 6.3, 5.2, False), (1, 1.1, 4.1, 6.3, 5.2, False)]
    rays = spark.createDataFrame([(k, *r) for k, r in enumerate(rays)], "beam_idx int, scan_idx int, x0 double, y0 double, x1 double, y1 double, is_hit boolean")
    alike = traverse.alike(rays, ["scan_idx"])
    assert alike.count() == 3 and alike.select(F.sum("n")).first()[0] == 9
    apart, together = (evidence.touches(traverse.walk(r, GRID, ["scan_idx", *more]), ["scan_idx"]) for r, more in ((rays, ["is_hit"]), (alike, ["is_hit", "n"])))
    columns = ("scan_idx", "row", "col", "is_occ", "visits")
    assert sorted(map(tuple, apart.select(*columns).collect())) == sorted(map(tuple, together.select(*columns).collect()))


def test_few_tiles_and_poses_are_broadcast(spark):
    """Cells come out of a walk whose size the optimizer doesn't know: it planned to shuffle every point beside every candidate."""
    cells = spark.range(900).select((F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.lit(1.0).alias("v"))
    for _ in range(4):
        cells = cells.join(cells.select("row", "col", F.lit(1.0).alias("w")), ["row", "col"]).drop("w")
    points = spark.range(50).select(F.lit(0).alias("scan_idx"), (F.col("id") / 9).alias("px"), (F.col("id") / 7).alias("py"))
    poses = spark.createDataFrame([(0, 0, 1.0, 3.0, 0.0), (0, 1, 1.5, 3.5, 0.1)], "scan_idx int, idx int, x double, y double, theta double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = match.scores(points, poses, match.tiled(cells), GRID, ("scan_idx",))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("strategy=broadcast") == 2
