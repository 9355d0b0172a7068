"""Small exact cases of traversal, evidence, moves, scenes and scores, in the library's own restatement."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridfold.functions import scalars
from gridfold.operators import evidence, lidar, match, pose, score, shapes, traverse
from gridfold.params import Disc, EvidenceModel, Grid, Lidar, Polygon, Pose, Scenario, SearchWindow, Trajectory
from gridfold.plans import report, run as runs
from gridfold.sources import scenarios

UNIT, M = Grid(1.0, 10, 10), EvidenceModel()
RAY = "ray int, x0 double, y0 double, x1 double, y1 double"


def walked(spark, rays, grid=UNIT):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rays)], RAY)
    found = {i: [] for i in range(len(rays))}
    for r in traverse.walk(df, grid, ["ray"]).orderBy("ray", "step").collect():
        found[r.ray].append((r.row, r.col, r.is_terminal))
    return found


def test_traversal_by_hand(spark):
    nan, inf = float("nan"), float("inf")
    found = walked(spark, [(0.5, 0.5, 3.5, 2.2), (0.5, 0.5, 3.5, 3.5), (4.5, 6.5, 4.5, 6.5), (8.5, 5.5, 20, 5.5), (-3, 5.5, 5, 5.5), (1.5, 1.5, nan, 2), (1.5, 1.5, inf, 2), (3.5, 3.5, 0.5, 0.5)])
    cells = {k: [c[:2] for c in v] for k, v in found.items()}
    assert cells[0] == [(0, 0), (0, 1), (1, 1), (1, 2), (1, 3), (2, 3)]
    assert cells[1] == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    assert cells[2] == [(6, 4)] and found[2][0][2]
    assert cells[3] == [(5, 8), (5, 9)] and not any(c[2] for c in found[3])
    assert cells[4] == cells[5] == cells[6] == []
    assert cells[7] == [(3, 3), (3, 2), (2, 2), (2, 1), (1, 1), (1, 0), (0, 0)]


def test_traversal_against_a_walk_step_by_step(spark):
    grid, rng = Grid(0.37, 30, 40, -2.0, -3.0), random.Random(5)
    point = lambda: (rng.uniform(-3, 14), rng.uniform(-4, 9))
    rays = [(*point(), *point()) for _ in range(300)]
    found = walked(spark, rays, grid)
    for i, (x0, y0, x1, y1) in enumerate(rays):
        c, r = math.floor((x0 + 2) / 0.37), math.floor((y0 + 3) / 0.37)
        want, t = [], 0.0
        if 0 <= c < 40 and 0 <= r < 30:
            want.append((r, c))
            while True:
                line = lambda at, d, o: ((o + (at + (d > 0)) * 0.37)) if d else None
                tx = (line(c, x1 - x0, -2.0) - x0) / (x1 - x0)
                ty = (line(r, y1 - y0, -3.0) - y0) / (y1 - y0)
                t = min(tx, ty)
                if t > 1:
                    break
                c, r = (c + (1 if x1 > x0 else -1), r) if tx <= ty else (c, r + (1 if y1 > y0 else -1))
                if not (0 <= c < 40 and 0 <= r < 30):
                    break
                want.append((r, c))
        assert [v[:2] for v in found[i]] == want


def sweep(spark, rays, grid):
    """rays: (x0, y0, x1, y1, is_hit) of one sweep."""
    df = spark.createDataFrame([(0, i, *map(float, r[:4]), r[4]) for i, r in enumerate(rays)], "scan_idx int, beam_idx int, x0 double, y0 double, x1 double, y1 double, is_hit boolean")
    return traverse.walk(df, grid, ["scan_idx", "beam_idx", "is_hit"]), df


@pytest.mark.parametrize("rays, free, occupied", [([(0, 0, 6.2, 0, True)], 6, 1), ([(0, 0, 6.2, 0, False)], 7, 0), ([(0, 0, 40, 0, True)], 11, 0), ([(0, 0, 3.4, 0, True), (0, 0, 8, 0, False)], 8, 1)])
def test_returns_and_limits(spark, rays, free, occupied):
    visits, _ = sweep(spark, rays, Grid(1.0, 21, 21, -10.5, -10.5))
    got = [r.is_occ for r in evidence.touches(visits, ["scan_idx"]).collect()]
    assert (got.count(False), got.count(True)) == (free, occupied)


def test_fold_clamps_after_every_sweep_and_monoid_agrees(spark):
    rng = random.Random(3)
    rows = [(c, 0, s, rng.random() < 0.4) for c in range(200) for s in rng.sample(range(60), rng.randint(1, 40))]
    touch = spark.createDataFrame(rows, "row int, col int, scan_idx int, is_occ boolean")
    want = {}
    for c, _, _, occ in sorted(rows, key=lambda r: (r[0], r[2])):
        want[c] = min(max(want.get(c, M.l_prior) + (M.l_occupied if occ else M.l_free), M.l_min), M.l_max)
    assert {r.row: r.log_odds for r in evidence.fold(touch, [], M).collect()} == want
    assert {r.row: r.log_odds for r in evidence.fold_in_ranges(touch, [], M, 7).collect()} == pytest.approx(want, abs=1e-12)


def test_empty_inputs_give_empty_maps(spark):
    visits, beams = sweep(spark, [(0, 0, 1, 1, True)], UNIT)
    none = visits.filter("false")
    assert evidence.fold(evidence.touches(none, ["scan_idx"]), [], M).count() == 0
    assert score.score(evidence.dense(evidence.fold(evidence.touches(none, ["scan_idx"]), [], M), UNIT, M).withColumns({"occupied": F.lit(False), "scored": F.lit(False)}), M).first().balanced_agreement == 0.0


def test_band_is_inclusive(spark):
    values = [0.0, M.l_decision, -M.l_decision, M.l_decision - 1e-12, M.l_decision + 1e-12, M.l_min, M.l_max]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "l double").select(scalars.state("l", M).alias("s")).collect()]
    assert got == [0, 2, 1, 0, 2, 1, 2]


def test_bad_probability_raises(spark):
    with pytest.raises(Exception, match="probability"):
        spark.createDataFrame([(1.0,)], "p double").select(scalars.log_odds("p")).collect()


@pytest.mark.parametrize("policy", ["snap", "nearest", "bilinear"])
def test_whole_cell_moves_keep_every_bit(spark, policy):
    source, rng = Grid(0.25, 31, 37), random.Random(1)
    cells = spark.createDataFrame([(r, c, rng.uniform(-2, 3)) for r in range(31) for c in range(37)], "row int, col int, log_odds double")
    before = {(r.row, r.col): r.log_odds for r in cells.collect()}
    moved = evidence.resample(cells, source, Grid(0.25, 31, 37, 1.0, -0.75), M, policy)
    assert {(r.row, r.col): r.log_odds for r in moved.collect()} == {(r + 3, c - 4): v for (r, c), v in before.items() if r + 3 < 31 and c >= 4}


def test_bilinear_move_blends_and_edges_hold_the_prior(spark):
    source = Grid(0.5, 41, 41)
    cells = spark.createDataFrame([(20, 20, M.l_max)], "row int, col int, log_odds double")
    got = evidence.resample(cells, source, Grid(0.5, 41, 41, 0.23, 0.17), M, "bilinear").collect()
    assert sorted((r.row, r.col) for r in got) == [(19, 19), (19, 20), (20, 19), (20, 20)]
    assert sum(r.log_odds for r in got) == pytest.approx(M.l_max)
    edge = spark.createDataFrame([(40, 40, M.l_max)], "row int, col int, log_odds double")
    assert all(r.row < 40 and r.col < 40 for r in evidence.resample(edge, source, Grid(0.5, 41, 41, 0.23, 0.17), M, "bilinear").collect())
    with pytest.raises(ValueError):
        evidence.resample(cells, source, Grid(0.25, 41, 41), M, "snap")


def test_ranges_to_circles_and_polygons(spark):
    room = Scenario("s", UNIT, Lidar(), Trajectory((Pose(0, 0),), (0.0,)), (Polygon.rectangle(2.0, -1.0, 3.0, 1.0),), (Disc(0.0, 5.0, 1.0),))
    scene = scenarios.scene(spark, room, "r")
    rays = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0)], "i int, dx double, dy double").crossJoin(scene)
    got = {r.i: r.t for r in rays.select("i", lidar.nearest_range(F.lit(0.0), F.lit(0.0), F.col("dx"), F.col("dy"), F.col("discs"), F.col("edges")).alias("t")).collect()}
    assert got == {0: 2.0, 1: 4.0, 2: math.inf}
    inside = spark.range(1).select(scalars.circle_range(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(3.0)).alias("t")).first().t
    assert inside == 3.0


def test_truth_of_an_l_shape(spark):
    shape = Polygon(((1, 1), (5, 1), (5, 2), (4, 2), (4, 5), (1, 5), (1, 4), (3, 4), (3, 2), (1, 2)))
    grid = Grid(0.1, 60, 60)
    s = Scenario("l", grid, Lidar(), Trajectory((Pose(0, 0),), (0.0,)), (shape,))
    area = lidar.truth(scenarios.scene(spark, s, "l"), grid, 0.0).filter("occupied").count() * 0.01
    x, y = zip(*shape.vertices, strict=True)
    exact = abs(sum(x[i] * y[(i + 1) % 10] - x[(i + 1) % 10] * y[i] for i in range(10))) / 2
    assert area == pytest.approx(exact, rel=0.02)


def test_band_and_capsule(spark):
    grid = Grid(1.0, 21, 21)
    truth = evidence.dense(spark.createDataFrame([], "row int, col int, log_odds double"), grid, M).withColumn("occupied", F.col("row").between(8, 12) & F.col("col").between(8, 12))
    band = {(r.row, r.col) for r in score.boundary_band(truth, grid, 1).collect()}
    assert (7, 10) in band and (8, 8) in band and (10, 10) not in band
    fine = Grid(0.1, 60, 100, -3.0, -3.0)
    every = evidence.dense(spark.createDataFrame([], "row int, col int, log_odds double"), fine, M)
    area = every.filter(score.in_path(fine, (0.0, 0.0), (4.0, 0.0), 1.0)).count() * 0.01
    assert area == pytest.approx(8 + math.pi, rel=0.02)


def test_smear_of_a_block(spark):
    grid = Grid(0.1, 100, 100)
    cells = evidence.dense(spark.createDataFrame([(r, c, M.l_max) for r in range(55, 65) for c in range(40, 80)], "row int, col int, log_odds double"), grid, M)
    cells = cells.withColumns({"occupied": F.lit(False), "region": F.lit(True), "occ_obs": F.lit(0)})
    got = score.smear(cells, M, grid, (2.0, 0.0), []).first()
    assert (got.occupied_cells, round(got.extent_along, 9), round(got.extent_across, 9)) == (400, 4.0, 1.0)


def test_dead_reckoning_inverts_increments(spark):
    path = scenarios.urban_block().trajectory
    rows = [("r", i, p.x, p.y, p.theta) for i, p in enumerate(path.poses)]
    moves = pose.increments(spark.createDataFrame(rows, "run_id string, scan_idx int, x double, y double, theta double"))
    for r in pose.dead_reckon(moves, *rows[0][2:]).collect():
        assert (r.x, r.y, r.theta) == pytest.approx(rows[r.scan_idx][2:], abs=1e-9)


def test_matching_recovers_a_displaced_pose(spark):
    grid = Grid(0.2, 60, 60)
    wall = [(40, c, M.l_max) for c in range(10, 50)] + [(r, 45, M.l_max) for r in range(10, 41)]
    cells = spark.createDataFrame(wall, "row int, col int, log_odds double")
    true = Pose(6.0, 6.0, 0.1)
    world = [((c + 0.5) * 0.2, (r + 0.5) * 0.2) for r, c, _ in wall[::3]]
    body = [(math.cos(0.1) * (x - 6) + math.sin(0.1) * (y - 6), -math.sin(0.1) * (x - 6) + math.cos(0.1) * (y - 6)) for x, y in world]
    points = spark.createDataFrame(body, "px double, py double")
    found = match.match(cells, points, grid, M, Pose(6.4, 5.8, 0.1 - math.radians(1)), SearchWindow.for_resolution(0.2))
    assert (found["pose"].x, found["pose"].y, found["pose"].theta) == pytest.approx((true.x, true.y, true.theta), abs=0.06)
    assert found["evaluations"] == 2187 and found["score"] > found["predicted_score"]
    blank = match.match(cells.filter("false"), points, grid, M, Pose(6.4, 5.8, 0.0), SearchWindow(0.2, 0.0, 0.2, 0.1, 0))
    assert blank["pose"] == Pose(6.4, 5.8, 0.0) and blank["score"] == 0.0


def test_tied_candidates_go_to_the_nearest_then_the_first(spark):
    rows = [(0, 1.0, 0.0, 0.0, 5.0), (1, 0.5, 0.0, 0.0, 5.0 - 1e-13), (2, -0.5, 0.0, 0.0, 5.0), (3, 0.0, 0.0, 0.0, 4.9)]
    scored = spark.createDataFrame(rows, "idx long, x double, y double, theta double, score double")
    assert match.best(scored, Pose(0.0, 0.0), 0.5, 0.1).first()["idx"] == 1
    assert match.best(scored.filter("idx <> 1"), Pose(0.0, 0.0), 0.5, 0.1).first()["idx"] == 2
    by_sweep = scored.withColumn("scan_idx", F.col("idx") % 2)
    assert {r.scan_idx: r.idx for r in match.best(by_sweep, Pose(0.0, 0.0), 0.5, 0.1, ("scan_idx",)).collect()} == {0: 2, 1: 1}
    assert match.best(scored.filter("false"), Pose(0.0, 0.0), 0.5, 0.1).count() == 0


def test_tables_as_text(spark):
    assert report.render(["a", "bb"], [["ccc", "d"]]) == "a    bb\n---  --\nccc  d "
    with pytest.raises(ValueError):
        report.render(["a"], [["b", "c"]])
    with pytest.raises(ValueError):
        report.agreement_rows(spark.range(1), by="colour")


@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_thick_and_thin_cells_against_squares(spark, radius):
    """Cells may be repeated for the one, and lie at the grid's edge for both."""
    rng = random.Random(radius)
    marked = {(rng.randrange(30), rng.randrange(40)) for _ in range(25)} | {(r, c) for r in range(5, 24) for c in range(0, 21)} | {(29, 39)}
    grid = Grid(1.0, 30, 40)
    square = lambda r, c: [(i, j) for i in range(r - radius, r + radius + 1) for j in range(c - radius, c + radius + 1)]
    df = spark.createDataFrame(sorted(marked), "row int, col int")
    thick = {tuple(r) for r in score.thickened(df.union(df), radius, grid).collect()}
    assert thick == {(i, j) for r, c in marked for i, j in square(r, c) if 0 <= i < 30 and 0 <= j < 40}
    assert {tuple(r) for r in score.thinned(df, radius).collect()} == {(r, c) for r, c in marked if set(square(r, c)) <= marked}
    near = score.occupied_distance(df, F.lit(True), [radius, 2 * radius + 1], []).collect()
    far = {(r.row, r.col): r.distance for r in near}
    assert len(near) == len(far) and all(d == min(k for k in (radius, 2 * radius + 1) if any(max(abs(x - r), abs(y - c)) <= k for r, c in marked)) for (x, y), d in far.items())
    assert score.thickened(df.filter("false"), radius, grid).count() == 0


def test_folds_in_ranges_of_long_runs(spark, monkeypatch):
    """Thousands of sweeps of few cells, with gaps: maps, counts and states after each sweep as by plain sums."""
    monkeypatch.setattr(evidence, "RANGE", 300)
    rng = random.Random(12)
    rows = [(k, 0, c, rng.random() < (0.35 if (k // 700) % 2 else 0.1)) for k in range(2500) for c in range(6) if rng.random() < (0.02 if c == 5 else 0.6) and not 900 < k < 1600]
    touch = spark.createDataFrame(rows, "scan_idx int, row int, col int, is_occ boolean")
    log_odds, counts, states = dict.fromkeys(range(6), M.l_prior), {c: [0, 0] for c in range(6)}, {}
    for k, _, c, occ in sorted(rows):
        log_odds[c] = min(max(log_odds[c] + (M.l_occupied if occ else M.l_free), M.l_min), M.l_max)
        counts[c][0] += 1
        counts[c][1] += occ
        free = sum(v <= M.l_prior - M.l_decision for v in log_odds.values())
        states[k] = (free, sum(v >= M.l_prior + M.l_decision for v in log_odds.values()))
    for size in (100, 5000):
        got = evidence.fold_in_ranges(touch, [], M, size).collect()
        assert {r.col: r.log_odds for r in got} == pytest.approx(log_odds, abs=1e-9)
        assert {r.col: [r.observed, r.occ_obs] for r in got} == counts
        found = {r.scan_idx: (r.free_cells, r.occupied_cells) for r in runs.state_counts(touch, [], M, 6, size).collect()}
        assert found == states
    assert evidence.fold_in_ranges(touch.filter("false"), [], M).count() == 0


def test_report_strings_round_exact_values(spark):
    """From unrounded rates, halves to even, as the value in binary says."""
    rates = {"decided_fraction": 32 / 801, "free_agreement": 0.03125, "occupied_agreement": 1 / 3, "balanced_agreement": 1.0}
    row = report.agreement_rows(spark.range(1).select(F.lit(0.7).alias("decision_prob"), *(F.lit(v).alias(k) for k, v in rates.items()), F.lit(1).alias("free_called_occupied"), F.lit(2).alias("occupied_called_free"))).first()
    assert tuple(row) == ("0.70", *(f"{v:.4f}" for v in rates.values()), "1", "2")
    assert spark.range(1).select(report.fixed(F.lit(1234.5), 0), report.fixed(F.lit(-0.125), 2)).first() == ("1234", "-0.12")


def test_the_walk_is_compiled_whole(spark):
    """No method of the generated code is too large for the just-in-time compiler (8000 bytes), nor for the class file."""
    rows = [(k, 0.3 * k, 0.1 + 0.2 * k, 60.0 - k, 0.7 * k, k % 2 == 0) for k in range(40)]
    beams = spark.createDataFrame(rows, "scan_idx int, x0 double, y0 double, x1 double, y1 double, is_hit boolean")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        touch = evidence.touches(traverse.walk(beams, Grid(0.5, 60, 80), ["scan_idx", "is_hit"]), ["scan_idx"])
        assert touch.count() > 1000
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(touch._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    assert len(sizes) >= 2 and 0 < max(sizes) < 8000


@pytest.mark.parametrize("where", ["row between 3 and 50 and col + 12 between 0 and 70", "row % 2 = 0", "is_terminal"])
def test_filters_after_the_walk_leave_it_compiled(spark, where):
    """A filter on visits or on what is made of them isn't pushed into the walk."""
    rows = [(k, 0.3 * k, 0.1 + 0.2 * k, 60.0 - k, 0.7 * k, k % 2 == 0) for k in range(40)]
    beams = spark.createDataFrame(rows, "scan_idx int, x0 double, y0 double, x1 double, y1 double, is_hit boolean")
    visits = traverse.walk(beams, Grid(0.5, 60, 80), ["scan_idx", "is_hit"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = visits.filter(where) if where == "is_terminal" else evidence.fold(evidence.touches(visits, ["scan_idx"]), [], M).filter(where)
        assert made.count() > 0
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(made._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000


def test_equal_extents_are_equal_after_turning(spark):
    """The same block at several places, along a slanted direction: what turning rounds doesn't make a smear of -0.00."""
    grid = Grid(0.25, 160, 240)
    places = [(k, 3 + 11 * k % 140, 5 + 17 * k % 200) for k in range(40)]
    rows = [(k, r + i, c + j, 3.0, 1, True, True) for k, r, c in places for i in range(7) for j in range(9)]
    cells = spark.createDataFrame(rows, "case int, row int, col int, log_odds double, occ_obs int, occupied boolean, region boolean")
    made = score.smear(cells, M, grid, (12.0, 9.0), ["case"]).withColumn("swept_distance", F.lit(15.0)).cache()
    assert made.select("extent_along", "extent_across").distinct().count() == 1
    parked = made.filter("case = 0").drop("case")
    table = report.smear_rows(score.compare_smear(made, made.select("case").crossJoin(parked)))
    assert {(r.smear_length, r.smear_fraction_of_sweep) for r in table.collect()} == {("0.00", "0.000")}


def test_scan_lines_against_crossing_numbers(spark):
    """Concave, self-crossing and level-sided polygons, corners on centres, shapes over the grid's edge and outside it."""
    rng = random.Random(3)
    grid = Grid(0.5, 24, 30, -2.0, 1.0)
    rings = [[(rng.uniform(-4, 15), rng.uniform(-2, 15)) for _ in range(rng.randint(3, 9))] for _ in range(12)]
    rings += [[(0.25, 3.25), (6.25, 3.25), (6.25, 7.25), (3.25, 7.25), (3.25, 5.25), (0.25, 5.25)], [(100.0, 100.0), (101.0, 100.0), (101.0, 101.0)], [(-2.0, 1.0), (13.0, 1.0), (13.0, 13.0), (-2.0, 13.0)]]

    def inside(ring, x, y):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            n += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return n % 2 == 1

    centres = [(r, c, -2.0 + (c + 0.5) * 0.5, 1.0 + (r + 0.5) * 0.5) for r in range(24) for c in range(30)]
    table = spark.createDataFrame([(k, ring) for k, ring in enumerate(rings)], "shape long, ring array<struct<x:double,y:double>>")
    got = [tuple(r) for r in shapes.polygon_cells(shapes.edges(table, "ring", ["shape"]), grid, ["shape"]).collect()]
    assert sorted(got) == sorted((k, r, c) for k, ring in enumerate(rings) for r, c, x, y in centres if inside(ring, x, y))
    discs = [(k, rng.uniform(-3, 14), rng.uniform(0, 14), rng.uniform(0.01, 4)) for k in range(15)] + [(20, -1.75, 1.25, 0.5), (21, 50.0, 50.0, 1.0)]
    got = [tuple(r) for r in shapes.disc_cells(spark.createDataFrame(discs, "shape long, x double, y double, r double"), grid, ["shape"]).collect()]
    assert sorted(got) == sorted((k, r, c) for k, cx, cy, radius in discs for r, c, x, y in centres if (x - cx) ** 2 + (y - cy) ** 2 <= radius**2)
