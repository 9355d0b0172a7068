"""Runs whose poses are matched against the map that the sweeps before have made.

Each pose needs the map before it, so that sweeps follow each other; all runs take a sweep together, in one or two jobs. A sweep's number, poses and windows come as rows that are
joined, and not as literals, so that the code which Spark makes is the same for all sweeps, and is compiled once. The maps lie in tiles (see
`windows`). A sweep is matched in a task of its own, against the part of its window that its sensor reaches; what comes to the driver is a pose for each run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.operators import evidence, lidar, traverse, windows
from gridfold.operators.evidence import is_whole_cell_shift, shift
from gridfold.operators.match import gaussian_taps, span
from gridfold.params import EvidenceModel, Grid, Pose, RunConfig, Scenario, SearchWindow, composed, wrap
from gridfold.session import checkpoint

FOUND = "run_id string, x double, y double, theta double, score double, predicted_score double, evaluations int, points int"
NOT_MATCHED = {"score": 0.0, "predicted_score": 0.0, "translation_correction": 0.0, "heading_correction": 0.0, "evaluations": 0, "points": 0}


@dataclass(frozen=True)
class Plan:
    """What a run needs besides its beams: where it starts, and how it believes to have moved since."""

    scenario: Scenario
    config: RunConfig
    start: Pose
    moves: tuple[Pose, ...]

    def first_grid(self) -> Grid:
        if self.config.frame == "world":
            return self.scenario.grid
        return Grid(self.scenario.grid.resolution, self.config.ego_rows, self.config.ego_cols).recentered(self.start.x, self.start.y)

    def search(self) -> SearchWindow:
        return self.config.search or SearchWindow.for_resolution(self.scenario.grid.resolution)


def window_at(grid: Grid, config: RunConfig, at: Pose) -> Grid:
    """The window centred on a pose; `snap` moves it by whole cells, halves to even. In the world frame it stands still."""
    if config.frame == "world":
        return grid
    target = grid.recentered(at.x, at.y)
    if config.shift_policy != "snap":
        return target
    rows, cols = (round(d) for d in shift(grid, target))
    return replace(grid, origin_x=grid.origin_x + cols * grid.resolution, origin_y=grid.origin_y + rows * grid.resolution)


class _Field:
    """The blurred field over a part of a grid, from (row, col) on; 0 elsewhere."""

    def __init__(self, log_odds: np.ndarray, grid: Grid, model: EvidenceModel, row: int, col: int, blur_cells: float = 1.0):
        self.grid, self.row, self.col = grid, row, col
        value = np.clip((log_odds - model.l_prior) / (model.l_max - model.l_prior), 0.0, 1.0)
        taps = gaussian_taps(blur_cells)
        radius = len(taps) // 2
        for axis in (0, 1):
            wide = np.pad(value, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
            n = value.shape[axis]
            value = sum(w * np.take(wide, np.arange(k, k + n), axis=axis) for k, w in enumerate(taps))
        self.value = value

    def at(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        r, c = rows - self.row, cols - self.col
        inside = (r >= 0) & (r < self.value.shape[0]) & (c >= 0) & (c < self.value.shape[1])
        return np.where(inside, self.value[np.where(inside, r, 0), np.where(inside, c, 0)], 0.0)

    def scores(self, px: np.ndarray, py: np.ndarray, poses: np.ndarray) -> np.ndarray:
        """Sum of the field under all points for each pose (x, y, theta): blended, 0 outside the grid's outermost centres."""
        grid, cos, sin = self.grid, np.cos(poses[:, 2:]), np.sin(poses[:, 2:])
        c = (cos * px - sin * py + poses[:, :1] - grid.origin_x) / grid.resolution - 0.5
        r = (sin * px + cos * py + poses[:, 1:2] - grid.origin_y) / grid.resolution - 0.5
        inside = (c >= 0) & (c <= grid.cols - 1) & (r >= 0) & (r <= grid.rows - 1)
        c0 = np.clip(np.floor(c), 0, max(grid.cols - 2, 0)).astype(np.int64)
        r0 = np.clip(np.floor(r), 0, max(grid.rows - 2, 0)).astype(np.int64)
        fc, fr = c - c0, r - r0
        value = (1 - fr) * ((1 - fc) * self.at(r0, c0) + fc * self.at(r0, c0 + 1)) + fr * ((1 - fc) * self.at(r0 + 1, c0) + fc * self.at(r0 + 1, c0 + 1))
        return np.where(inside, value, 0.0).sum(axis=1)


def _matched(field: _Field, px: np.ndarray, py: np.ndarray, at: Pose, search: SearchWindow) -> tuple[Pose, float, float, int]:
    """The best pose, its score, the predicted pose's score, and the candidates; as `match.match_sweeps`, for one sweep."""
    value = first = float(field.scores(px, py, np.array([[at.x, at.y, at.theta]]))[0])
    tried, radii = 0, [search.translation_radius, search.heading_radius, search.translation_step, search.heading_step]
    for _ in range(search.refinements + 1):
        axes = [-radius + np.arange(span(radius, step)) * step for radius, step in ((radii[0], radii[2]), (radii[0], radii[2]), (radii[1], radii[3]))]
        d = np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], axis=1)
        poses = d + np.array([at.x, at.y, at.theta])
        tried += len(poses)
        scores = field.scores(px, py, poses)
        tied = np.flatnonzero(scores >= scores.max() - 1e-12)
        cost = (((poses[tied] - np.array([at.x, at.y, at.theta])) / np.array([radii[2], radii[2], radii[3]])) ** 2).sum(axis=1)
        pick = tied[np.argmin(cost)]
        if scores[pick] > value:
            at, value = Pose(float(poses[pick, 0]), float(poses[pick, 1]), wrap(float(poses[pick, 2]))), float(scores[pick])
        radii = [r / 2 for r in radii]
    return at, value, first, tried


def _part(grid: Grid, at: Pose, reach: float) -> tuple[int, int, int, int]:
    """First and last row and column of the grid within `reach` of a pose; none may be left."""
    found = []
    for v, origin, n in ((at.y, grid.origin_y, grid.rows), (at.x, grid.origin_x, grid.cols)):
        found += [max(math.floor((v - reach - origin) / grid.resolution), 0), min(math.floor((v + reach - origin) / grid.resolution), n - 1)]
    return tuple(found)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row or a few for each run, as a local relation: no job makes them."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], arrow[kind]) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))}))


def _match(state: DataFrame, beams: DataFrame, plans: dict[str, Plan], grids: dict[str, Grid], steps: dict[str, windows.Step], predicted: dict[str, Pose], k: int, tile: int) -> dict[str, dict]:
    """The matched pose of each run in `predicted`, from its map's tiles that sweep k can reach and the sweep's beams."""
    spark, parts = state.sparkSession, {}
    for run_id, at in predicted.items():
        search, taps = plans[run_id].search(), len(gaussian_taps(1.0)) // 2
        # Passes halve the radius, so that a point stays within twice the first; the field there is blurred from cells a little further off.
        parts[run_id] = _part(grids[run_id], at, plans[run_id].scenario.lidar.max_range + 2 * search.translation_radius + (taps + 2) * grids[run_id].resolution)
    ranges = [(run_id, k, *((p + o) // tile for p, o in zip(part, (steps[run_id].row,) * 2 + (steps[run_id].col,) * 2, strict=True))) for run_id, part in parts.items()]
    near = _rows(spark, ranges, "run_id string, scan_idx int, _r0 int, _r1 int, _c0 int, _c1 int")  # a row for a run
    reached = state.select(*windows.KEYS, "log_odds").join(F.broadcast(near), "run_id").filter("tile_row between _r0 and _r1 and tile_col between _c0 and _c1").select(*windows.KEYS, "log_odds")
    hits = beams.filter("is_hit").join(F.broadcast(near.select("run_id", "scan_idx")), ["run_id", "scan_idx"]).select("run_id", "beam_idx", "angle", "range")

    def run(key: tuple[pa.Scalar, ...], tiles: pa.Table, own: pa.Table) -> pa.Table:
        run_id = key[0].as_py()
        plan, grid, step, (r0, r1, c0, c1) = plans[run_id], grids[run_id], steps[run_id], parts[run_id]
        log_odds = np.full((max(r1 - r0 + 1, 1), max(c1 - c0 + 1, 1)), plan.scenario.model.l_prior)
        for row, col, raw in zip(*(tiles[c].to_pylist() for c in ("tile_row", "tile_col", "log_odds")), strict=True):
            top, left = row * tile - step.row - r0, col * tile - step.col - c0
            held = np.frombuffer(raw, np.float64).reshape(tile, tile)
            a, b = max(top, 0), max(left, 0)
            place = log_odds[a : max(top + tile, 0), b : max(left + tile, 0)]
            place[:] = held[a - top : a - top + place.shape[0], b - left : b - left + place.shape[1]]
        order = np.argsort(own["beam_idx"].to_numpy(), kind="stable")[:: plan.config.match_stride]
        angle, distance = own["angle"].to_numpy()[order], own["range"].to_numpy()[order]
        field = _Field(log_odds, grid, plan.scenario.model, r0, c0)
        at, value, first, tried = _matched(field, distance * np.cos(angle), distance * np.sin(angle), predicted[run_id], plan.search())
        return pa.table({"run_id": [run_id], "x": [at.x], "y": [at.y], "theta": [at.theta], "score": [value], "predicted_score": [first], "evaluations": pa.array([tried], pa.int32()), "points": pa.array([len(order)], pa.int32())})

    found = reached.groupBy("run_id").cogroup(hits.groupBy("run_id")).applyInArrow(run, FOUND)
    return {r["run_id"]: r.asDict() for r in found.collect()}


def _touched(beams: DataFrame, poses: dict[str, Pose], grids: dict[str, Grid], steps: dict[str, windows.Step], k: int) -> DataFrame:
    """(run_id, scan_idx, row, col, is_occ) of sweep k's beams from the runs' poses, in rows and columns of the lattice."""
    spark, found = beams.sparkSession, None
    for shape in sorted({(g.resolution, g.rows, g.cols) for g in grids.values()}):
        own = [(run_id, k, p.x, p.y, p.theta, grids[run_id].origin_x, grids[run_id].origin_y, steps[run_id].row, steps[run_id].col) for run_id, p in poses.items() if (grids[run_id].resolution, grids[run_id].rows, grids[run_id].cols) == shape]
        if not own:
            continue
        placed = _rows(spark, own, "run_id string, scan_idx int, est_x double, est_y double, est_theta double, _ox double, _oy double, _row int, _col int")  # a row for a run
        rays = lidar.endpoints(beams.join(F.broadcast(placed), ["run_id", "scan_idx"]))
        rays = rays.withColumns({c: F.col(c) - F.col("_ox" if c[0] == "x" else "_oy") for c in ("x0", "y0", "x1", "y1")})
        visits = traverse.walk(rays, Grid(*shape), ["run_id", "scan_idx", "is_hit", "_row", "_col"])
        on_lattice = visits.withColumns({"row": F.col("row") + F.col("_row"), "col": F.col("col") + F.col("_col")})
        touch = evidence.touches(on_lattice, ["run_id", "scan_idx"]).select("run_id", "scan_idx", "row", "col", "is_occ")
        found = touch if found is None else found.unionByName(touch)
    return found


def fold(beams: DataFrame, plans: dict[str, Plan], tile: int = windows.TILE) -> tuple[dict[str, list[dict]], DataFrame]:
    """A record for each sweep of each run, and (run_id, row, col, log_odds, observed, occ_obs) of the last windows' cells.

    `beams` has run_id, scan_idx, beam_idx, angle, range, is_hit, and `plans` its runs. A sweep without beams moves the window and adds nothing.
    """
    spark = beams.sparkSession
    # As many parts as there are cores: each sweep looks for its beams in all of them.
    beams = checkpoint(beams.select("run_id", "scan_idx", "beam_idx", "angle", "range", "is_hit").repartition(spark.sparkContext.defaultParallelism, "run_id", "scan_idx", "beam_idx"))
    state = spark.createDataFrame([], windows.STATE)
    nothing = spark.createDataFrame([], "run_id string, scan_idx int, row int, col int, is_occ boolean")
    grids = {run_id: p.first_grid() for run_id, p in plans.items()}
    steps = {run_id: windows.first_step(g) for run_id, g in grids.items()}
    at = {run_id: p.start for run_id, p in plans.items()}
    records: dict[str, list[dict]] = {run_id: [] for run_id in plans}
    counted = None
    for k in range(max(len(p.moves) for p in plans.values()) + 1):
        active = [run_id for run_id, p in plans.items() if k <= len(p.moves)]
        moved, lossless = {}, {}
        for run_id in active:
            if k:
                at[run_id] = composed(at[run_id], plans[run_id].moves[k - 1])
            before, after = grids[run_id], window_at(grids[run_id], plans[run_id].config, at[run_id])
            moved[run_id] = after != before
            lossless[run_id] = is_whole_cell_shift(*shift(before, after)) if moved[run_id] else True
            steps[run_id] = windows.next_step(steps[run_id], before, after)
            if moved[run_id] and plans[run_id].config.shift_policy != "bilinear" and not lossless[run_id]:
                # The nearest cell is a whole-cell move of its own.
                n = steps[run_id].nearest
                steps[run_id] = replace(steps[run_id], row=steps[run_id].row + n[0], col=steps[run_id].col + n[1], part=(0.0, 0.0), nearest=(0, 0))
            grids[run_id] = after
        paths = {run_id: windows.Path(p.scenario.model, grids[run_id].rows, grids[run_id].cols, (steps[run_id],) * (k + 1)) for run_id, p in plans.items() if run_id in active}
        idle = {run_id: windows.Path(p.scenario.model, grids[run_id].rows, grids[run_id].cols, ()) for run_id, p in plans.items() if run_id not in active}
        if any(moved.values()):
            state = checkpoint(windows.folded(state, nothing, paths | idle, k, tile, 1, 1))
        found = _match(state, beams, plans, grids, steps, {r: at[r] for r in active if plans[r].config.pose_correction}, k, tile) if k else {}
        matched = {run_id: dict(NOT_MATCHED) for run_id in active}
        for run_id, f in found.items():
            predicted, at[run_id] = at[run_id], Pose(f["x"], f["y"], f["theta"])
            corrected = {"translation_correction": math.hypot(f["x"] - predicted.x, f["y"] - predicted.y), "heading_correction": wrap(f["theta"] - predicted.theta)}
            matched[run_id] = {c: f[c] for c in ("score", "predicted_score", "evaluations", "points")} | corrected
        still = {run_id: replace(p, steps=tuple(replace(s, moved=False) for s in p.steps)) for run_id, p in paths.items()}
        touch = _touched(beams, {r: at[r] for r in active}, grids, steps, k)
        state = checkpoint(windows.folded(state, touch, still | idle, k, tile, 1, 0))
        every = state.select("run_id", F.inline("counts"))
        counted = every if counted is None else counted.unionByName(every)
        for run_id in active:
            p, g = at[run_id], grids[run_id]
            places = {"x": p.x, "y": p.y, "theta": p.theta, "origin_x": g.origin_x, "origin_y": g.origin_y, "moved": moved[run_id], "lossless": lossless[run_id]}
            records[run_id].append({"scan_idx": k} | places | matched[run_id])
    counts = {(r["run_id"], r["scan_idx"]): (r["free"], r["occupied"]) for r in counted.groupBy("run_id", "scan_idx").agg(F.sum("free").alias("free"), F.sum("occupied").alias("occupied")).collect()}  # a row for each sweep of a run
    for run_id, own in records.items():
        for record in own:
            free, occupied = counts.get((run_id, record["scan_idx"]), (0, 0))
            record |= {"free_cells": free, "occupied_cells": occupied, "unknown_cells": grids[run_id].size - free - occupied}
    last = {run_id: windows.Path(p.scenario.model, grids[run_id].rows, grids[run_id].cols, (steps[run_id],)) for run_id, p in plans.items()}
    return records, windows.final_cells(state, last, tile)
