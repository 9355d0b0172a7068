"""Whole runs: sweeps are simulated, walked over the grid, and folded into a map.

With exact or dead-reckoned poses a run is one plan, also for windows that move by whole cells: cells
are folded on a lattice that stands still, with a reset wherever a cell was outside the window. Windows
that blend cells are folded over tiles, a block of sweeps at a time, all runs at once. Poses that are matched against the map
so far go sweep by sweep, all runs together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.functions.scalars import heading_error, pose, position_error, state
from gridfold.operators import evidence, lidar, matched, traverse, windows as blending
from gridfold.params import FREE, OCCUPIED, EvidenceModel, Grid, Pose, RunConfig, Scenario, composed, inverted
from gridfold.session import checkpoint
from gridfold.sources import scenarios

KEYS = ["run_id"]
SWEEP = ["run_id", "scan_idx"]


@dataclass(frozen=True)
class Window_:
    """Where an ego window lies at one sweep: its grid, its whole-cell place on the lattice, and what it kept of the window before."""

    grid: Grid
    row: int
    col: int
    #: Lattice rows and columns that kept their evidence in the move to here: least and greatest of each.
    kept: tuple[int, int, int, int]
    moved: bool
    lossless: bool


@dataclass
class Run:
    """A run's tables. `cells` has touched cells only (row, col, log_odds, observed, occ_obs); truth is of the last sweep's time."""

    scenario: Scenario
    config: RunConfig
    grid: Grid
    poses: DataFrame
    beams: DataFrame
    visits: DataFrame
    touch: DataFrame
    cells: DataFrame
    truth: DataFrame
    windows: list[Window_]
    matches: list[dict]
    #: Free, occupied and unknown cells after each sweep, where the map was made sweep by sweep.
    counts: list[tuple[int, int, int]]

    @property
    def sweeps(self) -> int:
        n = self.config.max_steps
        return len(self.scenario.trajectory) if n is None else min(n, len(self.scenario.trajectory))

    @property
    def resamples(self) -> int:
        return sum(w.moved for w in self.windows)

    @property
    def lossless_resamples(self) -> int:
        return sum(w.moved and w.lossless for w in self.windows)

    def scored_cells(self, observed_only: bool = True) -> DataFrame:
        """Every cell with log_odds, observed, occ_obs, occupied (truth) and scored."""
        dense = evidence.dense(self.cells, self.grid, self.scenario.model)
        joined = dense.join(self.truth.select("row", "col", "occupied"), ["row", "col"])
        return joined.withColumn("scored", (F.col("observed") > 0) if observed_only else F.lit(True))

    def totals(self) -> DataFrame:
        """One row: beams, hits, range-limit beams, placed returns and cell visits of the run."""
        counters = evidence.sweep_counters(self.visits, self.beams, SWEEP)
        return counters.agg(F.count("*").alias("sweeps"), *(F.sum(c).alias(c) for c in ("beams", "hits", "max_range_beams", "placed_returns", "cell_visits")))

    def summary(self) -> DataFrame:
        """One row: the run's parameters and counts, ready for JSON."""
        s, c = self.scenario, self.config
        fixed = {
            "scenario": s.name, "frame": c.frame, "shift_policy": c.shift_policy, "seed": s.seed, "resolution": self.grid.resolution, "rows": self.grid.rows, "cols": self.grid.cols,
            "max_range": s.lidar.max_range, "angular_resolution_deg": s.lidar.angular_resolution_deg, "range_noise_std": s.lidar.range_noise_std, "dropout_prob": s.lidar.dropout_prob,
            "p_free": s.model.p_free, "p_occupied": s.model.p_occupied, "clamp_free_prob": s.model.clamp_free_prob, "clamp_occupied_prob": s.model.clamp_occupied_prob, "decision_prob": s.model.decision_prob,
            "pose_correction": c.pose_correction, "resamples": self.resamples, "lossless_resamples": self.lossless_resamples, "grid_cells": self.grid.size,
        }
        counts = self.cells.agg(F.count_if(F.col("observed") > 0).alias("observed_cells"), F.count_if(state("log_odds", s.model) == OCCUPIED).alias("occupied_cells"), F.count_if(state("log_odds", s.model) == FREE).alias("free_cells"))
        return self.totals().crossJoin(counts).select(*(F.lit(v).alias(k) for k, v in fixed.items()), "*", (F.lit(self.grid.size) - F.col("occupied_cells") - F.col("free_cells")).alias("unknown_cells"))


def sweeps(spark: SparkSession, scenario: Scenario, config: RunConfig, run_id: str, poses: DataFrame, n: int) -> DataFrame:
    """All simulated beams of the run, dropped ones included."""
    return lidar.simulate(poses, scenarios.scene(spark, scenario, run_id), scenarios.variates(spark, scenario, n, run_id), scenario.lidar)


#: Kept of a window that didn't move: everything.
EVERYTHING = (-(10**9), 10**9, -(10**9), 10**9)


def first_window(scenario: Scenario, config: RunConfig, at: Pose) -> Window_:
    if config.frame == "world":
        return Window_(scenario.grid, 0, 0, EVERYTHING, False, True)
    return Window_(Grid(scenario.grid.resolution, config.ego_rows, config.ego_cols).recentered(at.x, at.y), 0, 0, EVERYTHING, False, True)


def next_window(before: Window_, config: RunConfig, at: Pose) -> Window_:
    """The window centred on a pose; `snap` moves it by whole cells, halves to even. In the world frame it stands still."""
    grid = before.grid
    if config.frame == "world":
        return before
    target = grid.recentered(at.x, at.y)
    d_row, d_col = evidence.shift(grid, target)
    if config.shift_policy == "snap":
        d_row, d_col = round(d_row), round(d_col)
        target = replace(grid, origin_x=grid.origin_x + d_col * grid.resolution, origin_y=grid.origin_y + d_row * grid.resolution)
    if target == grid:
        return replace(before, kept=EVERYTHING, moved=False, lossless=True)
    lossless = evidence.is_whole_cell_shift(d_row, d_col)
    if lossless:
        d_row, d_col = round(d_row), round(d_col)
    # The target's cell i comes from the source's i + d, which must lie in 0 to n - 1.
    kept = []
    for d, n, lattice in ((d_row, grid.rows, before.row), (d_col, grid.cols, before.col)):
        moved = lattice + math.floor(d + 0.5)
        kept += [math.ceil(max(0.0, -d)) + moved, math.floor(min(n - 1.0, n - 1.0 - d)) + moved]
    return Window_(target, before.row + math.floor(d_row + 0.5), before.col + math.floor(d_col + 0.5), tuple(kept), True, lossless)


def ego_windows(scenario: Scenario, config: RunConfig, path: list[Pose]) -> list[Window_]:
    """The window of each sweep."""
    found = [next_window(first_window(scenario, config, path[0]), config, path[0])]
    for p in path[1:]:
        found.append(next_window(found[-1], config, p))
    return found


def window_rays(rays: DataFrame, windows: list[Window_]) -> DataFrame:
    """Rays in the coordinates of their sweep's window, with its place on the lattice as _row and _col."""
    spark = rays.sparkSession
    rows = [(i, w.grid.origin_x, w.grid.origin_y, w.row, w.col) for i, w in enumerate(windows)]
    places = spark.createDataFrame(rows, "scan_idx int, _ox double, _oy double, _row int, _col int")  # one row for a sweep
    moved = rays.join(F.broadcast(places), "scan_idx")
    return moved.withColumns({c: F.col(c) - F.col("_ox" if c[0] == "x" else "_oy") for c in ("x0", "y0", "x1", "y1")})


def with_resets(touch: DataFrame, windows: list[Window_]) -> DataFrame:
    """(run_id, row, col, events): each lattice cell's sorted (scan_idx, kind): 1 occupied, 0 free, -1 lost in the move to that sweep."""
    boxes = [F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(n) for n, v in zip(("r0", "r1", "c0", "c1"), w.kept, strict=True))) for i, w in enumerate(windows) if w.moved]
    lost = lambda m: (F.col("row") < m["r0"]) | (F.col("row") > m["r1"]) | (F.col("col") < m["c0"]) | (F.col("col") > m["c1"])
    none = F.array().cast("array<struct<scan_idx:int,kind:int>>")
    resets = F.transform(F.filter(F.array(*boxes), lost), lambda m: F.struct(m["i"].alias("scan_idx"), F.lit(-1).alias("kind"))) if boxes else none
    seen = touch.groupBy("run_id", "row", "col").agg(F.collect_list(F.struct("scan_idx", F.when(F.col("is_occ"), 1).otherwise(0).alias("kind"))).alias("seen"))
    return seen.select("run_id", "row", "col", F.sort_array(F.concat("seen", resets)).alias("events"))


def stepped(log_odds: Column, kind: Column, model: EvidenceModel) -> Column:
    """The clamped sum after one event; a reset gives the prior."""
    added = F.least(F.greatest(log_odds + F.when(kind == 1, model.l_occupied).otherwise(model.l_free), F.lit(model.l_min)), F.lit(model.l_max))
    return F.when(kind < 0, F.lit(model.l_prior)).otherwise(added)


def fold_moving(touch: DataFrame, windows: list[Window_], model: EvidenceModel) -> DataFrame:
    """Fold on the lattice, with the prior and no counts again after each move that a cell didn't survive.

    `touch` has lattice row and col; the result has rows and columns of the last window.
    """
    blank = F.struct(F.lit(model.l_prior).alias("l"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("o"))
    step = lambda acc, s: F.when(s["kind"] < 0, blank).otherwise(F.struct(stepped(acc["l"], s["kind"], model).alias("l"), (acc["n"] + 1).alias("n"), (acc["o"] + s["kind"]).alias("o")))
    folded = with_resets(touch, windows).select("run_id", "row", "col", F.aggregate("events", blank, step).alias("s"))
    last = windows[-1]
    placed = folded.select("run_id", (F.col("row") - last.row).alias("row"), (F.col("col") - last.col).alias("col"), F.col("s.l").alias("log_odds"), F.col("s.n").alias("observed"), F.col("s.o").alias("occ_obs"))
    inside = (F.col("row") >= 0) & (F.col("row") < last.grid.rows) & (F.col("col") >= 0) & (F.col("col") < last.grid.cols)
    return placed.filter(inside & (F.col("observed") > 0))


KEEP = ["run_id", "scan_idx", "beam_idx", "is_hit"]


def run(spark: SparkSession, scenario: Scenario, config: RunConfig | None = None, run_id: str = "run") -> Run:
    """A run's tables, lazily, but for poses that are matched and windows that blend."""
    return run_many(spark, {run_id: (scenario, config or RunConfig())})[run_id]


def run_many(spark: SparkSession, wanted: dict[str, tuple[Scenario, RunConfig]]) -> dict[str, Run]:
    """Runs by run_id. Those whose poses are matched are made together, sweep by sweep, and those whose windows blend cells together by blocks of sweeps; the others are plans of their own."""
    made, stepped_, beams_of, plans, blended = {}, {}, [], {}, {}
    for run_id, (scenario, config) in wanted.items():
        path = scenario.trajectory if config.max_steps is None else scenario.trajectory.subsample(config.max_steps)
        poses = scenarios.poses(spark, scenario, config, run_id)
        beams = traverse.dealt(sweeps(spark, scenario, config, run_id, poses, len(path)).filter("kept"), "scan_idx", "beam_idx")
        if config.frame == "ego" and config.shift_policy == "bilinear" and not config.pose_correction:
            blended[run_id] = (scenario, config, path, poses, beams)
        elif config.pose_correction:
            moves = [composed(inverted(p), q) for p, q in zip(path.poses, path.poses[1:], strict=False)] if config.odometry is None else scenarios.increments(scenario, path, config.odometry)
            plans[run_id] = matched.Plan(scenario, config, path.poses[0], tuple(moves))
            stepped_[run_id] = (scenario, config, path, beams)
            beams_of.append(beams)
        else:
            made[run_id] = _planned(spark, scenario, config, run_id, path, poses, beams)
    if blended:
        made |= _blended(spark, blended)
    if plans:
        every = beams_of[0]
        for other in beams_of[1:]:
            every = every.unionByName(other)
        steps, cells = matched.fold(every, plans)
        cells = checkpoint(cells)
        for run_id, parts in stepped_.items():
            made[run_id] = _stepped(spark, run_id, *parts, cells.filter(F.col("run_id") == run_id).drop("run_id"), steps[run_id])
    return {run_id: made[run_id] for run_id in wanted}


def _truth(spark: SparkSession, scenario: Scenario, run_id: str, grid: Grid, path) -> DataFrame:
    return lidar.truth(scenarios.scene(spark, scenario, run_id), grid, path.times[-1])


def _planned(spark: SparkSession, scenario: Scenario, config: RunConfig, run_id: str, path, poses: DataFrame, beams: DataFrame) -> Run:
    """A run as one plan: the world's grid, or windows that move by whole cells."""
    if config.frame == "world":
        grid, windows = scenario.grid, []
        visits = traverse.walk(lidar.endpoints(beams), grid, KEEP)
        touch = evidence.touches(visits, SWEEP)
        cells = (evidence.fold if len(path) <= evidence.RANGE else evidence.fold_in_ranges)(touch, KEYS, scenario.model).drop("run_id")
    else:
        windows = ego_windows(scenario, config, _believed(poses))
        grid = windows[-1].grid
        visits = _in_windows(beams, windows)
        on_lattice = visits.withColumns({"row": F.col("row") + F.col("_row"), "col": F.col("col") + F.col("_col")})
        touch = evidence.touches(on_lattice, SWEEP)
        cells = fold_moving(touch, windows, scenario.model).drop("run_id")
    return Run(scenario, config, grid, poses, beams, visits, touch, cells, _truth(spark, scenario, run_id, grid, path), windows, [], [])


def _believed(poses: DataFrame) -> list[Pose]:
    return [Pose(r.est_x, r.est_y, r.est_theta) for r in poses.orderBy("scan_idx").select("est_x", "est_y", "est_theta").collect()]  # a pose for a sweep


def _blended(spark: SparkSession, wanted: dict[str, tuple]) -> dict[str, Run]:
    """Runs whose windows blend cells, folded together over tiles."""
    parts, paths = {}, {}
    for run_id, (scenario, config, _, poses, beams) in wanted.items():
        windows = ego_windows(scenario, config, _believed(poses))
        visits = _in_windows(beams, windows).drop("_row", "_col")
        parts[run_id] = (windows, visits, evidence.touches(visits, SWEEP))
        paths[run_id] = blending.path([w.grid for w in windows], scenario.model)
    touched = [touch.select(*SWEEP, "row", "col", "is_occ") for *_, touch in parts.values()]
    every = touched[0]
    for other in touched[1:]:
        every = every.unionByName(other)
    cells, states = blending.fold(every, paths)
    cells, counts = checkpoint(cells), {(r["run_id"], r["scan_idx"]): (r["free"], r["occupied"]) for r in states.collect()}  # a row for each sweep of a run
    made = {}
    for run_id, (scenario, config, path, poses, beams) in wanted.items():
        windows, visits, touch = parts[run_id]
        grid = windows[-1].grid
        own = [counts.get((run_id, k), (0, 0)) for k in range(len(windows))]
        own = [(free, occupied, grid.size - free - occupied) for free, occupied in own]
        made[run_id] = Run(scenario, config, grid, poses, beams, visits, touch, cells.filter(F.col("run_id") == run_id).drop("run_id"), _truth(spark, scenario, run_id, grid, path), windows, [], own)
    return made


def _in_windows(beams: DataFrame, windows: list[Window_]) -> DataFrame:
    """Visits in rows and columns of each sweep's window."""
    local = replace(windows[-1].grid, origin_x=0.0, origin_y=0.0)
    return traverse.walk(window_rays(lidar.endpoints(beams), windows), local, [*KEEP, "_row", "_col"])


def _stepped(spark: SparkSession, run_id: str, scenario: Scenario, config: RunConfig, path, beams: DataFrame, cells: DataFrame, steps: list[dict]) -> Run:
    """A run that was folded sweep by sweep; its visits are those of its estimated poses in its windows."""
    rows = [(run_id, i, t, q.x, q.y, q.theta, s["x"], s["y"], s["theta"]) for i, (t, q, s) in enumerate(zip(path.times, path.poses, steps, strict=True))]
    poses = spark.createDataFrame(rows, "run_id string, scan_idx int, time double, x double, y double, theta double, est_x double, est_y double, est_theta double")
    shape = scenario.grid if config.frame == "world" else Grid(scenario.grid.resolution, config.ego_rows, config.ego_cols)
    windows = [Window_(replace(shape, origin_x=s["origin_x"], origin_y=s["origin_y"]), 0, 0, EVERYTHING, s["moved"], s["lossless"]) for s in steps]
    placed = beams.drop("est_x", "est_y", "est_theta").join(F.broadcast(poses.select("scan_idx", "est_x", "est_y", "est_theta")), "scan_idx")  # a row for a sweep
    visits = _in_windows(placed, windows).drop("_row", "_col")
    matches = steps[1:] if config.pose_correction else []
    counts = [(s["free_cells"], s["occupied_cells"], s["unknown_cells"]) for s in steps]
    grid = windows[-1].grid
    return Run(scenario, config, grid, poses, placed, visits, evidence.touches(visits, SWEEP), cells, _truth(spark, scenario, run_id, grid, path), windows, matches, counts)


def state_counts(touch: DataFrame, keys: list[str], model: EvidenceModel, size: int, sweeps_per_range: int | None = None) -> DataFrame:
    """(keys, scan_idx, free_cells, occupied_cells, unknown_cells) after each sweep, for a grid that stands still; by ranges of sweeps if so many are given."""
    kind = lambda s: F.struct(s["scan_idx"].alias("scan_idx"), F.when(s["is_occ"], 1).otherwise(0).alias("kind"))
    events = F.transform("sweeps", kind).alias("events")
    if sweeps_per_range is None:
        gathered = evidence.gather(touch, keys).select(*keys, events, F.lit(model.l_prior).alias("start"))
    else:
        gathered = evidence.ranged(touch, keys, model, sweeps_per_range).select(*keys, events, "start")
    return counted_changes(gathered, touch.select(*keys, "scan_idx").distinct(), keys, model, size)


def counted_changes(cells: DataFrame, every: DataFrame, keys: list[str], model: EvidenceModel, size: int) -> DataFrame:
    """State counts after each of `every` (keys, scan_idx), from cells with sorted events and the log odds before them (`start`).

    Each cell's sum is kept after every event; only changes of state are summed, and running sums give the counts: within ranges of sweeps, and over
    the ranges before. A cell that a window has lost is reset, and so isn't counted any more.
    """
    start = F.struct(F.col("start").alias("l"), state(F.col("start"), model).alias("state"), F.array().cast("array<struct<scan_idx:int,old:int,new:int>>").alias("changes"))

    def step(acc: Column, s: Column) -> Column:
        value = stepped(acc["l"], s["kind"], model)
        now = state(value, model)
        change = F.when(now != acc["state"], F.array_append(acc["changes"], F.struct(s["scan_idx"].alias("scan_idx"), acc["state"].alias("old"), now.alias("new")))).otherwise(acc["changes"])
        return F.struct(value.alias("l"), now.alias("state"), change.alias("changes"))

    changes = cells.select(*keys, F.explode(F.aggregate("events", start, step)["changes"]).alias("c"))
    gain = lambda s: F.sum(F.when(F.col("c.new") == s, 1).otherwise(0) - F.when(F.col("c.old") == s, 1).otherwise(0))
    per_sweep = changes.groupBy(*keys, F.col("c.scan_idx").alias("scan_idx")).agg(gain(FREE).alias("f"), gain(OCCUPIED).alias("o"))
    joined = every.join(per_sweep, [*keys, "scan_idx"], "left").select(*keys, "scan_idx", F.floor(F.col("scan_idx") / evidence.RANGE).alias("_part"), *(F.coalesce(c, F.lit(0)).alias(c) for c in "fo"))
    within = Window.partitionBy(*keys, "_part").orderBy("scan_idx").rowsBetween(Window.unboundedPreceding, 0)
    # A row for each range of sweeps.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = joined.groupBy(*keys, "_part").agg(F.sum("f").alias("_f"), F.sum("o").alias("_o"))
    parts = parts.select(*keys, "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_f", "_o")))
    summed = joined.withColumns({c: F.sum(c).over(within) for c in "fo"}).join(parts, [*keys, "_part"])
    counted = summed.select(*keys, "scan_idx", (F.col("f") + F.col("_f")).alias("free_cells"), (F.col("o") + F.col("_o")).alias("occupied_cells"))
    return counted.withColumn("unknown_cells", F.lit(size) - F.col("free_cells") - F.col("occupied_cells"))


def run_state_counts(made: Run) -> DataFrame:
    """(run_id, scan_idx, free_cells, occupied_cells, unknown_cells) after each sweep of a run, in its window of that sweep."""
    model, size, spark = made.scenario.model, made.grid.size, made.poses.sparkSession
    if made.counts:
        rows = [(i, *c) for i, c in enumerate(made.counts)]
        counted = spark.createDataFrame(rows, "scan_idx int, free_cells long, occupied_cells long, unknown_cells long")  # one row for a sweep
        return made.poses.select(*SWEEP).join(F.broadcast(counted), "scan_idx").select(*SWEEP, "free_cells", "occupied_cells", "unknown_cells")
    if made.windows:
        return counted_changes(with_resets(made.touch, made.windows).withColumn("start", F.lit(model.l_prior)), made.poses.select(*SWEEP), KEYS, model, size)
    return state_counts(made.touch, KEYS, model, size, evidence.RANGE if made.sweeps > evidence.RANGE else None)


#: Columns of a sweep's record.
STEP_COLUMNS = (
    "scan_idx", "time", "x", "y", "theta", "beams", "hits", "max_range_beams", "dropped", "placed_returns", "cell_visits", "touched_cells", "free_cells", "occupied_cells", "unknown_cells",
    "est_x", "est_y", "est_theta", "position_error", "heading_error", "match_evaluations", "translation_correction",
)


def step_records(made: Run) -> DataFrame:
    """One row for each sweep of a run: pose, counters, states after it, and pose errors."""
    estimate, truth = pose(F.col("est_x"), F.col("est_y"), F.col("est_theta")), pose(F.col("x"), F.col("y"), F.col("theta"))
    with_errors = made.poses.withColumns({"position_error": position_error(estimate, truth), "heading_error": heading_error(estimate, truth)})
    counters = evidence.sweep_counters(made.visits, made.beams, SWEEP)
    dropped = F.lit(made.scenario.lidar.beams) - F.col("beams")
    records = with_errors.join(counters, SWEEP).join(run_state_counts(made), SWEEP)
    matched = made.poses.sparkSession.createDataFrame([(i + 1, m["evaluations"], m["translation_correction"]) for i, m in enumerate(made.matches)], "scan_idx int, match_evaluations int, translation_correction double")
    zero = {"match_evaluations": F.coalesce("match_evaluations", F.lit(0)), "translation_correction": F.coalesce("translation_correction", F.lit(0.0))}
    return records.withColumn("dropped", dropped).join(F.broadcast(matched), "scan_idx", "left").withColumns(zero)


#: Configuration in a run's trace; the rest of its summary stays beside it.
TRACED = ("frame", "shift_policy", "resolution", "rows", "cols", "seed", "max_range", "angular_resolution_deg", "range_noise_std", "dropout_prob", "p_free", "p_occupied", "clamp_free_prob", "clamp_occupied_prob", "decision_prob", "pose_correction")


def trace(made: Run) -> DataFrame:
    """One row: scenario, config, totals, counts, and steps, an array with the record of each sweep in order; ready for JSON."""
    totals = ("sweeps", "beams", "hits", "max_range_beams", "placed_returns", "cell_visits")
    steps = step_records(made).drop("run_id").agg(F.sort_array(F.collect_list(F.struct("scan_idx", *(c for c in STEP_COLUMNS if c != "scan_idx")))).alias("steps"))  # a record for each sweep of one run
    crossed = made.summary().crossJoin(steps)
    return crossed.select("scenario", F.struct(*TRACED).alias("config"), F.struct(*totals).alias("totals"), "resamples", "lossless_resamples", "observed_cells", "grid_cells", "steps")


def pose_errors(records: DataFrame) -> DataFrame:
    """Final and peak position error, and final heading error, of each run."""
    return records.groupBy("run_id").agg(
        F.max_by("position_error", "scan_idx").alias("final_position_error"), F.max("position_error").alias("peak_position_error"), F.max_by("heading_error", "scan_idx").alias("final_heading_error")
    )
