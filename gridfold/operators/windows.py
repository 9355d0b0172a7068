"""Windows that blend cells as they move, folded over tiles.

Each sweep moves the whole window by a part of a cell and blends four cells into one, so that the fold can't be kept apart by
cell. But on a lattice that moves by whole cells only, a cell of a sweep comes from that cell and its next neighbours in the sweep
before. So a tile with so many further rows and columns as a block has sweeps goes through the whole block by itself: a
block is one join of tiles with their neighbours and one grouped map. A task holds one tile, whatever the
window's size, the number of sweeps and the number of runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.operators.evidence import is_whole_cell_shift, shift
from gridfold.params import EvidenceModel, Grid
from gridfold.session import checkpoint

#: Rows and columns of a tile, and sweeps of a block, at most as many: the cells around a tile that are folded twice are BLOCK wide.
TILE, BLOCK = 64, 16
KEYS = ["run_id", "tile_row", "tile_col"]
STATE = "run_id string, tile_row int, tile_col int, log_odds binary, observed binary, returns binary, counts array<struct<scan_idx:int,free:long,occupied:long>>"


@dataclass(frozen=True)
class Step:
    """How a sweep's window came from the one before: its first cell on the lattice, the parts of a cell, the nearest cell's offset, the first and last row and column that are kept."""

    row: int
    col: int
    part: tuple[float, float]
    nearest: tuple[int, int]
    kept: tuple[int, int, int, int]
    moved: bool


@dataclass(frozen=True)
class Path:
    """A run's windows in the order of their sweeps."""

    model: EvidenceModel
    rows: int
    cols: int
    steps: tuple[Step, ...]


def first_step(grid: Grid) -> Step:
    return Step(0, 0, (0.0, 0.0), (0, 0), (0, grid.rows - 1, 0, grid.cols - 1), False)


def next_step(last: Step, before: Grid, after: Grid) -> Step:
    """The step from one window to the next, of the same size and resolution; `last` is the one that led to the first."""
    d = shift(before, after)
    if is_whole_cell_shift(*d):
        d = (float(round(d[0])), float(round(d[1])))
    whole = [math.floor(v) for v in d]
    part = tuple(v - w for v, w in zip(d, whole, strict=True))
    nearest = tuple(math.floor(v + 0.5) - w for v, w in zip(d, whole, strict=True))
    # A cell comes from its place plus d, which must lie within the outermost centres of the window before.
    kept = [b for v, n in zip(d, (after.rows, after.cols), strict=True) for b in (max(0, math.ceil(-v)), min(n - 1, math.floor(n - 1 - v)))]
    return Step(last.row + whole[0], last.col + whole[1], part, nearest, tuple(kept), after != before)


def path(grids: list[Grid], model: EvidenceModel) -> Path:
    """The steps between windows of one size and resolution."""
    steps = [first_step(grids[0])]
    for before, after in zip(grids, grids[1:], strict=False):
        steps.append(next_step(steps[-1], before, after))
    return Path(model, grids[0].rows, grids[0].cols, tuple(steps))


class _Tile:
    """A tile's cells and those after it that a block needs, at rows top.. and columns left.. of the lattice."""

    def __init__(self, run: Path, row: int, col: int, tile: int, halo: int):
        self.run, self.top, self.left, self.tile, self.size = run, row * tile, col * tile, tile, tile + halo
        shape = (self.size, self.size)
        self.log_odds, self.observed, self.returns = np.full(shape, run.model.l_prior), np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def place(self, row: int, col: int, parts: tuple[np.ndarray, ...]) -> None:
        """Puts the cells of a tile in."""
        to = tuple(slice(a, min(a + self.tile, self.size)) for a in (row * self.tile - self.top, col * self.tile - self.left))
        for own, part in zip((self.log_odds, self.observed, self.returns), parts, strict=True):
            own[to] = part[: to[0].stop - to[0].start, : to[1].stop - to[1].start]

    def _inside(self, step: Step, low_row: int, high_row: int, low_col: int, high_col: int) -> tuple[slice, slice]:
        rows, cols = (low_row + step.row - self.top, high_row + step.row - self.top + 1), (low_col + step.col - self.left, high_col + step.col - self.left + 1)
        return tuple(slice(min(max(a, 0), self.size), max(min(b, self.size), 0)) for a, b in (rows, cols))

    def move(self, step: Step) -> None:
        """Blends each cell with its next ones; what isn't kept gets the prior. The far edge, which lacks next cells, is given up by a cell."""
        model, inside = self.run.model, self._inside(step, *step.kept)
        above = np.pad(self.log_odds - model.l_prior, ((0, 1), (0, 1)))
        made, n = np.zeros_like(self.log_odds), self.size
        for i in (0, 1):
            for j in (0, 1):
                weight = (step.part[0] if i else 1 - step.part[0]) * (step.part[1] if j else 1 - step.part[1])
                if weight:
                    made += weight * above[i : n + i, j : n + j]
        if step.part == (0.0, 0.0):
            blended = self.log_odds  # whole cells keep every bit
        else:
            blended = np.minimum(np.maximum(made + model.l_prior, model.l_min), model.l_max)
        i, j = step.nearest
        counts = [np.pad(a, ((0, 1), (0, 1)))[i : n + i, j : n + j] for a in (self.observed, self.returns)]
        for name, values, blank in zip(("log_odds", "observed", "returns"), (blended, *counts), (model.l_prior, 0, 0), strict=True):
            moved = np.full_like(getattr(self, name), blank)
            moved[inside] = values[inside]
            setattr(self, name, moved)

    def add(self, rows: np.ndarray, cols: np.ndarray, is_occ: np.ndarray) -> None:
        """One sweep's cells, each once."""
        model, at = self.run.model, (rows - self.top, cols - self.left)
        added = self.log_odds[at] + np.where(is_occ, model.l_occupied, model.l_free)
        self.log_odds[at] = np.minimum(np.maximum(added, model.l_min), model.l_max)
        self.observed[at] += 1
        self.returns[at] += is_occ

    def states(self, step: Step) -> tuple[int, int]:
        """Free and occupied cells of the tile itself that lie in the window."""
        rows, cols = self._inside(step, 0, self.run.rows - 1, 0, self.run.cols - 1)
        own, model = self.log_odds[: self.tile, : self.tile][rows, cols], self.run.model
        return int((own <= model.l_prior - model.l_decision).sum()), int((own >= model.l_prior + model.l_decision).sum())

    def held(self) -> tuple[np.ndarray, ...]:
        return tuple(np.ascontiguousarray(a[: self.tile, : self.tile]) for a in (self.log_odds, self.observed, self.returns))


def arrays(tile: int, log_odds: bytes, observed: bytes, returns: bytes) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(raw, kind).reshape(tile, tile) for raw, kind in zip((log_odds, observed, returns), (np.float64, np.int64, np.int64), strict=True))


def _owners(row: Column, col: Column, tile: int, halo: int) -> Column:
    """The tiles that need a lattice cell: its own, and those before it that it is within the halo of."""
    at = lambda c: F.floor(c / tile).cast("int")
    reach = lambda c: F.when(F.pmod(c, F.lit(tile)) < halo, F.array(at(c), at(c) - 1)).otherwise(F.array(at(c)))
    return F.flatten(F.transform(reach(row), lambda r: F.transform(reach(col), lambda c: F.struct(r.alias("tile_row"), c.alias("tile_col")))))


def folded(state: DataFrame, touch: DataFrame, paths: dict[str, Path], first: int, size: int, block: int, halo: int) -> DataFrame:
    """`state` after a block of sweeps from the first on, with the states after each of them. The halo is as wide as windows blend in the block; with 0 none may move.

    `touch` has the block's sweeps, in lattice rows and columns. `paths` has the runs' steps, at least up to the block's end or the run's.
    """
    ahead = F.array(F.lit(0), F.lit(1)) if halo else F.array(F.lit(0))
    spread = F.explode(F.flatten(F.transform(ahead, lambda i: F.transform(ahead, lambda j: F.struct((F.col("tile_row") - i).alias("r"), (F.col("tile_col") - j).alias("c"))))))
    tiles = state.withColumn("to", spread).select("run_id", F.col("to.r").alias("tile_row"), F.col("to.c").alias("tile_col"), F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), "log_odds", "observed", "returns")
    own = touch.withColumn("to", F.explode(_owners(F.col("row"), F.col("col"), size, halo)))
    cells = own.select("run_id", "to.tile_row", "to.tile_col", "scan_idx", "row", "col", "is_occ")

    def run(key: tuple[pa.Scalar, ...], parts: pa.Table, touched: pa.Table) -> pa.Table:
        run_id, tile_row, tile_col = (k.as_py() for k in key)
        own = paths[run_id]
        tile = _Tile(own, tile_row, tile_col, size, halo)
        for r, c, *raw in zip(*(parts[name].to_pylist() for name in ("row", "col", "log_odds", "observed", "returns")), strict=True):
            tile.place(r, c, arrays(size, *raw))
        scan, rows, cols, is_occ = (touched[name].to_numpy() for name in ("scan_idx", "row", "col", "is_occ"))
        by = np.argsort(scan, kind="stable")
        edges = np.searchsorted(scan[by], np.arange(first, first + block + 1))
        counts = []
        for k in range(first, min(first + block, len(own.steps))):
            if own.steps[k].moved and halo:
                tile.move(own.steps[k])
            at = by[edges[k - first] : edges[k - first + 1]]
            tile.add(rows[at], cols[at], is_occ[at].astype(bool))
            free, occupied = tile.states(own.steps[k])
            counts.append({"scan_idx": k, "free": free, "occupied": occupied})
        log_odds, observed, returns = tile.held()
        return pa.table({"run_id": [run_id], "tile_row": pa.array([tile_row], pa.int32()), "tile_col": pa.array([tile_col], pa.int32()), "log_odds": [log_odds.tobytes()], "observed": [observed.tobytes()], "returns": [returns.tobytes()], "counts": pa.array([counts], pa.list_(pa.struct([("scan_idx", pa.int32()), ("free", pa.int64()), ("occupied", pa.int64())])))})

    return tiles.groupBy(*KEYS).cogroup(cells.groupBy(*KEYS)).applyInArrow(run, STATE)


def final_cells(state: DataFrame, paths: dict[str, Path], size: int) -> DataFrame:
    """(run_id, row, col, log_odds, observed, occ_obs) of each last window's cells that were observed or hold more than the prior."""

    def run(batches):
        for batch in batches:
            for run_id, tile_row, tile_col, *raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                own, (log_odds, observed, returns) = paths[run_id], arrays(size, *raw)
                row, col = np.nonzero((observed > 0) | (log_odds != own.model.l_prior))
                r, c = row + tile_row * size - own.steps[-1].row, col + tile_col * size - own.steps[-1].col
                inside = (r >= 0) & (r < own.rows) & (c >= 0) & (c < own.cols)
                row, col, r, c = row[inside], col[inside], r[inside], c[inside]
                yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(r), pa.string()), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), *(pa.array(a[row, col]) for a in (log_odds, observed, returns))], names=["run_id", "row", "col", "log_odds", "observed", "occ_obs"])

    return state.select(*KEYS, "log_odds", "observed", "returns").mapInArrow(run, "run_id string, row int, col int, log_odds double, observed long, occ_obs long")


def fold(touch: DataFrame, paths: dict[str, Path], tile: int = TILE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Maps and states of runs whose windows blend cells: (run_id, row, col, log_odds, observed, occ_obs) of the last window, and (run_id, scan_idx, free, occupied) after each sweep.

    `touch` has run_id, scan_idx, row, col, is_occ, in rows and columns of its sweep's window; `paths` has a record for each sweep of each run, as
    the list of windows has. A job for each block of sweeps; its state is checkpointed.
    """
    if not 1 <= block <= tile:
        raise ValueError("a block has at least one sweep, and at most as many as a tile has rows")
    spark = touch.sparkSession
    rows = [(run_id, k, s.row, s.col) for run_id, own in paths.items() for k, s in enumerate(own.steps)]
    places = spark.createDataFrame(rows, "run_id string, scan_idx int, _row int, _col int")
    on_lattice = checkpoint(touch.join(F.broadcast(places), ["run_id", "scan_idx"]).select("run_id", "scan_idx", (F.col("row") + F.col("_row")).alias("row"), (F.col("col") + F.col("_col")).alias("col"), "is_occ"))
    state = spark.createDataFrame([], STATE)
    counts = []
    for first in range(0, max(len(p.steps) for p in paths.values()), block):
        own = on_lattice.filter((F.col("scan_idx") >= first) & (F.col("scan_idx") < first + block))
        state = checkpoint(folded(state, own, paths, first, tile, block, block))
        counts.append(state.select("run_id", F.inline("counts")))
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return final_cells(state, paths, tile), every.groupBy("run_id", "scan_idx").agg(F.sum("free").alias("free"), F.sum("occupied").alias("occupied"))
