"""Maps from a stream of sweeps. The batch library has no stream; this is an addition.

Evidence is clamped after each sweep, so that its order counts. Late sweeps are therefore held until
the watermark has passed them, and are then added in order. State is kept for each tile of the map,
so that it is bounded by the tile's cells, whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridfold.operators import evidence, traverse
from gridfold.params import EvidenceModel, Grid

#: Cells of a tile's side.
TILE = 32
OUTPUT = "run_id string, row int, col int, log_odds double, observed long, occ_obs long, last_scan int"
#: A tile's cells, and the touches that wait for the watermark, as packed records.
STATE = "cells binary, pending binary"
CELL = np.dtype([("l", "f8"), ("n", "i8"), ("o", "i8"), ("s", "i4")])
TOUCH = np.dtype([("t", "i8"), ("scan", "i4"), ("cell", "i4"), ("occ", "?")])


def touches(beams: DataFrame, grid: Grid) -> DataFrame:
    """(run_id, ts, scan_idx, row, col, is_occ) of beams as they come, one row for each cell that a beam enters; stateless."""
    walked = traverse.walk(beams, grid, ["run_id", "ts", "scan_idx", "beam_idx", "is_hit"])
    return walked.select("run_id", "ts", "scan_idx", "row", "col", (F.col("is_terminal") & F.col("is_hit")).alias("is_occ"))


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Touches in order of time, sweep and cell; a cell counts once in a sweep, and a return wins."""
    touched = np.sort(np.concatenate(parts), order=["t", "scan", "cell", "occ"])
    key = touched[["t", "scan", "cell"]]
    return touched[np.append(key[1:] != key[:-1], True)] if len(touched) else touched


def _fold_tile(model: EvidenceModel):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        cells, parts = np.zeros(TILE * TILE, CELL), []
        cells["l"], cells["s"] = model.l_prior, -1
        if state.exists:
            held = state.get
            cells, parts = np.frombuffer(bytes(held[0]), CELL).copy(), [np.frombuffer(bytes(held[1]), TOUCH)]
        for batch in batches:
            part = np.empty(len(batch), TOUCH)
            part["t"], part["scan"], part["occ"] = batch["t"], batch["scan_idx"], batch["is_occ"]
            part["cell"] = batch["row"] % TILE * TILE + batch["col"] % TILE
            parts.append(part)
        pending = _merged(parts) if parts else np.empty(0, TOUCH)
        mark = state.getCurrentWatermarkMs()
        due, pending = pending[pending["t"] < mark], pending[pending["t"] >= mark]
        sweep = due[["t", "scan"]]
        for own in np.split(due, np.flatnonzero(sweep[1:] != sweep[:-1]) + 1) if len(due) else ():
            at = own["cell"]
            cells["l"][at] = np.clip(cells["l"][at] + np.where(own["occ"], model.l_occupied, model.l_free), model.l_min, model.l_max)
            cells["n"][at] += 1
            cells["o"][at] += own["occ"]
            cells["s"][at] = own["scan"]
        state.update((cells.tobytes(), pending.tobytes()))
        if len(pending):
            state.setTimeoutTimestamp(int(max(pending["t"].min(), mark)) + 1)
        changed = np.unique(due["cell"])
        row, col = int(key[1]) * TILE + changed // TILE, int(key[2]) * TILE + changed % TILE
        values = cells[changed]
        yield pd.DataFrame({"run_id": key[0], "row": row, "col": col, "log_odds": values["l"], "observed": values["n"], "occ_obs": values["o"], "last_scan": values["s"]})

    return run


def online_map(beams: DataFrame, grid: Grid, model: EvidenceModel, lateness: str = "10 minutes") -> DataFrame:
    """A stream of changed cells (run_id, row, col, log_odds, observed, occ_obs, last_scan).

    `beams` has run_id, ts (one time for a sweep), scan_idx, beam_idx, x0, y0, x1, y1, is_hit. A sweep is added once the watermark
    has passed its time; beams that come after that are dropped by the watermark.
    """
    touched = touches(beams.withWatermark("ts", lateness), grid)
    tiled = touched.select("run_id", F.floor(F.col("row") / TILE).alias("tile_row"), F.floor(F.col("col") / TILE).alias("tile_col"), "ts", F.unix_millis("ts").alias("t"), "scan_idx", "row", "col", "is_occ")
    return tiled.groupBy("run_id", "tile_row", "tile_col").applyInPandasWithState(_fold_tile(model), OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def batch_map(beams: DataFrame, grid: Grid, model: EvidenceModel) -> DataFrame:
    """What the stream's last rows add up to, from the same beams at rest."""
    walked = traverse.walk(beams, grid, ["run_id", "scan_idx", "beam_idx", "is_hit"])
    return evidence.fold(evidence.touches(walked, ["run_id", "scan_idx"]), ["run_id"], model)
