"""Blending windows over tiles against dense maps that are moved sweep by sweep."""

import math
import random

import numpy as np
import pytest

from gridfold.operators import windows
from gridfold.operators.evidence import is_whole_cell_shift, shift
from gridfold.params import EvidenceModel, Grid

M = EvidenceModel()


def dense(grids, touched):
    """(log odds, observed, returns) of the last window and (free, occupied) after each sweep; each target cell looks its sources up."""
    rows, cols = grids[0].rows, grids[0].cols
    maps = [np.full((rows, cols), M.l_prior), np.zeros((rows, cols), int), np.zeros((rows, cols), int)]
    states = []
    for k, grid in enumerate(grids):
        if k and grid != grids[k - 1]:
            d = shift(grids[k - 1], grid)
            whole = is_whole_cell_shift(*d)
            d = tuple(map(round, d)) if whole else d
            moved = [np.full((rows, cols), M.l_prior), np.zeros((rows, cols), int), np.zeros((rows, cols), int)]
            for i in range(rows):
                for j in range(cols):
                    r, c = i + d[0], j + d[1]
                    if not (0 <= r <= rows - 1 and 0 <= c <= cols - 1):
                        continue
                    r0, c0 = math.floor(r), math.floor(c)
                    fr, fc = d[0] - math.floor(d[0]), d[1] - math.floor(d[1])
                    near = math.floor(d[0] + 0.5) + i, math.floor(d[1] + 0.5) + j
                    moved[1][i, j], moved[2][i, j] = maps[1][near], maps[2][near]
                    value = 0.0
                    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
                        weight = (fr if a else 1 - fr) * (fc if b else 1 - fc)
                        if weight:
                            value += weight * (maps[0][r0 + a, c0 + b] - M.l_prior)
                    moved[0][i, j] = maps[0][r0, c0] if whole else min(max(value + M.l_prior, M.l_min), M.l_max)
            maps = moved
        for r, c, is_occ in touched.get(k, []):
            maps[0][r, c] = min(max(maps[0][r, c] + (M.l_occupied if is_occ else M.l_free), M.l_min), M.l_max)
            maps[1][r, c] += 1
            maps[2][r, c] += is_occ
        states.append((int((maps[0] <= M.l_prior - M.l_decision).sum()), int((maps[0] >= M.l_prior + M.l_decision).sum())))
    return maps, states


def moves(rng, kind, sweeps):
    grid = Grid(0.5, 21, 26, 3.0, -2.0)
    found = [grid]
    for k in range(sweeps - 1):
        step = {"small": (rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)), "large": (rng.uniform(-3, 3), rng.uniform(-3, 3)), "mixed": (0.5 * rng.randint(-2, 2), rng.choice([0.0, 0.25, -1.0, 0.1]))}[kind]
        last = found[-1]
        found.append(last if k % 5 == 4 else Grid(0.5, 21, 26, last.origin_x + step[0], last.origin_y + step[1]))
    return found


@pytest.mark.parametrize("tile, block", [(8, 3), (5, 5), (64, 16)])
def test_tiles_equal_dense_maps(spark, tile, block):
    """Several runs of different lengths at once; every cell and every state, to the last bit."""
    rng = random.Random(tile)
    grids, touched, rows = {}, {}, []
    for kind, sweeps in (("small", 11), ("large", 7), ("mixed", 12), ("empty", 4)):
        grids[kind] = moves(rng, kind if kind != "empty" else "small", sweeps)
        cells = {} if kind == "empty" else {k: [(r, c, rng.random() < 0.3) for r, c in {(rng.randrange(21), rng.randrange(26)) for _ in range(150)}] for k in range(sweeps) if k != 2}
        touched[kind] = cells
        rows += [(kind, k, r, c, o) for k, own in cells.items() for r, c, o in own]
    touch = spark.createDataFrame(rows, "run_id string, scan_idx int, row int, col int, is_occ boolean").repartition(3)
    found, counted = windows.fold(touch, {k: windows.path(g, M) for k, g in grids.items()}, tile, block)
    cells = {(r.run_id, r.row, r.col): (r.log_odds, r.observed, r.occ_obs) for r in found.collect()}
    counts = {(r.run_id, r.scan_idx): (r.free, r.occupied) for r in counted.collect()}
    for kind in grids:
        maps, states = dense(grids[kind], touched[kind])
        want = {(kind, r, c): tuple(m[r, c] for m in maps) for r, c in zip(*np.nonzero((maps[1] > 0) | (maps[0] != M.l_prior)), strict=True)}
        assert {k: v for k, v in cells.items() if k[0] == kind} == want
        assert all(counts.get((kind, k), (0, 0)) == s for k, s in enumerate(states))
