"""Scores of maps against ground truth: agreement, sharpness, and the smear of moving obstacles."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions.scalars import at_clamp, ratio, state, state_by, x_of, y_of
from gridfold.params import FREE, OCCUPIED, EvidenceModel, Grid

CELL = ["row", "col"]
COUNTS = ("scored_cells", "decided_cells", "free_truth", "free_correct", "occupied_truth", "occupied_correct", "free_called_occupied", "occupied_called_free")


def _agreement(state_: Column, matched: Column) -> list[Column]:
    """Counts over cells with `occupied` (truth) and `scored`; matched: called occupied, within the tolerance."""
    scored, truth = F.col("scored"), F.col("occupied")
    free, occ = state_ == FREE, state_ == OCCUPIED
    decided = free | occ
    conditions = (
        scored,
        scored & decided,
        scored & ~truth & decided,
        scored & ~truth & free,
        scored & truth & decided,
        scored & truth & decided & matched,
        scored & ~truth & occ,
        scored & truth & free,
    )
    return [F.count_if(c).alias(name) for name, c in zip(COUNTS, conditions, strict=True)]


def with_fractions(agreement: DataFrame) -> DataFrame:
    """decided_fraction, free_agreement, occupied_agreement, and balanced_agreement, their plain mean; 0 over nothing."""
    free, occ = ratio(F.col("free_correct"), F.col("free_truth")), ratio(F.col("occupied_correct"), F.col("occupied_truth"))
    return agreement.withColumns(
        {"decided_fraction": ratio(F.col("decided_cells"), F.col("scored_cells")), "free_agreement": free, "occupied_agreement": occ, "balanced_agreement": 0.5 * (free + occ)}
    )


def threshold_sweep(cells: DataFrame, model: EvidenceModel, decision_probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """Agreement at each decision threshold in one pass. `cells` has log_odds, occupied and scored.

    Each threshold must leave a valid model.
    """

    bands = [(p, replace(model, decision_prob=p).l_decision) for p in decision_probs]
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("decision_prob"), F.lit(d).alias("d")) for p, d in bands)))
    swept = cells.withColumn("_band", rows)
    called = state_by("log_odds", F.lit(model.l_prior), F.col("_band.d"))
    counted = swept.groupBy(*(keys or []), F.col("_band.decision_prob").alias("decision_prob")).agg(*_agreement(called, called == OCCUPIED))
    return with_fractions(counted.withColumn("spatial_tolerance", F.lit(0)))


def _runs(cells: DataFrame, keys: list[str], axis: str, gap: Column) -> DataFrame:
    """(keys, the other axis, low, high): stretches of cells along an axis with steps of at most `gap` between them."""
    across = "col" if axis == "row" else "row"
    line = Window.partitionBy(*keys, across).orderBy(axis)
    begins = F.when(F.col(axis) - F.lag(axis).over(line) <= gap, 0).otherwise(1)
    numbered = cells.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, across, "_run").agg(F.min(axis).alias("low"), F.max(axis).alias("high"))


def _along(cells: DataFrame, keys: list[str], radius: Column, by: int, sizes: tuple[int, int] | None) -> DataFrame:
    """Stretches along columns, then along rows, moved out (by 1) or in (by -1) at both ends: a square of any radius in two passes, each cell made once a pass."""
    cells = cells.select(*keys, *CELL)
    for axis, across, k in (("col", "row", 1), ("row", "col", 0)):
        runs = _runs(cells, keys, axis, 2 * radius + 1 if by > 0 else F.lit(1))
        low, high = F.col("low") - by * radius, F.col("high") + by * radius
        if sizes:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(sizes[k] - 1))
        ends = runs.select(*keys, across, low.cast("int").alias("low"), high.cast("int").alias("high")).filter("low <= high")
        cells = ends.select(*keys, across, F.explode(F.sequence("low", "high")).alias(axis)).select(*keys, *CELL)
    return cells


def thickened(cells: DataFrame, radius: int | Column, grid: Grid | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, row, col) within Chebyshev distance `radius` of one of `cells`, inside the grid if one is given. The radius may be one of the keys."""
    return _along(cells, keys or [], F.lit(radius) if isinstance(radius, int) else radius, 1, (grid.rows, grid.cols) if grid else None)


def thinned(cells: DataFrame, radius: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, row, col) of `cells` that have all cells within Chebyshev distance `radius` among them; each of `cells` must be there once."""
    return _along(cells, keys or [], F.lit(radius), -1, None)


def occupied_distance(cells: DataFrame, occupied: Column, reaches: list[int], keys: list[str]) -> DataFrame:
    """(keys, row, col, distance): the smallest of `reaches` within which of a cell, by Chebyshev distance, there is one that `occupied` marks."""
    marked = cells.filter(occupied).select(*keys, *CELL, F.explode(F.array(*(F.lit(r) for r in reaches))).alias("_reach"))
    near = thickened(marked, F.col("_reach"), keys=[*keys, "_reach"])
    return near.groupBy(*keys, *CELL).agg(F.min("_reach").alias("distance"))


def tolerance_sweep(cells: DataFrame, model: EvidenceModel, tolerances: list[int], keys: list[str] | None = None) -> DataFrame:
    """Agreement at each spatial tolerance: an occupied cell counts as found with one called occupied that near, scored or not."""
    if min(tolerances) < 0:
        raise ValueError("a tolerance must not be negative")
    keys = keys or []
    called = state("log_odds", model)
    near = occupied_distance(cells, called == OCCUPIED, tolerances, keys)
    joined = cells.join(near, [*keys, *CELL], "left").withColumn("spatial_tolerance", F.explode(F.array(*(F.lit(t) for t in tolerances))))
    matched = F.coalesce(F.col("distance") <= F.col("spatial_tolerance"), F.lit(False))
    return with_fractions(joined.groupBy(*keys, "spatial_tolerance").agg(*_agreement(called, matched)).withColumn("decision_prob", F.lit(model.decision_prob)))


def score(cells: DataFrame, model: EvidenceModel, decision_prob: float | None = None, spatial_tolerance: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Agreement of one map (or one for each of `keys`) with the truth."""
    if spatial_tolerance < 0:
        raise ValueError("a tolerance must not be negative")
    if spatial_tolerance:

        used = model if decision_prob is None else replace(model, decision_prob=decision_prob)
        return tolerance_sweep(cells, used, [spatial_tolerance], keys)
    return threshold_sweep(cells, model, [model.decision_prob if decision_prob is None else decision_prob], keys)


def dilated(cells: DataFrame, mask: str, radius: int, grid: Grid) -> DataFrame:
    """(row, col) within Chebyshev distance `radius` of a marked cell, inside the grid."""
    return thickened(cells.filter(F.col(mask)), radius, grid)


def boundary_band(truth: DataFrame, grid: Grid, width: int = 2) -> DataFrame:
    """(row, col) within `width` of the edge of an occupied area: dilation without erosion. Outside counts as not occupied."""
    if width < 1:
        raise ValueError("width must be at least one")
    occupied = truth.filter("occupied")
    return thickened(occupied, width, grid).join(thinned(occupied, width), CELL, "left_anti")


def gradient(cells: DataFrame) -> DataFrame:
    """`cells` (every cell, log_odds) with the gradient's magnitude: central differences, one-sided at the edges."""
    slopes = {}
    for axis, across in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(across).orderBy(axis)
        before, after = F.lag("log_odds").over(w), F.lead("log_odds").over(w)
        apart = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        slopes[f"_{axis}"] = (F.coalesce(after, F.col("log_odds")) - F.coalesce(before, F.col("log_odds"))) / apart
    return cells.withColumns(slopes).withColumn("magnitude", F.hypot("_row", "_col")).drop("_row", "_col")


def sharpness(cells: DataFrame, band: DataFrame, model: EvidenceModel) -> DataFrame:
    """One row: observed, clamped and band cells, edge_contrast, mean_abs_evidence, clamped_fraction. `cells`: every cell, with scored."""
    marked = gradient(cells).join(band.withColumn("_band", F.lit(True)), CELL, "left").withColumn("_band", F.coalesce("_band", F.lit(False)) & F.col("scored"))
    made = marked.agg(
        F.count_if("scored").alias("observed_cells"),
        F.count_if(F.col("scored") & at_clamp("log_odds", model)).alias("clamped_cells"),
        F.count_if("_band").alias("band_cells"),
        F.coalesce(F.avg(F.when(F.col("_band"), F.col("magnitude"))), F.lit(0.0)).alias("edge_contrast"),
        F.coalesce(F.avg(F.when(F.col("scored"), F.abs(F.col("log_odds") - model.l_prior))), F.lit(0.0)).alias("mean_abs_evidence"),
    )
    return made.withColumn("clamped_fraction", ratio(F.col("clamped_cells"), F.col("observed_cells")))


def in_path(grid: Grid, start: tuple[float, float], end: tuple[float, float], radius: float) -> Column:
    """Whether a cell's centre is within `radius` of a segment, ends and rim included."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    x, y = x_of("col", grid), y_of("row", grid)
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = dx * dx + dy * dy
    t = F.lit(0.0) if length == 0 else F.least(F.greatest(((x - start[0]) * dx + (y - start[1]) * dy) / length, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (start[0] + t * dx), y - (start[1] + t * dy)
    return ex * ex + ey * ey <= radius * radius


def smear(cells: DataFrame, model: EvidenceModel, grid: Grid, direction: tuple[float, float], keys: list[str]) -> DataFrame:
    """Occupied evidence in a region, for each of `keys`. `cells`: every cell, with log_odds, occ_obs, occupied (truth) and region.

    Extents are along and across the direction of motion, from the outer edges of the cells, to a nanometre, so that equal ones don't differ by what turning them has rounded; areas in square metres.
    """
    norm = math.hypot(*direction)
    if norm == 0:
        raise ValueError("direction must not be zero")
    # An axis of a rotated frame; the angle as atan2 gives it.
    heading = math.atan2(direction[1], direction[0])
    c, s = math.cos(heading), math.sin(heading)
    x, y, region, truth = x_of("col", grid), y_of("row", grid), F.col("region"), F.col("occupied")
    called = state("log_odds", model)
    occ, free = region & (called == OCCUPIED), region & (called == FREE)
    along, across = F.when(occ, c * x + s * y), F.when(occ, -s * x + c * y)
    extent = lambda v: F.coalesce(F.round(F.max(v) - F.min(v) + grid.resolution, 9), F.lit(0.0))
    made = cells.groupBy(*keys).agg(
        F.count_if(region).alias("roi_cells"),
        F.count_if(occ).alias("occupied_cells"),
        extent(along).alias("extent_along"),
        extent(across).alias("extent_across"),
        F.count_if(region & truth).alias("truth_cells"),
        F.count_if(occ & ~truth).alias("stale_cells"),
        F.count_if(truth & free).alias("false_free_cells"),
        F.count_if(truth & occ).alias("detected_cells"),
        F.coalesce(F.max(F.when(region, F.col("occ_obs"))), F.lit(0)).alias("peak_returns_per_cell"),
    )
    areas = {f"{n}_area": F.col(f"{n}_cells") * grid.cell_area for n in ("occupied", "truth", "stale")}
    return made.withColumns(
        areas
        | {"area_ratio": ratio(F.col("occupied_cells"), F.col("truth_cells")), "unknown_footprint_cells": F.col("truth_cells") - F.col("detected_cells") - F.col("false_free_cells")}
    )


def compare_smear(moving: DataFrame, parked: DataFrame, on: str = "case") -> DataFrame:
    """Moving runs beside their parked controls. Both are results of `smear` with `on`; `moving` also has swept_distance."""
    m, p = moving.alias("m"), parked.alias("p")
    joined = m.join(p, on)
    return joined.select(
        on,
        "m.swept_distance",
        F.col("p.extent_along").alias("parked_extent_along"),
        F.col("m.extent_along").alias("moving_extent_along"),
        (F.col("m.extent_along") - F.col("p.extent_along")).alias("smear_length"),
        ratio(F.col("m.extent_along") - F.col("p.extent_along"), F.col("m.swept_distance")).alias("smear_fraction_of_sweep"),
        F.col("p.occupied_area").alias("parked_occupied_area"),
        F.col("m.occupied_area").alias("moving_occupied_area"),
        ratio(F.col("m.occupied_area"), F.col("p.occupied_area")).alias("area_inflation"),
        F.col("m.stale_cells").alias("moving_stale_cells"),
        F.col("m.stale_area").alias("moving_stale_area"),
        F.col("p.stale_cells").alias("parked_stale_cells"),
        F.col("m.false_free_cells").alias("moving_false_free_cells"),
        F.col("m.detected_cells").alias("moving_detected_cells"),
        F.col("p.detected_cells").alias("parked_detected_cells"),
        F.col("m.unknown_footprint_cells").alias("moving_unknown_footprint_cells"),
        F.col("m.truth_cells").alias("footprint_cells"),
        ratio(F.col("m.false_free_cells"), F.col("m.truth_cells")).alias("missed_footprint_fraction"),
        F.col("m.peak_returns_per_cell").alias("peak_returns_per_cell"),
    )
