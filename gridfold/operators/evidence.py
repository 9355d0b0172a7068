"""Evidence of sweeps on cells, its ordered clamped sum, and maps that move."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.scalars import in_bounds
from gridfold.params import EvidenceModel, Grid
from gridfold.session import checkpoint

CELL = ["row", "col"]


def touches(visits: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each sweep and cell: is_occ where a return ends in it, which wins over passing through.

    `visits` has `keys`, row, col, is_terminal and is_hit, and n where equal rays were walked as one; the aggregate is distinct, union and difference in one.
    """
    number = F.sum("n") if "n" in visits.columns else F.count("*")
    return visits.groupBy(*keys, *CELL).agg(F.bool_or(F.col("is_terminal") & F.col("is_hit")).alias("is_occ"), number.alias("visits"))


def sweep_counters(visits: DataFrame, beams: DataFrame, keys: list[str]) -> DataFrame:
    """Beams, hits, range-limit beams, placed returns, cell visits and touched cells of each sweep."""
    per_beam = beams.groupBy(*keys).agg(
        F.count("*").alias("beams"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("max_range_beams")
    )
    per_cell = visits.groupBy(*keys, *CELL).agg(F.count("*").alias("n"), F.count_if(F.col("is_terminal") & F.col("is_hit")).alias("placed"))
    per_sweep = per_cell.groupBy(*keys).agg(F.sum("placed").alias("placed_returns"), F.sum("n").alias("cell_visits"), F.count("*").alias("touched_cells"))
    zero = ["placed_returns", "cell_visits", "touched_cells"]
    return per_beam.join(per_sweep, keys, "left").select(*keys, "beams", "hits", "max_range_beams", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero))


def folded(sweeps: Column, start: Column, free: Column, occupied: Column, low: Column, high: Column) -> Column:
    """Clamped sum of sorted (scan_idx, is_occ): clamped after each, so that the order counts."""
    step = lambda acc, s: F.least(F.greatest(acc + F.when(s["is_occ"], occupied).otherwise(free), low), high)
    return F.aggregate(sweeps, start, step)


def fold(touch: DataFrame, keys: list[str], model: EvidenceModel) -> DataFrame:
    """(keys, row, col, log_odds, observed, occ_obs) of every touched cell; others hold the prior."""
    gathered = gather(touch, keys)
    values = [F.lit(v) for v in (model.l_prior, model.l_free, model.l_occupied, model.l_min, model.l_max)]
    return gathered.select(*keys, *CELL, folded(F.col("sweeps"), *values).alias("log_odds"), "observed", "occ_obs")


def gather(touch: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell's sweeps in order, as sorted (scan_idx, is_occ): as many as a run has sweeps, a byte or two each."""
    return touch.groupBy(*keys, *CELL).agg(
        F.sort_array(F.collect_list(F.struct("scan_idx", "is_occ"))).alias("sweeps"), F.count("*").alias("observed"), F.count_if("is_occ").alias("occ_obs")
    )


def fold_by_models(touch: DataFrame, keys: list[str], models: DataFrame) -> DataFrame:
    """As `fold`, once for each row of `models` (model_id, l_prior, l_free, l_occupied, l_min, l_max), over one gathering."""
    values = [F.col(c) for c in ("l_prior", "l_free", "l_occupied", "l_min", "l_max")]
    crossed = gather(touch, keys).crossJoin(F.broadcast(models))  # a few parameter rows
    return crossed.select("model_id", *keys, *CELL, folded(F.col("sweeps"), *values).alias("log_odds"), "observed", "occ_obs")


#: Sweeps whose touches of a cell are held in one array; runs with more are folded by ranges of so many.
RANGE = 1000


def monoid(first: Column, second: Column) -> Column:
    """Two clamped sums (a, lo, hi) of x -> min(hi, max(lo, x + a)) in sequence, as one.

    Associative, so that sums over contiguous ranges of sweeps can be made apart and put together; equal
    to the fold up to rounding.
    """
    a, lo, hi = second["a"], second["lo"], second["hi"]
    clip = lambda v: F.least(F.greatest(v, lo), hi)
    return F.struct((first["a"] + a).alias("a"), clip(first["lo"] + a).alias("lo"), clip(first["hi"] + a).alias("hi"))


def ranged(touch: DataFrame, keys: list[str], model: EvidenceModel, sweeps_per_range: int = RANGE) -> DataFrame:
    """(keys, row, col, part, sweeps, start): each cell's sweeps in order, range by range, with the log odds before the range.

    A range is one clamped sum (see `monoid`); a cell's are gone through in order to give the starts, so that arrays hold a range's sweeps or a cell's
    ranges. The first range starts from the prior to the last bit, later ones up to rounding.
    """
    part = F.floor(F.col("scan_idx") / sweeps_per_range).alias("part")
    own = checkpoint(touch.groupBy(*keys, *CELL, part).agg(F.sort_array(F.collect_list(F.struct("scan_idx", "is_occ"))).alias("sweeps")))
    unit = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    one = lambda s: F.struct(F.when(s["is_occ"], model.l_occupied).otherwise(model.l_free).alias("a"), F.lit(model.l_min).alias("lo"), F.lit(model.l_max).alias("hi"))
    sums = own.select(*keys, *CELL, "part", F.aggregate("sweeps", unit, lambda acc, s: monoid(acc, one(s))).alias("f"))
    before = F.struct(F.lit(model.l_prior).alias("l"), F.array().cast("array<struct<part:bigint,start:double>>").alias("starts"))

    def step(acc: Column, r: Column) -> Column:
        after = F.least(F.greatest(acc["l"] + r["f"]["a"], r["f"]["lo"]), r["f"]["hi"])
        return F.struct(after.alias("l"), F.array_append(acc["starts"], F.struct(r["part"].alias("part"), acc["l"].alias("start"))).alias("starts"))

    parts = sums.groupBy(*keys, *CELL).agg(F.sort_array(F.collect_list(F.struct("part", "f"))).alias("parts"))
    starts = parts.select(*keys, *CELL, F.inline(F.aggregate("parts", before, step)["starts"]))
    return own.join(starts, [*keys, *CELL, "part"])


def fold_in_ranges(touch: DataFrame, keys: list[str], model: EvidenceModel, sweeps_per_range: int = RANGE) -> DataFrame:
    """As `fold`, for runs of any length: the last range of each cell is folded from its start."""
    values = [F.lit(v) for v in (model.l_free, model.l_occupied, model.l_min, model.l_max)]
    last = ranged(touch, keys, model, sweeps_per_range).select(*keys, *CELL, "part", folded(F.col("sweeps"), F.col("start"), *values).alias("l"), F.size("sweeps").alias("n"), F.size(F.filter("sweeps", lambda s: s["is_occ"])).alias("o"))
    return last.groupBy(*keys, *CELL).agg(F.max_by("l", "part").alias("log_odds"), F.sum("n").alias("observed"), F.sum("o").alias("occ_obs"))


def dense(cells: DataFrame, grid: Grid, model: EvidenceModel) -> DataFrame:
    """Every cell of the grid for one run; cells that `cells` lacks hold the prior and no observation."""
    spark = cells.sparkSession
    every = spark.range(grid.size).select(F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))
    filled = every.join(cells, CELL, "left")
    zero = [c for c in ("observed", "occ_obs") if c in cells.columns]
    return filled.select(*CELL, F.coalesce("log_odds", F.lit(model.l_prior)).alias("log_odds"), *(F.coalesce(c, F.lit(0)).alias(c) for c in zero))


def is_whole_cell_shift(d_row: float, d_col: float, tolerance: float = 1e-9) -> bool:
    return abs(d_row - round(d_row)) <= tolerance and abs(d_col - round(d_col)) <= tolerance


def shift(source: Grid, target: Grid) -> tuple[float, float]:
    """Rows and columns by which `target` starts after `source`."""
    if abs(source.resolution - target.resolution) > 1e-9:
        raise ValueError("maps of unequal resolution can't be shifted onto each other")
    return (target.origin_y - source.origin_y) / source.resolution, (target.origin_x - source.origin_x) / source.resolution


def translate(cells: DataFrame, d_row: int, d_col: int, target: Grid) -> DataFrame:
    """Whole-cell move; values stay as they are, and cells that leave the target are lost."""
    moved = cells.withColumns({"row": (F.col("row") - d_row).cast("int"), "col": (F.col("col") - d_col).cast("int")})
    return moved.filter(in_bounds("row", "col", target))


def resample(cells: DataFrame, source: Grid, target: Grid, model: EvidenceModel, policy: str) -> DataFrame:
    """Cells (row, col, log_odds) moved from one grid onto another of the same resolution; absent cells hold the prior.

    A whole-cell shift is a translation under every policy. `nearest` and `snap` take the cell that half a cell
    further lies over, `bilinear` blends four cells; a coordinate outside the source's outermost
    centres gives the prior, without blending. Results are clamped.
    """
    d_row, d_col = shift(source, target)
    if is_whole_cell_shift(d_row, d_col):
        return translate(cells.select(*CELL, "log_odds"), round(d_row), round(d_col), target)
    whole = [math.floor(d) for d in (d_row, d_col)]
    part = [d - w for d, w in zip((d_row, d_col), whole, strict=True)]
    covered = _covered(target, source, d_row, d_col)
    if policy in ("nearest", "snap"):
        return translate(cells.select(*CELL, "log_odds"), whole[0] + (part[0] >= 0.5), whole[1] + (part[1] >= 0.5), target).filter(covered)
    above = F.col("log_odds") - model.l_prior
    weights = [(i, j, (part[0] if i else 1 - part[0]) * (part[1] if j else 1 - part[1])) for i in (0, 1) for j in (0, 1)]
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in weights if w > 0)))
    spread = cells.select(*CELL, above.alias("v"), corners.alias("k")).select(
        (F.col("row") - whole[0] - F.col("k.i")).cast("int").alias("row"), (F.col("col") - whole[1] - F.col("k.j")).cast("int").alias("col"), (F.col("v") * F.col("k.w")).alias("v")
    )
    blended = spread.filter(in_bounds("row", "col", target) & covered).groupBy(*CELL).agg(F.sum("v").alias("v"))
    return blended.select(*CELL, F.least(F.greatest(F.col("v") + model.l_prior, F.lit(model.l_min)), F.lit(model.l_max)).alias("log_odds"))


def _covered(target: Grid, source: Grid, d_row: float, d_col: float) -> Column:
    """Whether a target cell's centre lies within the outermost centres of the source."""
    r, c = F.col("row") + d_row, F.col("col") + d_col
    return (r >= 0) & (r <= source.rows - 1) & (c >= 0) & (c <= source.cols - 1)


def resample_counts(cells: DataFrame, source: Grid, target: Grid, column: str) -> DataFrame:
    """Counts moved to the nearest cell; what comes from outside is 0 and left out."""
    d_row, d_col = shift(source, target)
    moved = translate(cells.select(*CELL, column), math.floor(d_row + 0.5), math.floor(d_col + 0.5), target)
    return moved.filter(_covered(target, source, d_row, d_col))
