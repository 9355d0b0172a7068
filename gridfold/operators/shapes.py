"""Cells that shapes in tables cover, by scan lines: each shape is dealt over the rows that it crosses, and filled between crossings.

What is made follows the covered cells, and not shapes times cells. A cell is covered if its centre is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions.scalars import x_of, y_of
from gridfold.params import Grid


def _lines(low: Column, high: Column, origin: float, resolution: float, size: int) -> Column:
    """Rows or columns whose centres may lie between two coordinates, one more at either end, inside the grid; the caller tests the centres themselves."""
    at = lambda v: F.floor((v - origin) / resolution - 0.5)
    first, last = F.greatest(at(low) - 1, F.lit(0).cast("long")), F.least(at(high) + 1, F.lit(size - 1).cast("long"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def edges(rings: DataFrame, ring: str, keys: list[str]) -> DataFrame:
    """(keys, ax, ay, bx, by): the sides of closed rings of points (x, y)."""
    n = F.size(ring)
    side = lambda k: F.struct(*(F.get(ring, i)[c].alias(f"{p}{c}") for p, i in (("a", k), ("b", (k + 1) % n)) for c in "xy"))
    return rings.filter(n > 0).select(*keys, F.inline(F.transform(F.sequence(F.lit(0), n - 1), side)))


def polygon_cells(sides: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, row, col) inside the polygon that the sides (keys, ax, ay, bx, by) of the same keys make, each once.

    A centre is inside if it has an odd number of crossings to its right; a side counts with its lower end only, so that level ones don't count. A centre on a
    crossing is inside where the polygon begins, and not where it ends.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = sides.withColumn("row", F.explode(_lines(low, high, grid.origin_y, grid.resolution, grid.rows))).withColumn("_y", y_of("row", grid))
    crossed = rows.filter((F.col("ay") > F.col("_y")) != (F.col("by") > F.col("_y")))
    crossed = crossed.select(*keys, "row", (F.col("ax") + (F.col("_y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("_x"))
    line = Window.partitionBy(*keys, "row").orderBy("_x")
    spans = crossed.withColumns({"_n": F.row_number().over(line), "_end": F.lead("_x").over(line)}).filter("_n % 2 = 1")
    cells = spans.withColumn("col", F.explode(_lines(F.col("_x"), F.col("_end"), grid.origin_x, grid.resolution, grid.cols)))
    centre = x_of("col", grid)
    return cells.filter((centre >= F.col("_x")) & (centre < F.col("_end"))).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def disc_cells(discs: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, row, col) within discs (keys, x, y, r), rims included; each disc by itself."""
    rows = discs.withColumn("row", F.explode(_lines(F.col("y") - F.col("r"), F.col("y") + F.col("r"), grid.origin_y, grid.resolution, grid.rows)))
    dy = y_of("row", grid) - F.col("y")
    half = F.sqrt(F.greatest(F.col("r") * F.col("r") - dy * dy, F.lit(0.0)))
    cells = rows.withColumn("col", F.explode(_lines(F.col("x") - half, F.col("x") + half, grid.origin_x, grid.resolution, grid.cols)))
    dx = x_of("col", grid) - F.col("x")
    inside = cells.filter(dx * dx + dy * dy <= F.col("r") * F.col("r"))
    return inside.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
