"""Walking rays over a grid in closed form: each crossing of a grid line is one row.

A crossing's parameter gives the number of crossings of the other axis before it, and so its cell and its
place in the walk: no step depends on the one before, and nothing is sorted. At a corner the column changes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.params import Grid


class _Axis:
    """One axis of rays: where its crossings of grid lines lie, and how many come before a parameter. `of` gives each of its columns."""

    def __init__(self, of, resolution: float):
        self.resolution = resolution
        self.origin, self.start, self.delta, self.sign, self.line = map(of, ("origin", "start", "delta", "sign", "line"))

    def crossing(self, k: Column) -> Column:
        """Parameter of the k-th crossing, from 0 on; it doesn't fall as k rises, also as rounded."""
        at = (self.origin + (self.line + self.sign * k) * self.resolution) - self.start
        return at / F.when(self.sign == 0, F.lit(1.0)).otherwise(self.delta)

    def nearest(self, t: Column, most: Column) -> Column:
        """The crossing that is nearest to the parameter t: those before it lie under t, those after it over it, whatever was rounded."""
        there = (self.start + t * self.delta - self.origin) / self.resolution
        return F.rint(F.least(F.greatest((there - self.line) * self.sign, F.lit(-1.0)), most + 1.0)).cast("long")

    def counted(self, nearest: Column, passed: Column, most: Column) -> Column:
        """Crossings before a parameter, of the first `most`: those before the nearest, and that one if it was passed."""
        upto = nearest + F.when(passed, 1).otherwise(0)
        return F.when(self.sign == 0, 0).otherwise(F.least(F.greatest(upto, F.lit(0).cast("long")), most))


def _columns(name: str, start: Column, delta: Column, origin: float, resolution: float) -> list[Column]:
    first = F.floor((start - origin) / resolution)
    return [
        F.lit(float(origin)).alias(f"_{name}_origin"),
        start.alias(f"_{name}_start"),
        delta.alias(f"_{name}_delta"),
        first.alias(f"_{name}_first"),
        F.signum(delta).cast("long").alias(f"_{name}_sign"),
        (first + F.when(delta > 0, 1).otherwise(0)).alias(f"_{name}_line"),
    ]


def walk(rays: DataFrame, grid: Grid, keep: list[str]) -> DataFrame:
    """Cells that each ray enters, in order of step: `keep` columns, step, row, col, is_terminal.

    `rays` has x0, y0, x1, y1 (double). A ray that starts outside the grid, or has a null or non-finite
    coordinate, enters none; one that leaves it ends there and isn't terminal in any cell. Of a
    ray that reaches its endpoint the last cell is terminal. Rays are walked where they lie; `dealt` spreads them first.

    A visit comes out as one struct, so that a filter on cells stays after it: pushed before, it would work the walk out again in each of its terms, in code that
    is too large to be compiled.
    """
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    finite = F.lit(True)
    for c in ends:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x0, y0, x1, y1 = ends
    res = grid.resolution
    inside = (x0 >= grid.origin_x) & (x0 < grid.extent[1] + res) & (y0 >= grid.origin_y) & (y0 < grid.extent[3] + res)
    started = rays.filter(finite).filter(inside).select(*keep, *_columns("x", x0, x1 - x0, grid.origin_x, res), *_columns("y", y0, y1 - y0, grid.origin_y, res))
    started = started.filter((F.col("_x_first") >= 0) & (F.col("_x_first") < grid.cols) & (F.col("_y_first") >= 0) & (F.col("_y_first") < grid.rows))
    x, y = (_Axis(lambda c, n=name: F.col(f"_{n}_{c}"), res) for name in "xy")

    def counted(rays: DataFrame, name: str, axis: _Axis, t: Column, inclusive: bool, most: Column) -> DataFrame:
        rays = rays.withColumn("_near", axis.nearest(t, most))
        passed = axis.crossing(F.col("_near")) <= t if inclusive else axis.crossing(F.col("_near")) < t
        return rays.withColumn(name, axis.counted(F.col("_near"), passed, most)).drop("_near")

    # `_in`: crossings that stay in the grid; one more leads out of it for good.
    for name, size in (("x", grid.cols), ("y", grid.rows)):
        first, sign = F.col(f"_{name}_first"), F.col(f"_{name}_sign")
        started = started.withColumn(f"_{name}_in", F.when(sign > 0, size - 1 - first).otherwise(first))
    for name, axis in (("x", x), ("y", y)):
        started = counted(started, f"_{name}_all", axis, F.lit(1.0), True, F.col(f"_{name}_in") + 1)
        started = started.withColumn(f"_{name}_out", F.when(F.col(f"_{name}_all") > F.col(f"_{name}_in"), axis.crossing(F.col(f"_{name}_in"))).otherwise(float("inf")))
    # At a corner the column changes first: a ray that leaves by x has the crossings of y under that parameter, one that leaves by y those of x up to it.
    started = started.withColumns({"_by_x": (F.col("_x_out") < float("inf")) & (F.col("_x_out") <= F.col("_y_out")), "_by_y": F.col("_y_out") < F.col("_x_out"), "_exit": F.least("_x_out", "_y_out", F.lit(1.0))})
    started = counted(started, "_x_upto", x, F.col("_exit"), True, F.col("_x_in"))
    started = counted(started, "_y_upto", y, F.col("_exit"), False, F.col("_y_in"))
    n_x = F.when(F.col("_by_x"), F.col("_x_in")).when(F.col("_by_y"), F.col("_x_upto")).otherwise(F.col("_x_all"))
    n_y = F.when(F.col("_by_x"), F.col("_y_upto")).when(F.col("_by_y"), F.col("_y_in")).otherwise(F.col("_y_all"))
    started = started.withColumns({"_x_n": n_x, "_y_n": n_y, "_reached": ~F.col("_by_x") & ~F.col("_by_y")})
    steps = started.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_x_n") + F.col("_y_n"))))
    # Row 0 is the start, then come the crossings of x, then those of y. Each row has its own axis as a, the other one as b; `_k` is the crossing's number on its own.
    of_x = F.col("_i") <= F.col("_x_n")
    sides = {f"_{side}_{c}": F.when(of_x, F.col(f"_{own}_{c}")).otherwise(F.col(f"_{other}_{c}")) for side, own, other in (("a", "x", "y"), ("b", "y", "x")) for c in ("origin", "start", "delta", "sign", "line", "n")}
    placed = steps.select(*keep, "_x_first", "_y_first", "_x_sign", "_y_sign", "_i", of_x.alias("_of_x"), F.when(of_x, F.col("_i")).otherwise(F.col("_i") - F.col("_x_n")).alias("_k"), F.when(F.col("_reached"), F.col("_x_n") + F.col("_y_n")).otherwise(-1).alias("_last"), *(v.alias(k) for k, v in sides.items()))
    own, other = (_Axis(lambda c, s=side: F.col(f"_{s}_{c}"), res) for side in "ab")
    placed = placed.withColumn("_t", own.crossing(F.col("_k") - 1))
    placed = placed.withColumn("_near", other.nearest(F.col("_t"), F.col("_b_n"))).withColumn("_at", other.crossing(F.col("_near")))
    # At a corner the column changes first, so that a crossing of y counts that of x at its own parameter.
    passed = (F.col("_at") < F.col("_t")) | (~F.col("_of_x") & (F.col("_at") == F.col("_t")))
    walked = placed.withColumn("_other", F.when(F.col("_i") == 0, 0).otherwise(other.counted(F.col("_near"), passed, F.col("_b_n"))))
    on_x, on_y = F.when(F.col("_of_x"), F.col("_k")).otherwise(F.col("_other")), F.when(F.col("_of_x"), F.col("_other")).otherwise(F.col("_k"))
    visit = F.struct(
        (F.col("_k") + F.col("_other")).cast("int").alias("step"),
        (F.col("_y_first") + F.col("_y_sign") * on_y).cast("int").alias("row"),
        (F.col("_x_first") + F.col("_x_sign") * on_x).cast("int").alias("col"),
        (F.col("_k") + F.col("_other") == F.col("_last")).alias("is_terminal"),
    )
    return walked.select(*keep, F.inline(F.array(visit)))


def dealt(rays: DataFrame, *keys: str) -> DataFrame:
    """`rays` over all cores by a hash of `keys`, whatever files they come from: a ray is a few bytes, and its cells are hundreds of rows."""
    return rays.repartition(max(rays.sparkSession.sparkContext.defaultParallelism, int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def alike(rays: DataFrame, keys: list[str]) -> DataFrame:
    """Equal rays of a sweep (`keys`) as one, with their number as n and is_hit if any is; dealt over all cores, by one shuffle. Each is walked once."""
    own = [*keys, "x0", "y0", "x1", "y1"]
    return dealt(rays, *own).groupBy(*own).agg(F.bool_or("is_hit").alias("is_hit"), F.count("*").alias("n"))


def counts(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and reached flag of each ray that enters the grid."""
    return visits.groupBy(*keys).agg(F.count("*").alias("cells"), F.max("is_terminal").alias("reached"))
