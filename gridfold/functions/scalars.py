"""Column expressions of the map's arithmetic: log odds, cells, planar poses, ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.params import FREE, OCCUPIED, UNKNOWN, EvidenceModel, Grid, Pose

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_odds(p: Column | str) -> Column:
    """ln(p / (1 - p)); a value outside (0, 1) raises, null stays null."""
    p = col(p)
    bad = F.raise_error(F.lit("a probability must lie strictly between 0 and 1")).cast("double")
    return F.when(p.isNull() | ((p > 0) & (p < 1)), F.ln(p / (1 - p))).otherwise(bad)


def probability(l: Column | str) -> Column:  # noqa: E741
    """Inverse of log_odds without overflow at either end."""
    l = col(l)  # noqa: E741
    e = F.exp(-F.abs(l))
    return F.when(l >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clamp(l: Column | str, model: EvidenceModel) -> Column:  # noqa: E741
    return F.least(F.greatest(col(l), F.lit(model.l_min)), F.lit(model.l_max))


def at_clamp(l: Column | str, model: EvidenceModel, tolerance: float = 1e-9) -> Column:  # noqa: E741
    l = col(l)  # noqa: E741
    return (l <= model.l_min + tolerance) | (l >= model.l_max - tolerance)


def state(l: Column | str, model: EvidenceModel) -> Column:  # noqa: E741
    """0 unknown, 1 free, 2 occupied; a value on a threshold is decided."""
    return state_by(l, F.lit(model.l_prior), F.lit(model.l_decision))


def state_by(l: Column | str, prior: Column, decision: Column) -> Column:  # noqa: E741
    """As `state`, with the band in columns, for sweeps over it."""
    l = col(l)  # noqa: E741
    return F.when(l <= prior - decision, FREE).when(l >= prior + decision, OCCUPIED).otherwise(UNKNOWN)


def row_of(y: Column | str, grid: Grid) -> Column:
    """Row of a world coordinate; it may lie outside the grid."""
    return F.floor((col(y) - grid.origin_y) / grid.resolution).cast("long")


def col_of(x: Column | str, grid: Grid) -> Column:
    return F.floor((col(x) - grid.origin_x) / grid.resolution).cast("long")


def x_of(c: Column | str, grid: Grid) -> Column:
    """World coordinate of a column's centre."""
    return grid.origin_x + (col(c) + 0.5) * grid.resolution


def y_of(r: Column | str, grid: Grid) -> Column:
    return grid.origin_y + (col(r) + 0.5) * grid.resolution


def in_bounds(r: Column | str, c: Column | str, grid: Grid) -> Column:
    r, c = col(r), col(c)
    return (r >= 0) & (r < grid.rows) & (c >= 0) & (c < grid.cols)


def wrap_angle(a: Column | str) -> Column:
    """The same angle in (-pi, pi]."""
    a = col(a)
    r = a - 2 * math.pi * F.rint(a / (2 * math.pi))
    return F.when(r <= -math.pi, F.lit(math.pi)).otherwise(r)


def pose(x, y, theta) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).alias("x"), as_column(y).alias("y"), as_column(theta).alias("theta"))


def pose_of(p: Pose) -> Column:
    return pose(p.x, p.y, p.theta)


def transform_point(p: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point given in the frame of pose `p`, in the frame of `p`'s parent."""
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    return p["x"] + c * x - s * y, p["y"] + s * x + c * y


def compose(outer: Column, inner: Column) -> Column:
    x, y = transform_point(outer, inner["x"], inner["y"])
    return pose(x, y, wrap_angle(outer["theta"] + inner["theta"]))


def inverse(p: Column) -> Column:
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    return pose(-(c * p["x"] + s * p["y"]), s * p["x"] - c * p["y"], wrap_angle(-p["theta"]))


def relative_motion(before: Column, after: Column) -> Column:
    """Pose `after` in the frame of pose `before`."""
    return compose(inverse(before), after)


def position_error(estimate: Column, truth: Column) -> Column:
    return F.hypot(estimate["x"] - truth["x"], estimate["y"] - truth["y"])


def heading_error(estimate: Column, truth: Column) -> Column:
    return F.abs(wrap_angle(estimate["theta"] - truth["theta"]))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def circle_range(px, py, dx, dy, cx, cy, r) -> Column:
    """Distance along a unit direction to a circle: the nearest positive root, or infinity."""
    ox, oy = px - cx, py - cy
    half = ox * dx + oy * dy
    under = half * half - (ox * ox + oy * oy - r * r)
    root = F.sqrt(F.greatest(under, F.lit(0.0)))
    near, far = -half - root, -half + root
    return F.when(under < 0, F.lit(INF)).when(near > 0, near).when(far > 0, far).otherwise(F.lit(INF))


def edge_range(px, py, dx, dy, ax, ay, bx, by) -> Column:
    """Distance along a unit direction to a polygon's side, ends included, or infinity; parallel sides aren't hit."""
    ex, ey = bx - ax, by - ay
    cross = dx * ey - dy * ex
    safe = F.when(F.abs(cross) < 1e-12, F.lit(1.0)).otherwise(cross)
    wx, wy = ax - px, ay - py
    t, s = (wx * ey - wy * ex) / safe, (wx * dy - wy * dx) / safe
    return F.when((F.abs(cross) >= 1e-12) & (t > 0) & (s >= 0) & (s <= 1), t).otherwise(F.lit(INF))
