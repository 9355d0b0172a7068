"""Correlative matching of a sweep against the map so far.

The field lies in tiles, each with the one row and column after it that blending needs; a point is looked up in the tile
of its cell, by an equi-join. A search is exact without trying all candidates: the field's maximum over the cells that a box of candidates
can reach gives each point its most in that box, so that boxes whose sum falls under a score that is reached already are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions.scalars import in_bounds, wrap_angle
from gridfold.params import EvidenceModel, Grid, Pose, SearchWindow, wrap
from gridfold.session import checkpoint


def body_points(beams: DataFrame, stride: int = 1) -> DataFrame:
    """(run_id, scan_idx, px, py): every stride-th return of each sweep, in the sensor's frame, counted over returns alone."""
    rank = F.row_number().over(Window.partitionBy("run_id", "scan_idx").orderBy("beam_idx"))
    hits = beams.filter("is_hit").withColumn("_n", rank).filter((F.col("_n") - 1) % stride == 0)
    return hits.select("run_id", "scan_idx", (F.col("range") * F.cos("angle")).alias("px"), (F.col("range") * F.sin("angle")).alias("py"))


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights of a Gaussian up to `truncate` deviations on either side."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def likelihood_field(cells: DataFrame, grid: Grid, model: EvidenceModel, blur_cells: float = 1.0) -> DataFrame:
    """(row, col, v): occupied evidence from 0 to 1, blurred; cells that are left out are 0.

    The blur is two passes of explode and sum, one for each axis; nothing comes in over the grid's edge.
    """
    if blur_cells < 0:
        raise ValueError("blur_cells must not be negative")
    above = (F.col("log_odds") - model.l_prior) / (model.l_max - model.l_prior)
    field = cells.select("row", "col", F.least(F.greatest(above, F.lit(0.0)), F.lit(1.0)).alias("v")).filter("v > 0")
    if blur_cells == 0:
        return field
    taps = gaussian_taps(blur_cells)
    radius = len(taps) // 2
    weights = F.explode(F.array(*(F.struct(F.lit(k - radius).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(taps))))
    for axis, size in (("row", grid.rows), ("col", grid.cols)):
        spread = field.withColumn("k", weights).select(*((F.col(c) + F.col("k.d") if c == axis else F.col(c)).alias(c) for c in ("row", "col")), (F.col("v") * F.col("k.w")).alias("v"))
        field = spread.filter((F.col(axis) >= 0) & (F.col(axis) < size)).groupBy("row", "col").agg(F.sum("v").alias("v"))
    return field


#: Rows and columns of a tile, and candidates along each axis of translation in a box.
TILE, BOX = 32, 3
#: The blended field is bounded by its values at so many places a cell along each axis.
NODES = 4
#: Tiles (some 64 MB) and poses (some 10 MB) that are broadcast at most; more are joined by a shuffle.
TILES, POSES = 7000, 100_000
#: Scores are summed in whole parts of this size and what is left of each value.
PART = 2.0**-24


def few(df: DataFrame, most: int) -> DataFrame:
    """`df` to be broadcast, if it has no more rows than `most`: counted, since the optimizer's bound for a grid's cells is far too high."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def weighed(points: DataFrame, keys: tuple[str, ...] = ("scan_idx",)) -> DataFrame:
    """(keys, px, py, n): equal points of a sweep as one row, with their number."""
    return points.groupBy(*keys, "px", "py").agg(F.count("*").alias("n"))


def summed(value: Column, n: Column) -> Column:
    """The sum of n times each value, which isn't negative: whole parts as integers, and the rest. A plain sum of as many doubles as a large sweep has points is rounded at each step,
    and differs with the order of its rows; this one is rounded where its two parts are put together."""
    parts = F.floor(value / PART)
    return (F.sum(parts * n) + F.sum((value / PART - parts) * n)) * PART


def ties(score: Column, top: Column) -> Column:
    """Whether a score is within 1e-12 of the highest one, or equals it but for rounding."""
    return score >= top - F.greatest(F.lit(1e-12), 1e-14 * top)


def tiled(field: DataFrame, halo: int = 1) -> DataFrame:
    """(tile_row, tile_col, field): the cells of each tile that holds any, row by row, with `halo` rows and columns after it: some 9 kB a tile, whatever the map's size."""
    side = TILE + halo
    own = lambda c: F.floor(F.col(c) / TILE).cast("int")
    # A cell at a tile's beginning is also in the halo of the tile before it.
    owners = lambda c: F.when(F.pmod(F.col(c), F.lit(TILE)) < halo, F.array(own(c), own(c) - 1)).otherwise(F.array(own(c)))
    spread = field.withColumn("tile_row", F.explode(owners("row"))).withColumn("tile_col", F.explode(owners("col")))
    at = (F.col("row") - F.col("tile_row") * TILE) * side + F.col("col") - F.col("tile_col") * TILE
    held = spread.groupBy("tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("at"), "v"))).alias("cells"))
    return held.select("tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0.0))).alias("field"))


def _tile_of(placed: DataFrame) -> DataFrame:
    """With the tile of each point's cell (_r0, _c0)."""
    return placed.withColumns({"tile_row": F.floor(F.col("_r0") / TILE).cast("int"), "tile_col": F.floor(F.col("_c0") / TILE).cast("int")})


def _local(i: int, j: int, side: int) -> Column:
    at = (F.col("_r0") - F.col("tile_row") * TILE + i) * side + F.col("_c0") - F.col("tile_col") * TILE + j
    return F.get("field", at.cast("int"))


def span(radius: float, step: float) -> int:
    """Number of candidates on one axis from -radius on by `step`, up to radius and half a step."""
    return max(1, math.ceil((2 * radius + 0.5 * step) / step - 1e-12))


def candidates(spark, center: Pose, translation_radius: float, heading_radius: float, translation_step: float, heading_step: float) -> DataFrame:
    """(idx, x, y, theta) around a pose, the heading running fastest."""
    n, h = span(translation_radius, translation_step), span(heading_radius, heading_step)
    t0, h0 = -translation_radius, -heading_radius
    idx = F.col("id")
    i, j, k = F.floor(idx / (n * h)), F.floor(idx / h) % n, idx % h
    return spark.range(n * n * h).select(idx.alias("idx"), (center.x + (t0 + i * translation_step)).alias("x"), (center.y + (t0 + j * translation_step)).alias("y"), (center.theta + (h0 + k * heading_step)).alias("theta"))


def window_around(grid: Grid, x: float, y: float, reach: float) -> Grid:
    """The part of the grid within `reach` of a point, as large as a sensor sees, and not as the map is."""
    lows, sizes = [], []
    for at, origin, n in ((y, grid.origin_y, grid.rows), (x, grid.origin_x, grid.cols)):
        low = min(max(math.floor((at - reach - origin) / grid.resolution) - 2, 0), n - 1)
        high = min(max(math.floor((at + reach - origin) / grid.resolution) + 2, low), n - 1)
        lows.append(low)
        sizes.append(high - low + 1)
    return Grid(grid.resolution, sizes[0], sizes[1], grid.origin_x + lows[1] * grid.resolution, grid.origin_y + lows[0] * grid.resolution)


def _crossed(points: DataFrame, poses: DataFrame, grid: Grid, keys: tuple[str, ...]) -> DataFrame:
    """Points (keys, px, py, n) beside the poses (keys, idx, x, y, theta) of the same sweep: (keys, idx, n, _c, _r), with their place in cells between centres.

    A pose is turned once, before the join; a place comes out as one struct, so that filters and tiles don't work it out again in each of their terms.
    """
    turned = few(poses.select(*keys, "idx", "x", "y", F.cos("theta").alias("_cos"), F.sin("theta").alias("_sin")), POSES)
    crossed = points.join(turned, list(keys)) if keys else points.crossJoin(turned)
    x, y = F.col("_cos") * F.col("px") - F.col("_sin") * F.col("py") + F.col("x"), F.col("_sin") * F.col("px") + F.col("_cos") * F.col("py") + F.col("y")
    place = F.struct(((x - grid.origin_x) / grid.resolution - 0.5).alias("_c"), ((y - grid.origin_y) / grid.resolution - 0.5).alias("_r"))
    return crossed.select(*keys, "idx", (F.col("n") if "n" in points.columns else F.lit(1)).alias("n"), F.inline(F.array(place)))


def scores(points: DataFrame, poses: DataFrame, tiles: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """`poses` (keys, idx, x, y, theta, ...) with score: the sum of the blended field under the points (keys, px, py; n, if equal ones are one row) of the same sweep; 0 outside the outermost centres.

    A point beside a candidate is a row of plain arithmetic, joined with the tile (as of `tiled`) of its cell, and sums are made on the map side. Tiles and poses that are few are
    broadcast, so that points stay where they lie. A pose of a sweep without points has 0.
    """
    placed = _crossed(points, poses, grid, keys)
    inside = (F.col("_c") >= 0) & (F.col("_c") <= grid.cols - 1) & (F.col("_r") >= 0) & (F.col("_r") <= grid.rows - 1)
    placed = placed.filter(inside).withColumns({"_c0": F.least(F.floor("_c"), F.lit(max(grid.cols - 2, 0))), "_r0": F.least(F.floor("_r"), F.lit(max(grid.rows - 2, 0)))})
    found = _tile_of(placed).join(few(tiles, TILES), ["tile_row", "tile_col"])
    at = lambda i, j: _local(i, j, TILE + 1)
    fc, fr = F.col("_c") - F.col("_c0"), F.col("_r") - F.col("_r0")
    value = (1 - fr) * ((1 - fc) * at(0, 0) + fc * at(0, 1)) + fr * ((1 - fc) * at(1, 0) + fc * at(1, 1))
    total = found.groupBy(*keys, "idx").agg(summed(value, F.col("n")).alias("score"))
    return poses.join(total, [*keys, "idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def reach(nodes: float) -> int:
    """Nodes along an axis between which a point stays that moves by up to `nodes` of their distances."""
    return math.ceil(nodes - 1e-9) + 2


def blended(field: DataFrame, nodes: int) -> DataFrame:
    """(row, col, v): the field's blended values at `nodes` places a cell along each axis; place 0 is the centre of cell 0. Between neighbouring places it has no higher value than at them."""
    for axis in ("row", "col"):
        spread = field.withColumn("_d", F.explode(F.sequence(F.lit(1 - nodes), F.lit(nodes - 1))))
        field = spread.withColumns({axis: F.col(axis) * nodes + F.col("_d"), "v": F.col("v") * (1 - F.abs("_d") / F.lit(float(nodes)))}).groupBy("row", "col").agg(F.sum("v").alias("v"))
    return field


def pooled(field: DataFrame, width: int) -> DataFrame:
    """(row, col, v): the field's maximum over the `width` rows and columns from each place on, along one axis after the other."""
    for axis in ("row", "col"):
        spread = field.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn(axis, F.col(axis) - F.col("_d"))
        field = spread.groupBy("row", "col").agg(F.max("v").alias("v"))
    return field


def bounds(points: DataFrame, boxes: DataFrame, tiles: DataFrame, grid: Grid, nodes: int, keys: tuple[str, ...]) -> DataFrame:
    """`boxes` (keys, idx, x, y, theta, ...; x and y of their lowest corners) with bound: what no candidate of the box can exceed. `tiles` are those of the blended field, pooled over the nodes that a box reaches."""
    at = lambda c: F.floor(F.col(c) * nodes)
    placed = _tile_of(_crossed(points, boxes, grid, keys).withColumns({"_c0": at("_c"), "_r0": at("_r")}))
    summed = placed.join(few(tiles, TILES), ["tile_row", "tile_col"]).groupBy(*keys, "idx").agg(F.sum(_local(0, 0, TILE) * F.col("n")).alias("bound"))
    return boxes.join(summed, [*keys, "idx"], "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))


def match_sweeps(points: DataFrame, predicted: DataFrame, field: DataFrame, grid: Grid, search: SearchWindow) -> DataFrame:
    """(scan_idx, x, y, theta, score, predicted_score, bounded, scored): the best pose of every sweep of `points` (scan_idx, px, py), all sweeps at once.

    `predicted` has scan_idx, x, y, theta; `field` is that of `likelihood_field`. From coarse to fine; in each pass the candidate with the highest score counts, of those
    that equal it (`ties`) the one nearest to the pose so far, then the first; it must be better than that pose to replace it.

    In a pass the boxes of candidates get their bounds; the box with the highest is scored first, then all boxes whose bound
    reaches what was scored. The others can't hold the best candidate, so that the result is that of all candidates. `bounded` and `scored` count the boxes and candidates.
    """
    sweep = ("scan_idx",)
    points, tiles = checkpoint(weighed(points, sweep)), checkpoint(tiled(field))
    first = scores(points, predicted.withColumn("idx", F.lit(0)), tiles, grid, sweep)
    zero = F.lit(0).cast("long")
    at = checkpoint(first.select("scan_idx", "x", "y", "theta", "score", F.col("score").alias("predicted_score"), zero.alias("bounded"), zero.alias("scored")))
    radii = [search.translation_radius, search.heading_radius, search.translation_step, search.heading_step]
    for _ in range(search.refinements + 1):
        n, h = span(radii[0], radii[2]), span(radii[1], radii[3])
        nodes = NODES
        coarse = checkpoint(tiled(pooled(blended(field, nodes), reach((BOX - 1) * radii[2] / grid.resolution * nodes)), 0))
        around = candidates(at.sparkSession, Pose(0.0, 0.0, 0.0), *radii).withColumnsRenamed({"x": "dx", "y": "dy", "theta": "dh"})
        i, j, k = F.floor(F.col("idx") / (n * h)), F.floor(F.col("idx") / h) % n, F.col("idx") % h
        across = -(-n // BOX)
        around = around.withColumn("box", (F.floor(i / BOX) * across + F.floor(j / BOX)) * h + k)
        corners = around.groupBy("box").agg(F.min("dx").alias("dx"), F.min("dy").alias("dy"), F.first("dh").alias("dh"), F.count("*").alias("held"))
        cost = sum((F.col(d) / step) * (F.col(d) / step) for d, step in (("dx", radii[2]), ("dy", radii[2]), ("dh", radii[3])))
        moved = lambda here, rows: here.crossJoin(F.broadcast(rows)).select(
            "scan_idx", "box", *(c for c in ("idx", "held") if c in rows.columns), (F.col("_x") + F.col("dx")).alias("x"), (F.col("_y") + F.col("dy")).alias("y"), (F.col("_theta") + F.col("dh")).alias("theta"), cost.alias("cost")
        )
        here = at.select("scan_idx", *(F.col(c).alias(f"_{c}") for c in ("x", "y", "theta")))
        boxes = moved(here, corners).withColumnRenamed("box", "idx").drop("cost")
        bounded = checkpoint(bounds(points, boxes, coarse, grid, nodes, sweep).select("scan_idx", F.col("idx").alias("box"), "bound", "held"))
        every = moved(here, around)
        top = bounded.groupBy("scan_idx").agg(F.max_by("box", F.struct("bound", -F.col("box"))).alias("box"))
        tried = checkpoint(scores(points, every.join(F.broadcast(top), ["scan_idx", "box"]), tiles, grid, sweep))
        reached = tried.groupBy("scan_idx").agg(F.max("score").alias("reached")).join(at.select("scan_idx", "score"), "scan_idx").select("scan_idx", F.greatest("reached", "score").alias("reached"))
        # Sums are rounded, so that a bound is given some slack.
        open_ = bounded.join(top, ["scan_idx", "box"], "left_anti").join(reached, "scan_idx").filter(F.col("bound") >= F.col("reached") - 1e-9 * (1 + F.col("reached"))).select("scan_idx", "box")
        rest = checkpoint(scores(points, every.join(open_, ["scan_idx", "box"]), tiles, grid, sweep))
        scored = tried.unionByName(rest)
        counted = bounded.groupBy("scan_idx").agg(F.count("*").alias("n_boxes")).join(scored.groupBy("scan_idx").agg(F.count("*").alias("n_scored")), "scan_idx")
        topped = scored.withColumn("top", F.max("score").over(Window.partitionBy("scan_idx")))
        tied = topped.filter(ties(F.col("score"), F.col("top")))
        pick = tied.groupBy("scan_idx").agg(F.min_by(F.struct("x", "y", "theta", "score"), F.struct("cost", "idx")).alias("p"))
        better = F.col("p.score") > F.col("score")
        take = lambda name, value: F.when(better, value).otherwise(F.col(name)).alias(name)
        joined = at.join(pick, "scan_idx", "left").join(counted, "scan_idx", "left")
        more = [(F.col(c) + F.coalesce(new, zero)).alias(c) for c, new in (("bounded", "n_boxes"), ("scored", "n_scored"))]
        at = checkpoint(joined.select("scan_idx", take("x", F.col("p.x")), take("y", F.col("p.y")), take("theta", wrap_angle(F.col("p.theta"))), take("score", F.col("p.score")), "predicted_score", *more))
        radii = [r / 2 for r in radii]
    return at


def best(scored: DataFrame, center: Pose, translation_step: float, heading_step: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The candidate with the highest score, for each of `keys`; of those that equal it (`ties`) the one nearest to the centre, then the first."""
    dx, dy, dh = (F.col("x") - center.x) / translation_step, (F.col("y") - center.y) / translation_step, (F.col("theta") - center.theta) / heading_step
    topped = scored.join(scored.groupBy(*keys).agg(F.max("score").alias("top")), list(keys)) if keys else scored.crossJoin(F.broadcast(scored.agg(F.max("score").alias("top"))))
    tied = topped.filter(ties(F.col("score"), F.col("top"))).withColumn("cost", dx * dx + dy * dy + dh * dh)
    return tied.groupBy(*keys).agg(F.min_by(F.struct("idx", "x", "y", "theta", "score"), F.struct("cost", "idx")).alias("p")).filter("p is not null").select(*keys, "p.*")


def match(cells: DataFrame, points: DataFrame, grid: Grid, model: EvidenceModel, predicted: Pose, window: SearchWindow | None = None, blur_cells: float = 1.0) -> dict:
    """Best pose of a sweep's points against the map, from coarse to fine; a candidate must be better to replace the pose so far.

    Returns pose, score, predicted_score, translation_correction, heading_correction, evaluations (candidates of the search), scored (those that had to be scored), bounded (boxes) and points. An
    empty map or sweep leaves the predicted pose.
    """
    spark, search = cells.sparkSession, window or SearchWindow()
    points = points.select(F.lit(0).alias("scan_idx"), "px", "py").cache()
    n, far = points.agg(F.count("*"), F.coalesce(F.max(F.hypot("px", "py")), F.lit(0.0))).first()
    # Passes halve the radius, so that the search as a whole stays within twice the first; cells further off than that and the blur don't count.
    taps = len(gaussian_taps(blur_cells)) // 2 if blur_cells else 0
    part = window_around(grid, predicted.x, predicted.y, far + 4 * search.translation_radius + taps * grid.resolution)
    row0, col0 = round((part.origin_y - grid.origin_y) / grid.resolution), round((part.origin_x - grid.origin_x) / grid.resolution)
    near = cells.filter(in_bounds(F.col("row") - row0, F.col("col") - col0, part))
    field = checkpoint(likelihood_field(near, grid, model, blur_cells))
    start = spark.createDataFrame([(0, predicted.x, predicted.y, predicted.theta)], "scan_idx int, x double, y double, theta double")
    found = match_sweeps(points, start, field, grid, search).first()
    at = Pose(found["x"], found["y"], found["theta"])
    radii, tried = [search.translation_radius, search.heading_radius, search.translation_step, search.heading_step], 0
    for _ in range(search.refinements + 1):
        tried += span(radii[0], radii[2]) ** 2 * span(radii[1], radii[3])
        radii = [r / 2 for r in radii]
    result = {
        "pose": at,
        "score": found["score"],
        "predicted_score": found["predicted_score"],
        "translation_correction": math.hypot(at.x - predicted.x, at.y - predicted.y),
        "heading_correction": wrap(at.theta - predicted.theta),
        "evaluations": tried,
        "scored": found["scored"],
        "bounded": found["bounded"],
        "points": n,
    }
    points.unpersist()
    return result
