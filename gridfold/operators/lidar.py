"""Simulated sweeps against analytic scenes, and ground truth on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.scalars import INF, circle_range, edge_range
from gridfold.operators import shapes
from gridfold.params import Grid, Lidar


def beam_angles(poses: DataFrame, lidar: Lidar) -> DataFrame:
    """Each pose with beam_idx and angle of all beams, centred on the heading."""
    n, step = lidar.beams, math.radians(lidar.angular_resolution_deg)
    beams = poses.withColumn("beam_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return beams.withColumn("angle", (F.col("beam_idx") - 0.5 * (n - 1)) * step)


def discs_at(time: Column) -> Column:
    """The scene's discs with its movers where they are at a time."""
    moved = F.transform("movers", lambda m: F.struct((m["x"] + m["vx"] * time).alias("x"), (m["y"] + m["vy"] * time).alias("y"), m["r"].alias("r")))
    return F.concat("discs", moved)


def nearest_range(px: Column, py: Column, dx: Column, dy: Column, discs: Column, edges: Column) -> Column:
    """Distance along a unit direction to the nearest surface of a scene, or infinity."""
    to_discs = F.transform(discs, lambda d: circle_range(px, py, dx, dy, d["x"], d["y"], d["r"]))
    to_edges = F.transform(edges, lambda e: edge_range(px, py, dx, dy, e["ax"], e["ay"], e["bx"], e["by"]))
    return F.coalesce(F.array_min(F.concat(to_discs, to_edges)), F.lit(INF))


def measured(true_range: Column, z: Column, lidar: Lidar) -> tuple[Column, Column]:
    """Range and is_hit as the sensor gives them: noise on returns, none at or beyond the limit, none nearer than the least range."""
    noisy = true_range + z * lidar.range_noise_std
    hit = (true_range < lidar.max_range) & (noisy < lidar.max_range)
    return F.when(hit, F.greatest(noisy, F.lit(lidar.min_range))).otherwise(F.lit(lidar.max_range)), hit


def simulate(poses: DataFrame, scenes: DataFrame, variates: DataFrame, lidar: Lidar) -> DataFrame:
    """Beams of every sweep: pose columns, beam_idx, angle, true_range, range, is_hit and kept (false where it dropped out).

    A scene is one row of arrays for a run, so that the nearest surface takes no join with obstacles and no shuffle of beams.
    """
    beams = beam_angles(poses, lidar).join(F.broadcast(scenes), "run_id")  # one row for a run
    beams = beams.withColumn("discs", discs_at(F.col("time")))
    heading = F.col("angle") + F.col("theta")
    ranged = beams.withColumn("true_range", nearest_range(F.col("x"), F.col("y"), F.cos(heading), F.sin(heading), F.col("discs"), F.col("edges")))
    ranged = ranged.drop("discs", "edges", "rings", "movers").join(variates, ["run_id", "scan_idx", "beam_idx"])
    value, hit = measured(F.col("true_range"), F.col("z"), lidar)
    return ranged.withColumns({"range": value, "is_hit": hit, "kept": F.col("u") >= lidar.dropout_prob}).drop("u", "z")


def endpoints(beams: DataFrame, x: str = "est_x", y: str = "est_y", theta: str = "est_theta") -> DataFrame:
    """Beams as rays x0, y0, x1, y1 from the pose by which the map is written."""
    heading = F.col("angle") + F.col(theta)
    return beams.withColumns({"x0": F.col(x), "y0": F.col(y), "x1": F.col(x) + F.col("range") * F.cos(heading), "y1": F.col(y) + F.col("range") * F.sin(heading)})


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside, by crossings of the ray to the right; a side counts with its lower end only."""
    n = F.size(ring)

    def crosses(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, (k + 1) % n)
        straddles = (a["y"] > y) != (b["y"] > y)
        rise = F.when(straddles, b["y"] - a["y"]).otherwise(F.lit(1.0))
        return straddles & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / rise)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def truth(scenes: DataFrame, grid: Grid, time: float) -> DataFrame:
    """(run_id, row, col, occupied) of every cell: whether its centre lies in an obstacle at a time. Obstacles are filled line by line."""
    spark = scenes.sparkSession
    cells = spark.range(grid.size).select(F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))
    rings = scenes.select("run_id", F.posexplode("rings").alias("_ring", "_points"))
    polygons = shapes.polygon_cells(shapes.edges(rings, "_points", ["run_id", "_ring"]), grid, ["run_id", "_ring"])
    discs = shapes.disc_cells(scenes.select("run_id", F.inline(discs_at(F.lit(time)))), grid, ["run_id"])
    covered = polygons.select("run_id", "row", "col").unionByName(discs).distinct().withColumn("occupied", F.lit(True))
    every = cells.crossJoin(F.broadcast(scenes.select("run_id")))  # one row for a run
    return every.join(covered, ["run_id", "row", "col"], "left").select("run_id", "row", "col", F.coalesce("occupied", F.lit(False)).alias("occupied"))
