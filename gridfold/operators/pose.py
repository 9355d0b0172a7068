"""Odometry as DataFrames: increments by lag, dead reckoning by running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions.scalars import pose, relative_motion, wrap_angle


def increments(poses: DataFrame) -> DataFrame:
    """(run_id, scan_idx, dx, dy, dtheta): motion since the sweep before, in its frame; the first sweep has none."""
    now = pose(F.col("x"), F.col("y"), F.col("theta"))
    before = F.lag(now).over(Window.partitionBy("run_id").orderBy("scan_idx"))
    moved = poses.withColumns({"_now": now, "_before": before}).filter(F.col("_before").isNotNull())
    d = relative_motion(F.col("_before"), F.col("_now"))
    return moved.select("run_id", "scan_idx", d["x"].alias("dx"), d["y"].alias("dy"), d["theta"].alias("dtheta"))


def corrupted(moves: DataFrame, draws: DataFrame, noise) -> DataFrame:
    """Increments with odometry noise from drawn variates (run_id, scan_idx, n0, n1, n2)."""
    joined = moves.join(draws, ["run_id", "scan_idx"])
    distance, turn = F.hypot("dx", "dy"), F.abs("dtheta")
    along = noise.translation_std_per_m * distance
    heading = noise.heading_std_per_m * distance + noise.heading_std_per_rad * turn
    return joined.select("run_id", "scan_idx", (F.col("dx") + F.col("n0") * along).alias("dx"), (F.col("dy") + F.col("n1") * along).alias("dy"), wrap_angle(F.col("dtheta") + F.col("n2") * heading).alias("dtheta"))


def dead_reckon(moves: DataFrame, x0: float, y0: float, theta0: float) -> DataFrame:
    """(run_id, scan_idx, x, y, theta) after each increment: the heading is a running sum, the position one of turned increments."""
    upto = Window.partitionBy("run_id").orderBy("scan_idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run_id").orderBy("scan_idx").rowsBetween(Window.unboundedPreceding, -1)
    turned = moves.withColumns({"_h": theta0 + F.coalesce(F.sum("dtheta").over(before), F.lit(0.0)), "theta": wrap_angle(theta0 + F.sum("dtheta").over(upto))})
    c, s = F.cos("_h"), F.sin("_h")
    turned = turned.withColumns({"_x": c * F.col("dx") - s * F.col("dy"), "_y": s * F.col("dx") + c * F.col("dy")})
    return turned.select("run_id", "scan_idx", (x0 + F.sum("_x").over(upto)).alias("x"), (y0 + F.sum("_y").over(upto)).alias("y"), "theta")


def subsample(poses: DataFrame, count: int, n: int) -> DataFrame:
    """`count` of the `n` poses of each run, evenly by index with halves to even, numbered anew."""
    if count >= n:
        return poses
    if count == 1:
        return poses.filter("scan_idx = 0")
    picks = poses.sparkSession.range(count).select(F.col("id").cast("int").alias("pick"), F.rint(F.col("id") * (n - 1) / (count - 1)).cast("int").alias("scan_idx"))
    return poses.join(F.broadcast(picks), "scan_idx").withColumn("scan_idx", F.col("pick")).drop("pick").select(*poses.columns)
