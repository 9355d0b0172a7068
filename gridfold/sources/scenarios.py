"""The scenarios, their trajectories, and the tables that describe a run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridfold.params import Disc, EvidenceModel, Grid, Lidar, Mover, OdometryNoise, Polygon, Pose, RunConfig, Scenario, Trajectory, composed, inverted, wrap

#: Start and velocity of the disc by direction of its motion. Fixed values.
MOTIONS = {"approaching": (26.0, 20.0, -1.2, 0.0), "receding": (16.4, 20.0, 1.2, 0.0), "crossing": (20.0, 13.6, 0.0, 1.6)}
DIRECTIONS = tuple(MOTIONS)
#: Odometry of a scanner vehicle, at scale 1. Fixed values.
SCANNER_ODOMETRY = OdometryNoise(0.02, 0.004, 0.02)
STREET_LIDAR = Lidar(30.0, 0.5, 360.0, 0.03, 0.02)
#: The odometry's own random stream beside the run's seed. A fixed value, as the seed of `Scenario` is.
ODOMETRY_STREAM = 1


def arc(speed: float, yaw_rate: float, dt: float) -> Pose:
    """Displacement in the body frame over one interval of a constant twist."""
    turn = yaw_rate * dt
    if abs(yaw_rate) < 1e-12:
        return Pose(speed * dt, 0.0, 0.0)
    radius = speed / yaw_rate
    return Pose(radius * math.sin(turn), radius * (1.0 - math.cos(turn)), turn)


def constant_twist(start: Pose, speed: float, yaw_rate: float, dt: float, steps: int) -> Trajectory:
    """`steps` + 1 poses; times are multiples of dt."""
    if steps < 0 or dt <= 0:
        raise ValueError("steps must not be negative, and dt must be positive")
    made = chained(start, ((speed, yaw_rate, steps),), dt)
    return Trajectory(made.poses, tuple(i * dt for i in range(steps + 1)))


def chained(start: Pose, segments: tuple[tuple[float, float, int], ...], dt: float) -> Trajectory:
    """Twists (speed, yaw rate, steps) one after the other; times are summed up."""
    poses, times = [Pose(start.x, start.y, wrap(start.theta))], [0.0]
    for speed, yaw_rate, steps in segments:
        for _ in range(steps):
            poses.append(composed(poses[-1], arc(speed, yaw_rate, dt)))
            times.append(times[-1] + dt)
    return Trajectory(tuple(poses), tuple(times))


def urban_block() -> Scenario:
    """A street of 60 by 40 m driven from end to end. The geometry is fixed values."""
    boxes = (
        (4.0, 26.0, 20.0, 38.0),
        (26.0, 26.0, 42.0, 38.0),
        (48.0, 26.0, 58.0, 38.0),
        (6.0, 2.0, 22.0, 12.0),
        (30.0, 2.0, 46.0, 12.0),
        (10.0, 24.0, 14.5, 25.8),
        (32.0, 24.0, 36.5, 25.8),
    )
    discs = ((24.0, 24.6, 0.3), (46.0, 24.6, 0.3), (28.0, 15.4, 0.6), (52.0, 23.6, 1.2))
    return Scenario(
        "urban_block",
        Grid(0.2, 200, 300),
        STREET_LIDAR,
        chained(Pose(4.0, 20.0), ((4.7, 0.0, 18), (4.7, -0.12, 10), (4.7, 0.12, 10), (4.7, 0.0, 12)), 0.2),
        tuple(Polygon.rectangle(*b) for b in boxes),
        tuple(Disc(*d) for d in discs),
    )


def dynamic_corridor(direction: str, model: EvidenceModel | None = None) -> Scenario:
    """A standing sensor in a corridor with one disc that moves. The geometry is fixed values."""
    if direction not in MOTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    return Scenario(
        f"dynamic_corridor_{direction}",
        Grid(0.2, 120, 200, 0.0, 8.0),
        STREET_LIDAR,
        constant_twist(Pose(10.0, 20.0), 0.0, 0.0, 0.2, 40),
        (Polygon.rectangle(0.0, 9.0, 40.0, 10.0), Polygon.rectangle(0.0, 30.0, 40.0, 31.0)),
        (Disc(34.0, 14.0, 0.8),),
        (Mover(*MOTIONS[direction], 1.0),),
        model or EvidenceModel(),
    )


def enclosed_room(steps: int = 8) -> Scenario:
    """A closed room seen from its centre, without noise. The geometry is fixed values."""
    low, high, outer = 0.70, 10.60, 11.30
    walls = ((0.0, 0.0, outer, low), (0.0, high, outer, outer), (0.0, 0.0, low, outer), (high, 0.0, outer, outer))
    middle = 0.5 * (low + high)
    return Scenario(
        "enclosed_room",
        Grid(0.25, 46, 46),
        Lidar(40.0, 0.25, 360.0, 0.0, 0.0),
        constant_twist(Pose(middle, middle), 0.0, 0.0, 0.2, steps),
        tuple(Polygon.rectangle(*w) for w in walls),
    )


SCENARIOS = {"urban_block": urban_block, "enclosed_room": enclosed_room} | {f"dynamic_corridor_{d}": (lambda d=d: dynamic_corridor(d)) for d in DIRECTIONS}


def variates(spark: SparkSession, scenario: Scenario, sweeps: int, run_id: str) -> DataFrame:
    """(run_id, scan_idx, beam_idx, u, z): of each sweep first the dropout's uniform, then the noise's normal variates.

    One generator for the run, since a normal variate takes a varying number of raw draws: it can't be
    made apart for each sweep. Needed only by simulation; recorded sweeps don't come here.
    """
    rng, n = np.random.default_rng(scenario.seed), scenario.lidar.beams
    drawn = [(rng.random(n), rng.normal(0.0, 1.0, n)) for _ in range(sweeps)]
    frame = pd.DataFrame({"scan_idx": np.repeat(np.arange(sweeps, dtype=np.int32), n), "beam_idx": np.tile(np.arange(n, dtype=np.int32), sweeps), "u": np.concatenate([u for u, _ in drawn]), "z": np.concatenate([z for _, z in drawn])})
    return spark.createDataFrame(frame.assign(run_id=run_id)[["run_id", "scan_idx", "beam_idx", "u", "z"]])


def increments(scenario: Scenario, trajectory: Trajectory, noise: OdometryNoise) -> list[Pose]:
    """Motion between poses as odometry gives it; three draws for each, whatever the noise is. The order of draws is fixed: results depend on it."""
    rng = np.random.default_rng([scenario.seed, ODOMETRY_STREAM])
    made = []
    for before, after in zip(trajectory.poses, trajectory.poses[1:], strict=False):
        d = composed(inverted(before), after)
        n0, n1, n2 = rng.normal(0.0, 1.0, 3).tolist()
        distance, turn = math.hypot(d.x, d.y), abs(d.theta)
        heading = noise.heading_std_per_m * distance + noise.heading_std_per_rad * turn
        along = noise.translation_std_per_m * distance
        made.append(Pose(d.x + n0 * along, d.y + n1 * along, wrap(d.theta + n2 * heading)))
    return made


def dead_reckoned(start: Pose, moves: list[Pose]) -> list[Pose]:
    poses = [start]
    for move in moves:
        poses.append(composed(poses[-1], move))
    return poses


def poses(spark: SparkSession, scenario: Scenario, config: RunConfig, run_id: str) -> DataFrame:
    """(run_id, scan_idx, time, x, y, theta, est_x, est_y, est_theta): true poses, and those by which the map is written."""
    path = scenario.trajectory if config.max_steps is None else scenario.trajectory.subsample(config.max_steps)
    believed = list(path.poses) if config.odometry is None else dead_reckoned(path.poses[0], increments(scenario, path, config.odometry))
    rows = [(run_id, i, t, p.x, p.y, p.theta, e.x, e.y, e.theta) for i, (t, p, e) in enumerate(zip(path.times, path.poses, believed, strict=True))]
    return spark.createDataFrame(rows, "run_id string, scan_idx int, time double, x double, y double, theta double, est_x double, est_y double, est_theta double")


def scene(spark: SparkSession, scenario: Scenario, run_id: str) -> DataFrame:
    """One row for a run: edges, discs and movers as arrays."""
    floats = lambda *v: tuple(map(float, v))
    edges = [floats(*e) for p in scenario.polygons for e in p.edges()]
    rings = [[floats(*v) for v in p.vertices] for p in scenario.polygons]
    discs = [floats(d.x, d.y, d.r) for d in scenario.discs]
    movers = [floats(m.x, m.y, m.vx, m.vy, m.r) for m in scenario.movers]
    schema = (
        "run_id string, edges array<struct<ax:double,ay:double,bx:double,by:double>>, rings array<array<struct<x:double,y:double>>>, "
        "discs array<struct<x:double,y:double,r:double>>, movers array<struct<x:double,y:double,vx:double,vy:double,r:double>>"
    )
    return spark.createDataFrame([(run_id, edges, rings, discs, movers)], schema)
