"""The library's registered queries: each operator over the driver's tables, with the same in SQL.

No table holds range sensors, so beams are derived from `events` by arithmetic that both engines
share: a sweep is a day, and an event is a beam from the sensor's place on that day. All rows of the table take part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.functions import scalars
from gridfold.operators import evidence, lidar, match, pose, score, shapes, traverse
from gridfold.params import Disc, EvidenceModel, Grid, Lidar, Mover, Polygon, Pose, Scenario, SearchWindow, Trajectory
from gridfold.plans import report, studies
from gridfold.plans import run as runs
from gridfold.session import checkpoint
from gridfold.sources import scenarios

GRID = Grid(0.25, 160, 240)
SMALL = Grid(0.25, 90, 130)
MODEL = EvidenceModel()
SWEEP = ["scan_idx"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def number(x: float) -> str:
    """A double literal that DuckDB reads as the same double."""
    return f"CAST('{x!r}' AS DOUBLE)"


L = {k: number(getattr(MODEL, k)) for k in ("l_prior", "l_free", "l_occupied", "l_min", "l_max", "l_decision")}

# Tables derived from events ---------------------------------------------------------------------


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_idx, beam_idx, x0, y0, x1, y1, is_hit): one beam for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("int")
    e = F.col("event_id")
    x0 = 30 + day / F.lit(8.0) + 0.06
    return events.select(
        day.alias("scan_idx"),
        e.alias("beam_idx"),
        x0.alias("x0"),
        F.lit(20.03).alias("y0"),
        (x0 + ((e * 37) % 401 - 200) / F.lit(17.0)).alias("x1"),
        (20.03 + ((e * 53) % 307 - 153) / F.lit(19.0)).alias("y1"),
        (F.col("event_type") != "error").alias("is_hit"),
    )


BEAMS = """days AS (SELECT event_id, event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS scan_idx FROM events),
placed AS (SELECT *, CAST(30 AS DOUBLE) + scan_idx / 8.0::DOUBLE + 0.06::DOUBLE AS x0, 20.03::DOUBLE AS y0 FROM days),
beams AS (SELECT scan_idx, event_id AS beam_idx, x0, y0, x0 + ((event_id * 37) % 401 - 200) / 17.0::DOUBLE AS x1,
  20.03::DOUBLE + ((event_id * 53) % 307 - 153) / 19.0::DOUBLE AS y1, event_type <> 'error' AS is_hit FROM placed)"""


def visits_sql(grid: Grid, beams_sql: str = BEAMS) -> str:
    """Walks by running counts over the sorted crossings, where the engine under test has closed forms."""
    res = number(grid.resolution)
    return f"""{beams_sql},
starts AS (SELECT *, CAST(floor(x0 / {res}) AS BIGINT) AS c0, CAST(floor(y0 / {res}) AS BIGINT) AS r0, CAST(sign(x1 - x0) AS BIGINT) AS sx, CAST(sign(y1 - y0) AS BIGINT) AS sy FROM beams),
xs AS (SELECT beam_idx, 0 AS axis, unnest(generate_series(0, abs(CAST(floor(x1 / {res}) AS BIGINT) - c0) + 1)) AS k, c0 + (sx > 0)::BIGINT AS line, sx AS s, x0 AS a, x1 - x0 AS d FROM starts WHERE sx <> 0),
ys AS (SELECT beam_idx, 1 AS axis, unnest(generate_series(0, abs(CAST(floor(y1 / {res}) AS BIGINT) - r0) + 1)) AS k, r0 + (sy > 0)::BIGINT AS line, sy AS s, y0 AS a, y1 - y0 AS d FROM starts WHERE sy <> 0),
crossings AS (SELECT beam_idx, axis, ((line + s * k) * {res} - a) / d AS t FROM (SELECT * FROM xs UNION ALL SELECT * FROM ys)),
events_ AS (SELECT beam_idx, axis, t FROM crossings WHERE t <= 1 UNION ALL SELECT beam_idx, -1, -1 FROM starts),
ordered AS (SELECT beam_idx, row_number() OVER w - 1 AS step, count(*) FILTER (axis = 0) OVER w AS nx, count(*) FILTER (axis = 1) OVER w AS ny,
  count(*) OVER (PARTITION BY beam_idx) - 1 AS last FROM events_ WINDOW w AS (PARTITION BY beam_idx ORDER BY t, axis ROWS UNBOUNDED PRECEDING)),
visits AS (SELECT s.scan_idx, s.beam_idx, s.is_hit, CAST(o.step AS INTEGER) AS step, CAST(s.r0 + s.sy * o.ny AS INTEGER) AS row, CAST(s.c0 + s.sx * o.nx AS INTEGER) AS col, o.step = o.last AS is_terminal
  FROM ordered o JOIN starts s ON s.beam_idx = o.beam_idx
  WHERE s.r0 + s.sy * o.ny BETWEEN 0 AND {grid.rows - 1} AND s.c0 + s.sx * o.nx BETWEEN 0 AND {grid.cols - 1} AND s.r0 BETWEEN 0 AND {grid.rows - 1} AND s.c0 BETWEEN 0 AND {grid.cols - 1})"""


TOUCH = f"""{visits_sql(GRID)},
touch AS (SELECT scan_idx, row, col, bool_or(is_terminal AND is_hit) AS is_occ, count(*) AS n FROM visits GROUP BY ALL)"""
CELLS = f"""{TOUCH},
cells AS (SELECT row, col, list_reduce(list_prepend({L["l_prior"]}, list(CASE WHEN is_occ THEN {L["l_occupied"]} ELSE {L["l_free"]} END ORDER BY scan_idx)),
  lambda a, x: least(greatest(a + x, {L["l_min"]}), {L["l_max"]})) AS log_odds, count(*) AS observed, count(*) FILTER (is_occ) AS occ_obs FROM touch GROUP BY row, col)"""
#: Truth for scoring: a cell's centre in one of two discs or one rectangle. `every` has every cell.
EVERY = f"""every AS (SELECT CAST(i // {GRID.cols} AS INTEGER) AS row, CAST(i % {GRID.cols} AS INTEGER) AS col FROM range({GRID.size}) t(i)),
centres AS (SELECT *, (col + 0.5) * 0.25::DOUBLE AS x, (row + 0.5) * 0.25::DOUBLE AS y FROM every),
truth AS (SELECT row, col, (x - 34.1) * (x - 34.1) + (y - 24.3) * (y - 24.3) <= 2.25 OR (x - 27.3) * (x - 27.3) + (y - 15.2) * (y - 15.2) <= 6.25
  OR (x > 38.1 AND x < 43.4 AND y > 17.2 AND y < 22.6) AS occupied FROM centres)"""
SCORED = f"""{CELLS}, {EVERY},
scored AS (SELECT t.row, t.col, t.occupied, coalesce(c.log_odds, {L["l_prior"]}) AS log_odds, coalesce(c.observed, 0) AS observed, coalesce(c.occ_obs, 0) AS occ_obs, coalesce(c.observed, 0) > 0 AS scored
  FROM truth t LEFT JOIN cells c ON c.row = t.row AND c.col = t.col),
called AS (SELECT *, CASE WHEN log_odds <= {L["l_prior"]} - {L["l_decision"]} THEN 1 WHEN log_odds >= {L["l_prior"]} + {L["l_decision"]} THEN 2 ELSE 0 END AS state FROM scored)"""
SCENE = Scenario(
    "contract", GRID, Lidar(30.0, 0.5, 360.0, 0.03, 0.02), Trajectory((Pose(30.06, 20.03),), (0.0,)),
    (Polygon.rectangle(38.1, 17.2, 43.4, 22.6),), (Disc(34.1, 24.3, 1.5), Disc(27.3, 15.2, 2.5)),
)


def visits(spark, sf_dir, grid: Grid = GRID) -> DataFrame:
    return traverse.walk(traverse.dealt(beams(spark, sf_dir), "beam_idx"), grid, ["scan_idx", "beam_idx", "is_hit"])


def touch(spark, sf_dir) -> DataFrame:
    rays = traverse.alike(beams(spark, sf_dir), SWEEP)
    return evidence.touches(traverse.walk(rays, GRID, ["scan_idx", "is_hit", "n"]), SWEEP)


def cells(spark, sf_dir) -> DataFrame:
    return evidence.fold(touch(spark, sf_dir), [], MODEL)


def truth(spark) -> DataFrame:
    return lidar.truth(scenarios.scene(spark, SCENE, "contract"), GRID, 0.0).drop("run_id")


def scored(spark, sf_dir) -> DataFrame:
    """Every cell with log_odds, observed, occ_obs, truth, and scored where it was observed. The walk is evaluated once, however often a score reads its cells: a dense map is written."""
    return checkpoint(evidence.dense(cells(spark, sf_dir), GRID, MODEL).join(truth(spark), ["row", "col"]).withColumn("scored", F.col("observed") > 0))


def events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")


def r9(c) -> object:
    return F.round(c, 6)


# Scalars ----------------------------------------------------------------------------------------


@query("SELECT event_id, round(ln(p / (1 - p)), 6) AS l, round(CASE WHEN ln(p / (1 - p)) >= 0 THEN 1 / (1 + exp(-ln(p / (1 - p)))) ELSE exp(ln(p / (1 - p))) / (1 + exp(ln(p / (1 - p)))) END, 6) AS p FROM (SELECT event_id, (event_id % 997 + 1) / 1000.0::DOUBLE AS p FROM events)")
def log_odds_roundtrip(spark, sf_dir):
    p = events(spark, sf_dir).select("event_id", ((F.col("event_id") % 997 + 1) / F.lit(1000.0)).alias("p")).withColumn("l", scalars.log_odds("p"))
    return p.select("event_id", r9("l").alias("l"), r9(scalars.probability("l")).alias("p"))


_SPREAD = "(SELECT event_id, ((event_id * 37) % 401 - 200) / 50.0::DOUBLE AS l FROM events)"


def _spread(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", (((F.col("event_id") * 37) % 401 - 200) / F.lit(50.0)).alias("l"))


@query(f"SELECT event_id, CASE WHEN l <= {L['l_prior']} - {L['l_decision']} THEN 1 WHEN l >= {L['l_prior']} + {L['l_decision']} THEN 2 ELSE 0 END AS state FROM {_SPREAD}")
def classify(spark, sf_dir):
    return _spread(spark, sf_dir).select("event_id", scalars.state("l", MODEL).alias("state"))


@query(f"SELECT event_id, round(least(greatest(l, {L['l_min']}), {L['l_max']}), 6) AS clipped, l <= {L['l_min']} + 1e-9 OR l >= {L['l_max']} - 1e-9 AS at_clamp FROM {_SPREAD}")
def clip_and_clamp(spark, sf_dir):
    return _spread(spark, sf_dir).select("event_id", r9(scalars.clamp("l", MODEL)).alias("clipped"), scalars.at_clamp("l", MODEL).alias("at_clamp"))


@query("SELECT round(-ln(0.7/0.3) / ln(0.4/0.6), 6) AS forget_ratio, round(-ln(0.65/0.35) / ln(0.4/0.6), 6) AS observations_to_free, round((ln(0.65/0.35) - ln(0.12/0.88)) / ln(0.7/0.3), 6) AS observations_to_occupied, round(ln(0.12/0.88), 6) AS l_min, round(ln(0.97/0.03), 6) AS l_max")
def model_constants(spark, sf_dir):
    names = ("forget_ratio", "observations_to_free", "observations_to_occupied", "l_min", "l_max")
    return spark.range(1).select(*(r9(F.lit(getattr(MODEL, n))).alias(n) for n in names))


@query(f"WITH {BEAMS} SELECT beam_idx, CAST(floor((y1 + 4) / 0.37::DOUBLE) AS BIGINT) AS row, CAST(floor((x1 - 3) / 0.37::DOUBLE) AS BIGINT) AS col FROM beams")
def world_to_cell(spark, sf_dir):
    grid = Grid(0.37, 130, 290, 3.0, -4.0)
    return beams(spark, sf_dir).select("beam_idx", scalars.row_of("y1", grid).alias("row"), scalars.col_of("x1", grid).alias("col"))


@query("SELECT event_id, round(3.0 + (event_id % 290 + 0.5) * 0.37::DOUBLE, 6) AS x, round(-4.0 + (event_id % 130 + 0.5) * 0.37::DOUBLE, 6) AS y FROM events")
def cell_to_world(spark, sf_dir):
    grid = Grid(0.37, 130, 290, 3.0, -4.0)
    return events(spark, sf_dir).select("event_id", r9(scalars.x_of(F.col("event_id") % 290, grid)).alias("x"), r9(scalars.y_of(F.col("event_id") % 130, grid)).alias("y"))


@query(f"WITH {EVERY} SELECT row, col, round(x, 6) AS x, round(y, 6) AS y FROM centres")
def cell_centers(spark, sf_dir):
    every = evidence.dense(spark.createDataFrame([], "row int, col int, log_odds double"), GRID, MODEL)
    return every.select("row", "col", r9(scalars.x_of("col", GRID)).alias("x"), r9(scalars.y_of("row", GRID)).alias("y"))


@query("SELECT 160 AS rows, 240 AS cols, 38400 AS size, 0.0625::DOUBLE AS cell_area, 0.0::DOUBLE AS x_min, 60.0::DOUBLE AS x_max, 0.0::DOUBLE AS y_min, 40.0::DOUBLE AS y_max, -26.5::DOUBLE AS moved_x, -12.5::DOUBLE AS moved_y")
def grid_properties(spark, sf_dir):
    moved = GRID.recentered(3.5, 7.5)
    names = dict(zip(("x_min", "x_max", "y_min", "y_max"), GRID.extent, strict=True)) | {"moved_x": moved.origin_x, "moved_y": moved.origin_y}
    ints = {"rows": GRID.rows, "cols": GRID.cols, "size": GRID.size}
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in ints.items()), F.lit(GRID.cell_area).alias("cell_area"), *(F.lit(float(v)).alias(k) for k, v in names.items()))


@query(f"WITH {BEAMS} SELECT beam_idx, floor(y1 / 0.25) BETWEEN 0 AND {SMALL.rows - 1} AND floor(x1 / 0.25) BETWEEN 0 AND {SMALL.cols - 1} AS inside FROM beams")
def in_bounds(spark, sf_dir):
    return beams(spark, sf_dir).select("beam_idx", scalars.in_bounds(scalars.row_of("y1", SMALL), scalars.col_of("x1", SMALL), SMALL).alias("inside"))


@query("SELECT event_id, round(CASE WHEN r <= -pi() THEN pi() ELSE r END, 6) AS wrapped FROM (SELECT event_id, a - 2 * pi() * round_even(a / (2 * pi()), 0) AS r FROM (SELECT event_id, ((event_id * 37) % 401 - 200) / 9.0::DOUBLE AS a FROM events))")
def wrap_angle(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r9(scalars.wrap_angle(((F.col("event_id") * 37) % 401 - 200) / F.lit(9.0))).alias("wrapped"))


@query(f"WITH {BEAMS} SELECT beam_idx, round(x0 + cos(0.3) * (x1 - x0) - sin(0.3) * (y1 - y0), 6) AS x, round(y0 + sin(0.3) * (x1 - x0) + cos(0.3) * (y1 - y0), 6) AS y FROM beams")
def se2_transform(spark, sf_dir):
    p = scalars.pose(F.col("x0"), F.col("y0"), 0.3)
    x, y = scalars.transform_point(p, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return beams(spark, sf_dir).select("beam_idx", r9(x).alias("x"), r9(y).alias("y"))


_TURN = "((beam_idx * 37) % 101 - 50) / 40.0::DOUBLE"


@query(f"WITH {BEAMS}, t AS (SELECT *, {_TURN} AS h FROM beams), i AS (SELECT *, -(cos(h) * x1 + sin(h) * y1) AS ix, sin(h) * x1 - cos(h) * y1 AS iy FROM t) SELECT beam_idx, round(ix + cos(-h) * x0 - sin(-h) * y0, 6) AS x, round(iy + sin(-h) * x0 + cos(-h) * y0, 6) AS y, round(0.2 - h, 6) AS theta FROM i")
def se2_compose_inverse(spark, sf_dir):
    h = ((F.col("beam_idx") * 37) % 101 - 50) / F.lit(40.0)
    made = scalars.relative_motion(scalars.pose(F.col("x1"), F.col("y1"), h), scalars.pose(F.col("x0"), F.col("y0"), 0.2))
    return beams(spark, sf_dir).select("beam_idx", made.alias("p")).select("beam_idx", r9("p.x").alias("x"), r9("p.y").alias("y"), r9("p.theta").alias("theta"))


# Poses ------------------------------------------------------------------------------------------

_POSES = f"{BEAMS}, poses AS (SELECT scan_idx, min(x0) AS x, min(y0) + (scan_idx * 7 % 5) / 10.0::DOUBLE AS y, (scan_idx * 11 % 13 - 6) / 20.0::DOUBLE AS theta FROM beams GROUP BY scan_idx)"


def _poses(spark, sf_dir):
    s = F.col("scan_idx")
    per_day = beams(spark, sf_dir).groupBy("scan_idx").agg(F.min("x0").alias("x"), F.min("y0").alias("y"))
    return per_day.select(F.lit("events").alias("run_id"), s, "x", (F.col("y") + (s * 7 % 5) / F.lit(10.0)).alias("y"), ((s * 11 % 13 - 6) / F.lit(20.0)).alias("theta"))


_MOVES = f"""{_POSES}, l AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(theta) OVER o AS pt FROM poses WINDOW o AS (ORDER BY scan_idx)),
moves AS (SELECT scan_idx, cos(pt) * (x - px) + sin(pt) * (y - py) AS dx, -sin(pt) * (x - px) + cos(pt) * (y - py) AS dy, theta - pt AS dtheta FROM l WHERE px IS NOT NULL)"""


@query(f"WITH {_MOVES} SELECT scan_idx, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dtheta, 6) AS dtheta FROM moves")
def relative_motion_lag(spark, sf_dir):
    return pose.increments(_poses(spark, sf_dir)).select("scan_idx", r9("dx").alias("dx"), r9("dy").alias("dy"), r9("dtheta").alias("dtheta"))


@query(f"""WITH {_MOVES}, first AS (SELECT x AS fx, y AS fy, theta AS ft FROM poses ORDER BY scan_idx LIMIT 1)
SELECT m.scan_idx, round(p.x, 5) AS x, round(p.y, 5) AS y, round(p.theta, 5) AS theta FROM moves m JOIN poses p ON p.scan_idx = m.scan_idx""")
def dead_reckon_window(spark, sf_dir):
    """Exact increments lead back to the poses that they came from."""
    poses = _poses(spark, sf_dir)
    first = poses.orderBy("scan_idx").first()
    made = pose.dead_reckon(pose.increments(poses), first.x, first.y, first.theta)
    return made.select("scan_idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("theta", 5).alias("theta"))


@query(f"WITH {_MOVES} SELECT scan_idx, round(dx + (scan_idx % 3 - 1) * 0.02::DOUBLE * sqrt(dx * dx + dy * dy), 6) AS dx, round(dy + (scan_idx % 5 - 2) * 0.02::DOUBLE * sqrt(dx * dx + dy * dy), 6) AS dy, round(dtheta + (scan_idx % 7 - 3) * (0.004::DOUBLE * sqrt(dx * dx + dy * dy) + 0.02::DOUBLE * abs(dtheta)), 6) AS dtheta FROM moves")
def odometry_noise(spark, sf_dir):
    moves = pose.increments(_poses(spark, sf_dir))
    s = F.col("scan_idx")
    draws = moves.select("run_id", "scan_idx", (s % 3 - 1).cast("double").alias("n0"), (s % 5 - 2).cast("double").alias("n1"), (s % 7 - 3).cast("double").alias("n2"))
    made = pose.corrupted(moves, draws, scenarios.SCANNER_ODOMETRY)
    return made.select("scan_idx", r9("dx").alias("dx"), r9("dy").alias("dy"), r9("dtheta").alias("dtheta"))


@query(f"WITH {_POSES}, n AS (SELECT *, row_number() OVER (ORDER BY scan_idx) - 1 AS i, count(*) OVER () AS n FROM poses), k AS (SELECT unnest(generate_series(0, 8)) AS j) SELECT CAST(j AS INTEGER) AS pick, scan_idx FROM k JOIN n ON i = CAST(round_even(j * (n - 1) / 8.0::DOUBLE, 0) AS BIGINT)")
def subsample(spark, sf_dir):
    poses = _poses(spark, sf_dir)
    numbered = poses.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("scan_idx")) - 1).alias("scan_idx"), F.col("scan_idx").alias("day"))
    return pose.subsample(numbered, 9, poses.count()).select(F.col("scan_idx").alias("pick"), F.col("day").alias("scan_idx"))


@query(f"WITH {_POSES} SELECT scan_idx, round(sqrt(0.01 + 0.04), 6) AS position_error, round(0.05, 6)::DOUBLE AS heading_error FROM poses")
def pose_error(spark, sf_dir):
    truth_ = scalars.pose(F.col("x"), F.col("y"), F.col("theta"))
    estimate = scalars.pose(F.col("x") + 0.1, F.col("y") - 0.2, F.col("theta") + 0.05 + 2 * math.pi)
    return _poses(spark, sf_dir).select("scan_idx", r9(scalars.position_error(estimate, truth_)).alias("position_error"), r9(scalars.heading_error(estimate, truth_)).alias("heading_error"))


# Sensor -----------------------------------------------------------------------------------------


@query(f"WITH {_POSES}, b AS (SELECT unnest(generate_series(0, 719)) AS i) SELECT scan_idx, CAST(i AS INTEGER) AS beam_idx, round((i - 359.5) * 0.5 * pi() / 180, 6) AS angle FROM poses, b")
def beam_angles(spark, sf_dir):
    return lidar.beam_angles(_poses(spark, sf_dir), SCENE.lidar).select("scan_idx", "beam_idx", r9("angle").alias("angle"))


_SENSED = f"{BEAMS}, sensed AS (SELECT *, (beam_idx * 37 % 720 - 359.5) * (pi() / 360) AS angle, 1.0 + beam_idx * 53 % 290 / 10.0::DOUBLE AS range FROM beams)"


def _sensed(spark, sf_dir):
    b = F.col("beam_idx")
    return beams(spark, sf_dir).withColumns({"angle": (b * 37 % 720 - 359.5) * (math.pi / 360), "range": 1.0 + b * 53 % 290 / F.lit(10.0), "est_theta": F.lit(0.25)})


@query(f"WITH {_SENSED} SELECT beam_idx, round(x0 + range * cos(angle + 0.25), 6) AS x, round(y0 + range * sin(angle + 0.25), 6) AS y FROM sensed")
def endpoints(spark, sf_dir):
    sensed = _sensed(spark, sf_dir).withColumnsRenamed({"x0": "est_x", "y0": "est_y"}).drop("x1", "y1")
    return lidar.endpoints(sensed).select("beam_idx", r9("x1").alias("x"), r9("y1").alias("y"))


@query(f"WITH {_SENSED}, h AS (SELECT *, row_number() OVER (PARTITION BY scan_idx ORDER BY beam_idx) AS n FROM sensed WHERE is_hit) SELECT scan_idx, round(range * cos(angle), 6) AS px, round(range * sin(angle), 6) AS py FROM h WHERE (n - 1) % 4 = 0")
def body_points(spark, sf_dir):
    sensed = _sensed(spark, sf_dir).withColumn("run_id", F.lit("events"))
    return match.body_points(sensed, 4).select("scan_idx", r9("px").alias("px"), r9("py").alias("py"))


@query(f"WITH {_POSES} SELECT scan_idx, round(26.0 - 1.2::DOUBLE * scan_idx, 6) AS cx, round(20.0 + 0.5::DOUBLE * scan_idx, 6) AS cy, 1.3::DOUBLE AS speed, round(-1.2 / 1.3, 6)::DOUBLE AS ux FROM poses")
def mover_positions(spark, sf_dir):
    mover = Mover(26.0, 20.0, -1.2, 0.5, 1.0)
    scene = scenarios.scene(spark, Scenario("m", GRID, SCENE.lidar, SCENE.trajectory, movers=(mover,)), "events")
    placed = _poses(spark, sf_dir).join(F.broadcast(scene), "run_id").withColumn("d", F.element_at(lidar.discs_at(F.col("scan_idx").cast("double")), 1))
    return placed.select("scan_idx", r9("d.x").alias("cx"), r9("d.y").alias("cy"), F.lit(mover.speed).alias("speed"), r9(F.lit(mover.direction[0])).alias("ux"))


_RAYS = f"{BEAMS}, rays AS (SELECT *, (x1 - x0) / d AS dx, (y1 - y0) / d AS dy FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d FROM beams) WHERE d > 0)"


def _rays(spark, sf_dir):
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = F.sqrt(dx * dx + dy * dy)
    return beams(spark, sf_dir).withColumn("d", d).filter("d > 0").withColumns({"dx": dx / F.col("d"), "dy": dy / F.col("d")})


def _disc_sql(cx: float, cy: float, r: float) -> str:
    half = f"((x0 - {cx}) * dx + (y0 - {cy}) * dy)"
    under = f"({half} * {half} - ((x0 - {cx}) * (x0 - {cx}) + (y0 - {cy}) * (y0 - {cy}) - {r * r}))"
    return f"CASE WHEN {under} < 0 THEN 1e9 WHEN -{half} - sqrt({under}) > 0 THEN -{half} - sqrt({under}) WHEN -{half} + sqrt({under}) > 0 THEN -{half} + sqrt({under}) ELSE 1e9 END"


def _box_sql(x0: float, y0: float, x1: float, y1: float) -> str:
    """Slab by slab, for a box that doesn't hold the sensor."""
    tx = f"CASE WHEN abs(dx) < 1e-12 THEN CASE WHEN x0 BETWEEN {x0} AND {x1} THEN -1e9 ELSE 2e9 END ELSE least(({x0} - x0) / dx, ({x1} - x0) / dx) END"
    fx = f"CASE WHEN abs(dx) < 1e-12 THEN 1e9 ELSE greatest(({x0} - x0) / dx, ({x1} - x0) / dx) END"
    ty = tx.replace("dx", "dy").replace(f"{x0} - x0", f"{y0} - y0").replace(f"{x1} - x0", f"{y1} - y0").replace(f"x0 BETWEEN {x0} AND {x1}", f"y0 BETWEEN {y0} AND {y1}")
    fy = fx.replace("dx", "dy").replace(f"{x0} - x0", f"{y0} - y0").replace(f"{x1} - x0", f"{y1} - y0")
    return f"CASE WHEN greatest({tx}, {ty}) <= least({fx}, {fy}) AND greatest({tx}, {ty}) > 0 THEN greatest({tx}, {ty}) ELSE 1e9 END"


_FAR = lambda c: r9(F.least(c, F.lit(1e9)))


@query(f"WITH {_RAYS} SELECT beam_idx, round({_disc_sql(34.1, 24.3, 1.5)}, 6) AS range FROM rays")
def circle_range(spark, sf_dir):
    p = [F.col(c) for c in ("x0", "y0", "dx", "dy")]
    return _rays(spark, sf_dir).select("beam_idx", _FAR(scalars.circle_range(*p, F.lit(34.1), F.lit(24.3), F.lit(1.5))).alias("range"))


@query(f"WITH {_RAYS} SELECT beam_idx, round({_box_sql(38.1, 17.2, 43.4, 22.6)}, 6) AS range FROM rays")
def polygon_range(spark, sf_dir):
    rays = _rays(spark, sf_dir).crossJoin(F.broadcast(scenarios.scene(spark, SCENE, "c")))
    p = [F.col(c) for c in ("x0", "y0", "dx", "dy")]
    return rays.select("beam_idx", _FAR(lidar.nearest_range(*p, F.array().cast("array<struct<x:double,y:double,r:double>>"), F.col("edges"))).alias("range"))


_NEAREST = f"least({_disc_sql(34.1, 24.3, 1.5)}, {_disc_sql(27.3, 15.2, 2.5)}, {_box_sql(38.1, 17.2, 43.4, 22.6)})"


@query(f"WITH {_RAYS} SELECT beam_idx, round({_NEAREST}, 6) AS range FROM rays")
def nearest_range(spark, sf_dir):
    rays = _rays(spark, sf_dir).crossJoin(F.broadcast(scenarios.scene(spark, SCENE, "c")))
    p = [F.col(c) for c in ("x0", "y0", "dx", "dy")]
    return rays.select("beam_idx", _FAR(lidar.nearest_range(*p, F.col("discs"), F.col("edges"))).alias("range"))


_NOISY = f"{BEAMS}, noisy AS (SELECT beam_idx, scan_idx, d, d + z * 0.3::DOUBLE AS m, d < 8 AND d + z * 0.3::DOUBLE < 8 AS hit, u FROM (SELECT beam_idx, scan_idx, beam_idx * 53 % 90 / 10.0::DOUBLE AS d, (beam_idx * 37 % 41 - 20) / 10.0::DOUBLE AS z, beam_idx % 50 / 50.0::DOUBLE AS u FROM beams))"
_SHORT = Lidar(8.0, 0.5, 360.0, 0.3, 0.1)


def _noisy(spark, sf_dir):
    b = F.col("beam_idx")
    value, hit = lidar.measured(b * 53 % 90 / F.lit(10.0), (b * 37 % 41 - 20) / F.lit(10.0), _SHORT)
    return beams(spark, sf_dir).select("scan_idx", "beam_idx", value.alias("range"), hit.alias("is_hit"), (b % 50 / F.lit(50.0) >= _SHORT.dropout_prob).alias("kept"))


@query(f"WITH {_NOISY} SELECT beam_idx, round(CASE WHEN hit THEN greatest(m, 0.25) ELSE 8 END, 6)::DOUBLE AS range, hit AS is_hit, u >= 0.1 AS kept FROM noisy")
def scan_noise_limit(spark, sf_dir):
    return _noisy(spark, sf_dir).select("beam_idx", r9("range").alias("range"), "is_hit", "kept")


@query(f"WITH {_NOISY} SELECT scan_idx, count(*) FILTER (u >= 0.1 AND hit) AS hits, count(*) FILTER (u >= 0.1 AND NOT hit) AS max_range_beams, count(*) FILTER (u < 0.1) AS dropped FROM noisy GROUP BY scan_idx")
def scan_counts(spark, sf_dir):
    kept = F.col("kept")
    return _noisy(spark, sf_dir).groupBy("scan_idx").agg(F.count_if(kept & F.col("is_hit")).alias("hits"), F.count_if(kept & ~F.col("is_hit")).alias("max_range_beams"), F.count_if(~kept).alias("dropped"))


@query(f"WITH {EVERY} SELECT row, col, occupied FROM truth")
def occupancy_truth(spark, sf_dir):
    return truth(spark).select("row", "col", "occupied")


#: A dart (concave) and a disc at each event's endpoint.
_DARTS = f"{BEAMS}, shapes AS (SELECT beam_idx, x1, y1, [x1, x1 + 1.6, x1 + 0.5, x1 + 0.2 + (beam_idx % 7) / 10.0::DOUBLE] AS xs, [y1, y1 + 0.3, y1 + 0.6, y1 + 1.7] AS ys, 0.3 + (beam_idx % 11) / 10.0::DOUBLE AS r FROM beams)"
_AROUND = f"""around AS (SELECT s.*, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, (row + 0.5) * 0.25::DOUBLE AS cy, (col + 0.5) * 0.25::DOUBLE AS cx
  FROM shapes s, unnest(generate_series(greatest(CAST(floor((y1 - 1.5) * 4) AS BIGINT), 0), least(CAST(floor((y1 + 2) * 4) AS BIGINT), {GRID.rows - 1}))) a(row),
  unnest(generate_series(greatest(CAST(floor((x1 - 1.5) * 4) AS BIGINT), 0), least(CAST(floor((x1 + 2) * 4) AS BIGINT), {GRID.cols - 1}))) b(col))"""
_CROSSES = " + ".join(f"CASE WHEN (ys[{i}] > cy) <> (ys[{j}] > cy) AND cx < xs[{i}] + (cy - ys[{i}]) * (xs[{j}] - xs[{i}]) / (ys[{j}] - ys[{i}]) THEN 1 ELSE 0 END" for i, j in ((1, 2), (2, 3), (3, 4), (4, 1)))


@query(f"WITH {_DARTS}, {_AROUND} SELECT row, col, count(*) AS shapes FROM around WHERE ({_CROSSES}) % 2 = 1 GROUP BY row, col")
def filled_polygons(spark, sf_dir):
    """How many darts cover each cell."""
    x, y, e = F.col("x1"), F.col("y1"), F.col("beam_idx")
    corners = ((x, y), (x + 1.6, y + 0.3), (x + 0.5, y + 0.6), (x + 0.2 + (e % 7) / F.lit(10.0), y + 1.7))
    rings = beams(spark, sf_dir).select("beam_idx", F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in corners)).alias("ring"))
    covered = shapes.polygon_cells(shapes.edges(rings, "ring", ["beam_idx"]), GRID, ["beam_idx"])
    return covered.groupBy("row", "col").agg(F.count("*").alias("shapes"))


@query(f"WITH {_DARTS}, {_AROUND} SELECT row, col, count(*) AS shapes FROM around WHERE (cx - x1) * (cx - x1) + (cy - y1) * (cy - y1) <= r * r GROUP BY row, col")
def filled_discs(spark, sf_dir):
    """How many discs cover each cell."""
    discs = beams(spark, sf_dir).select("beam_idx", F.col("x1").alias("x"), F.col("y1").alias("y"), (0.3 + (F.col("beam_idx") % 11) / F.lit(10.0)).alias("r"))
    return shapes.disc_cells(discs, GRID, ["beam_idx"]).groupBy("row", "col").agg(F.count("*").alias("shapes"))


# Traversal and evidence -------------------------------------------------------------------------


@query(f"WITH {visits_sql(GRID)} SELECT beam_idx, step, row, col FROM visits")
def traverse_cells(spark, sf_dir):
    return visits(spark, sf_dir).select("beam_idx", "step", "row", "col")


@query(f"WITH {visits_sql(SMALL)} SELECT beam_idx, count(*) AS cells, max(is_terminal) AS reached FROM visits GROUP BY beam_idx")
def traverse_counts(spark, sf_dir):
    return traverse.counts(visits(spark, sf_dir, SMALL), ["beam_idx"])


@query(f"WITH {visits_sql(SMALL)} SELECT beam_idx, row, col FROM visits WHERE is_terminal")
def terminal_mask(spark, sf_dir):
    return visits(spark, sf_dir, SMALL).filter("is_terminal").select("beam_idx", "row", "col")


@query(f"WITH {TOUCH} SELECT scan_idx, row, col, is_occ FROM touch")
def scan_update(spark, sf_dir):
    return touch(spark, sf_dir).select("scan_idx", "row", "col", "is_occ")


@query(f"""WITH {visits_sql(SMALL)}, b AS (SELECT scan_idx, count(*) AS beams, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS max_range_beams FROM beams GROUP BY scan_idx),
v AS (SELECT scan_idx, count(*) FILTER (is_terminal AND is_hit) AS placed_returns, count(*) AS cell_visits, count(DISTINCT row * 1000 + col) AS touched_cells FROM visits GROUP BY scan_idx)
SELECT b.*, coalesce(placed_returns, 0) AS placed_returns, coalesce(cell_visits, 0) AS cell_visits, coalesce(touched_cells, 0) AS touched_cells FROM b LEFT JOIN v ON v.scan_idx = b.scan_idx""")
def scan_counters(spark, sf_dir):
    return evidence.sweep_counters(visits(spark, sf_dir, SMALL), beams(spark, sf_dir), SWEEP)


@query(f"WITH {CELLS} SELECT row, col, round(log_odds, 6) AS log_odds FROM cells")
def fold_log_odds(spark, sf_dir):
    return cells(spark, sf_dir).select("row", "col", r9("log_odds").alias("log_odds"))


@query(f"WITH {CELLS} SELECT row, col, round(log_odds, 6) AS log_odds, observed, occ_obs FROM cells")
def fold_in_ranges(spark, sf_dir):
    """The same over ranges of four sweeps, whose clamped sums are put together."""
    return evidence.fold_in_ranges(touch(spark, sf_dir), [], MODEL, 4).select("row", "col", r9("log_odds").alias("log_odds"), "observed", "occ_obs")


@query(f"WITH {CELLS} SELECT row, col, observed, occ_obs FROM cells")
def observed_counts(spark, sf_dir):
    return cells(spark, sf_dir).select("row", "col", "observed", "occ_obs")


@query(f"WITH {CELLS} SELECT CASE WHEN log_odds <= {L['l_prior']} - {L['l_decision']} THEN 1 WHEN log_odds >= {L['l_prior']} + {L['l_decision']} THEN 2 ELSE 0 END AS state, count(*) AS cells, sum(observed)::BIGINT AS observed FROM cells GROUP BY 1")
def map_states(spark, sf_dir):
    """Flagship: beams are walked, folded and classified."""
    return cells(spark, sf_dir).groupBy(scalars.state("log_odds", MODEL).alias("state")).agg(F.count("*").alias("cells"), F.sum("observed").alias("observed"))


CLAMPS = (0.05, 0.12, 0.20, 0.28, 0.34)


@query(
    "WITH " + TOUCH + ", m AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {number(math.log(c / (1 - c)))})" for c in CLAMPS) + f") t(clamp, lo)), f AS (SELECT clamp, row, col, list_reduce(list_prepend({L['l_prior']}, list(CASE WHEN is_occ THEN {L['l_occupied']} ELSE {L['l_free']} END ORDER BY scan_idx)), lambda a, x: least(greatest(a + x, any_lo), {L['l_max']})) AS l FROM (SELECT *, lo AS any_lo FROM touch, m) GROUP BY clamp, row, col, any_lo) SELECT CAST(clamp AS DOUBLE) AS clamp, count(*) FILTER (l >= {L['l_decision']}) AS occupied, count(*) FILTER (l <= -{L['l_decision']}) AS free FROM f GROUP BY clamp"
)
def clamp_sweep(spark, sf_dir):
    models = [(c, 0.0, MODEL.l_free, MODEL.l_occupied, math.log(c / (1 - c)), MODEL.l_max) for c in CLAMPS]
    swept = evidence.fold_by_models(touch(spark, sf_dir), [], spark.createDataFrame(models, "model_id double, l_prior double, l_free double, l_occupied double, l_min double, l_max double"))
    return swept.groupBy(F.col("model_id").alias("clamp")).agg(F.count_if(F.col("log_odds") >= MODEL.l_decision).alias("occupied"), F.count_if(F.col("log_odds") <= -MODEL.l_decision).alias("free"))


# Moving windows ---------------------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT row - 7 AS row, col + 12 AS col, round(log_odds, 6) AS log_odds FROM cells WHERE row - 7 BETWEEN 0 AND {GRID.rows - 1} AND col + 12 BETWEEN 0 AND {GRID.cols - 1}")
def translate_grid(spark, sf_dir):
    target = Grid(0.25, GRID.rows, GRID.cols, -3.0, 1.75)
    return evidence.resample(cells(spark, sf_dir), GRID, target, MODEL, "bilinear").select("row", "col", r9("log_odds").alias("log_odds"))


_SHIFTED = Grid(0.25, GRID.rows, GRID.cols, 0.8125, 1.6875)  # 3.25 columns and 6.75 rows on


@query(f"""WITH {CELLS}, w AS (SELECT * FROM (VALUES (0, 0, 0.25 * 0.75), (0, 1, 0.25 * 0.25), (1, 0, 0.75 * 0.75), (1, 1, 0.75 * 0.25)) t(i, j, w)),
s AS (SELECT row - 6 - i AS row, col - 3 - j AS col, sum((log_odds - {L['l_prior']}) * w) AS v FROM cells, w GROUP BY ALL)
SELECT row, col, round(least(greatest(v, {L['l_min']}), {L['l_max']}), 6)::DOUBLE AS log_odds FROM s WHERE row BETWEEN 0 AND {GRID.rows - 8} AND col BETWEEN 0 AND {GRID.cols - 5}""")
def bilinear_shift(spark, sf_dir):
    return evidence.resample(cells(spark, sf_dir), GRID, _SHIFTED, MODEL, "bilinear").select("row", "col", r9("log_odds").alias("log_odds"))


@query(f"WITH {CELLS} SELECT row - 7 AS row, col - 3 AS col, round(log_odds, 6) AS log_odds FROM cells WHERE row - 7 BETWEEN 0 AND {GRID.rows - 8} AND col - 3 BETWEEN 0 AND {GRID.cols - 5}")
def nearest_shift(spark, sf_dir):
    return evidence.resample(cells(spark, sf_dir), GRID, _SHIFTED, MODEL, "nearest").select("row", "col", r9("log_odds").alias("log_odds"))


@query(f"WITH {CELLS} SELECT row - 7 AS row, col - 3 AS col, observed FROM cells WHERE row - 7 BETWEEN 0 AND {GRID.rows - 8} AND col - 3 BETWEEN 0 AND {GRID.cols - 5}")
def resample_counts(spark, sf_dir):
    return evidence.resample_counts(cells(spark, sf_dir), GRID, _SHIFTED, "observed").select("row", "col", "observed")


# Matching ---------------------------------------------------------------------------------------

_TAPS = match.gaussian_taps(1.0)
_FIELD = (
    CELLS
    + f", ev AS (SELECT row, col, least(greatest((log_odds - {L['l_prior']}) / ({L['l_max']} - {L['l_prior']}), 0.0), 1.0) AS v FROM cells), taps AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k - 4}, {number(w)})" for k, w in enumerate(_TAPS))
    + f") t(d, w)), f1 AS (SELECT row + d AS row, col, sum(v * w) AS v FROM ev, taps WHERE v > 0 AND row + d BETWEEN 0 AND {GRID.rows - 1} GROUP BY ALL), field AS (SELECT row, col + d AS col, sum(v * w) AS v FROM f1, taps WHERE col + d BETWEEN 0 AND {GRID.cols - 1} GROUP BY ALL)"
)


def _field(spark, sf_dir):
    return match.likelihood_field(cells(spark, sf_dir), GRID, MODEL)


@query(f"WITH {_FIELD} SELECT row, col, round(v, 6) AS v FROM field")
def likelihood_field(spark, sf_dir):
    return _field(spark, sf_dir).select("row", "col", r9("v").alias("v"))


_CENTER, _STEPS = Pose(31.0, 20.1, 0.05), (0.5, 0.02, 0.25, 0.01)
_CANDIDATES = "cand AS (SELECT i * 25 + j * 5 + k AS idx, 31.0 + (-0.5 + i * 0.25) AS x, 20.1 + (-0.5 + j * 0.25) AS y, 0.05::DOUBLE + (-0.02::DOUBLE + k * 0.01::DOUBLE) AS theta FROM range(5) a(i), range(5) b(j), range(5) c(k))"


def _candidates(spark):
    return match.candidates(spark, _CENTER, *_STEPS)


@query(f"WITH {_CANDIDATES} SELECT idx, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y, round(theta, 6)::DOUBLE AS theta FROM cand")
def match_candidates(spark, sf_dir):
    return _candidates(spark).select("idx", r9("x").alias("x"), r9("y").alias("y"), r9("theta").alias("theta"))


def _sampled_sql(candidates: str) -> str:
    """parts (scan_idx, idx, s): the field under all points of a sweep, for each row of `candidates` (scan_idx, idx, x, y, theta)."""
    return f"""SELECT scan_idx, idx, sum(v * w) AS s FROM (SELECT scan_idx, idx, r0 + i AS row, c0 + j AS col, (CASE WHEN i = 1 THEN fr ELSE 1 - fr END) * (CASE WHEN j = 1 THEN fc ELSE 1 - fc END) AS w FROM
  (SELECT scan_idx, idx, CAST(floor(c) AS INTEGER) AS c0, CAST(floor(r) AS INTEGER) AS r0, c - floor(c) AS fc, r - floor(r) AS fr FROM
    (SELECT p.scan_idx, idx, (cos(theta) * px - sin(theta) * py + x) / 0.25 - 0.5 AS c, (sin(theta) * px + cos(theta) * py + y) / 0.25 - 0.5 AS r FROM {candidates} q JOIN pts p ON p.scan_idx = q.scan_idx)
    WHERE c BETWEEN 0 AND {GRID.cols - 1} AND r BETWEEN 0 AND {GRID.rows - 1}), range(2) a(i), range(2) b(j)) JOIN field USING (row, col) GROUP BY scan_idx, idx"""


_POINTS = "pts AS (SELECT scan_idx, x1 - x0 AS px, y1 - y0 AS py FROM beams WHERE is_hit)"
_SCORES = f"""{_FIELD}, {_CANDIDATES}, {_POINTS}, tried AS (SELECT scan_idx, cand.* FROM cand, (SELECT DISTINCT scan_idx FROM pts)),
part AS ({_sampled_sql('tried')}),
scores AS (SELECT scan_idx, idx, x, y, theta, coalesce(s, 0) AS score FROM tried LEFT JOIN part USING (scan_idx, idx))"""


def _points(spark, sf_dir):
    return beams(spark, sf_dir).filter("is_hit").select("scan_idx", (F.col("x1") - F.col("x0")).alias("px"), (F.col("y1") - F.col("y0")).alias("py"))


def _scores(spark, sf_dir):
    points = checkpoint(match.weighed(_points(spark, sf_dir)))
    tried = points.select("scan_idx").distinct().crossJoin(F.broadcast(_candidates(spark)))
    return match.scores(points, tried, checkpoint(match.tiled(_field(spark, sf_dir))), GRID, ("scan_idx",))


@query(f"WITH {_SCORES} SELECT scan_idx, idx, round(score, 5)::DOUBLE AS score FROM scores")
def match_score(spark, sf_dir):
    """Every sweep's returns under every candidate."""
    return _scores(spark, sf_dir).select("scan_idx", "idx", F.round("score", 5).alias("score"))


@query(f"WITH {_SCORES} SELECT scan_idx, arg_min(idx, (cost, idx)) AS idx, round(max(top), 5)::DOUBLE AS score FROM (SELECT *, ((x - 31.0) / 0.25) ** 2 + ((y - 20.1) / 0.25) ** 2 + ((theta - 0.05) / 0.01) ** 2 AS cost, max(score) OVER (PARTITION BY scan_idx) AS top FROM scores) WHERE score >= top - 1e-12 GROUP BY scan_idx")
def match_best(spark, sf_dir):
    """Every sweep's best candidate."""
    return match.best(_scores(spark, sf_dir), _CENTER, 0.25, 0.01, ("scan_idx",)).select("scan_idx", "idx", F.round("score", 5).alias("score"))


_SEARCH = SearchWindow(0.25, 0.02, 0.25, 0.02, 1)


def _passes_sql(search: SearchWindow) -> str:
    """The search's passes over all candidates, each around what the one before took."""
    made = [f"at0 AS (SELECT scan_idx, x, y, theta, coalesce(s, 0) AS score FROM start LEFT JOIN ({_sampled_sql('start')}) USING (scan_idx))"]
    t, h, ts, hs = search.translation_radius, search.heading_radius, search.translation_step, search.heading_step
    for k in range(search.refinements + 1):
        n, m = match.span(t, ts), match.span(h, hs)
        cost = f"((-{t} + i * {ts}) / {ts}) ** 2 + ((-{t} + j * {ts}) / {ts}) ** 2 + ((-{h} + m * {hs}) / {hs}) ** 2"
        made.append(f"""try{k} AS (SELECT scan_idx, (i * {n} + j) * {m} + m AS idx, x + (-{t} + i * {ts}) AS x, y + (-{t} + j * {ts}) AS y, theta + (-{h} + m * {hs}) AS theta, {cost} AS cost FROM at{k}, range({n}) a(i), range({n}) b(j), range({m}) c(m)),
got{k} AS (SELECT q.*, coalesce(s, 0) AS score FROM try{k} q LEFT JOIN ({_sampled_sql(f'try{k}')}) USING (scan_idx, idx)),
pick{k} AS (SELECT scan_idx, arg_min(x, (cost, idx)) AS x, arg_min(y, (cost, idx)) AS y, arg_min(theta, (cost, idx)) AS theta, arg_min(score, (cost, idx)) AS score FROM (SELECT *, max(score) OVER (PARTITION BY scan_idx) AS top FROM got{k}) WHERE score >= top - 1e-12 GROUP BY scan_idx),
at{k + 1} AS (SELECT a.scan_idx, CASE WHEN p.score > a.score THEN p.x ELSE a.x END AS x, CASE WHEN p.score > a.score THEN p.y ELSE a.y END AS y, CASE WHEN p.score > a.score THEN p.theta ELSE a.theta END AS theta, greatest(p.score, a.score) AS score FROM at{k} a JOIN pick{k} p USING (scan_idx))""")
        t, h, ts, hs = t / 2, h / 2, ts / 2, hs / 2
    return ",\n".join(made)


def _searched_sql(search: SearchWindow) -> str:
    return f"""WITH {_FIELD}, {_POINTS}, start AS (SELECT scan_idx, 0 AS idx, min(x0) + 0.37 AS x, min(y0) - 0.21 AS y, 0.013::DOUBLE AS theta FROM beams GROUP BY scan_idx),
{_passes_sql(search)} SELECT scan_idx, round(x, 5)::DOUBLE AS x, round(y, 5)::DOUBLE AS y, round(theta, 5)::DOUBLE AS theta, round(score, 5)::DOUBLE AS score FROM at{search.refinements + 1}"""


def _searched(spark, sf_dir, search: SearchWindow) -> DataFrame:
    predicted = beams(spark, sf_dir).groupBy("scan_idx").agg((F.min("x0") + 0.37).alias("x"), (F.min("y0") - 0.21).alias("y"), F.lit(0.013).alias("theta"))
    found = match.match_sweeps(_points(spark, sf_dir), predicted, checkpoint(_field(spark, sf_dir)), GRID, search)
    return found.select("scan_idx", *(F.round(c, 5).alias(c) for c in ("x", "y", "theta", "score")))


@query(_searched_sql(_SEARCH))
def match_scan(spark, sf_dir):
    """Every sweep from a displaced pose, from coarse to fine."""
    return _searched(spark, sf_dir, _SEARCH)


_WIDE_SEARCH = SearchWindow(1.0, 0.04, 0.25, 0.02, 1)


@query(_searched_sql(_WIDE_SEARCH))
def match_search(spark, sf_dir):
    """Every sweep over 405 candidates a pass, most of which bounds leave out; the SQL tries them all."""
    return _searched(spark, sf_dir, _WIDE_SEARCH)


# Scores -----------------------------------------------------------------------------------------

_COUNTS = """count(*) FILTER (scored) AS scored_cells, count(*) FILTER (scored AND state > 0) AS decided_cells, count(*) FILTER (scored AND NOT occupied AND state > 0) AS free_truth,
count(*) FILTER (scored AND NOT occupied AND state = 1) AS free_correct, count(*) FILTER (scored AND occupied AND state > 0) AS occupied_truth, count(*) FILTER (scored AND occupied AND state > 0 AND matched) AS occupied_correct,
count(*) FILTER (scored AND NOT occupied AND state = 2) AS free_called_occupied, count(*) FILTER (scored AND occupied AND state = 1) AS occupied_called_free"""
_RATIOS = {
    "decided_fraction": "coalesce(decided_cells / nullif(scored_cells, 0), 0)",
    "free_agreement": "coalesce(free_correct / nullif(free_truth, 0), 0)",
    "occupied_agreement": "coalesce(occupied_correct / nullif(occupied_truth, 0), 0)",
    "balanced_agreement": "0.5 * (coalesce(free_correct / nullif(free_truth, 0), 0) + coalesce(occupied_correct / nullif(occupied_truth, 0), 0))",
}
_FRACTIONS = ", ".join(f"round({v}, 6)::DOUBLE AS {k}" for k, v in _RATIOS.items())
_RATES = ("decided_fraction", "free_agreement", "occupied_agreement", "balanced_agreement")


def _rounded(df, *first):
    return df.select(*first, *score.COUNTS, *(r9(c).alias(c) for c in _RATES))


@query(f"WITH {SCORED}, n AS (SELECT {_COUNTS} FROM (SELECT *, state = 2 AS matched FROM called)) SELECT *, {_FRACTIONS} FROM n")
def score_grid(spark, sf_dir):
    return _rounded(score.score(scored(spark, sf_dir), MODEL))


THRESHOLDS = [0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.83, 0.86]


_THRESHOLD_COUNTS = (
    f"WITH {SCORED}, b AS (SELECT * FROM (VALUES " + ", ".join(f"({p}::DOUBLE, {number(math.log(p / (1 - p)))})" for p in THRESHOLDS) + f") t(decision_prob, d)), n AS (SELECT decision_prob, {_COUNTS} FROM (SELECT *, state = 2 AS matched FROM (SELECT decision_prob, row, col, occupied, scored, CASE WHEN log_odds <= -d THEN 1 WHEN log_odds >= d THEN 2 ELSE 0 END AS state FROM scored, b)) GROUP BY decision_prob)"
)


@query(_THRESHOLD_COUNTS + f" SELECT *, {_FRACTIONS} FROM n")
def threshold_sweep(spark, sf_dir):
    return _rounded(score.threshold_sweep(scored(spark, sf_dir), MODEL, THRESHOLDS), "decision_prob")


@query(_THRESHOLD_COUNTS + " SELECT printf('%.2f', decision_prob) AS label, " + ", ".join(f"printf('%.4f', CAST({v} AS DOUBLE)) AS {k}" for k, v in _RATIOS.items()) + ", CAST(free_called_occupied AS VARCHAR) AS free_called_occupied, CAST(occupied_called_free AS VARCHAR) AS occupied_called_free FROM n")
def agreement_rows(spark, sf_dir):
    """The agreement table's strings, from rates that aren't rounded before."""
    return report.agreement_rows(score.threshold_sweep(scored(spark, sf_dir), MODEL, THRESHOLDS))


_NEAR = "near AS (SELECT k, c.row, c.col, bool_or(o.row IS NOT NULL) AS matched FROM (SELECT * FROM called, range(4) t(k)) c LEFT JOIN (SELECT row, col FROM called WHERE state = 2) o ON c.occupied AND o.row BETWEEN c.row - k AND c.row + k AND o.col BETWEEN c.col - k AND c.col + k GROUP BY ALL)"


@query(f"WITH {SCORED}, {_NEAR}, n AS (SELECT CAST(k AS INTEGER) AS spatial_tolerance, {_COUNTS} FROM called JOIN near USING (row, col) GROUP BY k) SELECT *, {_FRACTIONS} FROM n")
def tolerance_sweep(spark, sf_dir):
    return _rounded(score.tolerance_sweep(scored(spark, sf_dir), MODEL, [0, 1, 2, 3]), "spatial_tolerance")


@query(f"WITH {CELLS} SELECT DISTINCT CAST(row + i AS INTEGER) AS row, CAST(col + j AS INTEGER) AS col FROM cells, range(-2, 3) a(i), range(-2, 3) b(j) WHERE log_odds >= {L['l_decision']} AND row + i BETWEEN 0 AND {GRID.rows - 1} AND col + j BETWEEN 0 AND {GRID.cols - 1}")
def dilate(spark, sf_dir):
    marked = cells(spark, sf_dir).withColumn("mask", scalars.state("log_odds", MODEL) == 2)
    return score.dilated(marked, "mask", 2, GRID)


_BAND = f"""grown AS (SELECT DISTINCT CAST(row + i AS INTEGER) AS row, CAST(col + j AS INTEGER) AS col FROM truth, range(-2, 3) a(i), range(-2, 3) b(j) WHERE occupied AND row + i BETWEEN 0 AND {GRID.rows - 1} AND col + j BETWEEN 0 AND {GRID.cols - 1}),
bare AS (SELECT DISTINCT CAST(row + i AS INTEGER) AS row, CAST(col + j AS INTEGER) AS col FROM truth, range(-2, 3) a(i), range(-2, 3) b(j) WHERE NOT occupied),
band AS (SELECT g.row, g.col FROM grown g JOIN bare b ON b.row = g.row AND b.col = g.col)"""


@query(f"WITH {EVERY}, {_BAND} SELECT row, col FROM band")
def boundary_band(spark, sf_dir):
    return score.boundary_band(truth(spark), GRID)


@query(f"""WITH {SCORED}, {_BAND}, g AS (SELECT *, CASE WHEN row = 0 OR row = {GRID.rows - 1} THEN 1 ELSE 2 END AS hr, CASE WHEN col = 0 OR col = {GRID.cols - 1} THEN 1 ELSE 2 END AS hc,
coalesce(lead(log_odds) OVER (PARTITION BY col ORDER BY row), log_odds) - coalesce(lag(log_odds) OVER (PARTITION BY col ORDER BY row), log_odds) AS gr,
coalesce(lead(log_odds) OVER (PARTITION BY row ORDER BY col), log_odds) - coalesce(lag(log_odds) OVER (PARTITION BY row ORDER BY col), log_odds) AS gc FROM called)
SELECT count(*) FILTER (scored) AS observed_cells, count(*) FILTER (scored AND (log_odds <= {L['l_min']} + 1e-9 OR log_odds >= {L['l_max']} - 1e-9)) AS clamped_cells, count(*) FILTER (scored AND b.row IS NOT NULL) AS band_cells,
round(avg(sqrt((gr / hr) * (gr / hr) + (gc / hc) * (gc / hc))) FILTER (scored AND b.row IS NOT NULL), 6) AS edge_contrast, round(avg(abs(log_odds)) FILTER (scored), 6) AS mean_abs_evidence,
round(coalesce(count(*) FILTER (scored AND (log_odds <= {L['l_min']} + 1e-9 OR log_odds >= {L['l_max']} - 1e-9)) / nullif(count(*) FILTER (scored), 0), 0), 6)::DOUBLE AS clamped_fraction
FROM g LEFT JOIN band b ON b.row = g.row AND b.col = g.col""")
def edge_contrast(spark, sf_dir):
    made = score.sharpness(scored(spark, sf_dir), score.boundary_band(truth(spark), GRID), MODEL)
    return made.select("observed_cells", "clamped_cells", "band_cells", *(r9(c).alias(c) for c in ("edge_contrast", "mean_abs_evidence", "clamped_fraction")))


_PATH = "(x - (24.0 + t * 12.0)) * (x - (24.0 + t * 12.0)) + (y - (14.0 + t * 9.0)) * (y - (14.0 + t * 9.0)) <= 9.0"
_REGION = f"{EVERY}, region AS (SELECT row, col, x, y, {_PATH} AS region FROM (SELECT *, least(greatest(((x - 24.0) * 12.0 + (y - 14.0) * 9.0) / 225.0::DOUBLE, 0.0), 1.0) AS t FROM centres))"


@query(f"WITH {_REGION} SELECT row, col FROM region WHERE region")
def path_region(spark, sf_dir):
    every = evidence.dense(spark.createDataFrame([], "row int, col int, log_odds double"), GRID, MODEL)
    return every.filter(score.in_path(GRID, (24.0, 14.0), (36.0, 23.0), 3.0)).select("row", "col")


_SMEAR_COUNTS = """count(*) FILTER (region) AS roi_cells, count(*) FILTER (region AND state = 2) AS occupied_cells, count(*) FILTER (region AND occupied) AS truth_cells, count(*) FILTER (region AND state = 2 AND NOT occupied) AS stale_cells,
count(*) FILTER (region AND occupied AND state = 1) AS false_free_cells, count(*) FILTER (region AND occupied AND state = 2) AS detected_cells,
round(coalesce(max(a) FILTER (region AND state = 2) - min(a) FILTER (region AND state = 2) + 0.25, 0), 5)::DOUBLE AS extent_along, round(coalesce(max(c) FILTER (region AND state = 2) - min(c) FILTER (region AND state = 2) + 0.25, 0), 5)::DOUBLE AS extent_across,
coalesce(max(occ_obs) FILTER (region), 0) AS peak_returns_per_cell"""
_AREAS = "round(coalesce(occupied_cells / nullif(truth_cells, 0), 0), 5)::DOUBLE AS area_ratio, truth_cells - detected_cells - false_free_cells AS unknown_footprint_cells"
_SMEARED = f"{SCORED}, " + _REGION.split(", region AS", 1)[1].join(["region AS", ""]) + ", smeared AS (SELECT *, 0.8 * x + 0.6 * y AS a, -0.6 * x + 0.8 * y AS c FROM called JOIN region USING (row, col))"


def _regions(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("region", score.in_path(GRID, (24.0, 14.0), (36.0, 23.0), 3.0))


@query(f"WITH {_SMEARED}, m AS (SELECT {_SMEAR_COUNTS} FROM smeared) SELECT *, {_AREAS} FROM m")
def smear_metrics(spark, sf_dir):
    made = score.smear(_regions(spark, sf_dir), MODEL, GRID, (12.0, 9.0), [])
    names = ("roi_cells", "occupied_cells", "truth_cells", "stale_cells", "false_free_cells", "detected_cells", "peak_returns_per_cell", "unknown_footprint_cells")
    return made.select(*names, F.round("area_ratio", 5).alias("area_ratio"), F.round("extent_along", 5).alias("extent_along"), F.round("extent_across", 5).alias("extent_across"))


_HALVES = f"""{_SMEARED}, h AS (SELECT row % 2 AS half, {_SMEAR_COUNTS} FROM smeared GROUP BY 1), m AS (SELECT * FROM h WHERE half = 0), p AS (SELECT * FROM h WHERE half = 1),
report AS (SELECT 15.0::DOUBLE AS swept_distance, p.extent_along AS parked_extent_along, m.extent_along AS moving_extent_along, m.extent_along - p.extent_along AS smear_length, (m.extent_along - p.extent_along) / 15.0 AS smear_fraction_of_sweep,
  coalesce(m.occupied_cells / nullif(p.occupied_cells, 0), 0) AS area_inflation, m.stale_cells AS moving_stale_cells, m.stale_cells * 0.0625::DOUBLE AS moving_stale_area, p.stale_cells AS parked_stale_cells, m.truth_cells AS footprint_cells, m.detected_cells AS moving_detected_cells,
  p.detected_cells AS parked_detected_cells, m.false_free_cells AS moving_false_free_cells, m.truth_cells - m.detected_cells - m.false_free_cells AS moving_unknown_footprint_cells, coalesce(m.false_free_cells / nullif(m.truth_cells, 0), 0) AS missed_footprint_fraction, m.peak_returns_per_cell AS peak_returns_per_cell FROM m, p)"""
_REPORT = ("swept_distance", "smear_length", "area_inflation", "moving_stale_cells", "parked_stale_cells", "footprint_cells", "moving_unknown_footprint_cells", "missed_footprint_fraction")


def _smear_report(spark, sf_dir):
    """Even rows stand for the moving run, odd ones for its control."""
    made = checkpoint(score.smear(_regions(spark, sf_dir).withColumn("half", F.col("row") % 2), MODEL, GRID, (12.0, 9.0), ["half"]))  # two rows
    moving = made.filter("half = 0").withColumns({"case": F.lit("rows"), "swept_distance": F.lit(15.0)})
    return score.compare_smear(moving, made.filter("half = 1").withColumn("case", F.lit("rows")))


@query(f"WITH {_HALVES} SELECT " + ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in _REPORT) + " FROM report")
def smear_report(spark, sf_dir):
    """As a flat row of doubles."""
    rows = report.as_doubles(_smear_report(spark, sf_dir).select("case", *_REPORT), ("case",))
    return rows.select(*(F.round(c, 4).alias(c) for c in _REPORT))


def _text_sql(digits: int, column: str) -> str:
    return f"printf('%.{digits}f', CAST({column} AS DOUBLE))"


@query(f"WITH {_HALVES} SELECT 'rows' AS \"case\", " + ", ".join(f"{_text_sql(digits, c)} AS {c}" for _, c, digits in report.SMEAR_COLUMNS) + " FROM report")
def smear_rows(spark, sf_dir):
    """The smear table's strings."""
    return report.smear_rows(_smear_report(spark, sf_dir))


_PREFIX = f"""{TOUCH}, g AS (SELECT row, col, list(scan_idx ORDER BY scan_idx) AS scans, list(CASE WHEN is_occ THEN {L['l_occupied']} ELSE {L['l_free']} END ORDER BY scan_idx) AS deltas FROM touch GROUP BY row, col),
p AS (SELECT row, col, scans[k] AS scan_idx, list_reduce(list_prepend({L['l_prior']}, deltas[1:k]), lambda a, x: least(greatest(a + x, {L['l_min']}), {L['l_max']})) AS l, coalesce(scans[k + 1], 1000000) AS upto FROM (SELECT *, unnest(generate_series(1, len(scans))) AS k FROM g)),
d AS (SELECT DISTINCT scan_idx FROM touch)"""


@query(f"WITH {_PREFIX} SELECT d.scan_idx, count(*) FILTER (l <= -{L['l_decision']}) AS free_cells, count(*) FILTER (l >= {L['l_decision']}) AS occupied_cells, {GRID.size} - count(*) FILTER (abs(l) >= {L['l_decision']}) AS unknown_cells FROM d JOIN p ON d.scan_idx >= p.scan_idx AND d.scan_idx < p.upto GROUP BY d.scan_idx")
def state_counts(spark, sf_dir):
    return runs.state_counts(touch(spark, sf_dir), [], MODEL, GRID.size)


@query(f"WITH {_PREFIX} SELECT d.scan_idx, count(*) FILTER (l <= -{L['l_decision']}) AS free_cells, count(*) FILTER (l >= {L['l_decision']}) AS occupied_cells, {GRID.size} - count(*) FILTER (abs(l) >= {L['l_decision']}) AS unknown_cells FROM d JOIN p ON d.scan_idx >= p.scan_idx AND d.scan_idx < p.upto GROUP BY d.scan_idx")
def state_counts_in_ranges(spark, sf_dir):
    """The same with cells' sweeps in ranges of seven."""
    return runs.state_counts(touch(spark, sf_dir), [], MODEL, GRID.size, 7)


@query(f"WITH {visits_sql(GRID)} SELECT count(DISTINCT scan_idx) AS sweeps, (SELECT count(*) FROM beams) AS beams, count(*) FILTER (is_terminal AND is_hit) AS placed_returns, count(*) AS cell_visits FROM visits")
def run_totals(spark, sf_dir):
    counters = evidence.sweep_counters(visits(spark, sf_dir), beams(spark, sf_dir), SWEEP)
    return counters.agg(F.count("*").alias("sweeps"), *(F.sum(c).alias(c) for c in ("beams", "placed_returns", "cell_visits")))


# Whole studies take no table. The room has no noise, and so has SQL; the random stream of the others has none, and the tests hold them against published figures.

_ROOM = scenarios.enclosed_room(12)
_ROOM_BEAMS = """sweeps AS (SELECT CAST(unnest(generate_series(0, 12)) AS INTEGER) AS scan_idx), fan AS (SELECT unnest(generate_series(0, 1439)) AS beam_idx),
turned AS (SELECT scan_idx, beam_idx, cos(a) AS dx, sin(a) AS dy, 5.65::DOUBLE AS x0, 5.65::DOUBLE AS y0 FROM (SELECT *, (beam_idx - 719.5) * radians(0.25) AS a FROM sweeps, fan)),
ranged AS (SELECT *, least((CASE WHEN dx > 0 THEN 10.6 ELSE 0.7 END - x0) / dx, (CASE WHEN dy > 0 THEN 10.6 ELSE 0.7 END - y0) / dy) AS r FROM turned),
beams AS (SELECT scan_idx, scan_idx * 1440 + beam_idx AS beam_idx, x0, y0, x0 + r * dx AS x1, y0 + r * dy AS y1, r < 40 AS is_hit FROM ranged)"""
_ROOM_TOUCH = f"""{visits_sql(_ROOM.grid, _ROOM_BEAMS)},
touch AS (SELECT scan_idx, row, col, bool_or(is_terminal AND is_hit) AS is_occ, count(*) AS n FROM visits GROUP BY ALL)"""
_ROOM_CELLS = f"""{_ROOM_TOUCH}, {CELLS.split("count(*) AS n FROM visits GROUP BY ALL),", 1)[1]},
every AS (SELECT CAST(i // 46 AS INTEGER) AS row, CAST(i % 46 AS INTEGER) AS col FROM range(2116) t(i)),
truth AS (SELECT row, col, NOT ((col + 0.5) * 0.25 BETWEEN 0.7 AND 10.6 AND (row + 0.5) * 0.25 BETWEEN 0.7 AND 10.6) AND (col + 0.5) * 0.25 < 11.3 AND (row + 0.5) * 0.25 < 11.3 AS occupied FROM every),
called AS (SELECT t.row, t.col, occupied, coalesce(observed, 0) > 0 AS seen, CASE WHEN coalesce(log_odds, 0) <= -{L['l_decision']} THEN 1 WHEN coalesce(log_odds, 0) >= {L['l_decision']} THEN 2 ELSE 0 END AS state FROM truth t LEFT JOIN cells c ON c.row = t.row AND c.col = t.col)"""


@query(f"""WITH {_ROOM_CELLS}, regions AS (SELECT * FROM (VALUES ('observed', false), ('grid', true)) r(region, whole)),
n AS (SELECT region, {_COUNTS} FROM (SELECT *, seen OR whole AS scored, state = 2 AS matched FROM called, regions) GROUP BY region) SELECT *, {_FRACTIONS} FROM n""")
def room_map(spark, sf_dir):
    return _rounded(studies.static_map(spark, _ROOM), "region")


_ROOM_COUNTERS = """counted AS (SELECT scan_idx, count(*) FILTER (is_terminal AND is_hit) AS placed_returns, count(*) AS cell_visits, count(DISTINCT row * 1000 + col) AS touched_cells FROM visits GROUP BY scan_idx)"""


@query(f"""WITH {_ROOM_TOUCH}, {_PREFIX.split("GROUP BY ALL),", 1)[1]}, {_ROOM_COUNTERS},
states AS (SELECT d.scan_idx, count(*) FILTER (l <= -{L['l_decision']}) AS free_cells, count(*) FILTER (l >= {L['l_decision']}) AS occupied_cells FROM d JOIN p ON d.scan_idx >= p.scan_idx AND d.scan_idx < p.upto GROUP BY d.scan_idx)
SELECT scan_idx, round(scan_idx * 0.2, 6)::DOUBLE AS time, 5.65::DOUBLE AS x, 5.65::DOUBLE AS est_y, 0.0::DOUBLE AS position_error, 1440::BIGINT AS beams, 1440::BIGINT AS hits, 0::BIGINT AS max_range_beams, 0::BIGINT AS dropped,
placed_returns, cell_visits, touched_cells, free_cells, occupied_cells, 2116 - free_cells - occupied_cells AS unknown_cells, 0 AS match_evaluations FROM counted JOIN states USING (scan_idx)""")
def run_step_records(spark, sf_dir):
    """A record of each sweep."""
    made = runs.step_records(runs.run(spark, _ROOM))
    counts = ("beams", "hits", "max_range_beams", "dropped", "placed_returns", "cell_visits", "touched_cells", "free_cells", "occupied_cells", "unknown_cells")
    return made.select("scan_idx", *(r9(c).alias(c) for c in ("time", "x", "est_y", "position_error")), *(F.col(c).cast("long").alias(c) for c in counts), "match_evaluations")


@query(f"""WITH {_ROOM_CELLS} SELECT 'enclosed_room' AS scenario, 'world' AS frame, 20260731::BIGINT AS seed, 2116::BIGINT AS grid_cells, 13::BIGINT AS steps, 18720::BIGINT AS beams, (SELECT count(*) FROM visits) AS cell_visits,
count(*) FILTER (seen) AS observed_cells, 0::BIGINT AS resamples FROM called""")
def run_summary(spark, sf_dir):
    """Fields read back from the run's trace in JSON, which holds the configuration, totals and a record of each sweep."""
    json = report.to_json(runs.trace(runs.run(spark, _ROOM)))
    schema = "scenario string, config struct<frame:string,seed:long>, totals struct<beams:long,cell_visits:long>, observed_cells long, grid_cells long, resamples long, steps array<struct<scan_idx:int>>"
    read = json.select(F.from_json("json", schema).alias("j")).select("j.*")
    return read.select("scenario", "config.frame", "config.seed", "grid_cells", F.size("steps").cast("long").alias("steps"), "totals.beams", "totals.cell_visits", "observed_cells", "resamples")


@query(None)
def static_map(spark, sf_dir):
    return studies.static_map(spark)


@query(None)
def static_map_thresholds(spark, sf_dir):
    return studies.agreement_sweeps(spark)[0]


@query(None)
def static_map_tolerances(spark, sf_dir):
    return studies.agreement_sweeps(spark)[1]


@query(None)
def grid_frames(spark, sf_dir):
    return studies.frames(spark)


@query(None)
def smear_cases(spark, sf_dir):
    return studies.smear_cases(spark)


@query(None)
def pose_drift(spark, sf_dir):
    return studies.drift(spark)


def _channel_sql(k: int) -> str:
    unknown, free, occupied = (number(report.COLOURS[i][k]) for i in range(3))
    return f"CASE WHEN abs(log_odds) < {L['l_decision']} THEN {unknown} WHEN log_odds < 0 THEN {free} ELSE {occupied} END"


@query(f"WITH {CELLS} SELECT row, col, {_channel_sql(0)} AS red, {_channel_sql(1)} AS green, {_channel_sql(2)} AS blue FROM cells")
def state_image(spark, sf_dir):
    return report.state_image(cells(spark, sf_dir), MODEL)


_LEVELS = [1, 3, 5]


@query(f"""WITH {CELLS}, s AS (SELECT *, CASE WHEN log_odds <= {L["l_prior"]} - {L["l_decision"]} THEN 1 WHEN log_odds >= {L["l_prior"]} + {L["l_decision"]} THEN 2 ELSE 0 END AS state FROM cells),
b AS (SELECT level, row // (2 ** level)::INTEGER AS row, col // (2 ** level)::INTEGER AS col, count(*) FILTER (state = 1) AS free, count(*) FILTER (state = 2) AS occupied, greatest(max(log_odds), {L["l_prior"]}) AS most FROM s, unnest({_LEVELS}) l(level) GROUP BY 1, 2, 3),
u AS (SELECT *, least((2 ** level)::INTEGER, {GRID.rows} - row * (2 ** level)::INTEGER) * least((2 ** level)::INTEGER, {GRID.cols} - col * (2 ** level)::INTEGER) - free - occupied AS unknown FROM b)
SELECT level, row, col, free, occupied, unknown, round(most, 6) AS most, CASE WHEN occupied >= free AND occupied >= unknown THEN 2 WHEN free >= unknown THEN 1 ELSE 0 END AS state FROM u""")
def map_pyramid(spark, sf_dir):
    """The map at three scales."""
    return report.pyramid(cells(spark, sf_dir), MODEL, GRID, _LEVELS).withColumn("most", r9("most"))


@query(f"WITH {SCORED} SELECT row, col, CASE WHEN NOT scored THEN 'unscored' WHEN state = 0 THEN 'undecided' WHEN (state = 2) = occupied THEN 'right' WHEN state = 2 THEN 'free_called_occupied' ELSE 'occupied_called_free' END AS verdict FROM called")
def decision_image(spark, sf_dir):
    return report.decision_image(scored(spark, sf_dir), MODEL)
