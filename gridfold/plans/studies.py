"""The studies that a user runs from end to end: static map, sweeps, frames, smear, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.scalars import heading_error, pose, position_error, state
from gridfold.operators import evidence, score
from gridfold.params import EvidenceModel, RunConfig
from gridfold.plans import run as runs
from gridfold.session import checkpoint
from gridfold.sources import scenarios

THRESHOLDS = [0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.83, 0.86]
CLAMPS = (0.05, 0.12, 0.20, 0.28, 0.34)


def static_map(spark: SparkSession, scenario=None) -> DataFrame:
    """Agreement over observed cells and over the whole grid, from one evaluation of the run."""
    made = runs.run(spark, scenario or scenarios.urban_block())
    regions = F.explode(F.array(*(F.struct(F.lit(name).alias("region"), F.lit(whole).alias("whole")) for name, whole in (("observed", False), ("grid", True)))))
    cells = made.scored_cells().withColumn("_r", regions)
    cells = cells.select("row", "col", "log_odds", "occupied", F.col("_r.region").alias("region"), (F.col("scored") | F.col("_r.whole")).alias("scored"))
    return score.score(cells, made.scenario.model, keys=["region"])


def agreement_sweeps(spark: SparkSession, scenario=None) -> tuple[DataFrame, DataFrame]:
    """Threshold and tolerance sweeps of one run."""
    made = runs.run(spark, scenario or scenarios.urban_block())
    cells = made.scored_cells()
    return score.threshold_sweep(cells, made.scenario.model, THRESHOLDS), score.tolerance_sweep(cells, made.scenario.model, [0, 1, 2, 3])


def frames(spark: SparkSession, policies=("world", "snap", "bilinear", "nearest"), max_steps: int | None = None) -> DataFrame:
    """Agreement and sharpness of a map that stands still beside windows that move."""
    found, street = [], scenarios.urban_block()
    for policy in policies:
        config = RunConfig(max_steps=max_steps) if policy == "world" else RunConfig(frame="ego", shift_policy=policy, max_steps=max_steps)
        made = runs.run(spark, street, config)
        # The run is evaluated once for both measures: a dense map of its cells is written.
        cells = checkpoint(made.scored_cells())
        sharp = score.sharpness(cells, score.boundary_band(made.truth, made.grid), made.scenario.model)
        names = F.lit(policy).alias("policy"), F.lit(made.resamples).alias("resamples"), F.lit(made.lossless_resamples).alias("lossless_resamples")
        found.append(score.score(cells, made.scenario.model).crossJoin(sharp).select(*names, "*"))
    return _union(found)


def _union(found: list[DataFrame]) -> DataFrame:
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def smear_cases(spark: SparkSession, directions=scenarios.DIRECTIONS, clamps: tuple[float, ...] = CLAMPS, max_steps: int | None = None, margin: float = 1.0) -> DataFrame:
    """Moving runs beside their parked controls, for each direction and free clamp.

    Which cells a sweep touches doesn't depend on the model, so that a run is walked once, and its
    touches are folded under all clamps in one plan.
    """
    found = []
    models = [EvidenceModel(clamp_free_prob=c) for c in clamps]
    rows = [(c, m.l_prior, m.l_free, m.l_occupied, m.l_min, m.l_max) for c, m in zip(clamps, models, strict=True)]
    table = spark.createDataFrame(rows, "model_id double, l_prior double, l_free double, l_occupied double, l_min double, l_max double")
    for direction in directions:
        moving = scenarios.dynamic_corridor(direction)
        duration, mover = moving.trajectory.duration, moving.movers[0]
        end = mover.at(duration)
        measured = {}
        for label, scenario in (("moving", moving), ("parked", moving.frozen_at(duration))):
            made = runs.run(spark, scenario, RunConfig(max_steps=max_steps), label)
            folded = evidence.fold_by_models(made.touch, ["run_id"], table).drop("run_id")
            every = spark.range(moving.grid.size).select(F.floor(F.col("id") / moving.grid.cols).cast("int").alias("row"), (F.col("id") % moving.grid.cols).cast("int").alias("col"))
            dense = every.crossJoin(F.broadcast(table.select("model_id"))).join(folded, ["model_id", "row", "col"], "left")
            cells = dense.withColumns({"log_odds": F.coalesce("log_odds", F.lit(moving.model.l_prior)), "occ_obs": F.coalesce("occ_obs", F.lit(0))})
            cells = cells.join(made.truth.select("row", "col", "occupied"), ["row", "col"])
            cells = cells.withColumn("region", score.in_path(moving.grid, (mover.x, mover.y), (end.x, end.y), mover.r + margin))
            case = F.concat(F.lit(f"{direction} "), F.format_string("%.2f", "model_id"))
            measured[label] = score.smear(cells, moving.model, moving.grid, mover.direction, ["model_id"]).withColumns({"case": case, "swept_distance": F.lit(mover.speed * duration)})
        found.append(score.compare_smear(measured["moving"], measured["parked"]))
    return _union(found)


def drift(spark: SparkSession, scales=(0.0, 1.0, 2.0, 4.0), corrections=(False, True), max_steps: int | None = None) -> DataFrame:
    """Pose errors and agreement under drifting odometry, with and without correction; matched runs are made side by side."""
    street = scenarios.urban_block()
    wanted = {(scale, correct): RunConfig(odometry=scenarios.SCANNER_ODOMETRY.scaled(scale), pose_correction=correct, max_steps=max_steps) for scale in scales for correct in corrections}
    made = runs.run_many(spark, {f"scale {scale} corrected {correct}": (street, config) for (scale, correct), config in wanted.items()})
    found = []
    for (scale, correct), one in zip(wanted, made.values(), strict=True):
        errors = runs.pose_errors(with_errors(one))
        named = errors.select(F.lit(scale).alias("scale"), F.lit(correct).alias("corrected"), "final_position_error", "peak_position_error", "final_heading_error")
        found.append(named.crossJoin(score.score(one.scored_cells(), one.scenario.model)))
    return _union(found)


def with_errors(made: runs.Run) -> DataFrame:
    """The run's poses with position_error and heading_error."""
    estimate, truth = pose(F.col("est_x"), F.col("est_y"), F.col("est_theta")), pose(F.col("x"), F.col("y"), F.col("theta"))
    return made.poses.withColumns({"position_error": position_error(estimate, truth), "heading_error": heading_error(estimate, truth)})


def state_counts(made: runs.Run) -> dict[str, int]:
    """Free, occupied and unknown cells of a run's final map."""
    s = state("log_odds", made.scenario.model)
    row = made.cells.agg(F.count_if(s == 1).alias("free"), F.count_if(s == 2).alias("occupied")).first()
    return {"free": row["free"], "occupied": row["occupied"], "unknown": made.grid.size - row["free"] - row["occupied"]}

