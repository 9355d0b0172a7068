"""Runs against published figures, at the tolerances that go with them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridfold.operators import matched
from gridfold.params import RunConfig, Trajectory, composed, inverted
from gridfold.plans import report, studies
from gridfold.plans import run as runs
from gridfold.sources import scenarios


def counts(made):
    s = studies.state_counts(made)
    t = made.totals().first()
    return (made.cells.filter("observed > 0").count(), s["free"], s["occupied"], s["unknown"], t.beams, t.hits, t.max_range_beams, t.placed_returns, t.cell_visits)


def test_enclosed_room_is_exact(spark):
    made = runs.run(spark, scenarios.enclosed_room(12))
    assert counts(made) == (1681, 1521, 160, 435, 18720, 18720, 0, 18720, 556556)
    got = studies.static_map(spark, scenarios.enclosed_room(12)).filter("region = 'observed'").first()
    assert (got.decided_fraction, got.free_agreement, got.occupied_agreement) == (1.0, 1.0, 1.0)


def test_street_block(spark):
    made = runs.run(spark, scenarios.urban_block())
    assert counts(made) == (35482, 33649, 1235, 25116, 35976, 24277, 11699, 24277, 3135805)
    whole = studies.static_map(spark).filter("region = 'grid'").first()
    assert (whole.decided_fraction, whole.free_agreement, whole.occupied_agreement) == pytest.approx((0.5814, 0.9865, 0.9923), abs=2e-3)


def test_sweeps(spark):
    thresholds, tolerances = studies.agreement_sweeps(spark)
    rows = thresholds.orderBy("decision_prob").collect()
    assert (rows[0].decided_fraction, rows[-1].decided_fraction) == pytest.approx((0.9986, 0.9380), abs=2e-3)
    assert [r.occupied_agreement for r in tolerances.orderBy("spatial_tolerance").collect()] == pytest.approx([0.9923, 0.9949, 0.9974, 0.9987], abs=2e-3)
    assert report.agreement_table(thresholds).splitlines()[2].startswith("0.55")


WINDOWS = [("world", 0.9831, 0.9923, 1.481, 0, 0), ("snap", 0.9516, 0.9883, 1.614, 50, 50), ("bilinear", 0.9448, 0.9226, 1.180, 50, 0), ("nearest", 0.9464, 0.6038, 1.174, 50, 0)]


def test_moving_windows(spark):
    rows = {r.policy: r for r in studies.frames(spark).collect()}
    for policy, decided, occupied, contrast, moves, lossless in WINDOWS:
        row = rows[policy]
        assert (row.decided_fraction, row.occupied_agreement) == pytest.approx((decided, occupied), abs=2e-3)
        assert row.edge_contrast == pytest.approx(contrast, rel=5e-3)
        assert (row.resamples, row.lossless_resamples) == (moves, lossless)


@pytest.mark.parametrize("policy, want", [("snap", (26908, 25032, 573, 22947, 3243561)), ("bilinear", (26987, 25223, 583, 22941, 3243799)), ("nearest", (26987, 25172, 368, 22941, 3243799))])
def test_moving_window_counts(spark, policy, want):
    made = runs.run(spark, scenarios.urban_block(), RunConfig(frame="ego", shift_policy=policy))
    got = counts(made)
    for mine, its in zip((got[0], got[1], got[2], got[7], got[8]), want, strict=True):
        assert abs(mine - its) <= max(2, 0.002 * its)


@pytest.mark.parametrize("policy", ["snap", "nearest"])
def test_maps_made_sweep_by_sweep_equal_planned_ones(spark, policy):
    """The same run as one plan and sweep by sweep: every cell agrees."""
    scenario, config = scenarios.urban_block(), RunConfig(frame="ego", shift_policy=policy, max_steps=6)
    planned = runs.run(spark, scenario, config)
    path = scenario.trajectory.subsample(6)
    moves = tuple(composed(inverted(p), q) for p, q in zip(path.poses, path.poses[1:], strict=False))
    _, cells = matched.fold(planned.beams, {"run": matched.Plan(scenario, replace(config, pose_correction=False), path.poses[0], moves)})
    got = {(r.row, r.col): (round(r.log_odds, 9), r.observed, r.occ_obs) for r in cells.filter("observed > 0").collect()}
    want = {(r.row, r.col): (round(r.log_odds, 9), r.observed, r.occ_obs) for r in planned.cells.collect()}
    assert len(want) > 10_000 and sum(got.get(k) != v for k, v in want.items()) + len(got.keys() - want.keys()) <= 20


def test_smear_cases(spark):
    got = {r.case.split()[0]: r for r in studies.smear_cases(spark, clamps=(0.12,)).collect()}
    want = {"approaching": (15, 0, 20, 60, 80), "receding": (7, 8, 72, 0, 80), "crossing": (4, 0, 1, 79, 80)}
    for case, (stale, found, unknown, free, all_) in want.items():
        r = got[case]
        assert (r.moving_stale_cells, r.moving_detected_cells, r.moving_unknown_footprint_cells, r.moving_false_free_cells, r.footprint_cells) == (stale, found, unknown, free, all_)
    assert [round(got[c].smear_length, 2) for c in ("approaching", "receding", "crossing")] == pytest.approx([0.20, 0.40, -0.80], abs=0.1)


def test_clamp_sweep_of_the_approaching_case(spark):
    got = {r.case: r for r in studies.smear_cases(spark, ("approaching",)).collect()}
    want = {0.05: (0, 0.20), 0.12: (0, 0.20), 0.20: (0, 0.20), 0.28: (20, 9.00), 0.34: (22, 9.00)}
    for clamp, (found, length) in want.items():
        row = got[f"approaching {clamp:.2f}"]
        assert abs(row.moving_detected_cells - found) <= 2 and row.smear_length == pytest.approx(length, abs=0.1)


def test_drift(spark):
    rows = {(r.scale, r.corrected): r for r in studies.drift(spark).collect()}
    want = {
        (1.0, False): (0.880, 0.5953), (2.0, False): (1.759, 0.4168), (4.0, False): (3.515, 0.2390),
        (0.0, True): (0.141, 0.9517), (1.0, True): (0.165, 0.9263), (2.0, True): (0.123, 0.9577), (4.0, True): (0.130, 0.9680),
    }
    for key, (error, occupied) in want.items():
        assert rows[key].final_position_error == pytest.approx(error, abs=0.02), key
        assert rows[key].occupied_agreement == pytest.approx(occupied, abs=1e-2), key
    assert rows[(0.0, False)].final_position_error == pytest.approx(0.0, abs=1e-9)


def test_matched_run_is_nearer_than_dead_reckoning(spark):
    street = scenarios.urban_block()
    short = replace(street, trajectory=Trajectory(street.trajectory.poses[:5], street.trajectory.times[:5]))
    noise = scenarios.SCANNER_ODOMETRY.scaled(10.0)
    error = {}
    for correct in (False, True):
        made = runs.run(spark, short, RunConfig(odometry=noise, pose_correction=correct))
        error[correct] = runs.pose_errors(studies.with_errors(made)).first().final_position_error
    assert [m["evaluations"] for m in made.matches] == [2187] * 4
    assert error[True] < 0.2 and error[True] < error[False]


@pytest.mark.parametrize("how", [{}, {"frame": "ego", "shift_policy": "snap"}, {"frame": "ego", "shift_policy": "nearest"}, {"frame": "ego", "odometry": scenarios.SCANNER_ODOMETRY, "pose_correction": True}])
def test_step_records_add_up(spark, how):
    scenario = scenarios.urban_block() if how else scenarios.enclosed_room(4)
    scenario = replace(scenario, trajectory=Trajectory(scenario.trajectory.poses[:3], scenario.trajectory.times[:3]))
    made = runs.run(spark, scenario, RunConfig(ego_rows=80, ego_cols=80, **how))
    rows = runs.step_records(made).orderBy("scan_idx").collect()
    last = studies.state_counts(made)
    assert (rows[-1].free_cells, rows[-1].occupied_cells, rows[-1].unknown_cells) == (last["free"], last["occupied"], last["unknown"])
    assert len(rows) == 3 and rows[-1].free_cells > 0 and all(r.touched_cells > 0 for r in rows)
    assert how or all(r.dropped == 0 and r.position_error == 0 for r in rows)
    assert report.to_json(made.summary()).count() == 1


def test_stream_agrees_with_batch(spark, tmp_path):
    from gridfold.params import EvidenceModel, Grid
    from gridfold.streaming import online

    grid, model = Grid(1.0, 40, 40), EvidenceModel()
    rows = [("r", s, b, 20.3, 20.3, 20.3 + (b * 7 % 19) - 9, 20.3 + (b * 5 % 17) - 8, (s + b) % 3 > 0) for s in range(6) for b in range(12)]
    schema = "run_id string, scan_idx int, beam_idx int, x0 double, y0 double, x1 double, y1 double, is_hit boolean"
    beams = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("scan_idx") * 60 + 1_700_000_000))
    last = spark.createDataFrame([("end", 999, 0, 20.3, 20.3, 20.3, 20.3, False)], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000)))
    for k, part in enumerate((beams.filter("scan_idx % 2 = 1"), beams.filter("scan_idx % 2 = 0"), last, last)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(beams.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.online_map(stream, grid, model).writeStream.outputMode("update").format("memory").queryName("online").start()
    q.processAllAvailable()
    q.stop()
    latest = spark.sql("select row, col, max_by(log_odds, observed) l, max(observed) n from online where run_id = 'r' group by row, col")
    got = {(r.row, r.col): (round(r.l, 9), r.n) for r in latest.collect()}
    want = {(r.row, r.col): (round(r.log_odds, 9), r.observed) for r in online.batch_map(beams, grid, model).collect()}
    assert got == want


def test_matched_runs_in_all_frames(spark):
    """World and moving windows of every policy together, of different lengths. Poses that are 16 m apart share little of the map, so that corrections are only held to the search's reach."""
    street = scenarios.urban_block()
    configs = {"world": RunConfig(pose_correction=True, odometry=scenarios.SCANNER_ODOMETRY.scaled(1.0), max_steps=5)}
    configs |= {policy: RunConfig(frame="ego", shift_policy=policy, pose_correction=True, odometry=scenarios.SCANNER_ODOMETRY.scaled(0.0), max_steps=4) for policy in ("snap", "bilinear", "nearest")}
    made = runs.run_many(spark, {name: (street, config) for name, config in configs.items()})
    for name, one in made.items():
        n = configs[name].max_steps
        assert len(one.windows) == len(one.counts) == n and len(one.matches) == n - 1
        assert all(m["evaluations"] == 2187 and m["points"] > 50 and m["score"] >= m["predicted_score"] for m in one.matches)
        reach = 4 * street.grid.resolution * (1 + 0.5 + 0.25)
        assert all(m["translation_correction"] <= 2**0.5 * reach + 1e-9 for m in one.matches)
        state = studies.state_counts(one)
        assert (state["free"], state["occupied"], state["unknown"]) == one.counts[-1]


def test_sweeps_of_matched_runs_share_their_code(spark, monkeypatch):
    """Sweeps after the first ones compile nothing: their numbers, poses and windows are rows, not literals."""
    compiled, plain = [], matched.checkpoint

    def counting(df):
        made = plain(df)
        compiled.append(spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount())
        return made

    monkeypatch.setattr(matched, "checkpoint", counting)
    runs.run(spark, scenarios.urban_block(), RunConfig(odometry=scenarios.SCANNER_ODOMETRY, pose_correction=True, max_steps=8))
    assert len(compiled) == 9 and compiled[-1] - compiled[4] <= 4, compiled
