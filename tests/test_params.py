import math

import pytest

from gridfold.params import Disc, EvidenceModel, Grid, Lidar, Mover, OdometryNoise, Polygon, Pose, RunConfig, SearchWindow, Trajectory, composed, inverted, log_odds, wrap
from gridfold.sources import scenarios


def test_model_constants():
    m = EvidenceModel()
    assert round(m.forget_ratio, 2) == 2.09
    assert round(m.observations_to_free, 2) == 1.53
    assert round(m.observations_to_occupied, 2) == 3.08


@pytest.mark.parametrize(
    "bad",
    [
        lambda: EvidenceModel(p_free=0.6),
        lambda: EvidenceModel(prior=1.0),
        lambda: EvidenceModel(clamp_free_prob=0.45),
        lambda: EvidenceModel(clamp_occupied_prob=0.6),
        lambda: EvidenceModel(decision_prob=0.4),
        lambda: EvidenceModel(decision_prob=0.98),
        lambda: EvidenceModel(clamp_free_prob=0.36),
        lambda: Grid(0, 1, 1),
        lambda: Grid(1, 0, 1),
        lambda: Disc(0, 0, 0),
        lambda: Polygon(((0, 0), (1, 1))),
        lambda: Mover(0, 0, 1, 1, -1),
        lambda: Lidar(max_range=0.1),
        lambda: Lidar(dropout_prob=1.0),
        lambda: OdometryNoise(-1),
        lambda: OdometryNoise().scaled(-1),
        lambda: Trajectory((), ()),
        lambda: Trajectory((Pose(0, 0),), (0.0, 1.0)),
        lambda: SearchWindow(translation_step=0),
        lambda: SearchWindow(refinements=-1),
        lambda: RunConfig(frame="moon"),
        lambda: RunConfig(shift_policy="jump"),
        lambda: RunConfig(pose_correction=True),
        lambda: log_odds(0.0),
        lambda: scenarios.dynamic_corridor("up"),
        lambda: scenarios.constant_twist(Pose(0, 0), 1, 0, 0, 1),
    ],
)
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        bad()


def test_planar_poses():
    p, q = Pose(1.0, 2.0, 0.7), Pose(-3.0, 0.5, 2.9)
    back = composed(inverted(p), composed(p, q))
    assert (back.x, back.y, back.theta) == pytest.approx((q.x, q.y, q.theta))
    assert [wrap(a) for a in (0, math.pi, -math.pi, 3 * math.pi)] == pytest.approx([0, math.pi, math.pi, math.pi])


def test_trajectory_subsample_rounds_halves_to_even():
    t = Trajectory(tuple(Pose(i, 0) for i in range(6)), tuple(map(float, range(6))))
    assert [p.x for p in t.subsample(3).poses] == [0, 2, 5]
    assert [p.x for p in t.subsample(1).poses] == [0]
    assert t.subsample(9) is t


def test_scenarios_are_as_described():
    assert {k: (f().grid.shape, len(f().trajectory)) for k, f in scenarios.SCENARIOS.items()} == {
        "urban_block": ((200, 300), 51), "enclosed_room": ((46, 46), 9), "dynamic_corridor_approaching": ((120, 200), 41),
        "dynamic_corridor_receding": ((120, 200), 41), "dynamic_corridor_crossing": ((120, 200), 41),
    }
    still = scenarios.dynamic_corridor("crossing").frozen_at(8.0)
    assert not still.movers and still.discs[-1] == Disc(20.0, 13.6 + 1.6 * 8.0, 1.0)
    assert Mover(0, 0, 0, 0, 1).direction == (1.0, 0.0)


def test_parts_of_poses():
    p = Pose(1.0, 2.0, math.pi / 2)
    assert p.translation == (1.0, 2.0)
    assert p.rotation()[0] == pytest.approx((0.0, -1.0)) and p.rotation()[1] == pytest.approx((1.0, 0.0))
    assert Pose(1.0, 2.0, 3 * math.pi).normalized() == Pose(1.0, 2.0, wrap(3 * math.pi))


def test_defaults_and_limits_of_the_checks():
    """Clamps may be equal to the increments; defaults are those of a noisy sensor, snapped windows and a search of 0.8 m and 0.035 rad."""
    assert EvidenceModel(p_free=0.3, clamp_free_prob=0.3).l_min == pytest.approx(math.log(0.3 / 0.7))
    assert EvidenceModel(p_occupied=0.9, clamp_occupied_prob=0.9).l_max == pytest.approx(math.log(9))
    assert (Lidar().range_noise_std, Lidar().dropout_prob, RunConfig().shift_policy) == (0.03, 0.02, "snap")
    assert (SearchWindow().translation_radius, SearchWindow().heading_radius, SearchWindow().translation_step, SearchWindow().heading_step) == (0.8, 0.035, 0.2, 0.00873)
