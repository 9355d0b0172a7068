"""Parameters of maps, sensors, scenes and runs: small driver-side records that check themselves.

They describe a plan before it is built; data is in DataFrames, whose `run_id` column tells runs apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

#: Cell states; fixed values.
UNKNOWN, FREE, OCCUPIED = 0, 1, 2
STATES = {"UNKNOWN": UNKNOWN, "FREE": FREE, "OCCUPIED": OCCUPIED}


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def log_odds(p: float) -> float:
    """ln(p / (1 - p)) of a probability strictly between 0 and 1."""
    _need(0.0 < p < 1.0, f"a probability must lie strictly between 0 and 1, got {p}")
    return math.log(p / (1.0 - p))


# Default values of the records below are fixed values: results depend on them.


@dataclass(frozen=True)
class EvidenceModel:
    """Inverse sensor increments, clamps and decision band, all as probabilities."""

    prior: float = 0.5
    p_free: float = 0.4
    p_occupied: float = 0.7
    clamp_free_prob: float = 0.12
    clamp_occupied_prob: float = 0.97
    decision_prob: float = 0.65

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            _need(0.0 < getattr(self, name) < 1.0, f"{name} must lie strictly between 0 and 1")
        _need(self.p_free < self.prior < self.p_occupied, "p_free < prior < p_occupied must hold")
        _need(self.clamp_free_prob <= self.p_free and self.p_occupied <= self.clamp_occupied_prob, "the clamps must not lie inside the increments")
        _need(self.prior < self.decision_prob < self.clamp_occupied_prob, "decision_prob must lie between prior and clamp_occupied_prob")
        _need(self.clamp_free_prob < 1.0 - self.decision_prob, "clamp_free_prob must lie under 1 - decision_prob")

    l_prior = property(lambda self: log_odds(self.prior))
    l_free = property(lambda self: log_odds(self.p_free) - self.l_prior)
    l_occupied = property(lambda self: log_odds(self.p_occupied) - self.l_prior)
    l_min = property(lambda self: log_odds(self.clamp_free_prob))
    l_max = property(lambda self: log_odds(self.clamp_occupied_prob))
    l_decision = property(lambda self: log_odds(self.decision_prob) - self.l_prior)

    @property
    def forget_ratio(self) -> float:
        """Free observations that undo one occupied one."""
        return self.l_occupied / -self.l_free

    @property
    def observations_to_free(self) -> float:
        """Free observations from the prior to a free decision."""
        return self.l_decision / -self.l_free

    @property
    def observations_to_occupied(self) -> float:
        """Occupied observations from the free clamp to an occupied decision."""
        return (self.l_prior + self.l_decision - self.l_min) / self.l_occupied


@dataclass(frozen=True)
class Grid:
    """A map's geometry: rows along y, columns along x."""

    resolution: float
    rows: int
    cols: int
    origin_x: float = 0.0
    origin_y: float = 0.0

    def __post_init__(self):
        _need(self.resolution > 0 and self.rows > 0 and self.cols > 0, "resolution, rows and cols must be positive")

    shape = property(lambda self: (self.rows, self.cols))
    size = property(lambda self: self.rows * self.cols)
    cell_area = property(lambda self: self.resolution**2)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """Least x, greatest x, least y, greatest y."""
        return (self.origin_x, self.origin_x + self.cols * self.resolution, self.origin_y, self.origin_y + self.rows * self.resolution)

    def recentered(self, x: float, y: float) -> Grid:
        return replace(self, origin_x=x - self.cols * self.resolution / 2, origin_y=y - self.rows * self.resolution / 2)


@dataclass(frozen=True)
class Pose:
    x: float
    y: float
    theta: float = 0.0

    translation = property(lambda self: (self.x, self.y))

    def rotation(self) -> tuple[tuple[float, float], tuple[float, float]]:
        """Rows of the rotation's matrix."""
        c, s = math.cos(self.theta), math.sin(self.theta)
        return ((c, -s), (s, c))

    def normalized(self) -> Pose:
        """The same pose with its heading in (-pi, pi]."""
        return replace(self, theta=wrap(self.theta))


def wrap(angle: float) -> float:
    """The same angle in (-pi, pi]."""
    r = math.remainder(angle, 2.0 * math.pi)
    return math.pi if r == -math.pi else r


def composed(outer: Pose, inner: Pose) -> Pose:
    """Where `inner`, given in the frame of `outer`, lies in the frame of `outer`'s parent."""
    c, s = math.cos(outer.theta), math.sin(outer.theta)
    return Pose(outer.x + c * inner.x - s * inner.y, outer.y + s * inner.x + c * inner.y, wrap(outer.theta + inner.theta))


def inverted(pose: Pose) -> Pose:
    c, s = math.cos(pose.theta), math.sin(pose.theta)
    return Pose(-(c * pose.x + s * pose.y), s * pose.x - c * pose.y, wrap(-pose.theta))


@dataclass(frozen=True)
class Disc:
    x: float
    y: float
    r: float

    def __post_init__(self):
        _need(self.r > 0, "a radius must be positive")


@dataclass(frozen=True)
class Polygon:
    vertices: tuple[tuple[float, float], ...]

    def __post_init__(self):
        _need(len(self.vertices) >= 3, "a polygon needs three vertices")

    @classmethod
    def rectangle(cls, x0: float, y0: float, x1: float, y1: float) -> Polygon:
        return cls(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))

    def edges(self) -> list[tuple[float, float, float, float]]:
        """Start and end of each side; the last one closes the ring."""
        return [(*a, *b) for a, b in zip(self.vertices, (*self.vertices[1:], self.vertices[0]), strict=True)]


@dataclass(frozen=True)
class Mover:
    """A disc that moves at a constant velocity."""

    x: float
    y: float
    vx: float
    vy: float
    r: float

    def __post_init__(self):
        _need(self.r > 0, "a radius must be positive")

    speed = property(lambda self: math.hypot(self.vx, self.vy))

    @property
    def direction(self) -> tuple[float, float]:
        """Unit vector of the motion; along x for one that stands."""
        return (self.vx / self.speed, self.vy / self.speed) if self.speed else (1.0, 0.0)

    def at(self, time: float) -> Disc:
        return Disc(self.x + self.vx * time, self.y + self.vy * time, self.r)


@dataclass(frozen=True)
class Lidar:
    max_range: float = 30.0
    angular_resolution_deg: float = 0.5
    field_of_view_deg: float = 360.0
    range_noise_std: float = 0.03
    dropout_prob: float = 0.02
    min_range: float = 0.25

    def __post_init__(self):
        _need(self.max_range > self.min_range, "max_range must exceed min_range")
        _need(0 < self.angular_resolution_deg and 0 < self.field_of_view_deg <= 360, "the angles must be positive, the field of view at most 360")
        _need(self.range_noise_std >= 0 and 0 <= self.dropout_prob < 1, "noise must not be negative, dropout in [0, 1)")

    @property
    def beams(self) -> int:
        """Number of beams; halves round to even."""
        return max(1, round(self.field_of_view_deg / self.angular_resolution_deg))


@dataclass(frozen=True)
class OdometryNoise:
    translation_std_per_m: float = 0.0
    heading_std_per_m: float = 0.0
    heading_std_per_rad: float = 0.0

    def __post_init__(self):
        _need(min(self.translation_std_per_m, self.heading_std_per_m, self.heading_std_per_rad) >= 0, "noise must not be negative")

    is_exact = property(lambda self: self == OdometryNoise())

    def scaled(self, factor: float) -> OdometryNoise:
        _need(factor >= 0, "a factor must not be negative")
        return OdometryNoise(self.translation_std_per_m * factor, self.heading_std_per_m * factor, self.heading_std_per_rad * factor)


@dataclass(frozen=True)
class Trajectory:
    poses: tuple[Pose, ...]
    times: tuple[float, ...]

    def __post_init__(self):
        _need(len(self.poses) == len(self.times) > 0, "a trajectory needs as many times as poses, and one at least")

    def __len__(self) -> int:
        return len(self.poses)

    duration = property(lambda self: self.times[-1] - self.times[0])

    def subsample(self, count: int) -> Trajectory:
        """`count` poses evenly picked by index, halves to even; one pose is the first."""
        _need(count > 0, "count must be positive")
        n = len(self)
        if count >= n:
            return self
        picks = [0] if count == 1 else [round(i * (n - 1) / (count - 1)) for i in range(count)]
        return Trajectory(tuple(self.poses[i] for i in picks), tuple(self.times[i] for i in picks))


@dataclass(frozen=True)
class Scenario:
    name: str
    grid: Grid
    lidar: Lidar
    trajectory: Trajectory
    polygons: tuple[Polygon, ...] = ()
    discs: tuple[Disc, ...] = ()
    movers: tuple[Mover, ...] = ()
    model: EvidenceModel = field(default_factory=EvidenceModel)
    seed: int = 20260731

    def discs_at(self, time: float) -> tuple[Disc, ...]:
        return self.discs + tuple(m.at(time) for m in self.movers)

    def frozen_at(self, time: float) -> Scenario:
        """The same scene with its movers parked where they are at `time`."""
        return replace(self, name=f"{self.name}_parked", discs=self.discs_at(time), movers=())


@dataclass(frozen=True)
class SearchWindow:
    translation_radius: float = 0.8
    heading_radius: float = 0.035
    translation_step: float = 0.2
    heading_step: float = 0.00873
    refinements: int = 2

    def __post_init__(self):
        _need(self.translation_radius >= 0 and self.heading_radius >= 0, "radii must not be negative")
        _need(self.translation_step > 0 and self.heading_step > 0, "steps must be positive")
        _need(self.refinements >= 0, "refinements must not be negative")

    @classmethod
    def for_resolution(cls, resolution: float) -> SearchWindow:
        """Four cells and two degrees, by one cell and half a degree."""
        return cls(4.0 * resolution, math.radians(2.0), resolution, math.radians(0.5), 2)


@dataclass(frozen=True)
class RunConfig:
    frame: str = "world"
    shift_policy: str = "snap"
    ego_rows: int = 200
    ego_cols: int = 200
    max_steps: int | None = None
    odometry: OdometryNoise | None = None
    pose_correction: bool = False
    search: SearchWindow | None = None
    match_stride: int = 4

    def __post_init__(self):
        _need(self.frame in ("world", "ego"), "frame must be world or ego")
        _need(self.shift_policy in ("snap", "nearest", "bilinear"), "shift_policy must be snap, nearest or bilinear")
        _need(self.ego_rows > 0 and self.ego_cols > 0 and self.match_stride > 0, "sizes and stride must be positive")
        _need(self.max_steps is None or self.max_steps > 0, "max_steps must be positive")
        _need(not self.pose_correction or self.odometry is not None, "pose_correction needs an odometry model")
