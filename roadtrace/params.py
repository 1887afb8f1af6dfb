"""Parameters of the two jobs."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The road classes that count as drivable roads.
ROAD_CLASSES = (
    "motorway",
    "trunk",
    "primary",
    "secondary",
    "tertiary",
    "unclassified",
    "residential",
)

# The city-centre box, latitude then longitude, both ends included.
CENTRE_LAT = (45.4370, 45.5020)
CENTRE_LON = (9.1344, 9.2344)

# Quality limits of a trajectory worth matching.
MIN_MEAN_SPACING = 0.01
MIN_MEAN_SPEED = 25
MIN_POINTS_ABOVE = 25

# Smallest distance used for an emission, default GPS noise, default top-k.
DISTANCE_FLOOR = 5.0
GPS_SIGMA = 10.0
TOP_K = 50


@dataclass(frozen=True)
class SegmentParams:
    """Limits of the ping filter and of the cut into trajectories.

    ``block_seconds`` only sets how a user's time line is split over tasks; results do not depend on it.
    """

    time_range: tuple[int, int] = (1504224000, 1514764800)
    lat_range: tuple[float, float] = (45.38673, 45.53586)
    lon_range: tuple[float, float] = (9.04088, 9.27812)
    max_accuracy: int = 100
    min_pings: int = 50
    max_gap: int = 60
    digits: int = 6
    zone: str = "Europe/Rome"
    block_seconds: int = 3600

    def __post_init__(self) -> None:
        if self.block_seconds < 3 * self.max_gap:
            raise ValueError("block_seconds must be at least three times max_gap")


@dataclass(frozen=True)
class MatchParams:
    """Parameters of map matching.

    alpha   roads kept per point
    beta    scale of the transition probability
    tau     search radius, in projected units
    theta   longest path in hops (at least 2)
    gamma   a path is only extended while the roads before the new one sum to less than this many metres
    top_k   keep only the k trajectories with most points in the centre box; None keeps all

    ``frame`` and ``foot_frame`` choose the projection of the candidate search and of the foot points (see
    ``functions.geo.project``).  ``keep_dead_ends`` set to False drops a road reached at hop theta-1 that has
    no neighbour outside its path.  ``full_length`` measures roads along their pieces, with feet on the nearest edge
    and routes from place to place, instead of from first to last node.  ``emission`` is ``inverse`` (share of the
    inverse distances) or ``gaussian`` (density of the distance).  ``block_seconds`` only sets how a trajectory is split over tasks, ``part_points`` and ``part_edges`` how a
    crowded cell of the candidate search is.  ``restart`` begins a new chain of roads where no candidate of a point can be
    reached; else the rest of the trajectory has none.

    Cost: with theta up to 4 only the cheapest path per pair of roads goes on after each hop; with more hops, or with
    ``keep_dead_ends=False``, a number of paths that depends on theta alone (at most 10 with theta 6).
    """

    alpha: int = 4
    beta: int = 10
    tau: int = 100
    theta: int = 4
    gamma: float = 200.0
    top_k: int | None = None
    frame: str = "mercator"
    foot_frame: str = "swapped"
    keep_dead_ends: bool = True
    full_length: bool = False
    emission: str = "inverse"
    block_seconds: int = 600
    restart: bool = False
    part_points: int = 4096
    part_edges: int = 1024

    def __post_init__(self) -> None:
        if self.theta < 2:
            raise ValueError("theta must be at least 2")
        if self.alpha < 1 or self.beta <= 0 or self.tau <= 0:
            raise ValueError("alpha, beta and tau must be positive")
        if self.emission not in ("inverse", "gaussian"):
            raise ValueError("emission must be inverse or gaussian")
        if self.block_seconds < 1:
            raise ValueError("block_seconds must be positive")
        if self.part_points < 1 or self.part_edges < 1:
            raise ValueError("part_points and part_edges must be positive")
        # The decoder adds whole numbers: 10^9 per unit of log probability, times room for the candidate.  A block has
        # at most one point per second, and consecutive points are taken to be less than 100 km apart.
        per_point = 1e5 / self.beta + abs(math.log(self.beta)) + max(20.0, self.tau**2 / (2 * GPS_SIGMA**2) + 5)
        if self.block_seconds * per_point * 2 * (self.alpha + 1) * 1e9 >= 2.0**63:
            raise ValueError("block_seconds is too long for beta, alpha and tau: scores would leave the bigint range")

    @classmethod
    def from_args(cls, args: list[str]) -> MatchParams:
        """Five ``name=value`` arguments in the order alpha, beta, tau, theta, gamma; names are not read.

        Any sixth argument turns on the top-50 subset.
        """
        if len(args) < 5:
            raise ValueError("five arguments are needed, such as: alpha=4 beta=10 tau=100 theta=4 gamma=200")
        values = [a.split("=", 1)[-1] for a in args[:5]]
        alpha, beta, tau, theta = (int(v) for v in values[:4])
        top_k = TOP_K if len(args) == 6 else None
        return cls(alpha, beta, tau, theta, float(values[4]), top_k)
