"""Map matching of GPS trajectories on road networks, as Spark DataFrame operations."""

from roadtrace.params import MatchParams, SegmentParams

__all__ = ["MatchParams", "SegmentParams"]
