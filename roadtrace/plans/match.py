"""Map matching end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadtrace.operators.candidates import candidate_points, candidate_roads, candidates, road_cells
from roadtrace.operators.decode import decode
from roadtrace.operators.paths import measured_facts, neighbor_paths, path_facts
from roadtrace.operators.roads import HUB_ROADS, adjacency, adjacency_parts, build_roads, connected_roads
from roadtrace.operators.route import routes
from roadtrace.operators.select import quality_trajectories, top_trajectories
from roadtrace.operators.transitions import linked_points, transitions
from roadtrace.params import MatchParams
from roadtrace.staging import staged


class Network:
    """Road tables that several steps read, computed once; the pairs when they are first asked for."""

    def __init__(self, roads: DataFrame):
        self.roads = staged(roads)
        self._pairs: DataFrame | None = None
        self._parts: tuple[DataFrame, DataFrame | None] | None = None

    @property
    def pairs(self) -> DataFrame:
        if self._pairs is None:
            self._pairs = staged(adjacency(self.roads))
        return self._pairs

    def parts(self, hub_roads: int = HUB_ROADS) -> tuple[DataFrame, DataFrame | None]:
        """Pairs without those of crowded nodes, and the roads at such nodes if there are any."""
        if self._parts is None:
            pairs, hubs = (staged(part) for part in adjacency_parts(self.roads, hub_roads))
            self._parts = pairs, None if hubs.isEmpty() else hubs
        return self._parts


def network(ways: DataFrame, nodes: DataFrame, p: MatchParams = MatchParams()) -> Network:
    return Network(build_roads(ways, nodes, p.full_length))


def selected_points(trajectories: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Trajectories worth matching, all or the top k of the centre."""
    good = quality_trajectories(trajectories)
    return good if p.top_k is None else top_trajectories(good, p.top_k)


def found_candidates(points: DataFrame, net: Network, p: MatchParams = MatchParams()) -> DataFrame:
    """Candidate rows of the points, among roads that share a node with another one."""
    return candidates(points, road_cells(connected_roads(net.roads), p), p)


def matched_candidates(points: DataFrame, net: Network, p: MatchParams = MatchParams()) -> DataFrame:
    """Points with their candidates: paths, links and moves all read them."""
    return staged(candidate_points(found_candidates(points, net, p), p))


def path_starts(points: DataFrame, net: Network) -> DataFrame:
    """Roads that are a candidate of some point, with their places, by which the search of paths deals them."""
    return net.roads.join(candidate_roads(points), "road_id", "left_semi").select("road_id", "lat0", "lon0")


def candidate_paths(points: DataFrame, net: Network, p: MatchParams = MatchParams()) -> DataFrame:
    """Paths that start at a candidate road."""
    pairs, hubs = net.parts()
    return staged(neighbor_paths(pairs, path_starts(points, net), p, hubs))


def scored_moves(points: DataFrame, paths: DataFrame, net: Network, p: MatchParams = MatchParams()) -> DataFrame:
    """Moves between candidates of consecutive points."""
    facts = measured_facts(paths, net.roads) if p.full_length else path_facts(paths)
    return transitions(linked_points(points), facts, p)


def match(trajectories: DataFrame, ways: DataFrame, nodes: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Trajectories, ways and nodes to driven roads."""
    net = network(ways, nodes, p)
    points = matched_candidates(selected_points(trajectories, p), net, p)
    paths = candidate_paths(points, net, p)
    return routes(decode(scored_moves(points, paths, net, p), p), paths)
