"""Command line: ``spark-submit`` entry of the two programs.

    jobs.py match alpha=4 beta=10 tau=100 theta=4 gamma=200 [top50]
    jobs.py segment <ping table> <output table> [daily]
    jobs.py load <ways, nodes or trajectories> <text files> <output table> [checked]

``segment ... daily`` replaces the days it finds in a table by day and leaves the others.
``load ... checked`` keeps lines with a missing or unreadable field out of the table and puts them, with the names of
these fields, into ``<output table>_rejects``.

Tables are those of the session's metastore.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from roadtrace.operators.segment import segment
from roadtrace.params import MatchParams
from roadtrace.plans.match import match
from roadtrace.sources.readers import read_nodes, read_pings, read_trajectories, read_ways
from roadtrace.sources.sinks import write_matches, write_segments, write_segments_daily
from roadtrace.sources.text import load_text, write_checked_text

# Names of the input and output tables.
WAYS_TABLE = "osmwaysmilan"
NODES_TABLE = "osmnodesmilan"
TRAJECTORIES_TABLE = "trajectories"
MATCHES_TABLE = "MapMatchedTrajectories"


def run_match(spark: SparkSession, args: list[str]) -> None:
    """Match the trajectories table on the way and node tables and write the routes."""
    found = match(
        read_trajectories(spark, TRAJECTORIES_TABLE),
        read_ways(spark, WAYS_TABLE),
        read_nodes(spark, NODES_TABLE),
        MatchParams.from_args(args),
    )
    write_matches(found, MATCHES_TABLE)


def run_segment(spark: SparkSession, args: list[str]) -> None:
    """Segment the pings of one table into another."""
    source, target, *daily = args
    write = write_segments_daily if daily else write_segments
    write(segment(read_pings(spark, source)), target)


def run_load(spark: SparkSession, args: list[str]) -> None:
    """Comma-separated text into a table that the other programs read."""
    kind, path, target, *checked = args
    if checked:
        print(write_checked_text(spark.read.text(path), kind, target))
        return
    load_text(spark, path, kind).write.mode("overwrite").saveAsTable(target)


def main(args: list[str]) -> None:
    programs = {"match": run_match, "segment": run_segment, "load": run_load}
    if not args or args[0] not in programs:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName(f"roadtrace {args[0]}").enableHiveSupport().getOrCreate()
    programs[args[0]](spark, args[1:])


if __name__ == "__main__":
    main(sys.argv[1:])
