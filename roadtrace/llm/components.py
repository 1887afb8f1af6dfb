"""Connected components of a table of links, by alternating large and small stars.

Every round is two aggregations and two joins over the links; nothing is collected.  A round replaces the links of a
node by links to the smallest node it knows, so chains get shorter by a constant factor and the number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed


def _links(df: DataFrame, u: str, v: str) -> DataFrame:
    """Distinct links from the larger node ``u`` to the smaller ``v``."""
    a, b = F.col(u), F.col(v)
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _links(both.join(smallest, "u").where(F.col("v") > F.col("u")), "v", "m")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(smallest, "u")
    return _links(joined.select("v", "m").unionByName(smallest.select(F.col("u").alias("v"), "m")), "v", "m")


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links (up to collisions of a 64-bit digest)."""
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``node`` and ``component``, the smallest node it can reach, for all nodes with a link to another one.

    Links may come in any direction and repeatedly; those with a null end or two equal ends are dropped.
    """
    known = checkpointed(_links(links.where(F.col(u).isNotNull() & F.col(v).isNotNull()), u, v))
    before = _state(known)
    while before[0]:
        known = checkpointed(_small_star(_large_star(known)))
        after = _state(known)
        if after == before:
            break
        before = after
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
