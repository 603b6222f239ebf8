"""Connected components of an undirected edge table by alternating large-star and small-star rounds.

Every round is two group-bys with map-side partial minima and two joins; a hub is a hot key of a plain
inner join, which adaptive execution splits.  Each round is cut with a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.session import files, stored


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60, about: int | None = None) -> DataFrame:
    """``edges(u, v)`` (longs) -> ``(node, component)`` for every node with an edge to another node.

    ``component`` is the smallest node reachable.  Nulls, self-loops and repeated edges are ignored; an empty
    table gives an empty table.  ``about``: how many edges there are, for the number of files.  Raises if ``max_rounds`` do not suffice (rounds grow with log of the size).
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e if about is None else e.coalesce(files(about)))
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large-star: every larger neighbour of u is linked to u's smallest neighbour (or u itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: every smaller neighbour of u, and u, are linked to u's smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small.coalesce(files(state[0])))
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
