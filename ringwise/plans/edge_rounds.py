"""Rounds of messages along a fixed edge table (PageRank, community moves).

The edges are written once, bucketed by source, so a round moves the values of the vertices and what they send, never
the edges.  The values of a bucket, one row a vertex, are hashed and the edges stream past them unsorted.  A source with
more than ``HUBS // 20`` edges and a ``1 / HUBS`` share of all would fill one bucket: those hubs, fewer than ``HUBS`` by that
share, send their few values to every task instead; every round reads the values once more for them.  Their edges are bucketed
by target, so what hubs send to one vertex is summed before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.session import bucketed, stored

HUBS = 300_000


class EdgeRounds:
    def __init__(self, edges: DataFrame):
        """``edges(src, dst, w, ...)`` with every direction that messages take."""
        self.edges = stored(edges)
        total = self.edges.count()
        self.hubs = stored(self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
                           .where(F.col("n") > max(total // HUBS, HUBS // 20)).select("src"))
        self.has_hubs = not self.hubs.isEmpty()
        cold = self.edges
        if self.has_hubs:
            cold = self.edges.join(F.broadcast(self.hubs), "src", "left_anti")
            self.hot = bucketed(self.edges.join(F.broadcast(self.hubs), "src", "left_semi"), "dst")
        self.cold = bucketed(cold, "src")

    def send_cold(self, values: DataFrame) -> DataFrame:
        """``send`` along the edges of all vertices but the hubs."""
        return self.cold.join(values.withColumnRenamed("v", "src").hint("shuffle_hash"), "src")

    def send_hot(self, values: DataFrame) -> DataFrame:
        """``send`` along the edges of the hubs; the rows lie by ``dst``, in as many parts as the buckets."""
        few = values.withColumnRenamed("v", "src").join(F.broadcast(self.hubs), "src", "left_semi")
        return self.hot.join(F.broadcast(few), "src")

    def send(self, values: DataFrame) -> DataFrame:
        """Every edge of a vertex with its values: ``values(v, ...)`` -> ``(src, dst, w, ...)``.

        With hubs ``values`` is read twice, so it should be a stored table.
        """
        out = self.send_cold(values)
        return out.unionByName(self.send_hot(values)) if self.has_hubs else out
