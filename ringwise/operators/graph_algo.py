"""Graph algorithms over the card-node graph.

Vertices are cards plus typed nodes (``device:<id>``, ``email:<id>``,
``address:<id>``); every distinct card-node link is an undirected edge, so
parallel links of different types count separately.  Iterations are
DataFrame joins and group-bys over edges bucketed by source, on vertex numbers
that stand in the order of the names; lineage is cut in ``spark.checkpoint.dir``.

Fixed values: PageRank 30 rounds, damping 0.85, start rank 1,
un-normalised form ``0.15 + 0.85 * sum(rank / degree)``; community risk keeps
communities with >= 3 cards, top 20; members top 50 by PageRank.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwise.plans.edge_rounds import EdgeRounds
from ringwise.session import at_once, bucketed, stored


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("card_id").alias("src"), F.concat_ws(":", "node_type", "node_id").alias("dst"))


def _both_ways(one: DataFrame) -> DataFrame:
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertex_edges(edges: DataFrame) -> DataFrame:
    """Undirected edge list ``(src, dst)`` over card and typed-node vertices (both directions)."""
    return _both_ways(_pairs(edges))


class VertexGraph:
    """The card-node graph on numbers: ``names(v, name)``, ``degrees(v, k, own)`` and rounds over ``(src, dst, w, to_k)``.

    Numbers ascend with the names, so the smallest number is the smallest name.  The names are sorted and written once,
    and everything later reads what was written; ``to_k`` is the degree of ``dst``.
    """

    def __init__(self, edges: DataFrame):
        one = stored(_pairs(edges))
        self.names = stored(_both_ways(one).select(F.col("src").alias("name")).distinct().orderBy("name")
                            .select(F.monotonically_increasing_id().alias("v"), "name"))
        for end in ("src", "dst"):
            one = (one.withColumnRenamed(end, "name").join(self.names.hint("shuffle_hash"), "name").drop("name")
                   .withColumnRenamed("v", end))
        self.size = (self.names.agg(F.max("v")).first()[0] or 0) + 1  # above every number
        both = _both_ways(stored(one.select("src", "dst"))).withColumn("w", F.lit(1).cast("long"))
        self.degrees = bucketed(_degrees(both), "v")
        self.rounds = EdgeRounds(_with_target(both, self.degrees))

    def named(self, df: DataFrame, *cols: str) -> DataFrame:
        """``df`` with the names of the vertices in ``cols`` in place of their numbers."""
        for col in cols:
            rest = [F.col("name").alias(c) if c == col else F.col(c) for c in df.columns]
            df = df.join(self.names.select(F.col("v").alias(col), "name").hint("merge"), col).select(*rest)
        return df


def _degrees(edges: DataFrame) -> DataFrame:
    own = F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0)
    return edges.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"), F.sum(own).alias("own"))


def _with_target(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    return edges.join(degrees.select(F.col("v").alias("dst"), F.col("k").alias("to_k")).hint("shuffle_hash"), "dst")


def pagerank(edges: DataFrame | VertexGraph, iters: int = 30, d: float = 0.85, cut_every: int = 10) -> DataFrame:
    """``(vertex, kind, rank)`` after a fixed number of synchronous rounds.

    The edges lie bucketed by source, the degrees by vertex: a round exchanges contributions only.
    """
    graph = edges if isinstance(edges, VertexGraph) else VertexGraph(edges)
    rounds = graph.rounds
    ranks = graph.degrees.withColumn("rank", F.lit(1.0))
    for i in range(1, iters + 1):
        share = ranks.select("v", (F.col("rank") / F.col("k")).alias("x"))
        if rounds.has_hubs or i % cut_every == 0:
            share = stored(share)  # hubs read the shares a second time
        got = graph.degrees.join(_sums(rounds.send_cold(share)).hint("shuffle_hash"), "v", "left")
        s = F.coalesce("s", F.lit(0.0))
        if rounds.has_hubs:
            hot = _sums(rounds.send_hot(share)).withColumnRenamed("s", "hot")
            got = got.join(hot.hint("shuffle_hash"), "v", "left")
            s = s + F.coalesce("hot", F.lit(0.0))
        ranks = got.select("v", "k", (1.0 - d + d * s).alias("rank"))
    return graph.named(ranks, "v").select("v", _kind("v"), F.round("rank", 9).alias("rank"))


def _sums(sent: DataFrame) -> DataFrame:
    return sent.groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("x") * F.col("w")).alias("s"))


def _kind(v: str):
    return F.when(F.col(v).contains(":"), F.substring_index(v, ":", 1)).otherwise(F.lit("card")).alias("kind")


def _wide(x: str | int) -> str:
    return f"CAST({x} AS DECIMAL(38,0))"


def _exact(x: str | int, twice_m: int) -> str:
    """A factor of products up to ``twice_m ** 2``: long where those fit, else a decimal."""
    return f"CAST({x} AS LONG)" if twice_m < 2 ** 31 else _wide(x)


def draws(turns: list[int]) -> Column:
    """One bit for every turn: whether the vertex ``name`` may move in it."""
    bit = [F.when(F.substring(F.md5(F.concat("name", F.lit(f":{turn}"))), 1, 1) < "8", 1 << i).otherwise(0)
           for i, turn in enumerate(turns)]
    return sum(bit[1:], bit[0]).cast("long")


def move_round(state: DataFrame, rounds: EdgeRounds, twice_m: int, size: int, bit: int, vertices: DataFrame | None = None) -> DataFrame:
    """One synchronous round of community moves by modularity gain.

    ``state(v, k, own, draw, c, total)``, with hubs a stored table (``k`` degree, ``own`` self-loop weight, ``c`` community of
    degree ``total``) -> the same with ``inside`` (weight to the own community), ``next`` and ``wants``.  ``vertices`` may be the
    same rows without ``total`` where those are cheaper to read.  Joining C is worth
    ``w(v, C) * 2m - k * total(C)``, staying ``w(v, c) * 2m - k * (total(c) - k)``; the best C (ties: smallest name) wins only
    when strictly better.  Half of the vertices, drawn by a hash of name and turn, may move in a turn, so neighbours seldom
    swap places.  The best is the smallest ``-worth * size + number`` (numbers are below ``size``), one decimal that is
    aggregated without sorting.  Messages bring the total of their community along and edges the degree of their target, so what arrives
    is scored where it is summed and never joined.
    """
    m2 = _exact(twice_m, twice_m)
    sent = (rounds.send(state.select("v", "c", "total")).where("src <> dst")
            .selectExpr("dst AS v", "to_k AS k", "c AS to", "total", "w", "0 AS mine"))
    mine = state.selectExpr("v", "k", "c AS to", "total", "0L AS w", "1 AS mine")
    links = sent.union(mine).groupBy("v", "k", "to", "total").agg(F.expr("sum(w) AS w"), F.expr("max(mine) AS mine"))
    low = f"{_exact('k', twice_m)} * {_exact('total', twice_m)} - {_exact('w', twice_m)} * {m2}"
    best = links.groupBy("v").agg(F.expr(f"min(CASE WHEN mine = 0 THEN {_wide(low)} * {_wide(size)} + to END) AS best"),
                                  F.expr("sum(CASE WHEN mine = 1 THEN w END) AS inside"),
                                  F.expr("max(CASE WHEN mine = 1 THEN total END) AS total"))
    stay = f"({_exact('inside', twice_m)} * {m2} - {_exact('k', twice_m)} * {_exact('total - k', twice_m)})"
    rows = (state if vertices is None else vertices).select("v", "k", "own", "draw", "c")
    return (rows.join(best.hint("shuffle_hash"), "v")
            .selectExpr("*", f"coalesce(best < {_wide('-' + stay)} * {_wide(size)}, false) AS wants")
            .selectExpr("v", "k", "own", "draw", "c", "total", "inside", "wants",
                        f"CASE WHEN wants AND (draw & {1 << bit}L) <> 0 THEN CAST(pmod(best, {_wide(size)}) AS LONG) ELSE c END AS next"))


def modularity_sum(round_: DataFrame, twice_m: int) -> tuple[int, int]:
    """Modularity times ``(2m)^2`` of the communities ``c``, exactly, and how many vertices want to move.

    A community's squared total is the sum of ``k * total`` over its vertices.
    """
    r = round_.selectExpr("sum(inside + own)", f"sum({_exact('k', twice_m)} * {_exact('total', twice_m)})", "count_if(wants)").first()
    return int(r[0]) * twice_m - int(r[1]), int(r[2])


def _with_total(state: DataFrame) -> DataFrame:
    totals = state.groupBy("c").agg(F.sum("k").alias("total"))
    return state.join(totals.hint("shuffle_hash"), "c").select("v", "k", "own", "draw", "c", "total")


def _next_round(done: DataFrame, rounds: EdgeRounds, twice_m: int, size: int) -> DataFrame:
    """The turn after ``done``, stored; its draw is the next bit, so every turn is the same code."""
    vertices = done.selectExpr("v", "k", "own", "shiftright(draw, 1) AS draw", "next AS c")
    if rounds.has_hubs:
        return stored(move_round(stored(_with_total(vertices)), rounds, twice_m, size, 0))
    return stored(move_round(_with_total(vertices), rounds, twice_m, size, 0, vertices))


def louvain(edges: DataFrame | VertexGraph, levels: int = 3, turns: int = 8) -> tuple[DataFrame, list[float]]:
    """``(v, community)`` of every vertex, and the modularity reached by each level.

    Blondel, Guillaume, Lambiotte and Lefebvre (2008) as DataFrame rounds: on every level the vertices move for at most
    ``turns`` turns and the best state (the earliest of equals) is kept, so modularity never falls; then communities
    become the vertices of the next level, with the weights between them.  A community is named after one of its vertices.
    """
    graph = edges if isinstance(edges, VertexGraph) else VertexGraph(edges)
    twice_m = graph.degrees.agg(F.sum("k")).first()[0] or 0
    found, reached = graph.degrees.select("v", F.col("v").alias("community")), []
    rounds, members = graph.rounds, graph.degrees
    for level in range(levels if twice_m else 0):
        if level:
            weights = stored(weights)
            members = stored(_degrees(weights))
            rounds = EdgeRounds(_with_target(weights, members))
        drawn = draws([level * 100 + t for t in range(turns + 1)]).alias("draw")  # after the join: for the members only
        state = stored(graph.names.join(members.hint("shuffle_hash"), "v")
                       .select("v", "k", "own", drawn, F.col("v").alias("c"), F.col("k").alias("total")))
        kept, best, first = state, None, None
        done = stored(move_round(state, rounds, twice_m, graph.size, 0))
        for turn in range(turns + 1):
            # the next turn starts while this one's figures are summed; without hubs its state is no table of its own
            works = [partial(modularity_sum, done, twice_m)]
            if turn < turns:
                works.append(partial(_next_round, done, rounds, twice_m, graph.size))
            (q, wants), *after = at_once(*works)
            first = q if first is None else first
            if best is None or q > best:
                kept, best = done.select("v", "c"), q
            if not wants or not after:
                break
            done = after[0]
        reached.append(best / twice_m ** 2)
        if best == first:  # nothing was gained: further levels would repeat this one
            break
        found = stored(found.join(kept.select(F.col("v").alias("community"), "c").hint("merge"), "community")
                       .select("v", F.col("c").alias("community")))
        # what every vertex gets from a community is summed first: fewer rows, and those of hubs are spread
        weights = (rounds.send(kept).groupBy("dst", F.col("c").alias("src")).agg(F.sum("w").alias("w"))
                   .join(kept.withColumnRenamed("v", "dst").hint("merge"), "dst")
                   .groupBy("src", F.col("c").alias("dst")).agg(F.sum("w").alias("w")))
    return graph.named(found, "v", "community"), reached


def communities(edges: DataFrame | VertexGraph, levels: int = 3, turns: int = 8) -> DataFrame:
    """``(v, kind, community)`` by modularity, every vertex once."""
    found, _ = louvain(edges, levels, turns)
    return found.select("v", _kind("v"), "community")


def community_risk(comm: DataFrame, cards: DataFrame, min_size: int = 3, k: int = 20) -> DataFrame:
    """Card communities with >= ``min_size`` cards - mean card fraud rate (4 dp), fraud and total
    transactions; the ``k`` riskiest."""
    c = comm.where(F.col("kind") == "card").join(cards, F.col("v") == F.col("card_id"))
    g = (c.groupBy("community").agg(F.count(F.lit(1)).alias("ring_size"), F.avg("fraud_rate").alias("_avg"),
                                    F.sum("fraud_txn").alias("total_fraud_txn"), F.sum("total_txn").alias("total_txn"))
         .where(F.col("ring_size") >= min_size))
    return (g.select(F.col("community").alias("ring_id"), "ring_size", F.round("_avg", 4).alias("avg_fraud_rate"),
                     "total_fraud_txn", "total_txn")
            .orderBy(F.desc("avg_fraud_rate"), "ring_id").limit(k))


def members(comm: DataFrame, ranks: DataFrame, cards: DataFrame, k: int = 50) -> DataFrame:
    """For every community, its top-``k`` cards by PageRank (windowed, all communities at once)."""
    c = (comm.where(F.col("kind") == "card").join(ranks.select("v", "rank"), "v")
         .join(cards, F.col("v") == F.col("card_id")))
    w = Window.partitionBy("community").orderBy(F.desc("rank"), "card_id")
    return (c.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
            .select("community", "pos", "card_id", "fraud_rate", F.col("rank").alias("pagerank"),
                    "total_txn", "fraud_txn"))


def node_rings(comm: DataFrame, ranks: DataFrame) -> DataFrame:
    """Vertex -> (community, PageRank) for every vertex type."""
    return comm.join(ranks.select("v", "rank"), "v").select(
        F.col("kind").alias("node_type"), F.col("v").alias("node_key"), "community", F.col("rank").alias("pagerank"))
