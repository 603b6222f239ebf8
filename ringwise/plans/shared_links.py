"""Distinct other fraud cards reachable through a shared node (G4, G8-G10 core).

For every card ``c`` and link type ``t`` we need
``|{f fraud, f != c, f shares a node of type t with c}|``.  Joining edges with
edges emits every card pair inside a node - quadratic in a hot node (one email
domain can hold a third of all cards).  This plan meets pairs at sparse nodes
only, and never pairs of cards but of their node sets:

1. **Sets.**  The answer depends only on the card's *set* of nodes, so cards
   are grouped by an order-free signature of that set: degree plus two 64-bit
   hash sums, accumulated exactly as decimals.  The set work runs once per
   distinct set, on a representative card's links.  Nodes without a fraud
   card are left out first: they add nothing.
2. **Sparse nodes.**  A node in at most ``SPARSE`` sets of fraud cards emits
   the pairs of its sets with those: at most ``SPARSE`` rows a link.  A pair
   that has a hot node in common is left to step 3.
3. **Hot nodes, subset counts.**  A set's at most ``MAX_NODES`` hot nodes emit
   their subsets, with the number of the set's fraud cards; ``count(T)`` is how
   many fraud cards lie on all nodes of ``T``.  By inclusion and exclusion the
   fraud cards on any of the hot nodes are ``sum((-1)^(|T|+1) count(T))`` over
   their subsets ``T``: at most ``2^MAX_NODES`` rows however many cards a node
   holds.  Sets with the same hot nodes are cut once.
4. **Anchor.**  Where the asked or the fraud card has more hot nodes than that,
   the asked set's node with the most fraud cards counts directly, and only the
   fraud cards of its other nodes that are not on that node are joined.
5. A fraud card is in every one of its own nodes' sets, so it subtracts 1.

Everything is joins and partially-aggregated group-bys on Spark.  The links, the cards' signatures and the sets' links
are written once into the shared folder, because every later step reads them.  Their files are much smaller than their
rows in memory, so the joins are asked to merge: by the size of the files a side that grows with the cards would be sent
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwise.session import stored

#: Sets of more hot nodes are not cut into subsets.
MAX_NODES = 12
#: A node in more sets of fraud cards is hot.
SPARSE = 32

_SIG = ["node_type", "deg", "h1", "h2"]
_NODE = ["node_type", "node_id"]


def _h(seed: str):
    return F.sum(F.xxhash64(F.col("node_id"), F.lit(seed)).cast("decimal(38,0)"))


def subsets(groups: DataFrame) -> DataFrame:
    """``groups(group, n_fraud_cards, node_type, hot)`` -> one row per non-empty subset of the nodes in ``hot``: its two
    hashes ``t1, t2`` and its ``sign`` in the inclusion-exclusion sum."""
    nodes = F.transform("hot", lambda n: F.struct(F.xxhash64("node_type", n, F.lit("t1")).alias("a"),
                                                  F.xxhash64("node_type", n, F.lit("t2")).alias("b")))
    # few bytes become many rows: spread the groups over all tasks before they are cut
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # every node doubles the subsets made so far; the hashes of a subset are its nodes' hashes joined by exclusive or
    none = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("s")))
    every = F.aggregate(nodes, none, lambda made, n: F.concat(made, F.transform(made, lambda t: F.struct(
        t["a"].bitwiseXOR(n["a"]).alias("a"), t["b"].bitwiseXOR(n["b"]).alias("b"), (-t["s"]).alias("s")))))
    part = groups.repartition(tasks, "group").select("group", "n_fraud_cards", F.explode(F.slice(every, 2, F.size(every))).alias("t"))
    return part.select("group", "n_fraud_cards", F.col("t.a").alias("t1"), F.col("t.b").alias("t2"), F.col("t.s").alias("sign"))


def _by_subsets(hot: DataFrame) -> DataFrame:
    """``hot(set, node_type, n_fraud_cards, hot)`` -> ``(set, n)``: fraud cards of these sets that lie on a node of ``hot``."""
    groups = hot.groupBy("node_type", "hot").agg(F.min("set").alias("group"), F.sum("n_fraud_cards").alias("n_fraud_cards"))
    parts = subsets(groups)
    count = parts.where("n_fraud_cards > 0").groupBy("t1", "t2").agg(F.sum("n_fraud_cards").alias("c"))
    n = (parts.select("group", "t1", "t2", "sign").join(count.hint("merge"), ["t1", "t2"])
         .groupBy("group").agg(F.sum(F.col("sign") * F.col("c")).alias("n")))
    of = groups.drop("n_fraud_cards").join(n.hint("merge"), "group")
    return hot.select("set", "node_type", "hot").join(of.hint("merge"), ["node_type", "hot"]).select("set", "n")


def _by_pairs(links: DataFrame) -> DataFrame:
    """``links(set, node_type, node_id, n_fraud_cards, hot)`` at sparse nodes -> ``(set, n)``: fraud cards on a node of the
    set, less those of sets that also share a node of ``hot`` with it."""
    fraud = links.where("n_fraud_cards > 0").select(*_NODE, F.col("set").alias("f"), F.col("n_fraud_cards").alias("n"),
                                                    F.col("hot").alias("f_hot"))
    met = (links.select(*_NODE, "set", "hot").join(fraud.hint("merge"), _NODE)
           .where(~F.coalesce(F.arrays_overlap("hot", "f_hot"), F.lit(False))))
    return met.select("set", "f", "n").distinct().groupBy("set").agg(F.sum("n").alias("n"))


def _by_anchor(links: DataFrame, met: DataFrame) -> DataFrame:
    """``(set, n)``: fraud cards of the sets in ``met(f, n, node_type, node_id)`` that lie on a node of the set in ``links``."""
    nf = met.groupBy(*_NODE).agg(F.sum("n").alias("nf"))
    live = links.select("set", *_NODE).join(nf.hint("merge"), _NODE)
    best = (live.groupBy("set").agg(F.max(F.struct("nf", "node_id")).alias("a"))
            .select("set", F.col("a.node_id").alias("anchor"), F.col("a.nf").alias("anchor_nf")))
    others = live.join(best.hint("merge"), "set").where("node_id <> anchor").select("set", *_NODE, "anchor")
    at_anchor = met.select("f", "node_type", F.col("node_id").alias("anchor"))
    extra = (others.join(met.hint("merge"), _NODE)
             .join(at_anchor.hint("merge"), ["f", "node_type", "anchor"], "left_anti")
             .select("set", "f", "n").distinct().groupBy("set").agg(F.sum("n").alias("extra")))
    return best.join(extra.hint("merge"), "set", "left").select("set", (F.col("anchor_nf") + F.coalesce("extra", F.lit(0))).alias("n"))


def _by_sets(links: DataFrame, max_nodes: int, sparse: int) -> DataFrame:
    """``links(set, n_fraud_cards, node_type, node_id)`` -> ``(set, n)``: fraud cards that lie on a node of the set."""
    busy = (links.groupBy(*_NODE).agg(F.count_if(F.col("n_fraud_cards") > 0).alias("sets"))
            .select(*_NODE, (F.col("sets") > sparse).alias("is_hot")))
    links = stored(links.join(busy.hint("merge"), _NODE))
    hot = links.where("is_hot").withColumn("n_hot", F.count(F.lit(1)).over(Window.partitionBy("set")))
    hot = stored(hot)
    few = stored(hot.where(F.col("n_hot") <= max_nodes).groupBy("set", "node_type", "n_fraud_cards")
                 .agg(F.array_sort(F.collect_list("node_id")).alias("hot")))
    many = stored(hot.where(F.col("n_hot") > max_nodes).select("set").distinct())
    none = many.isEmpty()
    rest = links if none else links.join(many.hint("merge"), "set", "left_anti")
    cold = stored(rest.where("not is_hot").join(few.select("set", "hot").hint("merge"), "set", "left"))
    out = _by_subsets(few).unionByName(_by_pairs(cold))
    if not none:
        # a set of many hot nodes meets every fraud card by its anchor, any other set only the fraud cards of such sets
        wide = stored(links.join(many.hint("merge"), "set", "left_semi"))
        at = wide.select(*_NODE).distinct()
        met = links.where("n_fraud_cards > 0").select(F.col("set").alias("f"), F.col("n_fraud_cards").alias("n"), *_NODE)
        wide_met = wide.where("n_fraud_cards > 0").select(F.col("set").alias("f"), F.col("n_fraud_cards").alias("n"), *_NODE)
        out = (out.unionByName(_by_anchor(wide, met.join(at.hint("merge"), _NODE, "left_semi")))
               .unionByName(_by_anchor(rest.join(at.hint("merge"), _NODE, "left_semi"), wide_met)))
    return out.groupBy("set").agg(F.sum("n").alias("n"))


def other_fraud_counts(edges: DataFrame, fraud: DataFrame, max_nodes: int = MAX_NODES, sparse: int = SPARSE) -> DataFrame:
    """``(card_id, node_type, n_fraud)`` for every card with at least one edge.

    ``edges``: distinct ``(card_id, node_type, node_id)``; ``fraud``: ``card_id`` of fraud cards.
    """
    ff = fraud.select("card_id").distinct().withColumn("self", F.lit(1))
    every = stored(edges.select("card_id", "node_type", "node_id").join(ff.hint("merge"), "card_id", "left")
                   .withColumn("self", F.coalesce("self", F.lit(0))))
    used = every.where("self = 1").select(*_NODE).distinct()
    live = stored(every.join(used.hint("merge"), _NODE, "left_semi"))
    cards = stored(live.groupBy("card_id", "node_type", "self")
                   .agg(F.count(F.lit(1)).alias("deg"), _h("s1").alias("h1"), _h("s2").alias("h2")))
    sets = stored(cards.groupBy(*_SIG).agg(F.min("card_id").alias("card_id"), F.sum("self").alias("n_fraud_cards"))
                  .withColumn("set", F.monotonically_increasing_id()))
    links = stored(sets.select("set", "n_fraud_cards", "card_id", "node_type")
                   .join(live.drop("self").hint("merge"), ["card_id", "node_type"]).drop("card_id"))
    n = sets.select("set", *_SIG).join(_by_sets(links, max_nodes, sparse).hint("merge"), "set").drop("set")
    found = cards.join(n.hint("merge"), _SIG).select("card_id", "node_type", (F.col("n") - F.col("self")).alias("n"))
    return (every.select("card_id", "node_type").distinct().join(found.hint("merge"), ["card_id", "node_type"], "left")
            .select("card_id", "node_type", F.coalesce("n", F.lit(0)).cast("long").alias("n_fraud")))


def other_fraud_counts_naive(edges: DataFrame, fraud: DataFrame) -> DataFrame:
    """Brute-force twin (pairs inside each node) - for tests on small fixtures only."""
    fe = edges.join(fraud.select("card_id").distinct(), "card_id") \
        .select("node_type", "node_id", F.col("card_id").alias("other"))
    return (edges.join(fe, ["node_type", "node_id"])
            .where(F.col("other") != F.col("card_id"))
            .groupBy("card_id", "node_type").agg(F.countDistinct("other").alias("n_fraud")))
