"""Fraud rings and card checks.

Ring tables group the card-node links by node (partial aggregation makes a
hot node cheap).  Card checks use ``plans.shared_links`` so that no card pair
is ever materialised inside a node.

Fixed values: ring floors device 3 cards / 2 fraud cards, email 5 / 3,
address 10 / 5; ring list 3 / 2 with 200 rows per type; graph override
probability floor 0.15; lift uses 120 saved per recovered fraud.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwise.functions.decisions import RING_THRESHOLD, risk_step, ring_type
from ringwise.functions.num import ratio_round
from ringwise.operators.graph import fraud_cards
from ringwise.plans.shared_links import other_fraud_counts
from ringwise.session import stored

FLOORS = {"device": (3, 2), "email": (5, 3), "address": (10, 5)}


def _node_groups(edges: DataFrame, cards: DataFrame, node_type: str) -> DataFrame:
    c = cards.select("card_id", (F.col("fraud_txn") > 0).cast("long").alias("f"),
                     F.round(F.col("fraud_rate") * 1000000).cast("long").alias("rate_micro"))
    return (edges.where(F.col("node_type") == node_type).join(c, "card_id")
            .groupBy("node_id")
            .agg(F.count(F.lit(1)).alias("card_count"), F.sum("f").alias("fraud_card_count"),
                 F.sum("rate_micro").alias("_rate_sum")))


def _pct(num, den):
    return ratio_round(F.col(num) * 100, F.col(den), 2)


def rings(edges: DataFrame, cards: DataFrame, nodes: DataFrame, node_type: str,
          min_cards: int | None = None, min_frauds: int | None = None) -> DataFrame:
    """Nodes shared by >= min_cards cards of which >= min_frauds are fraud cards."""
    lo_c, lo_f = FLOORS[node_type]
    lo_c, lo_f = min_cards or lo_c, min_frauds or lo_f
    g = _node_groups(edges, cards, node_type).where(
        (F.col("card_count") >= lo_c) & (F.col("fraud_card_count") >= lo_f))
    pct = _pct("fraud_card_count", "card_count").alias("fraud_card_rate_pct")
    if node_type == "device":
        n = nodes.select(F.col("device_id").alias("node_id"), "device_type")
        out = g.join(n, "node_id", "left").select(
            F.col("node_id").alias("device"), "device_type", "card_count", "fraud_card_count",
            ratio_round(F.col("_rate_sum"), F.col("card_count") * 10000, 2).alias("avg_card_fraud_pct"), pct)
        key = "device"
    elif node_type == "email":
        n = nodes.select(F.col("email_id").alias("node_id"), F.col("fraud_rate").alias("email_node_fraud_rate"),
                         F.col("fraud_txn").alias("email_fraud_txn"))
        out = g.join(n, "node_id", "left").select(
            F.col("node_id").alias("email_domain"), "email_node_fraud_rate", "email_fraud_txn",
            "card_count", "fraud_card_count", pct)
        key = "email_domain"
    else:
        n = nodes.select(F.col("addr_id").alias("node_id"), F.col("addr2").alias("country_code"),
                         F.col("fraud_rate").alias("addr_fraud_rate"))
        out = g.join(n, "node_id", "left").select(
            F.col("node_id").alias("address"), "country_code", "addr_fraud_rate",
            "card_count", "fraud_card_count", pct)
        key = "address"
    return out.orderBy(F.desc("fraud_card_count"), F.desc("card_count"), F.asc(key))


def card_check(edges: DataFrame, cards: DataFrame, ids: DataFrame | None = None,
               link_types=("device", "email", "address")) -> DataFrame:
    """Per card the distinct other fraud cards by link type, total, ring flag, risk and type.

    ``ids`` (a ``card_id`` column) restricts the output; unknown ids get zeros.
    """
    e = edges.where(F.col("node_type").isin(*link_types))
    fraud = fraud_cards(cards)
    if ids is not None:
        ids = stored(ids.select("card_id").distinct())
        # only links of the asked cards plus the fraud cards' links are needed
        e = e.join(ids.unionByName(fraud.select("card_id")).distinct().hint("merge"), "card_id", "left_semi")
    counts = other_fraud_counts(e, fraud)
    wide = counts.groupBy("card_id").agg(*[
        F.sum(F.when(F.col("node_type") == t, F.col("n_fraud")).otherwise(0)).alias(f"{t}_frauds")
        for t in ("device", "email", "address")])
    base = ids if ids is not None else cards.select("card_id")
    d, em, a = F.col("device_frauds"), F.col("email_frauds"), F.col("address_frauds")
    return (base.join(wide.hint("merge"), "card_id", "left").na.fill(0, ["device_frauds", "email_frauds", "address_frauds"])
            .withColumn("total_connections", d + em + a)
            .withColumn("in_fraud_ring", F.col("total_connections") >= RING_THRESHOLD)
            .withColumn("ring_risk_score", risk_step("total_connections"))
            .withColumn("ring_type", ring_type(d, em, a)))


def check_batch(edges: DataFrame, cards: DataFrame, ids: DataFrame, threshold: int = 2,
                device_only: bool = True) -> DataFrame:
    """Asked cards whose connections reach ``threshold`` (device links only, or all three)."""
    types = ("device",) if device_only else ("device", "email", "address")
    chk = card_check(edges, cards, ids, link_types=types)
    return (chk.where(F.col("total_connections") >= threshold)
            .select("card_id", "device_frauds", "email_frauds", "address_frauds", "total_connections"))


def missed_in_rings(edges: DataFrame, cards: DataFrame, missed: DataFrame, k: int = 2) -> DataFrame:
    """Missed fraud cards connected to >= k other fraud cards through any one link type."""
    chk = card_check(edges, cards, missed)
    return (chk.where((F.col("device_frauds") >= k) | (F.col("email_frauds") >= k) | (F.col("address_frauds") >= k))
            .select(F.col("card_id").alias("card"), F.col("device_frauds").alias("device_connected_frauds"),
                    F.col("email_frauds").alias("email_connected_frauds"),
                    F.col("address_frauds").alias("address_connected_frauds"), "total_connections"))


def ring_counts(dev: DataFrame, email: DataFrame, addr: DataFrame) -> DataFrame:
    """Number of rings per type and in total."""
    c = (dev.select(F.lit("device").alias("ring_type"))
         .unionByName(email.select(F.lit("email").alias("ring_type")))
         .unionByName(addr.select(F.lit("address").alias("ring_type"))))
    per = c.groupBy("ring_type").agg(F.count(F.lit(1)).alias("rings"))
    types = c.sparkSession.createDataFrame([("device",), ("email",), ("address",)], "ring_type string")
    per = types.join(per, "ring_type", "left").na.fill(0)
    return per.unionByName(per.agg(F.lit("total").alias("ring_type"), F.sum("rings").alias("rings")))


def ring_list(edges: DataFrame, cards: DataFrame, node_tables: dict, min_cards: int = 3,
              min_frauds: int = 2, limit: int = 200) -> DataFrame:
    """Rings of all types among nodes with own fraud; top ``limit`` per type by fraud cards."""
    parts = []
    for t, (nodes, key) in node_tables.items():
        own = nodes.where(F.col("fraud_txn") > 0).select(F.col(key).alias("node_id"))
        g = (_node_groups(edges.join(own, "node_id", "left_semi"), cards, t)
             .where((F.col("card_count") >= min_cards) & (F.col("fraud_card_count") >= min_frauds))
             .select(F.lit(t).alias("ring_type"), F.col("node_id").alias("ring_id"), "card_count",
                     F.col("fraud_card_count").alias("fraud_count")))
        parts.append(g)
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    w = Window.partitionBy("ring_type").orderBy(F.desc("fraud_count"), F.desc("card_count"), "ring_id")
    return (allr.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
            .withColumn("fraud_rate", ratio_round("fraud_count", "card_count", 4))
            .orderBy(F.desc("fraud_count"), "ring_type", "ring_id"))


def ring_list_txn(txn_edges: DataFrame, min_cards: int = 3, min_frauds: int = 2) -> DataFrame:
    """Rings straight from the transaction edge table - fraud *transactions*, so the rate can exceed 1."""
    long = txn_edges.select("card_id", "is_fraud", F.stack(
        F.lit(3), F.lit("device"), F.col("device_id"), F.lit("email"), F.col("email_id"),
        F.lit("address"), F.col("addr_id")).alias("ring_type", "ring_id")).where(F.col("ring_id").isNotNull())
    g = (long.groupBy("ring_type", "ring_id")
         .agg(F.countDistinct("card_id").alias("card_count"),
              F.sum(F.col("is_fraud").cast("long")).alias("fraud_count"))
         .where((F.col("card_count") >= min_cards) & (F.col("fraud_count") >= min_frauds)))
    return g.withColumn("fraud_rate", ratio_round("fraud_count", "card_count", 4))


def override(pred: DataFrame, flagged: DataFrame, floor: float = 0.15) -> DataFrame:
    """A cleared row becomes fraud when its card is flagged by the ring check and p >= floor."""
    f = flagged.select("card_id").distinct().withColumn("_ring", F.lit(True))
    return (pred.join(f, "card_id", "left")
            .withColumn("y_graph", F.when((F.col("yhat") == 0) & F.col("_ring").isNotNull()
                                          & (F.col("fraud_probability") >= floor), 1).otherwise(F.col("yhat")))
            .drop("_ring"))


def lift(found: DataFrame, total_fraud: int, base_recall: float, saving: float = 120.0) -> DataFrame:
    """Recall lift from recovering ``found`` missed frauds, new recall and money saved."""
    return found.agg(F.count(F.lit(1)).alias("found")).select(
        "found", (F.col("found") / F.lit(float(total_fraud))).alias("recall_lift"),
        (F.lit(base_recall) + F.col("found") / F.lit(float(total_fraud))).alias("new_recall"),
        (F.col("found") * F.lit(saving)).alias("savings"))


def card_lookup(edges: DataFrame, cards: DataFrame, ids: DataFrame) -> DataFrame:
    """A card with its devices, emails and addresses; optional matches keep the row product."""
    c = cards.join(ids.select("card_id").distinct(), "card_id", "left_semi")
    out = c
    for t, col in (("device", "device"), ("email", "email"), ("address", "address")):
        e = edges.where(F.col("node_type") == t).select("card_id", F.col("node_id").alias(col))
        out = out.join(e, "card_id", "left")
    return out.select("card_id", "fraud_rate", "total_txn", "device", "email", "address")


def ring_picture(ring_list_df: DataFrame, edges: DataFrame, cards: DataFrame, k: int = 8, cards_per_ring: int = 8) -> DataFrame:
    """Node and link rows of the top ``k`` rings, up to ``cards_per_ring`` member cards each.

    ``is_fraud`` marks the cards with a fraud of their own (null for rings and links).
    """
    top = ring_list_df.orderBy(F.desc("fraud_count"), "ring_type", "ring_id").limit(k)
    members = (edges.join(top.select(F.col("ring_type").alias("node_type"), F.col("ring_id").alias("node_id")),
                          ["node_type", "node_id"], "left_semi"))
    w = Window.partitionBy("node_type", "node_id").orderBy("card_id")
    m = members.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cards_per_ring)
    ring_nodes = top.select(F.concat_ws(":", "ring_type", "ring_id").alias("id"), F.lit("ring").alias("kind"),
                            "fraud_count", F.lit(None).cast("boolean").alias("is_fraud"))
    card_nodes = m.select("card_id").distinct().join(cards.select("card_id", "fraud_txn"), "card_id", "left").select(
        F.col("card_id").alias("id"), F.lit("card").alias("kind"), F.lit(None).cast("long").alias("fraud_count"),
        (F.coalesce("fraud_txn", F.lit(0)) > 0).alias("is_fraud"))
    links = m.select(F.concat_ws(":", "node_type", "node_id").alias("source"), F.col("card_id").alias("target"))
    return (ring_nodes.unionByName(card_nodes).select("id", "kind", "fraud_count", "is_fraud",
                                                      F.lit(None).cast("string").alias("source"),
                                                      F.lit(None).cast("string").alias("target"))
            .unionByName(links.select(F.lit(None).cast("string").alias("id"), F.lit("link").alias("kind"),
                                      F.lit(None).cast("long").alias("fraud_count"),
                                      F.lit(None).cast("boolean").alias("is_fraud"), "source", "target")))


def lift_df(found: DataFrame, stats: DataFrame, saving: float = 120.0) -> DataFrame:
    """G14 over frames: ``stats`` is one row (``total``, ``base_recall``) joined as a scalar subquery."""
    from ringwise.functions.params import scalar_row
    st = scalar_row(stats)
    n = found.agg(F.count(F.lit(1)).alias("found"))
    lift_c = F.col("found").cast("double") / st["total"].cast("double")
    return n.select("found", lift_c.alias("recall_lift"), (st["base_recall"] + lift_c).alias("new_recall"),
                    (F.col("found") * F.lit(saving)).alias("savings"))
