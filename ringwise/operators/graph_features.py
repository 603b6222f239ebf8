"""Card-level graph features.

F1 takes the *maximum* over a card's devices of per-device statistics, so it
never needs a card-card join: per-device aggregates are joined back to the
(card, device) links and reduced per card.

Fixed values: risk = clip(0.5 * device rate + 0.3 * email rate + 0.2 * address rate, 0, 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.functions.num import clip

GRAPH_COLS = ("device_fraud_rate", "device_card_velocity", "connected_fraud_cards",
              "email_fraud_rate", "address_fraud_rate", "graph_risk_score")


def _links(edges: DataFrame, node_type: str) -> DataFrame:
    return edges.where(F.col("node_type") == node_type).select("card_id", "node_id")


def device_features(edges: DataFrame, cards: DataFrame, devices: DataFrame) -> DataFrame:
    """per card the max device fraud rate, max cards per device, max fraud cards per device minus self."""
    cd = _links(edges, "device")
    flag = cards.select("card_id", (F.col("fraud_txn") > 0).cast("int").alias("is_fraud_card"))
    per_dev = (cd.join(flag, "card_id", "left")
               .groupBy("node_id")
               .agg(F.count(F.lit(1)).alias("device_card_velocity"),
                    F.sum(F.coalesce("is_fraud_card", F.lit(0))).alias("device_fraud_card_count")))
    stats = (devices.select(F.col("device_id").alias("node_id"), F.col("fraud_rate").alias("dev_fraud_rate"))
             .join(per_dev, "node_id", "left").na.fill(0))
    agg = (cd.join(stats, "node_id", "left")
           .groupBy("card_id")
           .agg(F.max("dev_fraud_rate").alias("device_fraud_rate"),
                F.max("device_card_velocity").alias("device_card_velocity"),
                F.max("device_fraud_card_count").alias("raw_fraud_cnt")))
    return (agg.join(flag, "card_id", "left")
            .select("card_id", "device_fraud_rate", F.col("device_card_velocity").cast("double"),
                    F.greatest(F.col("raw_fraud_cnt") - F.coalesce("is_fraud_card", F.lit(0)), F.lit(0))
                    .cast("double").alias("connected_fraud_cards")))


def _max_rate(edges: DataFrame, node_type: str, nodes: DataFrame, key: str, out: str) -> DataFrame:
    rates = nodes.select(F.trim(F.col(key).cast("string")).alias("node_id"), F.col("fraud_rate").alias(out))
    return (_links(edges, node_type).withColumn("node_id", F.trim("node_id"))
            .join(rates, "node_id", "left").groupBy("card_id").agg(F.max(out).alias(out)))


def email_features(edges: DataFrame, emails: DataFrame) -> DataFrame:
    """max fraud rate over the card's email domains."""
    return _max_rate(edges, "email", emails, "email_id", "email_fraud_rate")


def address_features(edges: DataFrame, addrs: DataFrame) -> DataFrame:
    """max fraud rate over the card's billing addresses (ids compared as trimmed text)."""
    return _max_rate(edges, "address", addrs, "addr_id", "address_fraud_rate")


def graph_features(cards: DataFrame, dev: DataFrame, em: DataFrame, addr: DataFrame) -> DataFrame:
    """every card gets a row; missing links are 0; composite risk clipped to [0, 1]."""
    gf = (cards.select("card_id").join(dev, "card_id", "left").join(em, "card_id", "left")
          .join(addr, "card_id", "left"))
    gf = gf.na.fill(0.0, list(GRAPH_COLS[:5]))
    risk = clip(0.5 * F.col("device_fraud_rate") + 0.3 * F.col("email_fraud_rate")
                + 0.2 * F.col("address_fraud_rate"), 0.0, 1.0)
    return gf.withColumn("graph_risk_score", risk).select("card_id", *GRAPH_COLS)


def build_graph_features(txn: DataFrame, cards: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """E1-E6 then F1-F4 in one lazy plan (pass ``cards`` / ``edges`` to share them with other operators)."""
    from ringwise.operators import graph as g
    cards = cards if cards is not None else g.card_nodes(txn)
    edges = edges if edges is not None else g.typed_edges(txn)
    return graph_features(cards, device_features(edges, cards, g.device_nodes(txn)),
                          email_features(edges, g.email_nodes(txn)),
                          address_features(edges, g.address_nodes(txn)))


def attach(txn: DataFrame, gf: DataFrame) -> DataFrame:
    """graph columns onto transactions by card key, missing -> 0, helper key dropped."""
    from ringwise.functions.keys import card_key
    return (txn.withColumn("card_id", card_key()).join(gf.hint("shuffle_hash"), "card_id", "left")
            .na.fill(0.0, list(GRAPH_COLS)).drop("card_id"))


def coverage(df: DataFrame) -> DataFrame:
    """share of transactions with a device link and share with >= 2 connected fraud cards."""
    return df.agg(F.count(F.lit(1)).alias("transactions"),
                  F.sum((F.col("device_fraud_rate") > 0).cast("long")).alias("with_device_link"),
                  F.sum((F.col("connected_fraud_cards") >= 2).cast("long")).alias("in_fraud_ring"),
                  F.avg((F.col("device_fraud_rate") > 0).cast("double")).alias("device_link_share"),
                  F.avg((F.col("connected_fraud_cards") >= 2).cast("double")).alias("ring_share"))
