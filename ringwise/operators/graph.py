"""Graph construction (E1-E8): node tables and edge tables from transactions.

Every node table is one ``groupBy`` with map-side partial aggregation, so a
hot node (one email domain holding a third of all rows) costs one partial
row per input partition, never one giant task.  "First" values are taken by
``min_by(.., TransactionID)`` so they are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.functions.keys import legacy_node_ids, with_node_keys
from ringwise.functions.num import cents, int_div, ratio_round

LINK_TYPES = ("device", "email", "address")
_NODE_COL = {"device": "device_id", "email": "email_id", "address": "addr_id"}


def _fraud_stats(key: str):
    tot = F.count(F.lit(1))
    fr = F.sum("isFraud").cast("long")
    return [tot.alias("total_txn"), fr.alias("fraud_txn")]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("fraud_rate", ratio_round("fraud_txn", "total_txn", 6))


def _first(col, default="") -> F.Column:
    return F.min_by(F.coalesce(col, F.lit(default)), F.col("TransactionID"))


def card_nodes(txn: DataFrame) -> DataFrame:
    """One row per card with counts, rate (6 dp), mean amount (2 dp), first card4/card6."""
    t = with_node_keys(txn)
    g = t.groupBy("card_id").agg(
        *_fraud_stats("card_id"),
        F.sum(cents("TransactionAmt")).alias("_cents"),
        _first(F.col("card4")).alias("card4"),
        _first(F.col("card6")).alias("card6"),
    )
    return (_with_rate(g)
            .withColumn("avg_amount", int_div(F.col("_cents") * 2 + F.col("total_txn"),
                                              F.col("total_txn") * 2) / F.lit(100.0))
            .select("card_id", "total_txn", "fraud_txn", "fraud_rate", "avg_amount", "card4", "card6"))


def device_nodes(txn: DataFrame) -> DataFrame:
    """Devices with counts, rate and first type/info."""
    t = with_node_keys(txn).where(F.col("device_id").isNotNull())
    g = t.groupBy("device_id").agg(*_fraud_stats("device_id"),
                                   _first(F.col("DeviceType")).alias("device_type"),
                                   _first(F.col("DeviceInfo")).alias("device_info"))
    return _with_rate(g).select("device_id", "total_txn", "fraud_txn", "fraud_rate", "device_type", "device_info")


def email_nodes(txn: DataFrame) -> DataFrame:
    """Purchaser email domains with counts and rate."""
    t = with_node_keys(txn).where(F.col("email_id").isNotNull())
    g = t.groupBy("email_id").agg(*_fraud_stats("email_id"))
    return _with_rate(g).select("email_id", F.col("email_id").alias("email_domain"),
                                "total_txn", "fraud_txn", "fraud_rate")


def address_nodes(txn: DataFrame) -> DataFrame:
    """Billing addresses with counts, rate and first ``addr2``."""
    t = with_node_keys(txn).where(F.col("addr_id").isNotNull())
    g = t.groupBy("addr_id").agg(*_fraud_stats("addr_id"),
                                 _first(F.col("addr2").cast("long").cast("string")).alias("addr2"))
    return _with_rate(g).select("addr_id", F.col("addr_id").alias("addr1"), "addr2",
                                "total_txn", "fraud_txn", "fraud_rate")


def txn_edges(txn: DataFrame) -> DataFrame:
    """E5: one edge row per transaction; a null node id means no edge of that type."""
    t = with_node_keys(txn)
    return t.select(F.col("TransactionID").alias("transaction_id"), "card_id", "device_id", "email_id", "addr_id",
                    (F.col("isFraud") == 1).alias("is_fraud"), F.col("TransactionAmt").alias("amount"),
                    F.col("Transaction_Hour").cast("int").alias("transaction_hour"))


def typed_edges(txn_or_edges: DataFrame) -> DataFrame:
    """Distinct ``(card_id, node_type, node_id)`` links - the card-node graph in long form."""
    e = txn_or_edges if "transaction_id" in txn_or_edges.columns else txn_edges(txn_or_edges)
    long = e.select("card_id", F.stack(
        F.lit(3),
        F.lit("device"), F.col("device_id"),
        F.lit("email"), F.col("email_id"),
        F.lit("address"), F.col("addr_id"),
    ).alias("node_type", "node_id"))
    return long.where(F.col("node_id").isNotNull()).distinct()


def node_rates(txn: DataFrame) -> DataFrame:
    """Older graph - number of nodes and mean node fraud rate per label (Card/Device/IP/Email)."""
    ids = legacy_node_ids(txn)
    long = ids.select("isFraud", F.stack(
        F.lit(4), F.lit("Card"), F.col("card_id"), F.lit("Device"), F.col("device_id"),
        F.lit("IP"), F.col("ip_id"), F.lit("Email"), F.col("email_id")).alias("label", "node_id"))
    per_node = long.groupBy("label", "node_id").agg(F.avg("isFraud").alias("rate"))
    return per_node.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"),
                                         F.round(F.avg("rate"), 9).alias("mean_fraud_rate"))


def graph_counts(txn: DataFrame) -> DataFrame:
    """Node counts per label and distinct edge counts per relationship type."""
    t = with_node_keys(txn)
    nodes = t.select(F.stack(F.lit(4), F.lit("Card"), F.col("card_id"), F.lit("Device"), F.col("device_id"),
                             F.lit("Email"), F.col("email_id"), F.lit("Address"), F.col("addr_id"))
                     .alias("name", "id")).where(F.col("id").isNotNull())
    node_n = nodes.groupBy("name").agg(F.countDistinct("id").alias("n")).withColumn("kind", F.lit("node"))
    rel = F.when(F.col("node_type") == "device", "USED_DEVICE").when(F.col("node_type") == "email", "HAS_EMAIL") \
        .otherwise("BILLING_ADDR")
    edge_n = typed_edges(t).groupBy(rel.alias("name")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("kind", F.lit("edge"))
    return node_n.unionByName(edge_n).select("kind", "name", "n")


def fraud_cards(cards: DataFrame) -> DataFrame:
    """Cards with at least one fraudulent transaction (the graph's ``fraud_txn > 0``)."""
    return cards.where(F.col("fraud_txn") > 0).select("card_id")
