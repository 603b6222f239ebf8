"""Registered ring queries (G1-G7, G9, G10, G13, G14, G18, G21) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwise.catalog import _g, register, txn, txn_mat
from ringwise.catalog_eval import MISSED_SQL, scored_txn
from ringwise.checks.graph_sql import ratio_round_sql
from ringwise.operators import evaluate as ev
from ringwise.operators import graph as g
from ringwise.operators import rings
from ringwise.session import stored

NG = """
  SELECT e.node_type, e.node_id, count(*) AS card_count,
    CAST(sum(CASE WHEN c.fraud_txn > 0 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_card_count,
    CAST(sum(CAST(round(c.fraud_rate * 1000000) AS BIGINT)) AS BIGINT) AS rate_sum
  FROM edges e JOIN cards c ON e.card_id = c.card_id GROUP BY e.node_type, e.node_id"""

PCT = ratio_round_sql("fraud_card_count * 100", "card_count", 2) + " AS fraud_card_rate_pct"
G1_SQL = f"""
  SELECT n.node_id AS device, d.device_type, card_count, fraud_card_count,
    {ratio_round_sql('rate_sum', 'card_count * 10000', 2)} AS avg_card_fraud_pct, {PCT}
  FROM ng n LEFT JOIN devices d ON d.device_id = n.node_id
  WHERE node_type = 'device' AND card_count >= 3 AND fraud_card_count >= 2"""
G2_SQL = f"""
  SELECT n.node_id AS email_domain, m.fraud_rate AS email_node_fraud_rate, m.fraud_txn AS email_fraud_txn,
    card_count, fraud_card_count, {PCT}
  FROM ng n LEFT JOIN emails m ON m.email_id = n.node_id
  WHERE node_type = 'email' AND card_count >= 5 AND fraud_card_count >= 3"""
G3_SQL = f"""
  SELECT n.node_id AS address, a.addr2 AS country_code, a.fraud_rate AS addr_fraud_rate,
    card_count, fraud_card_count, {PCT}
  FROM ng n LEFT JOIN addrs a ON a.addr_id = n.node_id
  WHERE node_type = 'address' AND card_count >= 10 AND fraud_card_count >= 5"""


def _base(spark, sf):
    t = txn_mat(spark, sf)
    return t, stored(g.card_nodes(t)), stored(g.typed_edges(t))  # every step of a check reads both again


@register("g1_device_rings", _g("SELECT * FROM g1", "edges", "cards", "devices", ng=NG, g1=G1_SQL))
def q_g1(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.rings(edges, cards, g.device_nodes(t), "device")


@register("g2_email_rings", _g("SELECT * FROM g2", "edges", "cards", "emails", ng=NG, g2=G2_SQL))
def q_g2(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.rings(edges, cards, g.email_nodes(t), "email")


@register("g3_address_rings", _g("SELECT * FROM g3", "edges", "cards", "addrs", ng=NG, g3=G3_SQL))
def q_g3(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.rings(edges, cards, g.address_nodes(t), "address")


@register("g5_ring_counts", _g("""
SELECT ring_type, rings FROM (
  SELECT 'device' AS ring_type, (SELECT count(*) FROM g1) AS rings UNION ALL
  SELECT 'email', (SELECT count(*) FROM g2) UNION ALL SELECT 'address', (SELECT count(*) FROM g3) UNION ALL
  SELECT 'total', (SELECT count(*) FROM g1) + (SELECT count(*) FROM g2) + (SELECT count(*) FROM g3)) x""",
    "edges", "cards", "devices", "emails", "addrs", ng=NG, g1=G1_SQL, g2=G2_SQL, g3=G3_SQL))
def q_g5(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.ring_counts(rings.rings(edges, cards, g.device_nodes(t), "device"),
                             rings.rings(edges, cards, g.email_nodes(t), "email"),
                             rings.rings(edges, cards, g.address_nodes(t), "address"))


MISSED_CHECK = """
  SELECT c.* FROM checks2 c WHERE c.card_id IN (SELECT card_id FROM missed)"""


@register("g4_missed_in_rings", _g("""
SELECT card_id AS card, device_frauds AS device_connected_frauds, email_frauds AS email_connected_frauds,
  address_frauds AS address_connected_frauds, total_connections
FROM mc WHERE device_frauds >= 2 OR email_frauds >= 2 OR address_frauds >= 2""",
    "keyed", "checks2", missed=MISSED_SQL, mc=MISSED_CHECK))
def q_g4(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.missed_in_rings(edges, cards, ev.missed_cards(scored_txn(spark, sf, t)))


NODE_OWN = """
  SELECT 'device' AS node_type, device_id AS node_id FROM devices WHERE fraud_txn > 0 UNION ALL
  SELECT 'email', email_id FROM emails WHERE fraud_txn > 0 UNION ALL
  SELECT 'address', addr_id FROM addrs WHERE fraud_txn > 0"""
G6_SQL = f"""
  SELECT ring_type, ring_id, card_count, fraud_count, {ratio_round_sql('fraud_count', 'card_count', 4)} AS fraud_rate
  FROM (SELECT n.node_type AS ring_type, n.node_id AS ring_id, card_count, fraud_card_count AS fraud_count,
          row_number() OVER (PARTITION BY n.node_type ORDER BY fraud_card_count DESC, card_count DESC, n.node_id) AS rn
        FROM ng n JOIN own o ON o.node_type = n.node_type AND o.node_id = n.node_id
        WHERE card_count >= 3 AND fraud_card_count >= 2) x WHERE rn <= 200"""


def _ring_list(spark, sf):
    t, cards, edges = _base(spark, sf)
    tables = {"device": (g.device_nodes(t), "device_id"), "email": (g.email_nodes(t), "email_id"),
              "address": (g.address_nodes(t), "addr_id")}
    return edges, rings.ring_list(edges, cards, tables), cards


@register("g6_ring_list", _g("SELECT * FROM g6", "edges", "cards", "devices", "emails", "addrs",
                             ng=NG, own=NODE_OWN, g6=G6_SQL))
def q_g6(spark, sf):
    return _ring_list(spark, sf)[1]


@register("g7_ring_list_txn", _g(f"""
SELECT ring_type, ring_id, card_count, fraud_count, {ratio_round_sql('fraud_count', 'card_count', 4)} AS fraud_rate
FROM (SELECT ring_type, ring_id, count(DISTINCT card_id) AS card_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count
  FROM (SELECT card_id, isFraud, 'device' AS ring_type, device_id AS ring_id FROM keyed UNION ALL
        SELECT card_id, isFraud, 'email', email_id FROM keyed UNION ALL
        SELECT card_id, isFraud, 'address', addr_id FROM keyed) x
  WHERE ring_id IS NOT NULL GROUP BY ring_type, ring_id) y
WHERE card_count >= 3 AND fraud_count >= 2""", "keyed"))
def q_g7(spark, sf):
    return rings.ring_list_txn(g.txn_edges(txn(spark, sf)))


@register("g9_check_batch_device", _g("""
SELECT card_id, device_frauds, 0 AS email_frauds, 0 AS address_frauds, device_frauds AS total_connections
FROM mc WHERE device_frauds >= 2""", "keyed", "checks2", missed=MISSED_SQL, mc=MISSED_CHECK))
def q_g9(spark, sf):
    t, cards, edges = _base(spark, sf)
    out = rings.check_batch(edges, cards, ev.missed_cards(scored_txn(spark, sf, t)), 2, device_only=True)
    return out.withColumn("email_frauds", F.lit(0)).withColumn("address_frauds", F.lit(0))


@register("g10_check_batch_all", _g("""
SELECT card_id, device_frauds, email_frauds, address_frauds, total_connections
FROM mc WHERE total_connections >= 2""", "keyed", "checks2", missed=MISSED_SQL, mc=MISSED_CHECK))
def q_g10(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.check_batch(edges, cards, ev.missed_cards(scored_txn(spark, sf, t)), 2, device_only=False)


SCORED_SQL = """
  SELECT CAST(k.TransactionID AS VARCHAR) AS transaction_id, k.card_id, k.isFraud, pr.fraud_probability,
    CAST(pr.fraud_probability >= coalesce(CASE pr.customer_segment WHEN 'VIP' THEN CAST(0.72 AS DOUBLE)
      WHEN 'Regular' THEN CAST(0.88 AS DOUBLE) WHEN 'New' THEN CAST(0.82 AS DOUBLE) END, CAST(0.5 AS DOUBLE))
      AS INTEGER) AS yhat
  FROM keyed k JOIN predictions pr ON pr.transaction_id = CAST(k.TransactionID AS VARCHAR)"""
CLEARED_DEV = """
  SELECT DISTINCT c.card_id FROM checks2 c WHERE c.device_frauds >= 2
    AND c.card_id IN (SELECT card_id FROM scored WHERE yhat = 0)"""


@register("g13_override", _g("""
SELECT transaction_id, yhat, CASE WHEN yhat = 0 AND card_id IN (SELECT card_id FROM flagged)
  AND fraud_probability >= CAST(0.15 AS DOUBLE) THEN 1 ELSE yhat END AS y_graph FROM scored""",
    "keyed", "checks2", scored=SCORED_SQL, flagged=CLEARED_DEV))
def q_g13(spark, sf):
    t, cards, edges = _base(spark, sf)
    sc = scored_txn(spark, sf, t).withColumnRenamed("p", "fraud_probability")
    cleared = sc.where(F.col("yhat") == 0).select("card_id").distinct()
    flagged = rings.check_batch(edges, cards, cleared, 2, device_only=True)
    return rings.override(sc, flagged).select("transaction_id", "yhat", "y_graph")


@register("g14_lift", _g("""
SELECT found, CAST(found AS DOUBLE) / CAST(total AS DOUBLE) AS recall_lift,
  base_recall + CAST(found AS DOUBLE) / CAST(total AS DOUBLE) AS new_recall, found * CAST(120 AS DOUBLE) AS savings
FROM (SELECT (SELECT count(*) FROM mc WHERE device_frauds >= 2 OR email_frauds >= 2 OR address_frauds >= 2) AS found,
  count_if(isFraud = 1) AS total,
  CAST(count_if(isFraud = 1 AND yhat = 1) AS DOUBLE) / CAST(count_if(isFraud = 1) AS DOUBLE) AS base_recall
  FROM scored) x""", "keyed", "checks2", missed=MISSED_SQL, mc=MISSED_CHECK, scored=SCORED_SQL))
def q_g14(spark, sf):
    t, cards, edges = _base(spark, sf)
    sc = scored_txn(spark, sf, t)
    found = rings.missed_in_rings(edges, cards, ev.missed_cards(sc))
    stats = sc.agg(F.count_if(F.col("isFraud") == 1).alias("total"),
                   (F.count_if((F.col("isFraud") == 1) & (F.col("yhat") == 1)).cast("double")
                    / F.count_if(F.col("isFraud") == 1).cast("double")).alias("base_recall"))
    return rings.lift_df(found, stats)


@register("g18_card_lookup", _g("""
SELECT c.card_id, c.fraud_rate, c.total_txn, d.node_id AS device, m.node_id AS email, a.node_id AS address
FROM cards c
LEFT JOIN (SELECT * FROM edges WHERE node_type = 'device') d ON d.card_id = c.card_id
LEFT JOIN (SELECT * FROM edges WHERE node_type = 'email') m ON m.card_id = c.card_id
LEFT JOIN (SELECT * FROM edges WHERE node_type = 'address') a ON a.card_id = c.card_id""", "edges", "cards"))
def q_g18(spark, sf):
    t, cards, edges = _base(spark, sf)
    return rings.card_lookup(edges, cards, cards)


@register("g21_ring_picture", _g("""
SELECT ring_type || ':' || ring_id AS id, 'ring' AS kind, fraud_count, NULL::BOOLEAN AS is_fraud,
  NULL::VARCHAR AS source, NULL::VARCHAR AS target
FROM top8 UNION ALL
SELECT card_id, 'card', NULL::BIGINT, fraud_txn > 0, NULL::VARCHAR, NULL::VARCHAR FROM cards
WHERE card_id IN (SELECT card_id FROM mem) UNION ALL
SELECT NULL::VARCHAR, 'link', NULL::BIGINT, NULL::BOOLEAN, node_type || ':' || node_id, card_id FROM mem""",
    "edges", "cards", "devices", "emails", "addrs", ng=NG, own=NODE_OWN, g6=G6_SQL,
    top8="SELECT * FROM g6 ORDER BY fraud_count DESC, ring_type, ring_id LIMIT 8",
    mem="""
  SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.node_type, e.node_id ORDER BY e.card_id) AS rn
    FROM edges e JOIN top8 t ON t.ring_type = e.node_type AND t.ring_id = e.node_id) x WHERE rn <= 8"""))
def q_g21(spark, sf):
    edges, rl, cards = _ring_list(spark, sf)
    return rings.ring_picture(rl, edges, cards)


@register("a7_ring_report")
def q_a7(spark, sf):
    """Report lines - summary and the top 10 of each ring table."""
    from ringwise.sources.io import ring_report
    t, cards, edges = _base(spark, sf)
    sc = stored(scored_txn(spark, sf, t).where(F.col("isFraud") == 1))  # the missed cards and the recall are of frauds only
    found = rings.missed_in_rings(edges, cards, ev.missed_cards(sc))
    total = t.where(F.col("isFraud") == 1).count()
    base_recall = sc.where(F.col("yhat") == 1).count() / max(1, total)
    return ring_report(rings.rings(edges, cards, g.device_nodes(t), "device"),
                       rings.rings(edges, cards, g.email_nodes(t), "email"),
                       rings.rings(edges, cards, g.address_nodes(t), "address"), found, total, base_recall)
