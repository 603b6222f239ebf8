"""DuckDB CTEs for the card-node graph, written as the direct (pairwise) plan.

These are the brute-force definitions the Spark plans are checked against.
"""

from __future__ import annotations


def card_key_sql(a="card1", b="card2", c="card3") -> str:
    part = "coalesce(CAST(CAST({x} AS BIGINT) AS VARCHAR), 'NA')"
    return "concat_ws('-', " + ", ".join(part.format(x=x) for x in (a, b, c)) + ")"


def ratio_round_sql(num: str, den: str, digits: int) -> str:
    s = 10 ** digits
    return (f"(CASE WHEN ({den}) > 0 THEN ((CAST({num} AS BIGINT)*{2 * s} + ({den})) // (2*({den}))) END)"
            f" / CAST({s} AS DOUBLE)")


GRAPH = {
    "keyed": f"""
  SELECT *, {card_key_sql()} AS card_id,
    CASE WHEN DeviceType IS NOT NULL AND DeviceInfo IS NOT NULL THEN trim(DeviceType) || '-' || trim(DeviceInfo) END
      AS device_id,
    nullif(lower(trim(P_emaildomain)), '') AS email_id,
    nullif(trim(CAST(CAST(addr1 AS BIGINT) AS VARCHAR)), '') AS addr_id
  FROM transactions""",
    "edges": """
  SELECT DISTINCT card_id, node_type, node_id FROM (
    SELECT card_id, 'device' AS node_type, device_id AS node_id FROM keyed UNION ALL
    SELECT card_id, 'email', email_id FROM keyed UNION ALL
    SELECT card_id, 'address', addr_id FROM keyed) x WHERE node_id IS NOT NULL""",
    "cards": f"""
  SELECT card_id, count(*) AS total_txn, CAST(sum(isFraud) AS BIGINT) AS fraud_txn,
    {ratio_round_sql('sum(isFraud)', 'count(*)', 6)} AS fraud_rate,
    ((CAST(sum(round(TransactionAmt*100)) AS BIGINT)*2 + count(*)) // (2*count(*))) / CAST(100 AS DOUBLE) AS avg_amount,
    min_by(coalesce(card4, ''), TransactionID) AS card4, min_by(coalesce(card6, ''), TransactionID) AS card6
  FROM keyed GROUP BY card_id""",
    "devices": f"""
  SELECT device_id, count(*) AS total_txn, CAST(sum(isFraud) AS BIGINT) AS fraud_txn,
    {ratio_round_sql('sum(isFraud)', 'count(*)', 6)} AS fraud_rate,
    min_by(coalesce(DeviceType, ''), TransactionID) AS device_type,
    min_by(coalesce(DeviceInfo, ''), TransactionID) AS device_info
  FROM keyed WHERE device_id IS NOT NULL GROUP BY device_id""",
    "emails": f"""
  SELECT email_id, email_id AS email_domain, count(*) AS total_txn, CAST(sum(isFraud) AS BIGINT) AS fraud_txn,
    {ratio_round_sql('sum(isFraud)', 'count(*)', 6)} AS fraud_rate
  FROM keyed WHERE email_id IS NOT NULL GROUP BY email_id""",
    "addrs": f"""
  SELECT addr_id, addr_id AS addr1,
    min_by(coalesce(CAST(CAST(addr2 AS BIGINT) AS VARCHAR), ''), TransactionID) AS addr2,
    count(*) AS total_txn, CAST(sum(isFraud) AS BIGINT) AS fraud_txn,
    {ratio_round_sql('sum(isFraud)', 'count(*)', 6)} AS fraud_rate
  FROM keyed WHERE addr_id IS NOT NULL GROUP BY addr_id""",
    "fraud": "SELECT card_id FROM cards WHERE fraud_txn > 0",
    "links": """
  SELECT e1.card_id, e1.node_type, count(DISTINCT e2.card_id) AS n_fraud
  FROM edges e1 JOIN edges e2 ON e1.node_type = e2.node_type AND e1.node_id = e2.node_id
       AND e1.card_id <> e2.card_id
  JOIN fraud f ON f.card_id = e2.card_id
  GROUP BY e1.card_id, e1.node_type""",
    "checks": """
  SELECT c.card_id,
    coalesce(sum(CASE WHEN l.node_type = 'device' THEN l.n_fraud END), 0) AS device_frauds,
    coalesce(sum(CASE WHEN l.node_type = 'email' THEN l.n_fraud END), 0) AS email_frauds,
    coalesce(sum(CASE WHEN l.node_type = 'address' THEN l.n_fraud END), 0) AS address_frauds
  FROM cards c LEFT JOIN links l ON c.card_id = l.card_id GROUP BY c.card_id""",
    "checks2": """
  SELECT *, device_frauds + email_frauds + address_frauds AS total_connections,
    device_frauds + email_frauds + address_frauds >= 2 AS in_fraud_ring,
    CASE WHEN device_frauds + email_frauds + address_frauds >= 5 THEN 0.9
         WHEN device_frauds + email_frauds + address_frauds >= 3 THEN 0.7
         WHEN device_frauds + email_frauds + address_frauds >= 2 THEN 0.5
         WHEN device_frauds + email_frauds + address_frauds = 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS ring_risk_score,
    CASE WHEN (device_frauds >= 2)::INT + (email_frauds >= 2)::INT + (address_frauds >= 2)::INT > 1 THEN 'multiple'
         WHEN device_frauds >= 2 THEN 'device' WHEN email_frauds >= 2 THEN 'email'
         WHEN address_frauds >= 2 THEN 'address' ELSE 'none' END AS ring_type
  FROM checks""",
    "cd_stats": """
  SELECT e.node_id, count(*) AS velocity, sum(CASE WHEN c.fraud_txn > 0 THEN 1 ELSE 0 END) AS fcnt
  FROM edges e LEFT JOIN cards c ON e.card_id = c.card_id WHERE e.node_type = 'device' GROUP BY e.node_id""",
    "f_dev": """
  SELECT e.card_id, max(coalesce(d.fraud_rate, 0)) AS device_fraud_rate,
    max(coalesce(s.velocity, 0)) AS velocity, max(coalesce(s.fcnt, 0)) AS raw_fraud_cnt
  FROM edges e LEFT JOIN devices d ON e.node_id = d.device_id LEFT JOIN cd_stats s ON e.node_id = s.node_id
  WHERE e.node_type = 'device' GROUP BY e.card_id""",
    "f_email": """
  SELECT e.card_id, max(m.fraud_rate) AS email_fraud_rate FROM edges e LEFT JOIN emails m
  ON trim(e.node_id) = trim(m.email_id) WHERE e.node_type = 'email' GROUP BY e.card_id""",
    "f_addr": """
  SELECT e.card_id, max(a.fraud_rate) AS address_fraud_rate FROM edges e LEFT JOIN addrs a
  ON trim(e.node_id) = trim(a.addr_id) WHERE e.node_type = 'address' GROUP BY e.card_id""",
    "gf0": """
  SELECT c.card_id, coalesce(d.device_fraud_rate, 0.0) AS device_fraud_rate,
    CAST(coalesce(d.velocity, 0) AS DOUBLE) AS device_card_velocity,
    CAST(coalesce(greatest(d.raw_fraud_cnt - CASE WHEN c.fraud_txn > 0 THEN 1 ELSE 0 END, 0), 0) AS DOUBLE)
      AS connected_fraud_cards,
    coalesce(m.email_fraud_rate, 0.0) AS email_fraud_rate, coalesce(a.address_fraud_rate, 0.0) AS address_fraud_rate
  FROM cards c LEFT JOIN f_dev d ON c.card_id = d.card_id LEFT JOIN f_email m ON c.card_id = m.card_id
  LEFT JOIN f_addr a ON c.card_id = a.card_id""",
    "gf": """
  SELECT *, least(greatest(CAST(0.5 AS DOUBLE)*device_fraud_rate + CAST(0.3 AS DOUBLE)*email_fraud_rate
     + CAST(0.2 AS DOUBLE)*address_fraud_rate, 0.0), 1.0) AS graph_risk_score FROM gf0""",
    "mm": """
  SELECT min(D1) AS d1_min, max(D1) AS d1_max, min(D15) AS d15_min, max(D15) AS d15_max FROM transactions""",
    "segp": """
  SELECT any_value(d1_min) AS d1_min, any_value(d1_max) AS d1_max, any_value(d15_min) AS d15_min,
    any_value(d15_max) AS d15_max,
    quantile_cont(s, 0.5) AS regular_cut, quantile_cont(s, 0.9) AS vip_cut
  FROM (SELECT mm.*, CAST(0.5 AS DOUBLE)*((D1 - d1_min)/(d1_max - d1_min + CAST(1e-12 AS DOUBLE)))
        + CAST(0.5 AS DOUBLE)*((d15_max - D15)/(d15_max - d15_min + CAST(1e-12 AS DOUBLE))) AS s
        FROM transactions, mm) x""",
}


def seg_score_sql(d1: str, d15: str) -> str:
    return (f"(CAST(0.5 AS DOUBLE)*(({d1} - d1_min)/(d1_max - d1_min + CAST(1e-12 AS DOUBLE)))"
            f" + CAST(0.5 AS DOUBLE)*((d15_max - {d15})/(d15_max - d15_min + CAST(1e-12 AS DOUBLE))))")


def seg_label_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= vip_cut THEN 'VIP' WHEN {score} >= regular_cut THEN 'Regular' "
            f"ELSE 'New' END")


THRESHOLD_SQL = ("coalesce(CASE {seg} WHEN 'VIP' THEN CAST(0.72 AS DOUBLE) WHEN 'Regular' THEN CAST(0.88 AS DOUBLE) "
                 "WHEN 'New' THEN CAST(0.82 AS DOUBLE) END, CAST(0.5 AS DOUBLE))")
