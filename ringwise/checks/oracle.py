"""DuckDB twins of the adapter views, prepended to every oracle query.

The oracle sees only the base tables, so each query text starts with these
CTEs.  They restate ``ringwise.sources.adapter`` in DuckDB's dialect.
"""

from __future__ import annotations

BASE_CTES = {
    "li": """
  SELECT l_orderkey, min_by(l_partkey, l_linenumber*100000000+l_partkey) AS pk,
         min(l_quantity) AS q1, max(l_quantity) AS q2, count(*) AS n_items
  FROM lineitem GROUP BY l_orderkey""",
    "o": """
  SELECT o_orderkey AS k, o_custkey AS cu, CAST(o_orderdate AS DATE) AS od, o_totalprice, o_orderstatus,
         o_orderpriority, c_nationkey AS nk, c_mktsegment AS ms, pk, q1, q2, coalesce(n_items,0) AS n_items,
         (o_orderkey*7919) % 1000 AS u
  FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN li ON o_orderkey=l_orderkey""",
    "transactions": """
SELECT k AS TransactionID, k*60 AS TransactionDT, CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS isFraud,
  o_totalprice AS TransactionAmt, substr(o_orderpriority,1,1) AS ProductCD,
  cu AS card1, CASE WHEN cu % 50 <> 0 THEN nk END AS card2, 150 AS card3,
  lower(ms) AS card4, CASE WHEN cu % 3 = 0 THEN 'credit' ELSE 'debit' END AS card6,
  CASE WHEN cu % 10 <> 0 THEN nk*13 + k % 13 END AS addr1, CASE WHEN cu % 10 <> 0 THEN nk END AS addr2,
  CASE WHEN k % 3 = 0 THEN q1 END AS dist1, CASE WHEN k % 5 = 0 THEN q2*10 END AS dist2,
  CASE WHEN cu % 6 <> 0 THEN upper(ms) || '-' || o_orderpriority END AS P_emaildomain,
  CASE WHEN k % 4 = 0 THEN lower(ms) END AS R_emaildomain,
  CASE WHEN k % 2 = 0 AND pk IS NOT NULL THEN CASE WHEN pk % 2 = 0 THEN 'desktop' ELSE 'mobile' END END AS DeviceType,
  CASE WHEN k % 2 = 0 THEN 'dev-' || CAST(pk AS VARCHAR) END AS DeviceInfo,
  CASE WHEN k % 7 <> 0 THEN o_orderstatus END AS id_15,
  CAST(datediff('day', min(od) OVER (PARTITION BY cu), od) AS DOUBLE) AS D1,
  CAST(datediff('day', lag(od) OVER (PARTITION BY cu ORDER BY od,k), od) AS DOUBLE) AS D15,
  n_items AS C1, n_items*2 AS C14, k % 24 AS Transaction_Hour,
  CAST(floor(k/CAST(24 AS DOUBLE)) AS BIGINT) % 7 AS Transaction_Day,
  CASE WHEN k % 29 = 0 THEN CAST(3500+6*u AS DOUBLE)/10000
       ELSE floor(CAST(u*u*u*u*u*u AS DOUBLE)/105000000000000)/10000 END AS fraud_probability,
  count(*) OVER (PARTITION BY cu) AS uid_count
FROM o""",
    "predictions": """
WITH s AS (SELECT TransactionID AS k, fraud_probability AS p, CAST((TransactionID*104729) % 100 AS DOUBLE)/100 AS r,
  TransactionAmt AS amt, isFraud,
  CASE WHEN TransactionID % 11 = 0 THEN 'VIP' WHEN TransactionID % 11 < 6 THEN 'Regular' ELSE 'New' END AS seg
  FROM transactions),
t AS (SELECT s.*, CAST(CASE seg WHEN 'VIP' THEN 0.72 WHEN 'Regular' THEN 0.88 ELSE 0.82 END AS DOUBLE) AS th FROM s)
SELECT CAST(k AS VARCHAR) AS transaction_id, p AS fraud_probability, r AS graph_risk_score, seg AS customer_segment,
  CASE WHEN p >= th THEN 'BLOCK'
       WHEN p >= th*CAST(0.4 AS DOUBLE) AND r >= CAST(0.5 AS DOUBLE) THEN 'FLAG' ELSE 'APPROVE' END AS decision,
  CAST(50 + (k*31) % 400 AS DOUBLE)/10 AS latency_ms, CASE WHEN k % 13 <> 0 THEN amt END AS transaction_amt,
  CASE WHEN k % 10 <> 9 THEN isFraud = 1 END AS is_fraud_label,
  CAST(to_timestamp(1704067200 + k*60) AT TIME ZONE 'UTC' AS TIMESTAMP) AS created_at
FROM t""",
    "requests": """
SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'click' THEN '/api/v1/predict' WHEN 'error' THEN '/api/v1/predict'
    WHEN 'view' THEN '/api/v1/explain' WHEN 'purchase' THEN '/api/v1/graph/rings' ELSE '/api/v1/similar' END AS route,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS duration_ms, user_id AS card_id
FROM events""",
}


def with_base(body: str, **extra: str) -> str:
    """Prefix ``body`` with the adapter CTEs plus named helper CTEs (in order)."""
    ctes = dict(BASE_CTES)
    ctes.update(extra)
    head = ",\n".join(f"{name} AS MATERIALIZED ({text}\n)" for name, text in ctes.items())
    return f"WITH {head}\n{body}"
