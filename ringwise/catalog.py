"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
Every query reads the whole given tables (through the adapter views) and
ends in explicitly aliased columns so the oracle's names match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwise.checks.graph_sql import GRAPH, THRESHOLD_SQL, card_key_sql, seg_label_sql, seg_score_sql
from ringwise.checks.oracle import with_base
from ringwise.functions import keys
from ringwise.operators import graph as g
from ringwise.operators import graph_features as gfm
from ringwise.operators import rings, scoring, segments
from ringwise.session import stored
from ringwise.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _g(body: str, *names: str, **extra: str) -> str:
    """Oracle text with the adapter CTEs, the named graph CTEs (dependency order kept) and extras."""
    order = list(GRAPH)
    need = set(names)
    deps = {"edges": ["keyed"], "cards": ["keyed"], "devices": ["keyed"], "emails": ["keyed"], "addrs": ["keyed"],
            "fraud": ["cards"], "links": ["edges", "fraud"], "checks": ["cards", "links"], "checks2": ["checks"],
            "cd_stats": ["edges", "cards"], "f_dev": ["edges", "devices", "cd_stats"],
            "f_email": ["edges", "emails"], "f_addr": ["edges", "addrs"],
            "gf0": ["cards", "f_dev", "f_email", "f_addr"], "gf": ["gf0"], "segp": ["mm"]}
    stack = list(need)
    while stack:
        n = stack.pop()
        for d in deps.get(n, []):
            if d not in need:
                need.add(d)
                stack.append(d)
    ctes = {n: GRAPH[n] for n in order if n in need}
    ctes.update(extra)
    return with_base(body, **ctes)


def txn(spark, sf):
    return adapter.transactions(spark, sf)


def txn_mat(spark, sf):
    """The transactions table materialised once (reliable checkpoint into ``spark.checkpoint.dir``) for
    plans that read it in several branches - one write instead of recomputing the join and windows per branch."""
    from ringwise.session import cut_lineage
    return cut_lineage(adapter.transactions(spark, sf))


# ---------------------------------------------------------------- B: keys

@register("b1_node_keys", _g("""
SELECT TransactionID, card_id, device_id, email_id, addr_id FROM keyed""", "keyed"))
def q_b1(spark, sf):
    return keys.with_node_keys(txn(spark, sf)).select("TransactionID", "card_id", "device_id", "email_id", "addr_id")


@register("b5_legacy_keys", with_base("""
SELECT TransactionID, isFraud, """ + card_key_sql() + """ AS card_id,
  coalesce(DeviceType, 'None') || '-' || coalesce(DeviceInfo, 'None') AS device_id,
  coalesce(id_15, 'None') AS ip_id,
  coalesce(P_emaildomain, 'None') || '-' || coalesce(R_emaildomain, 'None') AS email_id
FROM transactions"""))
def q_b5(spark, sf):
    return keys.legacy_node_ids(txn(spark, sf))


# ---------------------------------------------------------------- E: graph build

@register("e1_card_nodes", _g("SELECT * FROM cards", "cards"))
def q_e1(spark, sf):
    return g.card_nodes(txn(spark, sf))


@register("e2_device_nodes", _g("SELECT * FROM devices", "devices"))
def q_e2(spark, sf):
    return g.device_nodes(txn(spark, sf))


@register("e3_email_nodes", _g("SELECT * FROM emails", "emails"))
def q_e3(spark, sf):
    return g.email_nodes(txn(spark, sf))


@register("e4_address_nodes", _g("SELECT * FROM addrs", "addrs"))
def q_e4(spark, sf):
    return g.address_nodes(txn(spark, sf))


@register("e5_txn_edges", _g("""
SELECT TransactionID AS transaction_id, card_id, device_id, email_id, addr_id, isFraud = 1 AS is_fraud,
  TransactionAmt AS amount, CAST(Transaction_Hour AS INTEGER) AS transaction_hour FROM keyed""", "keyed"))
def q_e5(spark, sf):
    return g.txn_edges(txn(spark, sf))


@register("e6_typed_edges", _g("SELECT card_id, node_type, node_id FROM edges", "edges"))
def q_e6(spark, sf):
    return g.typed_edges(txn(spark, sf))


@register("e7_node_rates", with_base("""
SELECT label, count(*) AS nodes, round(avg(rate), 9) AS mean_fraud_rate FROM per GROUP BY label""",
    ids=f"""
  SELECT isFraud, {card_key_sql()} AS card_id,
    coalesce(DeviceType, 'None') || '-' || coalesce(DeviceInfo, 'None') AS device_id, coalesce(id_15, 'None') AS ip_id,
    coalesce(P_emaildomain, 'None') || '-' || coalesce(R_emaildomain, 'None') AS email_id FROM transactions""",
    long="""
  SELECT 'Card' AS label, card_id AS node_id, isFraud FROM ids UNION ALL
  SELECT 'Device', device_id, isFraud FROM ids UNION ALL SELECT 'IP', ip_id, isFraud FROM ids UNION ALL
  SELECT 'Email', email_id, isFraud FROM ids""",
    per="SELECT label, node_id, avg(isFraud) AS rate FROM long GROUP BY label, node_id"))
def q_e7(spark, sf):
    return g.node_rates(txn(spark, sf))


@register("e8_graph_counts", _g("""
SELECT 'node' AS kind, name, count(DISTINCT id) AS n FROM (
  SELECT 'Card' AS name, card_id AS id FROM keyed UNION ALL SELECT 'Device', device_id FROM keyed
  UNION ALL SELECT 'Email', email_id FROM keyed UNION ALL SELECT 'Address', addr_id FROM keyed) x
WHERE id IS NOT NULL GROUP BY name
UNION ALL
SELECT 'edge', CASE node_type WHEN 'device' THEN 'USED_DEVICE' WHEN 'email' THEN 'HAS_EMAIL' ELSE 'BILLING_ADDR' END,
  count(*) FROM edges GROUP BY 2""", "keyed", "edges"))
def q_e8(spark, sf):
    return g.graph_counts(txn(spark, sf))


# ---------------------------------------------------------------- D: segments

@register("d1_fit_segments", _g("SELECT * FROM segp", "segp"))
def q_d1(spark, sf):
    return segments.fit_segments(txn(spark, sf))


@register("d2_segments", _g(f"""
SELECT TransactionID, {seg_score_sql('D1', 'D15')} AS segment_score,
  {seg_label_sql(seg_score_sql('D1', 'D15'))} AS customer_segment
FROM transactions, segp""", "segp"))
def q_d2(spark, sf):
    t = txn(spark, sf)
    return segments.assign_batch(t, segments.fit_segments(t)).select("TransactionID", "segment_score",
                                                                     "customer_segment")


@register("d3_online_segments", _g(f"""
SELECT TransactionID, {seg_label_sql(seg_score_sql('coalesce(D1, 0.0)', 'coalesce(D15, 0.0)'))} AS customer_segment
FROM transactions, segp""", "segp"))
def q_d3(spark, sf):
    t = txn(spark, sf)
    return segments.assign_online(t, segments.fit_segments(t)).select("TransactionID", "customer_segment")


@register("d5_minmax", with_base("""
SELECT TransactionID, D1, CASE WHEN D1 IS NULL THEN NULL WHEN lo IS NULL OR abs(hi - lo) < CAST(1e-12 AS DOUBLE)
  THEN 0.0 ELSE (D1 - lo) / (hi - lo + CAST(1e-12 AS DOUBLE)) END AS D1_scaled
FROM transactions, (SELECT min(D1) AS lo, max(D1) AS hi FROM transactions) s"""))
def q_d5(spark, sf):
    return segments.minmax(txn(spark, sf).select("TransactionID", "D1"), "D1")


# ---------------------------------------------------------------- F: graph features

def _graph(spark, sf):
    t = txn_mat(spark, sf)
    return t, stored(g.card_nodes(t)), stored(g.typed_edges(t))


@register("f1_device_features", _g("""
SELECT d.card_id, d.device_fraud_rate, CAST(d.velocity AS DOUBLE) AS device_card_velocity,
  CAST(greatest(d.raw_fraud_cnt - CASE WHEN c.fraud_txn > 0 THEN 1 ELSE 0 END, 0) AS DOUBLE) AS connected_fraud_cards
FROM f_dev d LEFT JOIN cards c ON c.card_id = d.card_id""", "f_dev", "cards"))
def q_f1(spark, sf):
    t, cards, edges = _graph(spark, sf)
    return gfm.device_features(edges, cards, g.device_nodes(t))


@register("f2_email_features", _g("SELECT card_id, email_fraud_rate FROM f_email", "f_email"))
def q_f2(spark, sf):
    t, cards, edges = _graph(spark, sf)
    return gfm.email_features(edges, g.email_nodes(t))


@register("f3_address_features", _g("SELECT card_id, address_fraud_rate FROM f_addr", "f_addr"))
def q_f3(spark, sf):
    t, cards, edges = _graph(spark, sf)
    return gfm.address_features(edges, g.address_nodes(t))


@register("f4_graph_features", _g("SELECT * FROM gf", "gf"))
def q_f4(spark, sf):
    return gfm.build_graph_features(txn_mat(spark, sf))


@register("f5_attach", _g("""
SELECT k.TransactionID, coalesce(gf.device_fraud_rate, 0.0) AS device_fraud_rate,
  coalesce(gf.device_card_velocity, 0.0) AS device_card_velocity,
  coalesce(gf.connected_fraud_cards, 0.0) AS connected_fraud_cards,
  coalesce(gf.email_fraud_rate, 0.0) AS email_fraud_rate, coalesce(gf.address_fraud_rate, 0.0) AS address_fraud_rate,
  coalesce(gf.graph_risk_score, 0.0) AS graph_risk_score
FROM keyed k LEFT JOIN gf ON k.card_id = gf.card_id""", "keyed", "gf"))
def q_f5(spark, sf):
    t = txn_mat(spark, sf)
    return gfm.attach(t, gfm.build_graph_features(t)).select("TransactionID", *gfm.GRAPH_COLS)


@register("f6_coverage", _g("""
SELECT count(*) AS transactions, CAST(sum(CASE WHEN dfr > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_device_link,
  CAST(sum(CASE WHEN cfc >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS in_fraud_ring,
  avg(CASE WHEN dfr > 0 THEN 1.0 ELSE 0.0 END) AS device_link_share,
  avg(CASE WHEN cfc >= 2 THEN 1.0 ELSE 0.0 END) AS ring_share FROM a""", "keyed", "gf", a="""
  SELECT coalesce(gf.device_fraud_rate, 0.0) AS dfr, coalesce(gf.connected_fraud_cards, 0.0) AS cfc
  FROM keyed k LEFT JOIN gf ON k.card_id = gf.card_id"""))
def q_f6(spark, sf):
    t = txn_mat(spark, sf)
    return gfm.coverage(gfm.attach(t, gfm.build_graph_features(t)))


# ---------------------------------------------------------------- G: rings and checks

@register("g8_card_check", _g("SELECT * FROM checks2", "checks2"))
def q_g8(spark, sf):
    t, cards, edges = _graph(spark, sf)
    return rings.card_check(edges, cards)


# ---------------------------------------------------------------- H: scoring

@register("h4_binary", with_base(f"""
SELECT transaction_id, customer_segment,
  CAST(fraud_probability >= {THRESHOLD_SQL.format(seg='customer_segment')} AS INTEGER) AS yhat
FROM predictions"""))
def q_h4(spark, sf):
    return scoring.binary(adapter.predictions(spark, sf)).select("transaction_id", "customer_segment", "yhat")


H7_SQL = _g(f"""
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, card_id, fraud_probability, customer_segment, threshold,
  graph_risk_score, in_fraud_ring, total_connections, ring_type, transaction_amt, decision,
  round(CASE decision WHEN 'BLOCK' THEN fraud_probability WHEN 'APPROVE' THEN 1.0 - fraud_probability
        ELSE abs(fraud_probability - 0.5) + 0.5 END, 4) AS confidence
FROM (
  SELECT *, CASE WHEN fraud_probability >= threshold THEN 'BLOCK'
    WHEN fraud_probability >= threshold * CAST(0.4 AS DOUBLE) AND (in_fraud_ring OR graph_risk_score >= 0.5)
    THEN 'FLAG' ELSE 'APPROVE' END AS decision
  FROM (
    SELECT k.TransactionID, k.card_id, round(k.fraud_probability, 4) AS fraud_probability,
      {seg_label_sql(seg_score_sql('coalesce(k.D1, 0.0)', 'coalesce(k.D15, 0.0)'))} AS customer_segment,
      {THRESHOLD_SQL.format(seg=seg_label_sql(seg_score_sql('coalesce(k.D1, 0.0)', 'coalesce(k.D15, 0.0)')))}
        AS threshold,
      CASE WHEN coalesce(c.in_fraud_ring, false) THEN greatest(coalesce(gf.graph_risk_score, 0.0), c.ring_risk_score)
           ELSE coalesce(gf.graph_risk_score, 0.0) END AS graph_risk_score,
      coalesce(c.in_fraud_ring, false) AS in_fraud_ring, coalesce(c.total_connections, 0) AS total_connections,
      coalesce(c.ring_type, 'none') AS ring_type, coalesce(k.TransactionAmt, 0.0) AS transaction_amt
    FROM keyed k CROSS JOIN segp LEFT JOIN gf ON k.card_id = gf.card_id LEFT JOIN checks2 c ON k.card_id = c.card_id
  ) x
) y""", "keyed", "segp", "gf", "checks2")


@register("h7_score_records", H7_SQL)
def q_h7(spark, sf):
    return scoring.score_records(txn_mat(spark, sf))


def _load_more():
    from ringwise import catalog_eval  # noqa: F401  (registers I-queries)


_load_more()


def _load_rings():
    from ringwise import catalog_rings  # noqa: F401  (registers ring queries)


_load_rings()


def _load_features():
    from ringwise import catalog_features  # noqa: F401  (registers feature queries)


_load_features()


def _load_review():
    from ringwise import catalog_more  # noqa: F401  (registers K, J, L queries)


_load_review()


def _load_stream():
    from ringwise import catalog_stream  # noqa: F401  (registers N queries)


_load_stream()


def _load_extra():
    from ringwise import catalog_extra  # noqa: F401  (registers B6-B12, H11, H12, I15, J3)


_load_extra()


def _load_algo():
    from ringwise import catalog_algo  # noqa: F401  (registers G15-G20)


_load_algo()


def _load_ml():
    from ringwise import catalog_ml  # noqa: F401  (registers H1-H3, H8, H9, J8, M)


_load_ml()


def _load_io():
    from ringwise import catalog_io  # noqa: F401  (registers A queries)


_load_io()
