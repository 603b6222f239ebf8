"""Registered preparation / split queries (B6-B12) and remaining scoring, override and reward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwise.catalog import _g, register, txn, txn_mat
from ringwise.catalog_eval import LAB, scored_txn
from ringwise.catalog_rings import CLEARED_DEV, SCORED_SQL
from ringwise.checks.graph_sql import THRESHOLD_SQL, seg_label_sql, seg_score_sql
from ringwise.checks.oracle import with_base
from ringwise.operators import evaluate as ev
from ringwise.operators import features as fx
from ringwise.operators import graph as g
from ringwise.operators import policy, prep, rings, scoring
from ringwise.operators.segments import fit_segments
from ringwise.session import stored
from ringwise.sources import adapter

NUM = ["TransactionAmt", "card1", "card2", "addr1", "addr2", "dist1", "dist2", "C1", "C14", "D1", "D15"]
CAT = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", "id_15"]
LABELLED = ["C1", "C14", "D1", "D15", "dist1", "addr1", "P_emaildomain", "R_emaildomain", "TransactionAmt"]
HASH_SQL = "(CAST(('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"


@register("b6_prepare", with_base("SELECT TransactionID, " + ", ".join(
    [f"coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0) AS {c}" for c in NUM]
    + [f"coalesce(CAST({c} AS VARCHAR), 'None') AS {c}" for c in CAT]) + " FROM transactions"))
def q_b6(spark, sf):
    return prep.prepare(txn(spark, sf), NUM, CAT)


@register("b7_feature_matrix", with_base("""
SELECT * EXCLUDE (isFraud, TransactionID, TransactionDT, fraud_probability) FROM transactions"""))
def q_b7(spark, sf):
    return prep.feature_matrix(txn(spark, sf), ("isFraud", "TransactionID", "TransactionDT", "fraud_probability"))


@register("b8_holdout", with_base(f"""
SELECT split, isFraud, count(*) AS n FROM (SELECT isFraud,
  CASE WHEN {HASH_SQL.format(c='TransactionID')} < 20 THEN 'test' ELSE 'train' END AS split FROM transactions) x
GROUP BY split, isFraud"""))
def q_b8(spark, sf):
    return prep.holdout(txn(spark, sf)).groupBy("split", "isFraud").agg(F.count(F.lit(1)).alias("n"))


@register("b9_parts", with_base("""
SELECT TransactionID % 5 AS part, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS frauds FROM transactions GROUP BY 1"""))
def q_b9(spark, sf):
    return prep.part(txn(spark, sf)).groupBy("part").agg(F.count(F.lit(1)).alias("n"),
                                                         F.sum("isFraud").cast("long").alias("frauds"))


@register("b11_label_names", with_base("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS filled, '{prep.FEATURE_LABELS.get(c, c)}' AS label FROM transactions"
    for c in LABELLED)))
def q_b11(spark, sf):
    """Rows that have each feature, with the feature's readable name (the code itself where there is none)."""
    filled = txn(spark, sf).agg(*[F.count(c).alias(c) for c in LABELLED])
    rows = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("filled")) for c in LABELLED]))
                         .alias("_r")).select("_r.feature", "_r.filled")
    return prep.label_names(rows)


@register("b10_sample", with_base("""
SELECT TransactionID, isFraud, TransactionAmt FROM transactions
ORDER BY md5(CAST(TransactionID AS VARCHAR)), TransactionID LIMIT 100"""))
def q_b10(spark, sf):
    return prep.sample_n(txn(spark, sf).select("TransactionID", "isFraud", "TransactionAmt"), n=100)


@register("b12_select_pred", with_base("""
SELECT * FROM predictions WHERE decision = 'FLAG' AND customer_segment = 'Regular' AND is_fraud_label IS NOT NULL
ORDER BY created_at DESC, transaction_id DESC LIMIT 100"""))
def q_b12(spark, sf):
    return prep.select_pred(adapter.predictions(spark, sf), "FLAG", "Regular", True, 100)


@register("h11_graph_facts", with_base("""
SELECT transaction_id,
  CASE WHEN r >= 0.7 THEN 'HIGH graph risk (' || printf('%.3f', r) || ') — strong fraud network signal'
       WHEN r >= 0.4 THEN 'ELEVATED graph risk (' || printf('%.3f', r) || ') — connected to suspicious network'
       WHEN r > 0 THEN 'LOW graph risk (' || printf('%.3f', r) || ')' ELSE 'No graph risk signal' END AS graph_desc,
  'Decision: ' || decision || ' | FraudProb: ' || printf('%.3f', fraud_probability) || ' | Segment: ' || customer_segment
    AS headline
FROM (SELECT *, coalesce(graph_risk_score, 0.0) AS r FROM predictions) x"""))
def q_h11(spark, sf):
    return scoring.graph_facts(adapter.predictions(spark, sf))


UP = """
  SELECT t.*, pa.r AS cluster_fraud_rate FROM transactions t
  LEFT JOIN (SELECT addr1, avg(isFraud) AS r FROM transactions WHERE addr1 IS NOT NULL GROUP BY addr1) pa
    ON t.addr1 = pa.addr1"""


@register("h12_score_lookup", _g(f"""
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_probability, seg AS customer_segment,
  {THRESHOLD_SQL.format(seg='seg')} AS threshold,
  CASE WHEN fraud_probability >= {THRESHOLD_SQL.format(seg='seg')} THEN 'FRAUD' ELSE 'CLEAR' END AS decision,
  cluster_fraud_rate AS graph_risk, CAST(Transaction_Hour AS DOUBLE) / 23.0 AS market_context,
  CASE seg WHEN 'VIP' THEN 1.0 WHEN 'Regular' THEN 0.5 ELSE 0.0 END AS segment_code
FROM (SELECT up.*, {seg_label_sql(seg_score_sql('D1', 'D15'))} AS seg FROM up, segp) x""", "segp", up=UP))
def q_h12(spark, sf):
    t = txn(spark, sf)
    ids = adapter.predictions(spark, sf, t).select("transaction_id")
    return scoring.score_lookup(ids, fx.upstream(t), fit_segments(t))


@register("i15_override_impact", _g("""
SELECT tp0, fp0, tp1, fp1, tp1 - tp0 AS delta_tp, fp1 - fp0 AS delta_fp,
  CAST((tp1 - tp0) * 120 - (fp1 - fp0) * 50 AS DOUBLE) AS net_impact
FROM (SELECT count_if(isFraud = 1 AND yhat = 1) AS tp0, count_if(isFraud = 0 AND yhat = 1) AS fp0,
        count_if(isFraud = 1 AND y_graph = 1) AS tp1, count_if(isFraud = 0 AND y_graph = 1) AS fp1
      FROM (SELECT *, CASE WHEN yhat = 0 AND card_id IN (SELECT card_id FROM flagged)
              AND fraud_probability >= CAST(0.15 AS DOUBLE) THEN 1 ELSE yhat END AS y_graph FROM scored) s) c""",
    "keyed", "checks2", scored=SCORED_SQL, flagged=CLEARED_DEV))
def q_i15(spark, sf):
    t = txn_mat(spark, sf)
    cards, edges = stored(g.card_nodes(t)), stored(g.typed_edges(t))
    sc = scored_txn(spark, sf, t).withColumnRenamed("p", "fraud_probability")
    flagged = rings.check_batch(edges, cards, sc.where(F.col("yhat") == 0).select("card_id").distinct(), 2, True)
    o = stored(rings.override(sc, flagged).select(F.col("isFraud").alias("y"), "yhat", "y_graph"))
    base = ev.confusion(o, "y", "yhat")
    graph = ev.confusion(o, "y", "y_graph")
    return ev.override_impact(base, graph)


@register("j3_reward_v1", with_base("""
SELECT transaction_id, decision,
  CASE WHEN f AND decision NOT IN ('FLAG','BLOCK') THEN -2000.0 ELSE 0.0 END
  + CASE WHEN NOT f AND decision IN ('FLAG','BLOCK') THEN -50.0 ELSE 0.0 END
  + CASE WHEN customer_segment = 'VIP' AND decision IN ('FLAG','BLOCK') THEN -10.0 ELSE 0.0 END AS reward
FROM (SELECT *, is_fraud_label AS f FROM predictions WHERE is_fraud_label IS NOT NULL) x"""))
def q_j3(spark, sf):
    lab = ev.labelled(adapter.predictions(spark, sf))
    return lab.select("transaction_id", "decision",
                      policy.reward_v1("decision", "is_fraud_label", "customer_segment").alias("reward"))
