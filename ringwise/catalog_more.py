"""Registered review (K), policy (J) and similarity (L) queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwise.catalog import register, txn
from ringwise.checks.oracle import with_base
from ringwise.operators import policy, review, similar
from ringwise.operators.evaluate import labelled
from ringwise.sources import adapter

D = "CAST({} AS DOUBLE)".format


def pred(spark, sf):
    return adapter.predictions(spark, sf)


# ---------------------------------------------------------------- K: review and audit

@register("k1_append_event")
def q_k1(spark, sf):
    return review.append_event(pred(spark, sf))


@register("k2_history", with_base("""
SELECT transaction_id, event_type, created_at, decision, fraud_probability,
  row_number() OVER (PARTITION BY transaction_id ORDER BY created_at, event_type) AS seq
FROM (SELECT transaction_id, 'predicted' AS event_type, created_at, decision, fraud_probability FROM predictions
      UNION ALL
      SELECT transaction_id, 'reviewed', created_at + INTERVAL 30 MINUTE, decision, fraud_probability
      FROM predictions WHERE decision = 'FLAG') x"""))
def q_k2(spark, sf):
    return review.history(review.events(pred(spark, sf)))


@register("k3_review_queue", with_base(f"""
SELECT transaction_id, round(coalesce(fraud_probability, 0.0), 4) AS fraud_probability,
  round(coalesce(graph_risk_score, 0.0), 4) AS graph_risk_score, coalesce(customer_segment, 'Unknown') AS customer_segment,
  ((CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(created_at) AS BIGINT) * 20 + 60) // 120) / {D(10)}
    AS minutes_waiting,
  upper(substr(r, 1, 1)) || lower(substr(r, 2)) AS flag_reason
FROM (SELECT *, CASE WHEN coalesce(fraud_probability, 0.0) < 0.5 AND coalesce(graph_risk_score, 0.0) < 0.5
        THEN 'borderline model score with graph risk signal'
        ELSE concat_ws('; ',
          CASE WHEN coalesce(fraud_probability, 0.0) >= 0.5
               THEN printf('elevated fraud probability (%.3f)', coalesce(fraud_probability, 0.0)) END,
          CASE WHEN coalesce(graph_risk_score, 0.0) >= 0.5
               THEN printf('high graph risk score (%.3f)', coalesce(graph_risk_score, 0.0)) END) END AS r
      FROM predictions WHERE decision = 'FLAG' ORDER BY fraud_probability DESC, transaction_id LIMIT 50) q"""))
def q_k3(spark, sf):
    return review.review_queue(pred(spark, sf))


@register("k4_stats", with_base("""
SELECT count(*) AS total, CAST(count_if(decision IN ('FLAG', 'BLOCK')) AS DOUBLE) / count(*) AS flagged_share,
  round(avg(latency_ms), 9) AS mean_latency_ms, count_if(decision = 'APPROVE') AS n_approve,
  count_if(decision = 'FLAG') AS n_flag, count_if(decision = 'BLOCK') AS n_block FROM predictions"""))
def q_k4(spark, sf):
    return review.stats(pred(spark, sf))


@register("k5_rolling_latency", with_base("""
SELECT count(*) AS n, round(avg(latency_ms), 9) AS mean_latency_ms
FROM (SELECT * FROM predictions ORDER BY created_at DESC, transaction_id DESC LIMIT 10000) x"""))
def q_k5(spark, sf):
    return review.rolling_latency(pred(spark, sf))


@register("k6_recent", with_base("""
SELECT * FROM predictions ORDER BY created_at DESC, transaction_id DESC LIMIT 50"""))
def q_k6(spark, sf):
    return review.recent(pred(spark, sf))


@register("k7_alert_counts", with_base("""
SELECT window_start, decision, count, count - coalesce(lag(count) OVER (PARTITION BY decision ORDER BY window_start), 0)
  AS change
FROM (SELECT date_trunc('hour', created_at) AS window_start, decision, count(*) AS count
      FROM predictions WHERE decision IN ('FLAG', 'BLOCK') GROUP BY 1, 2) x"""))
def q_k7(spark, sf):
    return review.alert_counts(review.alerts(pred(spark, sf)))


@register("k8_alert_feed", with_base("""
SELECT transaction_id, fraud_probability, graph_risk_score, customer_segment, decision, is_fraud_label, created_at
FROM predictions WHERE decision IN ('FLAG', 'BLOCK')
ORDER BY created_at DESC, transaction_id DESC LIMIT 20"""))
def q_k8(spark, sf):
    return review.alert_feed(review.alerts(pred(spark, sf)))


@register("k9_alert_text", with_base("""
SELECT transaction_id, CASE decision WHEN 'FLAG' THEN '\u26a0\ufe0f  FLAGGED' ELSE '\U0001f6ab BLOCKED' END
  || printf(': txn=%s | prob=%.3f | graph_risk=%.3f | seg=%s', coalesce(transaction_id, '?'), coalesce(fraud_probability, 0.0),
            coalesce(graph_risk_score, 0.0), coalesce(customer_segment, '?'))
  || CASE WHEN is_fraud_label IS NULL THEN '' WHEN is_fraud_label THEN ' | GT=fraud' ELSE ' | GT=legit' END AS line
FROM predictions WHERE decision IN ('FLAG', 'BLOCK')"""))
def q_k9(spark, sf):
    return review.alert_text(review.alerts(pred(spark, sf)))


@register("k11_row_counts", with_base("""
SELECT 'predictions' AS "table", count(*) AS rows FROM predictions UNION ALL
SELECT 'alerts', count(*) FROM predictions WHERE decision IN ('FLAG', 'BLOCK') UNION ALL
SELECT 'events', (SELECT count(*) FROM predictions) + (SELECT count(*) FROM predictions WHERE decision = 'FLAG')"""))
def q_k11(spark, sf):
    p = pred(spark, sf)
    return review.row_counts({"predictions": p, "alerts": review.alerts(p), "events": review.events(p)})


@register("k12_shares", with_base("""
SELECT decision, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS percent
FROM predictions GROUP BY decision"""))
def q_k12(spark, sf):
    return review.shares(pred(spark, sf))


# ---------------------------------------------------------------- J: policy

REWARD_SQL = """CASE action
  WHEN 'APPROVE' THEN CASE WHEN f THEN -2000.0 ELSE 10.0 END
  WHEN 'AUTO_APPROVE' THEN CASE WHEN f THEN -2000.0 ELSE 15.0 END
  WHEN 'BLOCK' THEN CASE WHEN f THEN 100.0 WHEN seg = 'VIP' THEN -5000.0 ELSE -50.0 END
  WHEN 'FLAG' THEN CASE WHEN f THEN 50.0 WHEN seg = 'VIP' THEN -100.0 ELSE -25.0 END END"""
LABP = "SELECT *, is_fraud_label AS f, customer_segment AS seg FROM predictions WHERE is_fraud_label IS NOT NULL"


@register("j1_states", with_base("""
SELECT transaction_id, fraud_probability AS s_prob,
  CASE customer_segment WHEN 'VIP' THEN 1.0 WHEN 'Regular' THEN 0.5 ELSE 0.0 END AS s_segment,
  graph_risk_score AS s_risk, coalesce(CAST(hour(created_at) AS DOUBLE) / 23.0, 0.5) AS s_hour FROM predictions"""))
def q_j1(spark, sf):
    return policy.states(pred(spark, sf))


@register("j2_reward_table", with_base(f"""
SELECT transaction_id, customer_segment, f AS is_fraud, action, CAST({REWARD_SQL} AS DOUBLE) AS reward
FROM lp CROSS JOIN (VALUES ('APPROVE'), ('FLAG'), ('BLOCK'), ('AUTO_APPROVE')) a(action)""", lp=LABP))
def q_j2(spark, sf):
    return policy.reward_table(labelled(pred(spark, sf)))


J4_SQL = f"""
SELECT strategy, sum(r) AS total_reward, avg(r) AS mean_reward,
  count_if(action IN ('FLAG','BLOCK') AND f) AS tp, count_if(action IN ('FLAG','BLOCK') AND NOT f) AS fp,
  count_if(action NOT IN ('FLAG','BLOCK') AND f) AS fn,
  count_if(action = 'APPROVE') AS n_approve, count_if(action = 'FLAG') AS n_flag, count_if(action = 'BLOCK') AS n_block,
  count_if(action = 'AUTO_APPROVE') AS n_auto_approve,
  coalesce(CAST(count_if(action IN ('FLAG','BLOCK') AND f) AS DOUBLE) / nullif(count_if(action IN ('FLAG','BLOCK')), 0), 0.0)
    AS precision,
  coalesce(CAST(count_if(action IN ('FLAG','BLOCK') AND f) AS DOUBLE) / nullif(count_if(f), 0), 0.0) AS recall,
  coalesce(2 * (coalesce(CAST(count_if(action IN ('FLAG','BLOCK') AND f) AS DOUBLE) / nullif(count_if(action IN ('FLAG','BLOCK')), 0), 0.0))
    * (coalesce(CAST(count_if(action IN ('FLAG','BLOCK') AND f) AS DOUBLE) / nullif(count_if(f), 0), 0.0))
    / nullif((coalesce(CAST(count_if(action IN ('FLAG','BLOCK') AND f) AS DOUBLE) / nullif(count_if(action IN ('FLAG','BLOCK')), 0), 0.0))
    + (coalesce(CAST(count_if(action IN ('FLAG','BLOCK') AND f) AS DOUBLE) / nullif(count_if(f), 0), 0.0)), 0), 0.0) AS f1
FROM (SELECT *, CAST({REWARD_SQL} AS DOUBLE) AS r FROM (
  SELECT 'stored' AS strategy, decision AS action, f, seg FROM lp UNION ALL
  SELECT 'threshold_0.5', CASE WHEN fraud_probability >= 0.5 THEN 'BLOCK' ELSE 'APPROVE' END, f, seg FROM lp UNION ALL
  SELECT 'approve_all', 'APPROVE', f, seg FROM lp) s) x
GROUP BY strategy"""


@register("j4_compare_strategies", with_base(J4_SQL, lp=LABP))
def q_j4(spark, sf):
    lab = labelled(pred(spark, sf))
    return policy.compare_strategies(lab, {
        "stored": F.col("decision"),
        "threshold_0.5": F.when(F.col("fraud_probability") >= 0.5, "BLOCK").otherwise("APPROVE"),
        "approve_all": F.lit("APPROVE")})


@register("j4_strategy_difference", with_base("""
SELECT 'stored - threshold_0.5' AS strategy, round(b.recall - a.recall, 4) AS recall, round(b.precision - a.precision, 4) AS precision,
  round(b.f1 - a.f1, 4) AS f1, round(b.total_reward - a.total_reward, 0) AS total_reward
FROM j4 a, j4 b WHERE a.strategy = 'threshold_0.5' AND b.strategy = 'stored'""", lp=LABP, j4=J4_SQL))
def q_j4_difference(spark, sf):
    return policy.strategy_difference(q_j4(spark, sf), "threshold_0.5", "stored")


@register("j5_best_action", with_base(f"""
SELECT p_decile, segment, risk_high, arg_max(action, [mean_reward, -ord]) AS best_action,
  max(mean_reward) AS best_mean_reward, max(n) AS n
FROM (SELECT p_decile, segment, risk_high, action, ord, avg(CAST({REWARD_SQL} AS DOUBLE)) AS mean_reward, count(*) AS n
  FROM (SELECT least(CASE WHEN fraud_probability < b0 / {D(10)} THEN b0 - 1
                          WHEN fraud_probability >= (b0 + 1) / {D(10)} THEN b0 + 1 ELSE b0 END, 9) AS p_decile,
          customer_segment AS segment, graph_risk_score >= 0.5 AS risk_high, f, seg
        FROM (SELECT *, CAST(floor(fraud_probability * 10) AS BIGINT) AS b0 FROM lp) q) r
  CROSS JOIN (VALUES ('APPROVE', 0), ('FLAG', 1), ('BLOCK', 2), ('AUTO_APPROVE', 3)) a(action, ord)
  GROUP BY ALL) m
GROUP BY p_decile, segment, risk_high""", lp=LABP))
def q_j5(spark, sf):
    return policy.best_action(labelled(pred(spark, sf)))


@register("j6_moving_average", with_base(f"""
SELECT run, transaction_id, moving_avg FROM (
  SELECT customer_segment AS run, transaction_id,
    row_number() OVER (PARTITION BY customer_segment ORDER BY created_at, transaction_id) AS rn,
    avg(CAST({REWARD_SQL} AS DOUBLE)) OVER (PARTITION BY customer_segment ORDER BY created_at, transaction_id
      ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS moving_avg
  FROM (SELECT *, decision AS action FROM lp) x) y WHERE rn >= 500""", lp=LABP))
def q_j6(spark, sf):
    lab = labelled(pred(spark, sf))
    r = lab.withColumn("reward", policy.reward("decision", "is_fraud_label", "customer_segment")) \
        .withColumn("run", F.col("customer_segment"))
    return policy.moving_average(r, "reward")


@register("j7_action_mix", with_base("""
SELECT decision AS action, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS percent
FROM predictions GROUP BY decision"""))
def q_j7(spark, sf):
    return policy.action_mix(pred(spark, sf).withColumnRenamed("decision", "action"))


# ---------------------------------------------------------------- L: similarity

@register("l1_unit_vector", with_base("""
SELECT vec_id, CASE WHEN n > 0 THEN list_transform(c, lambda x: x / n) ELSE c END AS unit
FROM (SELECT vec_id, c, sqrt(list_reduce(list_transform(c, lambda x: x * x), lambda a, b: a + b)) AS n
      FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) OR x IS NULL THEN 0.0
              ELSE CAST(x AS DOUBLE) END) AS c FROM embeddings) a) b"""))
def q_l1(spark, sf):
    return similar.unit_vector(adapter.table(spark, sf, "embeddings")).select("vec_id", "unit")


@register("l3_similar", with_base("""
SELECT e.vec_id, round(list_reduce(list_transform(list_zip(e.embedding, q.embedding),
    lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)), lambda a, b: a + b)
  / (sqrt(list_reduce(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b))
     * sqrt(list_reduce(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b))), 9)
  AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE e.vec_id <> 0 ORDER BY similarity DESC, e.vec_id LIMIT 10"""))
def q_l3(spark, sf):
    return similar.similar(adapter.table(spark, sf, "embeddings"), 0, 10)


_UNIT_SQL = """SELECT vec_id, CASE WHEN s > 0 THEN list_transform(x, lambda v: v / s) ELSE x END AS u FROM (
    SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS s FROM (
      SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v IS NULL OR NOT isfinite(v) THEN 0.0
        ELSE CAST(v AS DOUBLE) END) AS x FROM embeddings WHERE len(embedding) = 64) c) n"""


@register("l4_similar_all", with_base("""
SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank
FROM (SELECT q.vec_id AS a, e.vec_id AS b, round(list_dot_product(q.u, e.u), 9) AS similarity
  FROM units q JOIN units e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) x
QUALIFY rank <= 10""", units=_UNIT_SQL))
def q_l4(spark, sf):
    """The stated query set is every row whose id is divisible by 50; it is searched among all rows."""
    return similar.similar_many(adapter.table(spark, sf, "embeddings"), F.col("id") % 50 == 0, 10).select(
        "a", "b", "similarity", F.col("rank").cast("long").alias("rank"))
