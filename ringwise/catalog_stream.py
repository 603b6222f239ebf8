"""Registered streaming queries: windowed statistics (N8-N12), the scoring stream (N1), stateful streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ringwise import catalog_extra, catalog_more  # noqa: F401  (N4 is checked against their oracles)
from ringwise.catalog import ORACLE, register, txn, txn_mat
from ringwise.checks.oracle import with_base
from ringwise.session import checkpoint_dir, cut_lineage, stored
from ringwise.sources import adapter
from ringwise.streaming import stateful as sf_
from ringwise.streaming import stream as st

D = "CAST({} AS DOUBLE)".format

SLIDE = """
  SELECT r.*, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start
  FROM requests r, range(0, 5) s(k)"""


@register("n8_request_rate", with_base("""
SELECT window_start, status, count(*) AS n, count(*) / CAST(300 AS DOUBLE) AS rate
FROM sl GROUP BY window_start, status""", sl=SLIDE))
def q_n8(spark, sf):
    return st.rate(adapter.requests(spark, sf))


@register("n9_error_share", with_base("""
SELECT window_start, count(*) AS n, count_if(status >= 500) AS errors,
  CAST(count_if(status >= 500) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS error_share
FROM sl GROUP BY window_start""", sl=SLIDE))
def q_n9(spark, sf):
    return st.error_share(adapter.requests(spark, sf))


@register("n10_latency_quantiles", with_base("""
SELECT window_start, coalesce(route, '(all)') AS route, quantile_cont(duration_ms, 0.5) AS p50,
  quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99
FROM sl GROUP BY GROUPING SETS ((window_start, route), (window_start))""", sl=SLIDE))
def q_n10(spark, sf):
    return st.latency_quantiles(adapter.requests(spark, sf))


@register("n10_latency_sketches")
def q_n10_sketches(spark, sf):
    """The same panels from per-minute quantile sketches (rank error, so no exact twin; held by a test)."""
    return sf_.latency_windows(sf_.latency_sketches(adapter.requests(spark, sf)))


@register("n11_hourly_trend", with_base("""
SELECT hour, n, lag(n) OVER (ORDER BY hour) AS prev_n,
  CAST(n AS DOUBLE) / CAST(lag(n) OVER (ORDER BY hour) AS DOUBLE) - 1.0 AS trend
FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM requests WHERE route = '/api/v1/predict' AND status = 200
      GROUP BY 1) x"""))
def q_n11(spark, sf):
    return st.hourly_trend(adapter.requests(spark, sf))


@register("n12_decision_mix", with_base("""
SELECT date_trunc('hour', created_at) AS window_start, decision, count(*) AS n FROM predictions GROUP BY 1, 2"""))
def q_n12(spark, sf):
    return st.decision_mix(adapter.predictions(spark, sf))


@register("n1_score_stream")
def q_n1(spark, sf):
    """Replay transactions as time-ordered JSON files, score them with a streaming query, route each
    micro-batch to predictions / alerts / blocks, and return the predictions sink."""
    from ringwise.operators import graph as g
    from ringwise.operators.rings import card_check
    from ringwise.operators.segments import fit_segments
    base = checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    t = txn_mat(spark, sf)
    files = st.replay(st.to_payload(t, ["fraud_probability", "D1", "D15"]), f"{base}/in", rows_per_file=5000)
    msgs = st.read_txn_stream(spark, "json", f"{base}/in", {"maxFilesPerTrigger": st.files_per_trigger(files)})
    # static sides are materialised once (reliable checkpoint), not recomputed per micro-batch
    risk = cut_lineage(card_check(g.typed_edges(t), g.card_nodes(t)))
    params = cut_lineage(fit_segments(t))
    scored = st.score_stream(msgs, risk, params)
    q = st.route_stream(scored, f"{base}/out", f"{base}/ckpt")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{base}/out/predictions").drop("batch")


# ---------------------------------------------------------------- stateful streams (deliveries with late and repeated rows)

DEL = """
  SELECT r.*, CAST(epoch_us(ts + CASE WHEN request_id % 17 = 0 THEN INTERVAL 10 DAY WHEN request_id % 5 = 0
    THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END) // 432000000000 AS BIGINT) AS slot FROM requests r"""
MARKS = {
    "seen": "SELECT slot, max(ts) AS m FROM del GROUP BY slot",
    # the watermark that a slot's rows meet, and the one after all slots
    "mark": """SELECT slot, max(m) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - INTERVAL 10 MINUTE AS w FROM seen""",
    "fin": "SELECT max(ts) - INTERVAL 10 MINUTE AS f FROM del",
    "met": "SELECT del.*, coalesce(w, TIMESTAMP '1970-01-01') AS w, f FROM del JOIN mark USING (slot), fin",
}


def _base(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _requests(spark, sf):
    """The request log as it arrives: every 17th row ten days late, every 5th five minutes."""
    late = (F.when(F.col("request_id") % 17 == 0, F.expr("INTERVAL 10 DAYS"))
            .when(F.col("request_id") % 5 == 0, F.expr("INTERVAL 5 MINUTES")).otherwise(F.expr("INTERVAL 0 MINUTES")))
    return stored(sf_.delivered(adapter.requests(spark, sf), F.col("ts") + late))


def _run(spark, rows, name, result, start=None, stop_after=None, most=None):
    """Deliver ``rows`` to ``result(stream)`` and return the folder its files are in."""
    base = _base(spark, name)
    start = start or sf_.to_files
    sf_.feed({f"{base}/in": rows}, lambda: start(result(sf_.read_stream(spark, f"{base}/in", rows)), f"{base}/out",
                                                 f"{base}/ckpt"), stop_after, most)
    return base


@register("n13_windowed_stream", with_base("""
SELECT window_start, route, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM met) x
WHERE window_start + INTERVAL 5 MINUTE > w AND window_start + INTERVAL 5 MINUTE <= f GROUP BY 1, 2""", **{"del": DEL}, **MARKS))
def q_n13(spark, sf):
    """Tumbling windows in append mode; rows whose window has passed the watermark are dropped."""
    base = _run(spark, _requests(spark, sf), "n13", sf_.tumbling)
    return spark.read.parquet(f"{base}/out")


@register("n13_sliding_stream", with_base("""
SELECT window_start, route, count(*) AS n FROM (
  SELECT met.*, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start FROM met, range(0, 5) s(k)) x
WHERE window_start + INTERVAL 5 MINUTE > w AND window_start + INTERVAL 5 MINUTE <= f GROUP BY 1, 2""", **{"del": DEL}, **MARKS))
def q_n13_sliding(spark, sf):
    base = _run(spark, _requests(spark, sf), "n13s", lambda s: sf_.tumbling(s, slide="1 minute"))
    return spark.read.parquet(f"{base}/out")


@register("n13_session_stream", with_base("""
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, card_id, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN ts < before + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY card_id ORDER BY ts, request_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY card_id ORDER BY ts, request_id) AS before FROM met
        WHERE ts + INTERVAL 30 MINUTE > w) a) b
GROUP BY card_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= any_value(f)""", **{"del": DEL}, **MARKS))
def q_n13_session(spark, sf):
    """Sessions per card, closed 30 minutes after the last request."""
    base = _run(spark, _requests(spark, sf), "n13c", sf_.sessions)
    return spark.read.parquet(f"{base}/out")


@register("n14_dedup_stream", with_base("""
SELECT request_id, ts, route FROM met WHERE ts > w""", **{"del": DEL}, **MARKS))
def q_n14(spark, sf):
    """Every third request is delivered again an hour later; each id comes out once, late ones never."""
    rows = _requests(spark, sf)
    again = sf_.delivered(rows.where(F.col("request_id") % 3 == 0).drop("slot"), F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    again = again.where(F.col("request_id") % 17 != 0)
    both = stored(rows.unionByName(again).select("request_id", "ts", "route", "slot"))
    base = _run(spark, both, "n14", lambda s: sf_.dedup_within(s, "request_id"))
    return spark.read.parquet(f"{base}/out")


def _topics(spark, sf):
    """Alert and block messages, every third one delivered a second time an hour later."""
    p = adapter.predictions(spark, sf).where(F.col("decision") != "APPROVE").select(
        "transaction_id", "decision", "fraud_probability", F.col("created_at").alias("ts"))
    again = p.where(F.col("transaction_id").cast("long") % 3 == 0)
    return stored(sf_.delivered(p, F.col("ts")).unionByName(sf_.delivered(again, F.col("ts") + F.expr("INTERVAL 1 HOUR"))))


@register("n3_alert_log", with_base("""
SELECT transaction_id, fraud_probability, created_at AS ts, decision FROM predictions WHERE decision <> 'APPROVE'"""))
def q_n3(spark, sf):
    """The two topics as one log, each transaction once whatever is delivered again."""
    base, both = _base(spark, "n3"), _topics(spark, sf)
    topics = {f"{base}/{d}": both.where(F.col("decision") == d).drop("decision") for d in ("FLAG", "BLOCK")}

    def start():
        alerts, blocks = (sf_.read_stream(spark, folder, rows) for folder, rows in topics.items())
        return sf_.once_to_files(sf_.alert_log(alerts, blocks), f"{base}/out", f"{base}/ckpt", "transaction_id")
    for folder, rows in topics.items():
        rows.limit(0).drop("slot").write.mode("append").parquet(folder)
    sf_.feed(topics, start, most=sf_.DELIVERIES)  # each id once wherever a delivery ends
    return spark.read.parquet(f"{base}/out").select("transaction_id", "fraud_probability", "ts", "decision")


@register("n4_policy_stream", f"""
SELECT h.transaction_id, h.fraud_probability, h.decision, h.customer_segment, j.best_action AS policy_action
FROM (SELECT *, least(CASE WHEN fraud_probability < b0 / {D(10)} THEN b0 - 1
        WHEN fraud_probability >= (b0 + 1) / {D(10)} THEN b0 + 1 ELSE b0 END, 9) AS p_decile,
      coalesce(graph_risk >= 0.5, NULL) AS risk_high
    FROM (SELECT *, CAST(floor(fraud_probability * 10) AS BIGINT) AS b0 FROM ({ORACLE['h12_score_lookup']}) x) y) h
LEFT JOIN ({ORACLE['j5_best_action']}) j
  ON j.p_decile = h.p_decile AND j.segment = h.customer_segment AND j.risk_high = h.risk_high""")
def q_n4(spark, sf):
    """The older scoring stream: looked-up score, policy action, one audit row a transaction."""
    from ringwise.operators import features as fx
    from ringwise.operators import policy, scoring
    from ringwise.operators.evaluate import labelled
    from ringwise.operators.segments import fit_segments
    t = txn_mat(spark, sf)
    p = adapter.predictions(spark, sf, t)
    scored = stored(scoring.score_lookup(p.select("transaction_id"), fx.upstream(t), fit_segments(t)))
    best = stored(policy.best_action(labelled(p)))
    messages = p.select("transaction_id", F.col("created_at").alias("ts"))
    again = messages.where(F.col("transaction_id").cast("long") % 3 == 0)
    rows = stored(sf_.delivered(messages, F.col("ts")).unionByName(
        sf_.delivered(again, F.col("ts") + F.expr("INTERVAL 7 DAYS"))))
    base = _run(spark, rows, "n4", lambda s: sf_.policy_stream(s, scored, best).select(
        "transaction_id", "fraud_probability", "decision", "customer_segment", "policy_action"),
        lambda r, out, ckpt: sf_.once_to_files(r, out, ckpt, "transaction_id"), most=sf_.DELIVERIES)
    return spark.read.parquet(f"{base}/out").drop("batch")


@register("n6_input_lag", with_base("""
SELECT slot, count(*) AS waiting FROM (SELECT request_id, ts, dense_rank() OVER (ORDER BY slot) AS k, slot FROM (
  SELECT request_id, ts, CAST(epoch_us(ts) // 432000000000 AS BIGINT) AS slot FROM requests) a) b
WHERE k > 3 GROUP BY slot"""))
def q_n6(spark, sf):
    """What a query that has committed three slots has still to do of all that has arrived."""
    rows = stored(sf_.delivered(adapter.requests(spark, sf), F.col("ts")))
    base = _run(spark, rows, "n6", lambda s: s.select("request_id"),
                lambda r, out, ckpt: sf_.once_to_files(r, out, ckpt, "request_id"), stop_after=3)
    return sf_.lag(rows, f"{base}/out", f"{base}/ckpt", "request_id")


@register("n5_running_stats", with_base("""
SELECT decision, count(*) AS n, round(avg(fraud_probability), 9) AS mean_p FROM predictions GROUP BY decision"""))
def q_n5(spark, sf):
    """Running totals per decision; the result of the last committed batch."""
    p = adapter.predictions(spark, sf).select("transaction_id", "decision", "fraud_probability", "created_at")
    rows = stored(sf_.delivered(p, F.col("created_at")))
    base = _run(spark, rows, "n5", lambda s: st.running_stats(s).withColumn("mean_p", F.round("mean_p", 9)),
                sf_.complete_to_files, most=sf_.DELIVERIES)
    return spark.read.parquet(f"{base}/out/batch={sf_.committed(spark, f'{base}/ckpt')}")
