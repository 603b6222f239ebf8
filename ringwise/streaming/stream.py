"""Structured Streaming jobs.

The reference scores one message at a time in processing time.  Here the
stream is a Structured Streaming query: a file (or Kafka, when its jar is on
the classpath) source of JSON messages, stream-static joins against the
card-risk and segment tables, the same decision columns as batch H7, and a
``foreachBatch`` sink that writes each micro-batch idempotently (one folder
per batch id, so a replay after a lost executor rewrites the same output).

Windowed request statistics (N8-N12) are plain windowed aggregations; the
same functions run on a batch DataFrame (the oracle form) or on a stream
(state and watermarks: ``stateful``).

Fixed values: sliding window 5 minutes every 1 minute; trend over 1 hour.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwise.functions.decisions import confidence, decide, segment_threshold
from ringwise.streaming.stateful import ALL_ROUTES, DELIVERIES

MESSAGE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("card_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("features", T.MapType(T.StringType(), T.StringType())),
    T.StructField("is_fraud", T.IntegerType()),
])


def to_payload(txn: DataFrame, feature_cols: list[str]) -> DataFrame:
    """JSON-safe message per transaction: NaN / infinity -> null, features packed as a JSON map."""
    def safe(c):
        col = F.col(c)
        return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col) \
            if dict(txn.dtypes)[c] in ("double", "float") else col
    feats = F.create_map(*[x for c in feature_cols for x in (F.lit(c), safe(c).cast("string"))])
    from ringwise.functions.keys import card_key
    return txn.select(F.col("TransactionID").cast("string").alias("transaction_id"), card_key().alias("card_id"),
                      F.col("TransactionAmt").alias("amount"), feats.alias("features"),
                      F.col("isFraud").alias("is_fraud"), F.col("TransactionDT").alias("_order"))


def replay(payload: DataFrame, path: str, rows_per_file: int = 1000, first: int | None = None) -> int:
    """Write messages (all, or the ``first`` so many in time) as time-ordered JSON files so a file stream replays
    them in order; a file holds at most ``rows_per_file`` messages.  Returns the number of parts, about that of files."""
    if first is not None:
        payload = payload.orderBy("_order", "transaction_id").limit(first)
    n = payload.count()
    parts = max(1, -(-n // rows_per_file))
    (payload.repartitionByRange(parts, "_order").sortWithinPartitions("_order").drop("_order")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path))
    return parts


def files_per_trigger(files: int, least: int = 4, batches: int = DELIVERIES) -> str:
    """Files that a micro-batch takes at most: ``least``, or so many that a backlog of ``files`` is done in ``batches``.

    Every micro-batch joins the whole card table, so their number must not grow with the backlog.
    """
    return str(max(least, -(-files // batches)))


def read_txn_stream(spark: SparkSession, fmt: str = "json", path: str | None = None,
                    opts: dict | None = None) -> DataFrame:
    """Transaction messages as a stream; malformed rows are dropped (PERMISSIVE parse, null key filtered)."""
    opts = dict(opts or {})
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**opts).load()
        parsed = raw.select(F.from_json(F.col("value").cast("string"), MESSAGE_SCHEMA).alias("m")).select("m.*")
    else:
        opts.setdefault("maxFilesPerTrigger", "1")  # N7: bounded work per micro-batch
        parsed = spark.readStream.schema(MESSAGE_SCHEMA).options(mode="PERMISSIVE", **opts).format(fmt).load(path)
    return parsed.where(F.col("transaction_id").isNotNull())


def score_stream(msgs: DataFrame, card_risk: DataFrame, seg_params: DataFrame) -> DataFrame:
    """Message -> scored record, via stream-static joins (same rules as batch H7)."""
    from ringwise.operators.segments import assign_online
    f = F.col("features")
    rows = msgs.select("transaction_id", "card_id", "amount", "is_fraud",
                       F.coalesce(f["fraud_probability"].try_cast("double"), F.lit(0.0)).alias("fraud_probability"),
                       f["D1"].try_cast("double").alias("D1"), f["D15"].try_cast("double").alias("D15"),
                       F.coalesce(f["graph_risk_score"].try_cast("double"), F.lit(0.0)).alias("stored_risk"))
    seg = assign_online(rows, seg_params)
    chk = card_risk.select("card_id", "in_fraud_ring", "ring_risk_score")
    j = seg.join(chk, "card_id", "left").withColumn("in_fraud_ring", F.coalesce("in_fraud_ring", F.lit(False)))
    risk = F.when(F.col("in_fraud_ring"), F.greatest("stored_risk", "ring_risk_score")).otherwise(F.col("stored_risk"))
    out = j.select("transaction_id", "card_id", F.round("fraud_probability", 4).alias("fraud_probability"),
                   "customer_segment", segment_threshold("customer_segment").alias("threshold"),
                   risk.alias("graph_risk_score"), "in_fraud_ring", F.coalesce("amount", F.lit(0.0)).alias("amount"),
                   "is_fraud")
    d = decide("fraud_probability", "threshold", "graph_risk_score", "in_fraud_ring")
    return out.withColumn("decision", d).withColumn("confidence", confidence("fraud_probability", "decision"))


def route(batch: DataFrame, batch_id: int, sinks: str) -> None:
    """FLAG -> alerts, BLOCK -> blocks, everything -> predictions; one folder per batch id."""
    batch.persist()
    try:
        for name, cond in (("predictions", F.lit(True)), ("alerts", F.col("decision") == "FLAG"),
                           ("blocks", F.col("decision") == "BLOCK")):
            (batch.where(cond).write.mode("overwrite")
             .parquet(os.path.join(sinks, name, f"batch={batch_id}")))
    finally:
        batch.unpersist()


def route_stream(scored: DataFrame, sinks: str, checkpoint: str):
    """Start the routing query (exactly-once per batch through the checkpoint + idempotent writes)."""
    return (scored.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda b, i: route(b, i, sinks)).start())


def running_stats(scored: DataFrame) -> DataFrame:
    """Running totals per decision (update / complete output mode)."""
    return scored.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.avg("fraud_probability").alias("mean_p"))


# ---------------------------------------------------------------- windowed request statistics

def rate(req: DataFrame, win: str = "5 minutes", slide: str = "1 minute", by: tuple = ("status",)) -> DataFrame:
    """Requests per second over a sliding window, per status (or route)."""
    seconds = _seconds(win)
    return (req.groupBy(F.window("ts", win, slide).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / float(seconds)).alias("rate")))


def error_share(req: DataFrame, win: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Share of 5xx responses per sliding window."""
    return (req.groupBy(F.window("ts", win, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("errors"))
            .select(F.col("w.start").alias("window_start"), "n", "errors",
                    F.try_divide(F.col("errors").cast("double"), F.col("n").cast("double")).alias("error_share")))


def latency_quantiles(req: DataFrame, win: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Exact p50 / p95 / p99 of request duration per sliding window, per route and over all routes.

    One buffer per window and route: the form for checks and small windows; ``stateful.latency_windows`` keeps sketches.
    """
    q = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    panels = req.withColumn("route", F.explode(F.array("route", F.lit(ALL_ROUTES))))
    return (panels.groupBy(F.window("ts", win, slide).alias("w"), "route").agg(q.alias("q"))
            .select(F.col("w.start").alias("window_start"), "route", F.col("q")[0].alias("p50"),
                    F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99")))


def hourly_trend(req: DataFrame, route: str = "/api/v1/predict", status: int = 200) -> DataFrame:
    """Answered requests (of one status) this hour / previous hour - 1 (batch form with ``lag``)."""
    c = (req.where((F.col("route") == route) & (F.col("status") == status)).groupBy(F.window("ts", "1 hour").start.alias("hour"))
         .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(F.lit(1)).orderBy("hour")
    prev = F.lag("n").over(w)
    return c.select("hour", "n", prev.alias("prev_n"),
                    (F.try_divide(F.col("n").cast("double"), prev.cast("double")) - 1.0).alias("trend"))


def decision_mix(pred: DataFrame, win: str = "1 hour") -> DataFrame:
    """Decisions per tumbling window."""
    return (pred.groupBy(F.window("created_at", win).start.alias("window_start"), "decision")
            .agg(F.count(F.lit(1)).alias("n")))


def _seconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
