"""Review queue, audit trail and running statistics.

The reference computes these per request over a store; here each is a
query over the prediction / alert / event tables.  "Now" is a parameter so
results repeat.  Top-k reports keep their limit (it is the feature) with a
full tiebreak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwise.functions.num import fixed
from ringwise.functions.decisions import flag_reason
from ringwise.functions.num import ratio_round

DECISIONS = ("APPROVE", "FLAG", "BLOCK")


def append_event(pred: DataFrame, event_type: str = "predicted") -> DataFrame:
    """K1: one event per prediction with the record as JSON."""
    body = F.to_json(F.struct("transaction_id", "fraud_probability", "graph_risk_score", "customer_segment",
                              "decision", "latency_ms"))
    return pred.select("transaction_id", F.lit(event_type).alias("event_type"), body.alias("data"),
                       F.col("created_at"))


def events(pred: DataFrame) -> DataFrame:
    """Audit events: every prediction, plus a ``reviewed`` event 30 minutes later for FLAG rows."""
    base = append_event(pred)
    reviewed = append_event(pred.where(F.col("decision") == "FLAG"), "reviewed") \
        .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 30 MINUTES"))
    return base.unionByName(reviewed)


def history(ev: DataFrame, schema: str = "decision string, fraud_probability double") -> DataFrame:
    """K2: event history per transaction, oldest first, with the JSON body parsed."""
    return ev.select("transaction_id", "event_type", "created_at",
                     F.from_json("data", schema).alias("d")).select(
        "transaction_id", "event_type", "created_at", F.col("d.decision").alias("decision"),
        F.col("d.fraud_probability").alias("fraud_probability"),
        F.row_number().over(Window.partitionBy("transaction_id").orderBy("created_at", "event_type")).alias("seq"))


def review_queue(pred: DataFrame, now: str = "2024-03-01 00:00:00", limit: int = 50) -> DataFrame:
    """K3: FLAG rows by probability (desc), minutes waiting to 0.1, reason; ``limit`` in 1..500."""
    limit = max(1, min(500, int(limit)))
    waited = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")
    return (pred.where(F.col("decision") == "FLAG")
            .orderBy(F.desc("fraud_probability"), "transaction_id").limit(limit)
            .select("transaction_id", F.round(F.coalesce("fraud_probability", F.lit(0.0)), 4).alias("fraud_probability"),
                    F.round(F.coalesce("graph_risk_score", F.lit(0.0)), 4).alias("graph_risk_score"),
                    F.coalesce("customer_segment", F.lit("Unknown")).alias("customer_segment"),
                    ratio_round(waited, F.lit(60), 1).alias("minutes_waiting"),
                    flag_reason(F.coalesce("fraud_probability", F.lit(0.0)),
                                F.coalesce("graph_risk_score", F.lit(0.0))).alias("flag_reason")))


def stats(pred: DataFrame) -> DataFrame:
    """K4: total, flagged share (FLAG + BLOCK), mean latency, counts per decision."""
    return pred.agg(
        F.count(F.lit(1)).alias("total"),
        (F.count_if(F.col("decision").isin("FLAG", "BLOCK")) / F.count(F.lit(1))).alias("flagged_share"),
        F.round(F.avg("latency_ms"), 9).alias("mean_latency_ms"),
        *[F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in DECISIONS])


def rolling_latency(pred: DataFrame, n: int = 10000) -> DataFrame:
    """K5: mean over the newest ``n`` latencies."""
    newest = pred.orderBy(F.desc("created_at"), F.desc("transaction_id")).limit(n)
    return newest.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 9).alias("mean_latency_ms"))


def recent(pred: DataFrame, n: int = 50) -> DataFrame:
    """K6: the ``n`` newest records."""
    return pred.orderBy(F.desc("created_at"), F.desc("transaction_id")).limit(n)


def alerts(pred: DataFrame) -> DataFrame:
    """Alert records: FLAG / BLOCK predictions without latency and amount."""
    return pred.where(F.col("decision").isin("FLAG", "BLOCK")).drop("latency_ms", "transaction_amt")


def alert_counts(al: DataFrame, step: str = "1 hour") -> DataFrame:
    """K7: alerts per decision per time step and the change since the previous step."""
    c = al.groupBy(F.window("created_at", step).start.alias("window_start"), "decision").count()
    w = Window.partitionBy("decision").orderBy("window_start")
    return c.withColumn("change", F.col("count") - F.coalesce(F.lag("count").over(w), F.lit(0)))


def alert_feed(al: DataFrame, n: int = 20) -> DataFrame:
    """K8: first sight of each id among FLAG/BLOCK alerts, newest ``n``."""
    w = Window.partitionBy("transaction_id").orderBy("created_at")
    first = al.where(F.col("decision").isin("FLAG", "BLOCK")).withColumn("_rn", F.row_number().over(w)) \
        .where(F.col("_rn") == 1).drop("_rn")
    return first.orderBy(F.desc("created_at"), F.desc("transaction_id")).limit(n)


def alert_text(al: DataFrame) -> DataFrame:
    """K9: one alert line per row with a label suffix (fixed wording)."""
    label = (F.when(F.col("is_fraud_label").isNull(), "")
             .when(F.col("is_fraud_label"), " | GT=fraud").otherwise(" | GT=legit"))
    tag = F.when(F.col("decision") == "FLAG", "\u26a0\ufe0f  FLAGGED").otherwise("\U0001f6ab BLOCKED")
    line = F.concat(tag, F.lit(": txn="), F.coalesce("transaction_id", F.lit("?")),
                    F.lit(" | prob="), fixed(F.coalesce("fraud_probability", F.lit(0.0)), 3),
                    F.lit(" | graph_risk="), fixed(F.coalesce("graph_risk_score", F.lit(0.0)), 3),
                    F.lit(" | seg="), F.coalesce("customer_segment", F.lit("?")), label)
    return al.select("transaction_id", line.alias("line"))


def row_counts(tables: dict) -> DataFrame:
    """Row count of each result table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table", "rows")


def confusion_shares(conf: DataFrame) -> DataFrame:
    """The confusion cells as rows with their percent of all (0 of an empty table)."""
    cells = ("tp", "fp", "fn", "tn")
    total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    return conf.select(total.alias("_n"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("cell"), F.col(c).alias("count")) for c in cells])).alias("_c")).select(
        "_c.cell", "_c.count", F.coalesce(F.try_divide(F.col("_c.count") * 100.0, F.col("_n")), F.lit(0.0)).alias("percent"))


def shares(df: DataFrame, by: str = "decision") -> DataFrame:
    """Count and percent of the total per value of ``by``."""
    c = df.groupBy(by).count()
    return c.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))))
