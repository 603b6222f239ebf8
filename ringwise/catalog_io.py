"""Registered IO and merge queries (A1, A2, A4, A10-A13, L2) with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ringwise.catalog import ORACLE, _g, register, txn, txn_mat
from ringwise.checks.oracle import with_base
from ringwise.operators import graph as g
from ringwise.session import checkpoint_dir, stored
from ringwise.sources import adapter
from ringwise.sources import io
from ringwise.sources.merge import KeyedTable

INT_COLS = ["TransactionID", "TransactionDT", "isFraud", "card1", "card2", "card3", "addr1", "addr2", "C1", "C14",
            "Transaction_Hour", "Transaction_Day", "uid_count"]
FLOAT_COLS = ["TransactionAmt", "dist1", "dist2", "D1", "D15", "fraud_probability"]


def _scratch(spark, name):
    return checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


@register("a1_ingest", with_base("""
SELECT TransactionID, TransactionAmt, isFraud, CASE WHEN DeviceInfo IS NOT NULL THEN DeviceType END AS DeviceType,
  DeviceInfo, CASE WHEN DeviceInfo IS NOT NULL THEN id_15 END AS id_15 FROM transactions"""))
def q_a1(spark, sf):
    t = txn(spark, sf)
    base = _scratch(spark, "ingest")
    tx = t.select("TransactionID", "TransactionAmt", "isFraud")
    ident = t.where(F.col("DeviceInfo").isNotNull()).select("TransactionID", "DeviceType", "DeviceInfo", "id_15")
    io.write_csv(tx, f"{base}/txn")
    io.write_csv(ident, f"{base}/identity")
    return io.ingest(spark, f"{base}/txn", f"{base}/identity", tx.schema, ident.schema, f"{base}/out")


def _narrow_sql():
    parts = []
    for c in INT_COLS + FLOAT_COLS:
        kind = "float" if c in FLOAT_COLS else "int"
        t = ("'float'" if kind == "float" else
             f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
             f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
             f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END")
        parts.append(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                     f"{t} AS narrow_type FROM transactions")
    return "\nUNION ALL\n".join(parts)


@register("a2_narrow_types", with_base(_narrow_sql()))
def q_a2(spark, sf):
    return io.narrow_types(txn(spark, sf), INT_COLS + FLOAT_COLS)


@register("a4_read_edges", _g("""
SELECT TransactionID AS transaction_id, card_id, device_id, email_id, addr_id, isFraud = 1 AS is_fraud,
  TransactionAmt AS amount, CAST(Transaction_Hour AS INTEGER) AS transaction_hour FROM keyed""", "keyed"))
def q_a4(spark, sf):
    e = g.txn_edges(txn(spark, sf)).withColumn("is_fraud", F.when(F.col("is_fraud"), "true").otherwise("false"))
    path = _scratch(spark, "edges")
    io.write_csv(e, path)
    return io.read_edges(spark, path)


BATCH_SQL = """
  SELECT transaction_id, fraud_probability, graph_risk_score, customer_segment, 'FLAG' AS decision, latency_ms,
    transaction_amt, is_fraud_label, created_at + INTERVAL 1 MINUTE AS created_at FROM predictions WHERE decision = 'FLAG'
  UNION ALL
  SELECT transaction_id, fraud_probability, graph_risk_score, customer_segment, 'BLOCK', latency_ms,
    CASE WHEN CAST(transaction_id AS BIGINT) % 2 = 0 THEN NULL ELSE transaction_amt END, is_fraud_label,
    created_at + INTERVAL 2 MINUTE FROM predictions WHERE decision = 'FLAG'
  UNION ALL
  SELECT 'n' || transaction_id, fraud_probability, graph_risk_score, customer_segment, decision, latency_ms,
    transaction_amt, is_fraud_label, created_at FROM predictions WHERE decision = 'BLOCK'"""


def _batch(p):
    flag = p.where(F.col("decision") == "FLAG")
    v1 = flag.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 MINUTE"))
    v2 = (flag.withColumn("decision", F.lit("BLOCK"))
          .withColumn("transaction_amt", F.when(F.col("transaction_id").cast("long") % 2 == 0, F.lit(None))
                      .otherwise(F.col("transaction_amt")))
          .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 2 MINUTES")))
    new = p.where(F.col("decision") == "BLOCK").withColumn("transaction_id", F.concat(F.lit("n"), "transaction_id"))
    return v1.unionByName(v2).unionByName(new)


REPLACE = ["fraud_probability", "graph_risk_score", "customer_segment", "decision", "latency_ms",
           "is_fraud_label", "created_at"]


@register("a10_upsert", with_base("""
SELECT coalesce(b.transaction_id, t.transaction_id) AS transaction_id, """ + ", ".join(
    f"CASE WHEN b.transaction_id IS NOT NULL THEN b.{c} ELSE t.{c} END AS {c}" for c in REPLACE) + """,
  coalesce(b.transaction_amt, t.transaction_amt) AS transaction_amt
FROM predictions t FULL OUTER JOIN (SELECT * FROM batch
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC) = 1) b
  ON t.transaction_id = b.transaction_id""", batch=BATCH_SQL))
def q_a10(spark, sf):
    p = adapter.predictions(spark, sf)
    return io.upsert(p, _batch(p), "transaction_id", REPLACE, ["transaction_amt"])


@register("a10_upsert_buckets", ORACLE["a10_upsert"])
def q_a10_buckets(spark, sf):
    """A10 on a stored table: two batches, each of which rewrites only the hash partitions that it touches."""
    p = adapter.predictions(spark, sf)
    table = KeyedTable(spark, _scratch(spark, "predictions"), "transaction_id", 16).create(p)
    batch = stored(_batch(p))
    for part in (F.col("decision") == "FLAG", F.col("decision") != "FLAG"):
        table.merge(batch.where(part), ["created_at"], REPLACE, ["transaction_amt"])
    return table.read()


@register("a2_cast_narrow", with_base("""
SELECT TransactionID, CAST(isFraud AS TINYINT) AS isFraud, CAST(card3 AS SMALLINT) AS card3,
  CAST(Transaction_Hour AS TINYINT) AS Transaction_Hour, CAST(fraud_probability AS FLOAT) AS fraud_probability
FROM transactions"""))
def q_a2_cast(spark, sf):
    t = txn(spark, sf).select("TransactionID", "isFraud", "card3", "Transaction_Hour", "fraud_probability")
    return io.cast_narrow(t, ["isFraud", "card3", "Transaction_Hour", "fraud_probability"])


@register("a11_fill_label", with_base("""
SELECT p.* REPLACE (coalesce(l.v, p.is_fraud_label) AS is_fraud_label)
FROM predictions p LEFT JOIN (
  -- the later label wins: every seventh transaction was called fraud first and cleared an hour later
  SELECT CAST(TransactionID AS VARCHAR) AS k, CASE WHEN TransactionID % 7 = 0 THEN false ELSE isFraud = 1 END AS v
  FROM transactions) l ON p.transaction_id = l.k"""))
def q_a11(spark, sf):
    t = txn_mat(spark, sf)
    p = adapter.predictions(spark, sf, t)
    k = F.col("TransactionID")
    seen = t.select(k.cast("string").alias("transaction_id"), F.when(k % 7 == 0, True).otherwise(F.col("isFraud") == 1)
                    .alias("is_fraud_label"), k.alias("at"), k.alias("_k"))
    later = seen.where(F.col("_k") % 7 == 0).withColumn("is_fraud_label", F.lit(False)).withColumn("at", F.col("at") + 60)
    unknown = seen.withColumn("is_fraud_label", F.lit(None).cast("boolean")).withColumn("at", F.col("at") + 120)
    labels = seen.unionByName(later).unionByName(unknown).drop("_k")
    return io.fill_label(p, labels, order="at").select(*p.columns)


@register("a12_insert_absent", with_base("""
SELECT * FROM predictions WHERE decision IN ('FLAG', 'BLOCK')
UNION ALL
SELECT * FROM predictions WHERE fraud_probability >= 0.5 AND decision NOT IN ('FLAG', 'BLOCK')"""))
def q_a12(spark, sf):
    """Every candidate comes twice, the second time an hour later with another decision: the first one is inserted."""
    p = stored(adapter.predictions(spark, sf))
    target = p.where(F.col("decision").isin("FLAG", "BLOCK"))
    first = p.where(F.col("fraud_probability") >= 0.5)
    again = first.withColumn("decision", F.lit("LATER")).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    return io.insert_absent(target, first.unionByName(again), order="created_at")


@register("a13_backfill", with_base("""
SELECT e.vec_id, coalesce(p.is_fraud_label, e.label % 2 = 1) AS is_fraud
FROM embeddings e LEFT JOIN predictions p ON p.transaction_id = CAST(e.vec_id AS VARCHAR)"""))
def q_a13(spark, sf):
    """A label that is known replaces the embedding's own; an earlier opposite label and a later unknown one change nothing."""
    e = adapter.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 2 == 1).alias("is_fraud"), F.col("vec_id").cast("string").alias("transaction_id"))
    p = stored(adapter.predictions(spark, sf).select("transaction_id", F.col("is_fraud_label").alias("is_fraud"), F.lit(2).alias("at")))
    labels = (p.unionByName(p.withColumn("is_fraud", ~F.col("is_fraud")).withColumn("at", F.lit(1)))
              .unionByName(p.withColumn("is_fraud", F.lit(None).cast("boolean")).withColumn("at", F.lit(3))))
    return io.backfill(e, labels, "transaction_id", "is_fraud", "at").select("vec_id", "is_fraud")


@register("l2_upsert_embedding", with_base("""
SELECT coalesce(t.k, n.k) AS transaction_id, coalesce(t.embedding, n.embedding) AS embedding,
  CASE WHEN n.k IS NULL THEN t.is_fraud ELSE n.is_fraud END AS is_fraud
FROM (SELECT CAST(vec_id AS VARCHAR) AS k, embedding, label % 2 = 1 AS is_fraud FROM embeddings) t
FULL OUTER JOIN (
  SELECT CAST(vec_id * 2 AS VARCHAR) AS k, list_reverse(embedding) AS embedding,
    coalesce(p.is_fraud_label, CASE WHEN vec_id % 3 = 0 THEN true ELSE p.decision = 'BLOCK' END) AS is_fraud
  FROM embeddings e JOIN predictions p ON p.transaction_id = CAST(e.vec_id AS VARCHAR)) n ON t.k = n.k"""))
def q_l2(spark, sf):
    """Vectors for every second id: where one exists it stays and the label is replaced; a third is blocked later on."""
    e = adapter.table(spark, sf, "embeddings")
    target = e.select(F.col("vec_id").cast("string").alias("transaction_id"), "embedding", (F.col("label") % 2 == 1).alias("is_fraud"))
    p = adapter.predictions(spark, sf).select(F.col("transaction_id").alias("_k"), "is_fraud_label", "decision", "created_at")
    rows = stored(e.join(p, F.col("vec_id").cast("string") == F.col("_k")).select(
        "vec_id", (F.col("vec_id") * 2).cast("string").alias("transaction_id"), F.reverse("embedding").alias("embedding"),
        "is_fraud_label", "decision", "created_at"))
    later = (rows.where(F.col("vec_id") % 3 == 0).withColumn("decision", F.lit("BLOCK")).withColumn("embedding", F.slice("embedding", 1, 1))
             .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 MINUTE")))
    return io.upsert_embedding(target, rows.unionByName(later).drop("vec_id"))
