"""Adapter: driver test tables -> the fraud tables the operators consume.

``transactions`` is one row per order, ``predictions`` one scored row per
transaction, ``requests`` one API request per event.  The definitions are
the fixture contract; the DuckDB twin lives in ``ringwise.checks.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw card transactions joined with identity columns (one per order)."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.min_by("l_partkey", F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("pk"),
               F.min("l_quantity").alias("q1"), F.max("l_quantity").alias("q2"),
               F.count(F.lit(1)).alias("n_items")))
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("ms"))
    o = (table(spark, sf_dir, "orders")
         .select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cu"),
                 F.col("o_orderdate").cast("date").alias("od"), "o_totalprice",
                 "o_orderstatus", "o_orderpriority")
         .join(li, F.col("k") == F.col("l_orderkey"), "left")
         # by customer, as the windows below: no further exchange, and the customers never pass the driver
         .join(cust.hint("merge"), F.col("cu") == F.col("c_custkey"))
         .withColumn("n_items", F.coalesce("n_items", F.lit(0)))
         .withColumn("u", (F.col("k") * 7919) % 1000))
    k, cu, u = F.col("k"), F.col("cu"), F.col("u")
    per_cust = Window.partitionBy("cu")
    by_date = Window.partitionBy("cu").orderBy("od", "k")
    ms = F.col("ms")
    return o.select(
        k.alias("TransactionID"),
        (k * 60).alias("TransactionDT"),
        F.when(k % 29 == 0, 1).otherwise(0).alias("isFraud"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.substring("o_orderpriority", 1, 1).alias("ProductCD"),
        cu.alias("card1"),
        F.when(cu % 50 != 0, F.col("nk")).alias("card2"),
        F.lit(150).alias("card3"),
        F.lower(ms).alias("card4"),
        F.when(cu % 3 == 0, "credit").otherwise("debit").alias("card6"),
        F.when(cu % 10 != 0, F.col("nk") * 13 + k % 13).alias("addr1"),
        F.when(cu % 10 != 0, F.col("nk")).alias("addr2"),
        F.when(k % 3 == 0, F.col("q1")).alias("dist1"),
        F.when(k % 5 == 0, F.col("q2") * 10).alias("dist2"),
        F.when(cu % 6 != 0, F.concat(F.upper(ms), F.lit("-"), F.col("o_orderpriority"))).alias("P_emaildomain"),
        F.when(k % 4 == 0, F.lower(ms)).alias("R_emaildomain"),
        F.when((k % 2 == 0) & F.col("pk").isNotNull(),
               F.when(F.col("pk") % 2 == 0, "desktop").otherwise("mobile")).alias("DeviceType"),
        F.when(k % 2 == 0, F.concat(F.lit("dev-"), F.col("pk").cast("string"))).alias("DeviceInfo"),
        F.when(k % 7 != 0, F.col("o_orderstatus")).alias("id_15"),
        F.datediff("od", F.min("od").over(per_cust)).cast("double").alias("D1"),
        F.datediff("od", F.lag("od").over(by_date)).cast("double").alias("D15"),
        F.col("n_items").alias("C1"),
        (F.col("n_items") * 2).alias("C14"),
        (k % 24).alias("Transaction_Hour"),
        (F.floor(k / F.lit(24.0)).cast("long") % 7).alias("Transaction_Day"),
        F.when(k % 29 == 0, (F.lit(3500) + u * 6).cast("double") / 10000)
         .otherwise(F.floor((u * u * u * u * u * u).cast("double") / 105000000000000) / 10000)
         .alias("fraud_probability"),
        F.count(F.lit(1)).over(per_cust).alias("uid_count"),
    )


SEGMENT_THRESHOLDS = {"VIP": 0.72, "Regular": 0.88, "New": 0.82}


def predictions(spark: SparkSession, sf_dir: str, txn: DataFrame | None = None) -> DataFrame:
    """Prediction records as the scoring service stores them."""
    t = txn if txn is not None else transactions(spark, sf_dir)
    k = F.col("TransactionID")
    seg = (F.when(k % 11 == 0, "VIP").when(k % 11 < 6, "Regular").otherwise("New"))
    th = (F.when(seg == "VIP", 0.72).when(seg == "Regular", 0.88).otherwise(0.82))
    p = F.col("fraud_probability")
    r = ((k * 104729) % 100).cast("double") / 100
    return t.select(
        k.cast("string").alias("transaction_id"),
        p.alias("fraud_probability"),
        r.alias("graph_risk_score"),
        seg.alias("customer_segment"),
        F.when(p >= th, "BLOCK").when((p >= th * 0.4) & (r >= 0.5), "FLAG").otherwise("APPROVE").alias("decision"),
        (((k * 31) % 400 + 50).cast("double") / 10).alias("latency_ms"),
        F.when(k % 13 != 0, F.col("TransactionAmt")).alias("transaction_amt"),
        F.when(k % 10 != 9, F.col("isFraud") == 1).alias("is_fraud_label"),
        F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("created_at"),
    )


ROUTES = {"click": "/api/v1/predict", "error": "/api/v1/predict", "view": "/api/v1/explain",
          "purchase": "/api/v1/graph/rings"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API request log derived from ``events`` (route, status, duration)."""
    et = F.col("event_type")
    route = F.lit("/api/v1/similar")
    for ev, path in reversed(list(ROUTES.items())):
        route = F.when(et == ev, path).otherwise(route)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        route.alias("route"),
        F.when(et == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
        F.col("user_id").alias("card_id"),
    )
