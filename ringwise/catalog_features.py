"""Registered feature queries (C0-C6) with DuckDB oracles built from the same formula table."""

from __future__ import annotations

from ringwise.catalog import register, txn
from ringwise.checks.oracle import with_base
from ringwise.operators import features as fx

UP_SQL = """
  SELECT t.*, ln(1.0 + TransactionAmt) AS TransactionAmt_Log, TransactionAmt / pc.m AS uid_Amt_Relative_Check,
    pa.r AS cluster_fraud_rate
  FROM transactions t
  LEFT JOIN (SELECT card1, (CAST(sum(CAST(round(TransactionAmt * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE))
               / CAST(count(*) AS DOUBLE) AS m FROM transactions GROUP BY card1) pc ON t.card1 = pc.card1
  LEFT JOIN (SELECT addr1, avg(isFraud) AS r FROM transactions WHERE addr1 IS NOT NULL GROUP BY addr1) pa
    ON t.addr1 = pa.addr1"""
PARAMS_SQL = """
  SELECT (SELECT avg(isFraud) FROM up) AS global_fraud_rate,
    (SELECT quantile_cont(uid_Amt_Relative_Check, 0.75) FROM up) AS relative_amt_high_cut,
    (SELECT quantile_cont(D15, 0.25) FROM up WHERE NOT isnan(D15)) AS d15_recent_low_cut"""


def _sel(formulas: dict, keep: str = "TransactionID") -> str:
    cols = ",\n  ".join(f"round(CAST({fx.duck_formula(f)} AS DOUBLE), 9) AS {n}" for n, f in formulas.items())
    return f"SELECT {keep},\n  {cols}\nFROM up, params"


def _up(spark, sf):
    return fx.upstream(txn(spark, sf))


@register("c0_upstream", with_base("""
SELECT TransactionID, Transaction_Hour, Transaction_Day, round(TransactionAmt_Log, 9) AS TransactionAmt_Log, uid_count,
  round(uid_Amt_Relative_Check, 9) AS uid_Amt_Relative_Check, round(cluster_fraud_rate, 9) AS cluster_fraud_rate
FROM up""", up=UP_SQL))
def q_c0(spark, sf):
    from pyspark.sql import functions as F
    return _up(spark, sf).select("TransactionID", "Transaction_Hour", "Transaction_Day",
                                 F.round("TransactionAmt_Log", 9).alias("TransactionAmt_Log"), "uid_count",
                                 F.round("uid_Amt_Relative_Check", 9).alias("uid_Amt_Relative_Check"),
                                 F.round("cluster_fraud_rate", 9).alias("cluster_fraud_rate"))


@register("c1_velocity", with_base(_sel(fx.VELOCITY), up=UP_SQL, params=PARAMS_SQL))
def q_c1(spark, sf):
    return fx.velocity(_up(spark, sf))


@register("c2_geographic", with_base(_sel(fx.GEOGRAPHIC), up=UP_SQL, params=PARAMS_SQL))
def q_c2(spark, sf):
    return fx.geographic(_up(spark, sf))


@register("c3_temporal", with_base(_sel(fx.TEMPORAL), up=UP_SQL, params=PARAMS_SQL))
def q_c3(spark, sf):
    return fx.temporal(_up(spark, sf))


@register("c4_consistency", with_base(_sel(fx.CONSISTENCY), up=UP_SQL, params=PARAMS_SQL))
def q_c4(spark, sf):
    up = _up(spark, sf)
    return fx.consistency(up, fx.fit_params(up))


@register("c5_feature_params", with_base("SELECT * FROM params", up=UP_SQL, params=PARAMS_SQL))
def q_c5(spark, sf):
    return fx.fit_params(_up(spark, sf))


@register("c6_build_features", with_base(_sel(fx.ALL_FEATURES, keep="TransactionID, isFraud"),
                                         up=UP_SQL, params=PARAMS_SQL))
def q_c6(spark, sf):
    return fx.build_features(txn(spark, sf))
