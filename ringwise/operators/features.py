"""Row features.

C0 defines the upstream columns the feature builder consumes (the reference
reads them from a file nothing in it creates): hour, day, ``log1p(amount)``,
transactions per card, amount / card mean amount, fraud rate of the card's
billing address.  Per-key statistics are ``groupBy`` + join (partial
aggregation, skew-safe) rather than unbounded windows.

C1-C4 are plain column expressions (one ``select``, whole-stage codegen).
C5 fits three parameters as a one-row frame attached by scalar subquery.
Outputs are rounded to 9 decimals so that engines with different libm
agree on transcendental functions.

Fixed values: eps 1e-6; null addr2 / dist1 / dist2 read as -1; high-amount
cut = 0.75 quantile of the relative amount; recent cut = 0.25 quantile of D15.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.functions.params import scalar_row
from ringwise.plans.quantile import quantiles_of
from ringwise.session import stored

EPS = "0.000001"
_U = "log1p(coalesce(uid_count, 0))"
_R = "coalesce(uid_Amt_Relative_Check, 0.0)"
_H, _D = "CAST(Transaction_Hour AS DOUBLE)", "CAST(Transaction_Day AS DOUBLE)"
_REC = f"(1.0 / (1.0 + D15 + {EPS}))"
_TEN = f"(1.0 / (1.0 + D1 + {EPS}))"
_A1, _A2 = "abs(CAST(addr1 AS DOUBLE))", "abs(coalesce(CAST(addr2 AS DOUBLE), -1.0))"
_X1, _X2 = "abs(coalesce(dist1, -1.0))", "abs(coalesce(dist2, -1.0))"
_TOT = f"({_X1} + {_X2})"
_TOTLOG = f"log1p({_TOT} + {EPS})"
_PI = "3.141592653589793"

VELOCITY = {
    "vel_uid_count_log1p": _U,
    "vel_uid_count_div_time": f"{_U} / (1.0 + {_H} + {_D})",
    "vel_relative_amt": _R,
    "vel_relative_amt_sq": f"{_R} * {_R}",
    "vel_relative_amt_absdev": f"abs({_R} - 1.0)",
    "vel_relative_amt_log": f"log1p(abs({_R} - 1.0))",
    "vel_amt_per_uid_count": "TransactionAmt / (coalesce(uid_count, 0) + 1.0)",
    "vel_amt_log_per_uid_count": f"TransactionAmt_Log / ({_U} + 1.0)",
    "vel_recency_factor": _REC,
    "vel_tenure_factor": _TEN,
    "vel_recency_x_uid_count": f"{_REC} * {_U}",
    "vel_recency_x_relative": f"{_REC} * {_R}",
    "vel_hour_x_uid_count": f"{_H} * {_U}",
    "vel_day_x_relative": f"({_D} + 1.0) * {_R}",
    "vel_hour_day_interaction": f"({_H} + 1.0) * ({_D} + 1.0)",
}
GEOGRAPHIC = {
    "geo_addr1_log": f"log1p({_A1} + {EPS})",
    "geo_addr2_log": f"log1p({_A2} + {EPS})",
    "geo_addr1_bucket": f"floor({_A1} / 10.0)",
    "geo_dist1_abs": _X1,
    "geo_dist2_abs": _X2,
    "geo_dist1_log": f"log1p({_X1} + {EPS})",
    "geo_dist2_log": f"log1p({_X2} + {EPS})",
    "geo_dist_total": _TOT,
    "geo_dist_total_log": _TOTLOG,
    "geo_dist_ratio": f"{_X1} / ({_X2} + 1.0)",
    "geo_addr1_x_dist1_log": f"log1p({_A1} + {EPS}) * log1p({_X1} + {EPS})",
    "geo_addr1_x_dist2_log": f"log1p({_A1} + {EPS}) * log1p({_X2} + {EPS})",
    "geo_dist_symmetry": f"1.0 / (1.0 + abs({_X1} - {_X2}))",
    "geo_geo_interaction": f"(floor({_A1} / 10.0) + 1.0) * ({_TOTLOG} + 1.0)",
    "geo_addr_addr2_interaction": f"({_A1} + 1.0) * ({_A2} + 1.0) / (1.0 + {_TOT})",
}
TEMPORAL = {
    "temp_hour_sin": f"sin(2.0 * {_PI} * {_H} / 24.0)",
    "temp_hour_cos": f"cos(2.0 * {_PI} * {_H} / 24.0)",
    "temp_day_sin": f"sin(2.0 * {_PI} * {_D} / 7.0)",
    "temp_day_cos": f"cos(2.0 * {_PI} * {_D} / 7.0)",
    "temp_recency_factor": _REC,
    "temp_tenure_factor": _TEN,
    "temp_D1_over_D15": f"D1 / (D15 + 1.0 + {EPS})",
    "temp_recency_x_hour": f"{_REC} * ({_H} + 1.0)",
    "temp_tenure_x_day": f"{_TEN} * ({_D} + 1.0)",
    "temp_hour_bucket": f"floor({_H} / 6.0)",
}
_C = "cluster_fraud_rate"  # null where the row has no address: what is made of it is null too
CONSISTENCY = {
    "cons_relative_absdev": f"abs({_R} - 1.0)",
    "cons_relative_logdev": f"log1p(abs({_R} - 1.0))",
    "cons_cluster_risk_x_relative": f"{_C} * {_R}",
    "cons_cluster_risk_x_recency": f"{_C} * {_REC}",
    "cons_cluster_minus_global": f"{_C} - global_fraud_rate",
    "cons_uid_count_x_cluster": f"{_U} * {_C}",
    "cons_uid_count_over_day": f"uid_count / ({_D} + 1.0)",
    "cons_high_risk_flag": ("CAST(coalesce({r} >= relative_amt_high_cut AND D15 <= d15_recent_low_cut, false) AS INT)"
                            .format(r=_R)),
    "cons_mismatch_score": f"({_C} - 0.5) * ({_R} - 1.0)",
    "cons_transaction_amt_log_x_cluster": f"TransactionAmt_Log * {_C}",
}
ALL_FEATURES = {**VELOCITY, **GEOGRAPHIC, **TEMPORAL, **CONSISTENCY}


def upstream(txn: DataFrame) -> DataFrame:
    """Hour, day, log amount, per-card count and relative amount, address fraud rate."""
    # mean from an exact cents total, so every engine derives the same double
    per_card = txn.groupBy("card1").agg(
        ((F.sum(F.round(F.col("TransactionAmt") * 100).cast("long")) / 100.0) / F.count(F.lit(1))).alias("_card_mean"),
        F.count(F.lit(1)).alias("_card_n"))
    per_addr = (txn.where(F.col("addr1").isNotNull()).groupBy("addr1")
                .agg(F.avg("isFraud").alias("cluster_fraud_rate")))
    # the rows stream past the hashed cards of their part, unsorted
    return (txn.join(per_card.hint("shuffle_hash"), "card1", "left").join(per_addr, "addr1", "left")
            .withColumn("TransactionAmt_Log", F.log1p("TransactionAmt"))
            .withColumn("uid_Amt_Relative_Check", F.try_divide(F.col("TransactionAmt"), F.col("_card_mean")))
            .withColumn("uid_count", F.coalesce("uid_count", "_card_n"))
            .drop("_card_mean", "_card_n"))


def fit_params(df: DataFrame) -> DataFrame:
    """Global fraud rate, 0.75 quantile of the relative amount, 0.25 quantile of D15 (one row)."""
    # the three columns are written once: the upstream plan has joins, and the quantiles read it three times
    df = stored(df.select("isFraud", "uid_Amt_Relative_Check", "D15"))
    cuts = scalar_row(quantiles_of(df, [("uid_Amt_Relative_Check", 0.75), ("D15", 0.25)]))
    return df.agg(F.avg("isFraud").alias("global_fraud_rate")).select(
        "global_fraud_rate", cuts["q0"].alias("relative_amt_high_cut"), cuts["q1"].alias("d15_recent_low_cut"))


def _apply(df: DataFrame, formulas: dict, keep=("TransactionID",)) -> DataFrame:
    cols = [F.round(F.expr(f).cast("double"), 9).alias(n) for n, f in formulas.items()]
    return df.select(*keep, *cols)


def velocity(df: DataFrame) -> DataFrame:
    """15 velocity features."""
    return _apply(df, VELOCITY)


def geographic(df: DataFrame) -> DataFrame:
    """15 geographic features."""
    return _apply(df, GEOGRAPHIC)


def temporal(df: DataFrame) -> DataFrame:
    """10 temporal features."""
    return _apply(df, TEMPORAL)


def consistency(df: DataFrame, params: DataFrame) -> DataFrame:
    """C4: 10 consistency features (needs the C5 parameters)."""
    p = scalar_row(params)
    d = df.withColumns({k: p[k] for k in ("global_fraud_rate", "relative_amt_high_cut", "d15_recent_low_cut")})
    return _apply(d, CONSISTENCY)


def build_features(txn: DataFrame) -> DataFrame:
    """Upstream columns, parameters, then all 50 features in one projection."""
    up = upstream(txn)
    p = scalar_row(fit_params(up))
    d = up.withColumns({k: p[k] for k in ("global_fraud_rate", "relative_amt_high_cut", "d15_recent_low_cut")})
    return _apply(d, ALL_FEATURES, keep=("TransactionID", "isFraud"))


def duck_formula(expr: str) -> str:
    """The same formula in DuckDB's dialect (``log1p(x)`` is ``ln(1 + x)`` there)."""
    return expr.replace("log1p(", "ln(1.0 + ").replace(" AS INT)", " AS INTEGER)")
