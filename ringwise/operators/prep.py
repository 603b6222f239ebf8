"""Feature preparation, projections, filters and splits.

Splits and samples are deterministic hashes of the id (no ``row_number`` over
a whole label, no seeded shuffle), so any partitioning gives the same rows.

Fixed values: the 13 readable feature labels below; holdout 20 %; five parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURE_LABELS = {
    "C1": "Address-Card Frequency",
    "C13": "Purchase Velocity (Historical)",
    "C14": "Device Fingerprint Frequency",
    "D1": "Days Since Card Registered",
    "D15": "Days Since Last Transaction",
    "M4": "Merchant Category Match",
    "M5": "Communication/Email Match",
    "M6": "Billing/Shipping Address Match",
    "V307": "Recent Transaction Volume",
    "dist1": "Distance from Billing Address",
    "addr1": "Zip Code (Regional Risk)",
    "P_emaildomain": "Purchaser Email Provider",
    "R_emaildomain": "Recipient Email Provider",
}
GRAPH_COLS = ("device_fraud_rate", "device_card_velocity", "connected_fraud_cards",
              "email_fraud_rate", "address_fraud_rate", "graph_risk_score")


def prepare(df: DataFrame, num: list[str], cat: list[str], keep: tuple = ("TransactionID",)) -> DataFrame:
    """Numbers -> double with missing / unparsable as 0.0; categories -> text with missing as ``None``."""
    cols = [F.col(k) for k in keep]
    cols += [F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c) for c in num]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in cat]
    cols += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in GRAPH_COLS
             if c in df.columns and c not in num]
    return df.select(*cols)


def feature_matrix(df: DataFrame, drop=("isFraud", "TransactionID", "TransactionDT", "customer_segment")) -> DataFrame:
    """The model's input columns - label, ids, time and segment removed."""
    return df.drop(*drop)


def hash_bucket(id_col: str, buckets: int = 100):
    """0..buckets-1 from the first 32 bits of md5 of the id text (same value in any SQL engine)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets))


def holdout(df: DataFrame, id_col: str = "TransactionID", pct: int = 20) -> DataFrame:
    """Deterministic 80/20 split column (hash of the id, independent of the label)."""
    return df.withColumn("split", F.when(hash_bucket(id_col) < pct, "test").otherwise("train"))


def part(df: DataFrame, id_col: str = "TransactionID", n: int = 5) -> DataFrame:
    """Disjoint parts by id modulo ``n``."""
    return df.withColumn("part", F.pmod(F.col(id_col), F.lit(n)))


def sample_n(df: DataFrame, id_col: str = "TransactionID", n: int = 100) -> DataFrame:
    """A repeatable sample of ``n`` rows (smallest md5 of the id)."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)


def label_names(df: DataFrame, col: str = "feature") -> DataFrame:
    """Readable label for a feature-code column (code itself when unknown)."""
    m = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    return df.withColumn("label", F.coalesce(m[F.col(col)], F.col(col)))


def select_pred(pred: DataFrame, decision: str | None = None, segment: str | None = None,
                labelled_only: bool = False, newest: int | None = None) -> DataFrame:
    """Filter predictions by decision / segment / label presence, optionally the newest N."""
    out = pred
    if decision:
        out = out.where(F.col("decision") == decision)
    if segment:
        out = out.where(F.col("customer_segment") == segment)
    if labelled_only:
        out = out.where(F.col("is_fraud_label").isNotNull())
    if newest:
        out = out.orderBy(F.desc("created_at"), F.desc("transaction_id")).limit(newest)
    return out
