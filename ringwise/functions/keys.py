"""Graph node keys (B1-B5) as Column expressions.

One canonical card key everywhere: integer text of card1..card3 joined by
``-`` with null as ``NA``, so batch rows and streamed rows hit the same node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int_text(c) -> Column:
    return F.coalesce(F.col(c).cast("double").cast("long").cast("string"), F.lit("NA")) \
        if isinstance(c, str) else F.coalesce(c.cast("double").cast("long").cast("string"), F.lit("NA"))


def card_key(c1="card1", c2="card2", c3="card3") -> Column:
    """B1: ``card1-card2-card3`` as integer text, null -> ``NA``."""
    return F.concat_ws("-", _int_text(c1), _int_text(c2), _int_text(c3))


def _trimmed(c) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c)


def device_key(dtype="DeviceType", dinfo="DeviceInfo") -> Column:
    """B2: ``type-info`` only when both are present."""
    t, i = F.col(dtype), F.col(dinfo)
    return F.when(t.isNotNull() & i.isNotNull(), F.concat_ws("-", F.trim(t), F.trim(i)))


def email_key(domain="P_emaildomain") -> Column:
    """Purchaser domain, trimmed and lower-cased; blank means no node."""
    return F.nullif(F.lower(_trimmed(domain)), F.lit(""))


def address_key(addr="addr1") -> Column:
    """``addr1`` as trimmed integer text; blank means no node."""
    return F.nullif(F.trim(F.col(addr).cast("double").cast("long").cast("string")), F.lit(""))


def with_node_keys(txn: DataFrame) -> DataFrame:
    return txn.withColumns({"card_id": card_key(), "device_id": device_key(),
                            "email_id": email_key(), "addr_id": address_key()})


def legacy_node_ids(txn: DataFrame) -> DataFrame:
    """The older key set - device, IP (``id_15``, in a table without it ``id_01``) and the purchaser/recipient email pair.

    Missing parts read as ``None`` text, so every transaction has all four nodes.
    """
    none = F.lit("None")
    return txn.select(
        "TransactionID", "isFraud",
        card_key().alias("card_id"),
        F.concat_ws("-", F.coalesce("DeviceType", none), F.coalesce("DeviceInfo", none)).alias("device_id"),
        F.coalesce(F.col("id_15" if "id_15" in txn.columns else "id_01").cast("string"), none).alias("ip_id"),
        F.concat_ws("-", F.coalesce("P_emaildomain", none), F.coalesce("R_emaildomain", none)).alias("email_id"),
    )
