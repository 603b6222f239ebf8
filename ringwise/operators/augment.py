"""Synthetic fraud generation.

Random draws are hashes of (row id, seed, draw number), so a run repeats on
any partitioning.  Generated rows pick their seed fraud through a dense
index of the fraud rows (per-partition offsets, no single-partition window),
materialised once with a reliable checkpoint so recomputation after a lost
executor sees the same numbering.

Fixed values (pattern ranges):
  high_amount     amount x U(5, 20) (2 dp), D1 U(0, 3) (1 dp), D15 U(0, 5) (1 dp), risk U(0.6, 0.95)
  device_sharing  device velocity 5..20, device rate U(0.4, 0.9), connected fraud cards 3..10,
                  risk U(0.65, 0.95), device ``shared_device_<1..50>``
  rapid_sequence  C1..C4 10..50, D9 U(0, 0.5) (3 dp), risk U(0.5, 0.85)
  cross_border    addr2 one of 87, 32, 45, 60, 96; dist2 U(5000, 15000) (1 dp), dist1 U(0, 50) (1 dp),
                  risk U(0.45, 0.80)
  round_number    amount one of 100, 200, 500, 1000, 2000, 5000, 10000; C14 5..30; risk U(0.4, 0.75)
  risk values to 4 dp; noise 5 % (variants 3 %); mix adds max(1, int(0.2 n)) synthetic rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwise.functions.params import scalar_row
from ringwise.session import cut_lineage

PATTERNS = ("high_amount", "device_sharing", "rapid_sequence", "cross_border", "round_number")
_TWO63 = float(2 ** 63)


def uniform(key: Column, seed: int, draw: int) -> Column:
    """U[0, 1) from a hash of (key, seed, draw)."""
    h = F.xxhash64(key.cast("string"), F.lit(seed), F.lit(draw))
    return F.abs(h.cast("double")) / _TWO63


def normal(key: Column, seed: int, draw: int) -> Column:
    """N(0, 1) by Box-Muller on two hash draws."""
    u1 = F.greatest(uniform(key, seed, draw), F.lit(1e-300))
    u2 = uniform(key, seed, draw + 1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def _between(key, seed, draw, lo, hi) -> Column:
    return F.lit(lo) + uniform(key, seed, draw) * (hi - lo)


def _int_between(key, seed, draw, lo, hi) -> Column:
    return (F.lit(lo) + F.floor(uniform(key, seed, draw) * (hi - lo + 1))).cast("long")


def dense_index(df: DataFrame, col: str = "_idx") -> DataFrame:
    """0..n-1 over all rows: per-partition counts -> cumulative offsets (one row per partition) -> offset +
    position inside the partition.  Materialised so the numbering is stable."""
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    offs = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = offs.fillna(0, ["_off"]).select("_pid", "_off", "_base")
    return (tagged.join(F.broadcast(offs), "_pid")  # one row per input partition: bounded by the partition count
            .withColumn(col, F.col("_off") + F.col("_mid") - F.col("_base"))
            .drop("_pid", "_mid", "_off", "_base"))


def noise(df: DataFrame, cols: list[str], std: float = 0.05, seed: int = 0, key: str = "TransactionID") -> DataFrame:
    """M1: non-zero numeric columns x (1 + N(0, std)), 4 dp; new ``noise-`` id."""
    k = F.col(key)
    out = df
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(x.isNull() | (x == 0), x)
                             .otherwise(F.round(x * (1.0 + std * normal(k, seed, 10 + 2 * i)), 4)))
    return out.withColumn("transaction_id", F.concat(F.lit("noise-"), F.substring(F.sha2(
        F.concat_ws("|", k.cast("string"), F.lit(seed)), 256), 1, 32)))


def _frauds(df: DataFrame) -> DataFrame:
    return dense_index(df.where(F.col("isFraud") == 1))


def _pick(spark, frauds: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` generated rows, each joined to a random seed fraud (with replacement)."""
    nf = scalar_row(frauds.agg(F.count(F.lit(1)).alias("c")))["c"]
    gen = spark.range(n).withColumnRenamed("id", "gen_id")
    gen = gen.withColumn("_idx", F.pmod(F.xxhash64("gen_id", F.lit(seed), F.lit(0)), nf))
    return gen.join(frauds, "_idx").drop("_idx")


def variants(df: DataFrame, n: int, seed: int = 0, cols=("TransactionAmt", "D1", "D15", "C1", "C14")) -> DataFrame:
    """M2: ``n`` noisy copies (3 %) of randomly drawn fraud rows, tagged ``variant``."""
    picked = _pick(df.sparkSession, _frauds(df), n, seed)
    v = noise(picked.withColumn("_k", F.col("gen_id")), list(cols), 0.03, seed, "_k")
    return v.withColumn("isFraud", F.lit(1)).withColumn("pattern", F.lit("variant")) \
        .withColumn("seed_id", F.col("TransactionID")).drop("_k")


def apply_pattern(df: DataFrame, seed: int, key: str = "gen_id") -> DataFrame:
    """M3-M7: set the pattern's columns (pattern chosen per row)."""
    k = F.col(key)
    p = F.col("pattern")
    r4 = lambda lo, hi, d: F.round(_between(k, seed, d, lo, hi), 4)
    amt = F.coalesce(F.col("TransactionAmt"), F.lit(100.0))
    round_amounts = F.array(*[F.lit(a) for a in (100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0)])
    countries = F.array(*[F.lit(c) for c in ("87.0", "32.0", "45.0", "60.0", "96.0")])
    out = df.withColumns({
        "TransactionAmt": F.when(p == "high_amount", F.round(amt * _between(k, seed, 21, 5.0, 20.0), 2))
                           .when(p == "round_number",
                                 F.element_at(round_amounts, (_int_between(k, seed, 22, 0, 6) + 1).cast("int")))
                           .otherwise(F.col("TransactionAmt")),
        "D1": F.when(p == "high_amount", F.round(_between(k, seed, 23, 0.0, 3.0), 1)).otherwise(F.col("D1")),
        "D15": F.when(p == "high_amount", F.round(_between(k, seed, 24, 0.0, 5.0), 1)).otherwise(F.col("D15")),
        "device_card_velocity": F.when(p == "device_sharing", _int_between(k, seed, 25, 5, 20).cast("double")),
        "device_fraud_rate": F.when(p == "device_sharing", r4(0.4, 0.9, 26)),
        "connected_fraud_cards": F.when(p == "device_sharing", _int_between(k, seed, 27, 3, 10).cast("double")),
        "DeviceInfo": F.when(p == "device_sharing", F.concat(F.lit("shared_device_"),
                                                             _int_between(k, seed, 28, 1, 50).cast("string")))
                       .otherwise(F.col("DeviceInfo")),
        "C1": F.when(p == "rapid_sequence", _int_between(k, seed, 29, 10, 50)).otherwise(F.col("C1")),
        "C2": F.when(p == "rapid_sequence", _int_between(k, seed, 30, 10, 50)),
        "C3": F.when(p == "rapid_sequence", _int_between(k, seed, 31, 10, 50)),
        "C4": F.when(p == "rapid_sequence", _int_between(k, seed, 32, 10, 50)),
        "D9": F.when(p == "rapid_sequence", F.round(_between(k, seed, 33, 0.0, 0.5), 3)),
        "addr2": F.when(p == "cross_border",
                        F.element_at(countries, (_int_between(k, seed, 34, 0, 4) + 1).cast("int")).cast("double"))
                  .otherwise(F.col("addr2").cast("double")),
        "dist2": F.when(p == "cross_border", F.round(_between(k, seed, 35, 5000.0, 15000.0), 1))
                  .otherwise(F.col("dist2")),
        "dist1": F.when(p == "cross_border", F.round(_between(k, seed, 36, 0.0, 50.0), 1)).otherwise(F.col("dist1")),
        "C14": F.when(p == "round_number", _int_between(k, seed, 37, 5, 30)).otherwise(F.col("C14")),
        "graph_risk_score": (F.when(p == "high_amount", r4(0.6, 0.95, 38))
                             .when(p == "device_sharing", r4(0.65, 0.95, 38))
                             .when(p == "rapid_sequence", r4(0.5, 0.85, 38))
                             .when(p == "cross_border", r4(0.45, 0.80, 38))
                             .when(p == "round_number", r4(0.4, 0.75, 38))),
    })
    return out


def synthesise(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """M8: ``n`` synthetic frauds: random seed fraud x random pattern; ids ``syn-`` + hash; seed id kept."""
    picked = _pick(df.sparkSession, _frauds(df), n, seed)
    pats = F.array(*[F.lit(p) for p in PATTERNS])
    picked = picked.withColumn("pattern", F.element_at(pats, (_int_between(F.col("gen_id"), seed, 20, 0, 4) + 1)
                                                      .cast("int")))
    out = apply_pattern(picked, seed)
    sid = F.concat(F.lit("syn-"), F.substring(F.sha2(F.concat_ws("|", F.col("gen_id").cast("string"), F.lit(seed)),
                                                    256), 1, 12))
    return (out.withColumn("seed_id", F.col("TransactionID").cast("string")).withColumn("transaction_id", sid)
            .withColumn("isFraud", F.lit(1)).withColumn("synthetic", F.lit(True)))


def mix(df: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """M9: real rows plus max(1, int(ratio x n)) synthetic frauds (share 1/6 at 0.2), shuffled by hash."""
    n_real = df.count()
    n_syn = max(1, int(ratio * n_real))
    real = df.withColumn("transaction_id", F.col("TransactionID").cast("string")).withColumn("synthetic", F.lit(False))
    syn = synthesise(df, n_syn, seed)
    cols = ["transaction_id", "isFraud", "TransactionAmt", "synthetic"]
    u = real.select(*cols, F.lit(None).cast("string").alias("pattern")).unionByName(syn.select(*cols, "pattern"))
    return u.orderBy(F.xxhash64("transaction_id", F.lit(seed)))


def pattern_counts(df: DataFrame) -> DataFrame:
    """Rows per pattern."""
    return df.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
