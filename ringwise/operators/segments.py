"""Customer segmentation.

Parameters are a one-row DataFrame (bounded size by construction) attached
to the row plan as a scalar subquery - never collected, never joined.

Fixed values: score = 0.5 * tenure + 0.5 * recency, eps 1e-12, VIP at the
0.90 quantile of the score, Regular at the 0.50 quantile, else New.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.functions.params import scalar_row
from ringwise.plans.quantile import exact_quantiles

EPS = 1e-12
VIP_Q, REGULAR_Q = 0.90, 0.50


def _null_nan(c: str):
    return F.when(~F.isnan(F.col(c)), F.col(c))


def _score(d1, d15, p=None):
    g = (lambda n: p[n]) if p is not None else F.col
    return (0.5 * ((d1 - g("d1_min")) / (g("d1_max") - g("d1_min") + EPS))
            + 0.5 * ((g("d15_max") - d15) / (g("d15_max") - g("d15_min") + EPS)))


def fit_segments(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row ``d1_min d1_max d15_min d15_max regular_cut vip_cut``.

    Exact quantiles (linear interpolation) come from rank bracketing
    (``plans.quantile``); ``approx=True`` switches to ``percentile_approx``.
    """
    base = df.select(_null_nan("D1").alias("D1"), _null_nan("D15").alias("D15"))
    mm = base.agg(F.min("D1").alias("d1_min"), F.max("D1").alias("d1_max"),
                  F.min("D15").alias("d15_min"), F.max("D15").alias("d15_max"))
    scored = base.select(_score(F.col("D1"), F.col("D15"), scalar_row(mm)).alias("s"))
    if approx:
        q = scored.agg(F.percentile_approx("s", [REGULAR_Q, VIP_Q], 100000).alias("q"))
    else:
        q = exact_quantiles(scored, "s", [REGULAR_Q, VIP_Q]).select(F.array("q0", "q1").alias("q"))
    qs = scalar_row(q)
    return mm.select("d1_min", "d1_max", "d15_min", "d15_max",
                     qs["q"][0].alias("regular_cut"), qs["q"][1].alias("vip_cut"))


def _label(score, p):
    return (F.when(score >= p["vip_cut"], "VIP").when(score >= p["regular_cut"], "Regular")
            .otherwise("New"))


def assign_batch(df: DataFrame, params: DataFrame) -> DataFrame:
    """Batch segments; a missing D1/D15 (null or NaN) gives ``New``."""
    p = scalar_row(params)
    s = _score(_null_nan("D1"), _null_nan("D15"), p)
    return (df.withColumn("segment_score", s)
            .withColumn("customer_segment", _label(F.col("segment_score"), p)))


def assign_online(df: DataFrame, params: DataFrame | None) -> DataFrame:
    """D3: online segments - null D1/D15 read as 0.0; NaN gives ``New``; no parameters gives ``Regular``."""
    if params is None:
        return df.withColumn("customer_segment", F.lit("Regular"))
    p = scalar_row(params)
    d1, d15 = F.coalesce(F.col("D1"), F.lit(0.0)), F.coalesce(F.col("D15"), F.lit(0.0))
    s = _score(d1, d15, p)
    return df.withColumn("customer_segment", F.when(F.isnan(d1) | F.isnan(d15), "New").otherwise(_label(s, p)))


def minmax(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Min-max scale ``col``; a constant or empty column scales to 0."""
    st = scalar_row(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")))
    lo, hi, x = st["lo"], st["hi"], F.col(col)
    flat = lo.isNull() | hi.isNull() | (F.abs(hi - lo) < EPS)
    scaled = F.when(x.isNull(), F.lit(None)).when(flat, 0.0).otherwise((x - lo) / (hi - lo + EPS))
    return df.withColumn(out or f"{col}_scaled", scaled)
