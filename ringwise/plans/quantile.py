"""Exact quantiles by rank bracketing: only the rows close to the wanted ranks are sorted.

``percentile`` keeps every distinct value of a column in one aggregation buffer, and a global sort moves the whole
column for a few numbers.  Here a mergeable sketch (``percentile_approx``) names a lower and an upper bound for each
quantile, one aggregation counts the rows below them, and the rows between the bounds alone are grouped by value and
given their ranks (``plans.running``).  The bounds never decide the result: where the counts show that a wanted rank
lies outside, the bracket is opened on that side.  Equal values are one group, so a value that half of the rows share
costs one row per input partition.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwise.plans.running import running_totals

#: Accuracy of the sketch: its rank error is at most 1/ACCURACY of the rows.
ACCURACY = 10_000
#: Half width of a bracket in ranks, as a share of the rows.
MARGIN = 2 / ACCURACY


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> DataFrame:
    """One row, one column ``q<i>`` per requested quantile, interpolated linearly (as ``quantile_cont`` does).

    Nulls and NaN are left out; an empty column gives nulls.
    """
    return quantiles_of(df, [(col, q) for q in qs])


def quantiles_of(df: DataFrame, wanted: list[tuple[str, float]]) -> DataFrame:
    """As ``exact_quantiles`` for several columns in the same passes: ``q<i>`` is quantile ``wanted[i]`` = (column, share).

    Reads ``df`` three times (sketches, counts, brackets): store it first where it is costly to compute.  What reaches
    the driver is one row of bounds and one of counts.
    """
    def value(col: str) -> Column:
        v = F.col(col).cast("double")
        return F.when(~F.isnan(v), v)

    vs = [value(col) for col, _ in wanted]
    marks = [[min(1.0, max(0.0, q + side * MARGIN)) for side in (-1, 1)] for _, q in wanted]
    bounds = df.agg(*[F.percentile_approx(v, m, ACCURACY).alias(f"b{i}") for i, (v, m) in enumerate(zip(vs, marks))]).first()
    lows = [None if b is None else b[0] for b in bounds]
    highs = [None if b is None else b[1] for b in bounds]
    counts = df.agg(*[x for i, v in enumerate(vs) for x in (
        F.count(v).alias(f"n{i}"), F.count_if(v < F.lit(lows[i])).alias(f"below{i}"),
        F.count_if(v <= F.lit(highs[i])).alias(f"upto{i}"))]).first()
    picks, places = [], []
    for i, (_, q) in enumerate(wanted):
        last = counts[f"n{i}"] - 1
        if last < 0:
            places.append(None)
            continue
        lower = math.floor(last * q)
        upper = min(lower + 1, last)
        below, inside = counts[f"below{i}"], vs[i].isNotNull()
        if lower >= below:
            inside = inside & (vs[i] >= F.lit(lows[i]))
        else:
            below = 0
        if upper < counts[f"upto{i}"]:
            inside = inside & (vs[i] <= F.lit(highs[i]))
        picks.append((inside, F.struct(F.lit(i).alias("i"), vs[i].alias("v"))))
        places.append((lower - below, upper - below, last * q - lower))
    if not picks:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(wanted))])
    # a row enters every bracket that holds one of its values, and no row that is in none goes on
    held = (df.where(reduce(lambda a, b: a | b, [inside for inside, _ in picks]))
            .select(F.explode(F.array_compact(F.array(*[F.when(inside, iv) for inside, iv in picks]))).alias("_h"))
            .groupBy("_h.i", "_h.v").agg(F.count(F.lit(1)).alias("c")))
    ranks = running_totals(held, ["i"], "v", ["c"])

    def at(i: int, rank: int) -> Column:
        here = (F.col("i") == i) & (F.col("before_c") <= rank) & (F.col("before_c") + F.col("c") > rank)
        return F.max(F.when(here, F.col("v")))

    def interpolated(i: int) -> Column:
        if places[i] is None:
            return F.lit(None).cast("double")
        lo, hi, part = places[i]
        return at(i, lo) + (at(i, hi) - at(i, lo)) * F.lit(part)

    return ranks.agg(*[interpolated(i).alias(f"q{i}") for i in range(len(wanted))])
