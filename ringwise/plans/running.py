"""Running totals over an ordered column without a window that spans a whole group.

Rows are range-partitioned by (keys, order) and written once with the number of their range partition; totals per
partition (one row per partition and key) give every partition its offset, and a window inside one partition does the
rest.  No task ever holds more than one range partition, however large a group is.  Totals are decimals of 38 digits,
so counts of counts do not overflow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwise.session import stored

WHOLE = "decimal(38,0)"


def running_totals(rows: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``rows`` plus ``before_<c>``: total of the long column ``c`` over the earlier rows of the same ``keys``.

    (keys, order) must be unique: aggregate first.  Null keys form a group of their own; null orders come first
    (last when descending); a null in a summed column counts as 0; an empty table stays empty.
    """
    by = F.desc(order) if descending else F.asc(order)
    parts = stored(rows.repartitionByRange(*keys, by).withColumn("_pid", F.spark_partition_id()))
    total = {c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,0)") for c in sums}
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*keys, "_pid").agg(*[F.sum(total[c]).alias(f"_t_{c}") for c in sums]).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_opid"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).cast(WHOLE).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_pid").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(total[c]).over(inside), F.lit(0)).cast(WHOLE).alias(f"_l_{c}") for c in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_pid") == F.col("_opid"))
    return local.join(offsets, same).select(
        *rows.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).cast(WHOLE).alias(f"before_{c}") for c in sums])
