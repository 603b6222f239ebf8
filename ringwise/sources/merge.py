"""Merges into keyed tables.

A batch may hold a key many times.  It is folded first, as if its rows were applied one after another in their order
(ties: by the whole row), with one aggregation that keeps a row a key: ``replace`` columns take the last value,
``fill`` columns the last that is not null, all others the first.  The folded batch then meets the target: an existing
key takes the replace columns, its fill columns only where the batch has a value, and keeps the rest; a new key brings
all its columns.  Applying a batch twice gives the same table, so a replay is harmless.

``KeyedTable`` keeps a target in hash partitions by key; a merge reads and rewrites only those that the batch touches.

Defined results: rows without a key are left out of a batch; an empty batch or target is allowed; columns that only one
side has are null on the other side's new rows; batch columns that the target lacks are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwise.session import stored


def fold(batch: DataFrame, key: str, order: list[str], replace: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """One row a key: what applying the batch's rows in order leaves."""
    rest = [c for c in batch.columns if c != key]
    rank = F.struct(*order, *sorted(c for c in rest if c not in order))

    def kept(c: str) -> Column:
        if c in replace:
            return F.max_by(c, rank)
        if c in fill:
            return F.max_by(c, F.when(F.col(c).isNotNull(), rank))
        return F.min_by(c, rank)
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(*[kept(c).alias(c) for c in rest])


def merge(target: DataFrame, batch: DataFrame, key: str, order: list[str], replace: list[str] = (), fill: list[str] = (),
          insert: bool = True) -> DataFrame:
    """The target after the batch; without ``insert`` keys that it does not have are ignored."""
    new = fold(batch, key, order, replace, fill).alias("n")
    old = target.alias("t")
    both = old.join(new, F.col(f"t.{key}") == F.col(f"n.{key}"), "full_outer" if insert else "left")
    known, met = F.col(f"t.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        was = F.col(f"t.{c}")
        if c not in batch.columns:
            return was
        now = F.col(f"n.{c}")
        if c in replace:
            return F.when(met, now).otherwise(was)
        if c in fill:
            return F.coalesce(now, was)
        return F.when(known, was).otherwise(now)
    return both.select(*[(F.coalesce(f"t.{key}", f"n.{key}") if c == key else value(c)).alias(c) for c in target.columns])


class KeyedTable:
    """A Parquet table in hash partitions by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # one task a partition, unless it is large: then adaptive execution splits the exchange
        (rows.select("*", self._bucket()).hint("rebalance", "_bucket").write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path))

    def create(self, rows: DataFrame) -> KeyedTable:
        """Write the first rows; keys must be distinct (see ``fold``)."""
        self._write(rows, "errorifexists")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_bucket")

    def merge(self, batch: DataFrame, order: list[str], replace: list[str] = (), fill: list[str] = (),
              insert: bool = True) -> list[int]:
        """Merge a batch and return the partitions that were rewritten.

        The new partitions are written beside the table first, then put in place by a dynamic partition overwrite; a job
        that dies between can be run again.
        """
        batch = stored(batch.where(F.col(self.key).isNotNull()))
        touched = sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())  # at most ``buckets`` numbers
        if touched:
            table = self.spark.read.parquet(self.path)
            here = table.where(F.col("_bucket").isin(touched)).drop("_bucket")
            self._write(stored(merge(here, batch, self.key, order, replace, fill, insert)), "overwrite")
        return touched
