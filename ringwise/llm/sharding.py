"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned map says which shard a slot is on.

The number of virtual slots never changes, so a record's virtual slot never does.  Bytes and rows are summed per virtual
slot (one group-by with map-side partial sums), and only the map is edited when shards are added or have grown uneven:
every shard keeps its virtual slots up to the mean, and what is above goes, largest first, to the shard with the fewest
bytes.  Maps are stored as one Parquet folder per version; the newest one holds.

All of it is DataFrame expressions.  What is held in one row is the list of virtual slots, of which there are ``slots``
(a parameter), not records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots.
SLOTS = 4096
#: Equal records that one row of their count is dealt out to in one go.
BLOCK = 65_536
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def virtual_slot(slots: int = SLOTS) -> Column:
    """Virtual slot of a record: by its id, size, checksum and, among records equal in these, the number of the copy."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("vslot"), "size", "text_crc32", "copy"),
                  F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, size, text_crc32, copy, vslot``, one row per document.

    Equal records differ in ``copy`` (0 ..), so that a null or repeated id never fills one virtual slot.  They are counted
    before any shuffle and dealt from the count, in blocks that many tasks share where there are many copies.
    """
    counted = docs.select("doc_id", record_size(F.col("text")).alias("size"),
                          F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
                          ).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= BLOCK).withColumn("_first", F.lit(0).cast("long"))
    many = (counted.where(F.col("_n") > BLOCK)
            .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BLOCK).cast("long"))))
            .repartition("doc_id", "size", "text_crc32", "_first"))
    last = F.least(F.col("_n"), F.col("_first") + BLOCK) - 1
    every = few.unionByName(many).select("doc_id", "size", "text_crc32", F.explode(F.sequence("_first", last)).alias("copy"))
    return every.withColumn("vslot", virtual_slot(slots))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes, rows`` of every virtual slot, empty ones included, from ``records``."""
    held = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: virtual slots in turn to the shards."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"),
                                     (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map(version, vslot, shard)`` for ``sizes(vslot, bytes, rows)`` and ``shards`` shards.

    A shard keeps its largest virtual slots as long as their sum is not above the mean of all shards; the others (and all
    of shards that are no more) are dealt, largest first, each to the shard that then has the fewest bytes.  Slots
    without bytes stay unless their shard is gone.  Ties go by the slot's number and to the lowest shard.
    """
    rows = slot_map.join(sizes, "vslot").withColumn("all", F.sum("bytes").over(Window.partitionBy()))  # one row per slot
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    stays = (F.col("shard") < shards) & ((F.col("upto") <= F.col("all") / shards) | (F.col("bytes") == 0))
    rows = rows.withColumn("upto", F.sum("bytes").over(order)).withColumn("stays", stays)
    one = rows.agg(
        F.max("version").alias("version"),
        F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("vslot", "shard", "bytes")))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes")))
                     ).alias("moved"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda t, k: t + k["bytes"]))

    def deal(state, m):
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda v, s: F.when(s == to, v + m["bytes"]).otherwise(v)).alias("loads"),
            F.concat(state["dealt"], F.array(F.struct(m["vslot"].alias("vslot"), to.alias("shard")))).alias("dealt"))

    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("dealt"))
    dealt = F.aggregate("moved", start, deal, lambda state: state["dealt"])
    every = F.concat(F.transform("kept", lambda k: F.struct(k["vslot"].alias("vslot"), k["shard"].alias("shard"))), dealt)
    return one.select("version", F.inline(every)).select((F.col("version") + 1).alias("version"), "vslot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the maps stored under ``path`` (a stored version is never changed)."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def newest_map(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored version."""
    maps = spark.read.parquet(path)
    return maps.where(F.col("version") == maps.agg(F.max("version")).scalar())


def assign(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """``records`` -> ``doc_id, size, text_crc32, shard, slot, vslot``.

    ``slot`` is the record's place in its shard, gapless from 0: virtual slots of a shard follow each other by number,
    and records of a virtual slot by id, size, checksum and copy.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = (slot_map.join(sizes, "vslot")
            .select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")))
    place = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "copy")
    ranked = rows.withColumn("rank", F.row_number().over(place))
    return ranked.join(F.broadcast(base), "vslot").select(  # one row per virtual slot
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "vslot")


def shard(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Assign all ``docs`` to ``shards`` shards of near equal bytes; the map's versions are stored under ``path``.

    If maps are stored there, the newest is edited, else the first one is made.  A null text has no bytes; a null or
    repeated doc_id is one value among others, and its records spread over the virtual slots by size, checksum and copy;
    an empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    from ringwise.session import stored
    spark = docs.sparkSession
    rows = stored(records(docs, slots))  # read twice: sizes and places; the texts are read once
    sizes = stored(slot_sizes(rows, slots))
    try:
        current = newest_map(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store_map(first_map(spark, shards, slots), path)
        current = newest_map(spark, path)
    store_map(rebalance(current, sizes, shards), path)
    return assign(rows, newest_map(spark, path), sizes)
