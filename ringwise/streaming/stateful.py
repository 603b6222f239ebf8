"""Stateful streams with bounded state (N3-N6, N10, N13, N14): append mode, watermarks, file sinks.

Input comes in deliveries: all rows of one slot of arrival time are added to the input folder and processed before the
next slot comes, so a run's watermark, and with it the set of late rows, depends on the data alone.  A stream whose result
does not hang on where deliveries end may take several slots in one, so that a longer time costs larger deliveries and not
more of them.  After a slot the
watermark is the latest event time seen so far less the delay; a row whose window ends at or before it is dropped, and
windows, sessions and remembered ids that it has passed leave the state.  Results go to file sinks: windowed results
when their window is closed, tables that take each key once through ``append_once``, whose folder per batch is written
again when a batch is replayed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of one delivery slot (five days), and the delay that watermarks allow.
SLOT_MICROS, DELAY = 5 * 86_400_000_000, "10 minutes"
SESSION_GAP = "30 minutes"
#: Deliveries (and micro-batches) that a backlog is taken in where their ends are free.
DELIVERIES = 12


def delivered(rows: DataFrame, arrival: Column) -> DataFrame:
    """``rows`` with the ``slot`` of their arrival."""
    return rows.withColumn("slot", (F.unix_micros(arrival) / F.lit(SLOT_MICROS)).cast("long"))


def slot_ranges(inputs: dict[str, DataFrame], most: int | None = None) -> list[tuple[int, int]]:
    """First and last slot of every delivery: each slot by itself, or ``most`` runs of slots at most with about as many rows.

    Only slots that have rows begin or end a run; with ``most`` no more than so many numbers reach the driver.
    """
    slots = reduce(DataFrame.unionByName, [rows.select("slot") for rows in inputs.values()])
    if most is None:
        return [(r.slot, r.slot) for r in slots.distinct().orderBy("slot").collect()]
    r = slots.agg(F.min("slot").alias("lo"), F.percentile_approx("slot", [(i + 1) / most for i in range(most)]).alias("ends"),
                  F.max("slot").alias("hi")).first()
    if r.lo is None:
        return []
    ends = sorted({*r.ends, r.hi})
    return list(zip([r.lo] + [e + 1 for e in ends[:-1]], ends))


def feed(inputs: dict[str, DataFrame], start: Callable, stop_after: int | None = None, most: int | None = None) -> list[int]:
    """Deliver ``inputs`` (folder -> rows with ``slot``) slot by slot to the query that ``start()`` returns.

    Returns the last slot of each delivery; ``stop_after`` of them at most.  The number of slots depends on the time that
    the rows span, not on how many there are; ``most`` bounds the number of deliveries, each of whole slots in order.
    """
    ranges = slot_ranges(inputs, most)[:stop_after]
    query = None
    try:
        for first, last in ranges:
            for folder, rows in inputs.items():
                rows.where(F.col("slot").between(first, last)).drop("slot").write.mode("append").parquet(folder)
            query = query or start()
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    return [last for _, last in ranges]


def read_stream(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """The folder as a stream of the columns of ``rows``."""
    return spark.readStream.schema(rows.drop("slot").schema).parquet(folder)


# ---------------------------------------------------------------- windows

def tumbling(stream: DataFrame, ts: str = "ts", size: str = "5 minutes", by: str = "route", slide: str | None = None) -> DataFrame:
    """Rows per event-time window; with ``slide`` the windows overlap."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (stream.withWatermark(ts, DELAY).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), by, "n"))


def sessions(stream: DataFrame, ts: str = "ts", gap: str = SESSION_GAP, by: str = "card_id") -> DataFrame:
    """Rows per session of a card: a session ends when nothing came for ``gap``."""
    return (stream.withWatermark(ts, DELAY).groupBy(F.session_window(ts, gap).alias("w"), by)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n"))


def to_files(result: DataFrame, out: str, checkpoint: str):
    """Append ``result`` to Parquet files; each row is committed once."""
    return (result.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).start())


# ---------------------------------------------------------------- each key once

def dedup_within(stream: DataFrame, key: str, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """The first copy of an id; ids stay in the state as long as the watermark has not passed them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_once(batch: DataFrame, batch_id: int, out: str, key: str) -> None:
    """A12 on a stream: rows of the batch whose key no earlier batch wrote, one copy of each (the smallest whole row).

    The batch has a folder of its own, which a replay overwrites, so neither a replay nor a redelivery adds a row.
    """
    spark = batch.sparkSession
    others = [c for c in batch.columns if c != key]
    fresh = batch.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, "_r.*").select(*batch.columns)
    if batch_id > 0:
        earlier = spark.read.schema(batch.schema.add("batch", "long")).parquet(out).where(F.col("batch") < batch_id)
        fresh = fresh.join(earlier.select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def once_to_files(result: DataFrame, out: str, checkpoint: str, key: str):
    return (result.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda b, i: append_once(b, i, out, key)).start())


def alert_log(alerts: DataFrame, blocks: DataFrame, key: str = "transaction_id", ts: str = "ts") -> DataFrame:
    """Two topics as one log; the topic gives the decision; the slower topic holds the common watermark."""
    return dedup_within(alerts.withColumn("decision", F.lit("FLAG"))
                        .unionByName(blocks.withColumn("decision", F.lit("BLOCK"))), key, ts)


def policy_stream(messages: DataFrame, scored: DataFrame, policy: DataFrame) -> DataFrame:
    """Every message with its looked-up score (H12) and the policy's action for its state cell.

    ``scored`` is a stored table with one row an id; ``policy`` has one row a cell (10 deciles x segments x 2 risks at
    most), so it goes to every task.  An id without a score gives no row, a cell without experience no action.
    """
    from ringwise.operators.policy import state_cell
    cells = [c.alias(f"_{n}") for c, n in zip(state_cell(risk="graph_risk"), ("p_decile", "segment", "risk_high"))]
    rows = messages.join(scored, "transaction_id").select("*", *cells)
    table = policy.select(*[F.col(c).alias(f"_{c}") for c in ("p_decile", "segment", "risk_high")], F.col("best_action").alias("policy_action"))
    return rows.join(F.broadcast(table), ["_p_decile", "_segment", "_risk_high"], "left").drop("_p_decile", "_segment", "_risk_high")


# ---------------------------------------------------------------- progress

def complete_to_files(result: DataFrame, out: str, checkpoint: str):
    """The whole result of every batch in a folder of its own (complete mode)."""
    return (result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start())


def committed(spark: SparkSession, checkpoint: str) -> int:
    """The last batch a query has committed; -1 before the first."""
    try:
        files = spark.read.text(f"{checkpoint}/commits").select(F.input_file_name().alias("f")).distinct()
        last = files.agg(F.max(F.element_at(F.split("f", "/"), -1).try_cast("int"))).first()[0]
    except Exception as e:  # a query without a commit has no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return -1 if last is None else last


def lag(arrived: DataFrame, out: str, checkpoint: str, key: str, by: str = "slot") -> DataFrame:
    """Rows that have arrived but are in no committed batch of the sink, counted by ``by``."""
    spark = arrived.sparkSession
    last = committed(spark, checkpoint)
    if last < 0:
        waiting = arrived
    else:
        done = spark.read.parquet(out).where(F.col("batch") <= last).select(key)
        waiting = arrived.join(done, key, "left_anti")
    return waiting.groupBy(by).agg(F.count(F.lit(1)).alias("waiting"))


# ---------------------------------------------------------------- latency sketches

def latency_sketches(req: DataFrame, size: int = 400) -> DataFrame:
    """Per minute and route a mergeable quantile sketch of the durations: bounded state whatever the rate."""
    return (req.where("duration_ms is not null").groupBy(F.window("ts", "1 minute").start.alias("minute"), "route")
            .agg(F.kll_sketch_agg_double("duration_ms", F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n")))


def latency_windows(sketches: DataFrame, minutes: int = 5, size: int = 400) -> DataFrame:
    """p50 / p95 / p99 of sliding windows of whole minutes, per route and over all routes, from the minutes' sketches.

    A window's buffer is one sketch; a quantile's rank is off by about ``1.7 / size`` at most.
    """
    panels = sketches.withColumn("route", F.explode(F.array("route", F.lit(ALL_ROUTES))))
    spread = panels.withColumn("window_start", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(minutes - 1)), lambda k: F.col("minute") - F.make_interval(mins=k))))
    q = spread.groupBy("window_start", "route").agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("s"), F.sum("n").alias("n"))
    return q.select("window_start", "route", "n",
                    *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(c) for p, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


ALL_ROUTES = "(all)"
