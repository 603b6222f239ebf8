"""Sources, sinks and merges.

Files are read with declared schemas (no inference).  Merges are plans of
``ringwise.sources.merge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwise.sources.merge import fold, merge

INT_TYPES = (("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647))


def ingest(spark: SparkSession, txn_path: str, id_path: str, txn_schema: T.StructType, id_schema: T.StructType,
           out: str | None = None) -> DataFrame:
    """A1: two CSVs with headers, left-joined on ``TransactionID``; optionally written as Parquet."""
    t = spark.read.schema(txn_schema).option("header", True).csv(txn_path)
    i = spark.read.schema(id_schema).option("header", True).csv(id_path)
    joined = t.join(i, "TransactionID", "left")
    if out:
        joined.write.mode("overwrite").parquet(out)
        return spark.read.parquet(out)
    return joined


def narrow_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: per numeric column the smallest integer type whose limits strictly contain min and max
    (bigint otherwise); any floating column -> float.  One aggregation over all columns."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))
           and (cols is None or f.name in cols)]
    kinds = {f.name: ("float" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else "int")
             for f in df.schema.fields}
    aggs = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"),
                     F.max(c).cast("double").alias("max"), F.lit(kinds[c]).alias("kind")) for c in num]
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    t = F.lit("bigint")
    for name, lo, hi in reversed(INT_TYPES):
        t = F.when((F.col("min") > lo) & (F.col("max") < hi), F.lit(name)).otherwise(t)
    return rows.withColumn("narrow_type", F.when(F.col("kind") == "float", F.lit("float")).otherwise(t)).drop("kind")


def cast_narrow(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2 applied: every numeric column in the type that ``narrow_types`` names (one row a column reaches the driver)."""
    kinds = {r["column"]: r["narrow_type"] for r in narrow_types(df, cols).collect()}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def read_features(spark: SparkSession, path: str, first: int | None = None, order: str = "TransactionID") -> DataFrame:
    """A3: the feature Parquet, or its ``first`` so many rows in ``order``."""
    df = spark.read.parquet(path)
    return df if first is None else df.orderBy(order).limit(first)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A4: edge CSV with ids as text (blank -> null) and ``is_fraud`` from true / 1 / yes."""
    schema = ("transaction_id long, card_id string, device_id string, email_id string, addr_id string, "
              "is_fraud string, amount double, transaction_hour int")
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select("transaction_id", "card_id",
                      *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("device_id", "email_id", "addr_id")],
                      F.lower(F.trim("is_fraud")).isin("true", "1", "yes").alias("is_fraud"),
                      "amount", "transaction_hour")


def write_csv(df: DataFrame, path: str) -> None:
    """A5: node / edge tables as CSV with a header; nulls written as blanks."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Query results as JSON lines."""
    df.write.mode("overwrite").json(path)


def ring_report(dev: DataFrame, email: DataFrame, addr: DataFrame, found: DataFrame, total_fraud: int,
                base_recall: float, k: int = 10) -> DataFrame:
    """Report lines - counts, recall impact and the top-``k`` of each ring table, in order."""
    def top(df, kind, key):
        w = Window.orderBy(F.desc("fraud_card_count"), F.desc("card_count"), key)
        return (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
                .select(F.lit(kind).alias("section"), F.col("_rn").alias("pos"),
                        F.format_string("%d. %s: %d cards, %d fraud cards", F.col("_rn"), F.col(key),
                                        F.col("card_count"), F.col("fraud_card_count")).alias("line")))
    n = found.agg(F.count(F.lit(1)).alias("n"))
    head = n.select(F.lit("summary").alias("section"), F.lit(0).alias("pos"),
                    F.format_string("Missed frauds inside rings: %d of %d; recall %.4f -> %.4f", F.col("n"),
                                    F.lit(total_fraud), F.lit(base_recall),
                                    F.lit(base_recall) + F.col("n") / F.lit(float(total_fraud))).alias("line"))
    return (head.unionByName(top(dev, "device", "device")).unionByName(top(email, "email", "email_domain"))
            .unionByName(top(addr, "address", "address")))


def upsert(target: DataFrame, batch: DataFrame, key: str, replace: list[str], keep_if_null: list[str] = (),
           order: str = "created_at") -> DataFrame:
    """A10: ``replace`` fields take the batch's last value, ``keep_if_null`` fields its last non-null one where there is
    one; new keys are inserted with all their columns."""
    return merge(target, batch, key, [order], replace, keep_if_null)


def fill_label(target: DataFrame, batch: DataFrame, key: str = "transaction_id", label: str = "is_fraud_label",
               order: str | None = None, insert: bool = False) -> DataFrame:
    """Only the label is touched, by the latest one that is known; ``insert`` adds keys that are new."""
    return merge(target, batch, key, [order] if order else [], fill=[label], insert=insert)


def insert_absent(target: DataFrame, batch: DataFrame, key: str = "transaction_id", order: str | None = None) -> DataFrame:
    """Insert rows whose key is not present yet (the first copy in ``order``, ties by the whole row)."""
    fresh = fold(batch.select(*target.columns), key, [order] if order else []).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def backfill(target: DataFrame, labels: DataFrame, key: str, label: str, order: str | None = None) -> DataFrame:
    """The latest known label of an id replaces the one that its row has; ids without a row are ignored."""
    return merge(target, labels, key, [order] if order else [], fill=[label], insert=False)


def upsert_embedding(target: DataFrame, batch: DataFrame, key: str = "transaction_id", order: str = "created_at") -> DataFrame:
    """L2: ``batch(key, embedding, is_fraud_label, decision, order)``: the first vector of an id stays, its label is the
    last row's known label, else whether that row was blocked."""
    truth = F.coalesce("is_fraud_label", F.col("decision") == "BLOCK")
    return merge(target, batch.select(key, "embedding", truth.alias("is_fraud"), order), key, [order], replace=["is_fraud"])
