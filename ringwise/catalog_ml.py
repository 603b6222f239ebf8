"""Registered ML and synthetic-data queries (H1-H3, H8, H9, J8, M1-M10); rows-only except M9 counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringwise.catalog import register, txn
from ringwise.checks.oracle import with_base
from ringwise.operators import augment, evaluate as ev, ml, prep
from ringwise.operators.features import build_features
from ringwise.operators.graph_features import attach, build_graph_features
from ringwise.session import stored

NUM = ["TransactionAmt", "D1", "D15", "C1", "C14", "dist1", "dist2", "addr1", "addr2", "uid_count",
       *ml.GRAPH_FEATURES]
CAT = ["ProductCD", "card4", "card6", "P_emaildomain", "DeviceType"]
#: What features, cards and links are made of, besides the columns above.
BASE = ["TransactionID", "isFraud", "Transaction_Hour", "card1", "card2", "card3", "DeviceInfo"]


def _train_frame(spark, sf):
    """B6-prepared training table: missing numbers 0.0, missing categories ``None``."""
    from ringwise.operators.features import upstream
    from ringwise.operators.prep import prepare
    t = stored(txn(spark, sf).select(*BASE, *[c for c in NUM + CAT if c not in ml.GRAPH_FEATURES]))
    # the graph is made of the plain columns: none of its tables needs the joins of the features
    return ml.dealt(prepare(attach(upstream(t), build_graph_features(t)), NUM, CAT, keep=("TransactionID", "isFraud")))


def _model(spark, sf, kind="gbt"):
    """The training table in halves by B8 and a model that saw the train side only."""
    df = prep.holdout(_train_frame(spark, sf))
    return df, ml.train(df.where(F.col("split") == "train"), NUM, CAT, model=kind, max_iter=10 if kind == "gbt" else 50)


@register("h2_class_weight", with_base("""
SELECT isFraud, CASE WHEN isFraud = 1 THEN CAST(count_if(isFraud = 0) OVER () AS DOUBLE)
  / CAST(greatest(count_if(isFraud = 1) OVER (), 1) AS DOUBLE) ELSE 1.0 END AS weight, count(*) OVER (PARTITION BY isFraud) AS n
FROM transactions QUALIFY row_number() OVER (PARTITION BY isFraud ORDER BY TransactionID) = 1"""))
def q_h2(spark, sf):
    w = ml.class_weight(txn(spark, sf))
    return w.groupBy("isFraud").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


@register("h3_score")
def q_h3(spark, sf):
    """Every transaction scored; ``split`` tells whether the model was trained on it."""
    df, model = _model(spark, sf)
    return ml.score(model, df).select("TransactionID", "isFraud", "split", "model_probability")


@register("h1_holdout_metrics")
def q_h1(spark, sf):
    """H1: figures of the trained model on the rows that it did not see (I2, I3 at a probability of 0.5), and on the others."""
    df, model = _model(spark, sf)
    # written once: both figures read it, and scoring is the costly part
    s = stored(ml.score(model, df).select("split", F.col("isFraud").alias("y"), F.col("model_probability").alias("p")))
    conf = ev.confusion(s.withColumn("yhat", (F.col("p") >= 0.5).cast("int")), by=["split"])
    return ev.metrics(conf).join(ev.auc(s, by=["split"]).select("split", "auc"), "split")


@register("h9_importances")
def q_h9(spark, sf):
    return ml.importances(_model(spark, sf)[1], keep=None)


@register("h8_attributions")
def q_h8(spark, sf):
    df, model = _model(spark, sf, "lr")
    return ml.attributions(model, df, k=10)


@register("j8_fed_avg")
def q_j8(spark, sf):
    return ml.fed_avg(_train_frame(spark, sf), ["TransactionAmt", "D1", "D15", "C1", *ml.GRAPH_FEATURES])


@register("m1_noise")
def q_m1(spark, sf):
    return augment.noise(txn(spark, sf), ["TransactionAmt", "D1", "D15", "C1", "C14"], 0.05, seed=1)


@register("m2_variants")
def q_m2(spark, sf):
    return augment.variants(txn(spark, sf), n=200, seed=2)


@register("m8_synthesise")
def q_m8(spark, sf):
    return augment.synthesise(txn(spark, sf), n=500, seed=3)


@register("m9_mix", with_base("""
SELECT synthetic, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS frauds FROM (
  SELECT false AS synthetic, isFraud FROM transactions UNION ALL
  SELECT true, 1 FROM range(0, (SELECT greatest(1, CAST(floor(0.2 * count(*)) AS BIGINT)) FROM transactions))) x
GROUP BY synthetic"""))
def q_m9(spark, sf):
    m = augment.mix(txn(spark, sf), 0.2, seed=4)
    return m.groupBy("synthetic").agg(F.count(F.lit(1)).alias("n"), F.sum("isFraud").cast("long").alias("frauds"))


@register("m10_pattern_counts")
def q_m10(spark, sf):
    return augment.pattern_counts(augment.synthesise(txn(spark, sf), n=500, seed=3))


@register("c6_full_feature_table")
def q_c6b(spark, sf):
    """C6 with the graph columns attached (the v4 training table)."""
    t = txn(spark, sf)
    return build_features(t).join(attach(t, build_graph_features(t)).select("TransactionID", *ml.GRAPH_FEATURES),
                                  "TransactionID")
