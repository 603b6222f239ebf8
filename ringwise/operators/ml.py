"""Model training and scoring (H1-H3, H8, H9) and the federated average (J8), re-aimed to pyspark.ml.

The reference trains a boosted-tree library in one process and explains rows
with tree SHAP; here training is ``pyspark.ml`` (distributed), the class
weight is one aggregation, and per-row attributions come from a logistic
model as ``w * (x - mean)`` - linear, exact and computed in the JVM.

Each category column is hashed into slots of its own, so a column may have
any number of categories, and every slot belongs to one column: importances
and attributions of a column are the sums over its slots.  Slots that no training row fills tell nothing (no tree can split
there, a regression gives them 0) and are left out of the vector: training keeps a number for every entry of every row.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler, VectorSlicer
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwise.functions.params import scalar_row
from ringwise.session import stored

GRAPH_FEATURES = ("device_fraud_rate", "device_card_velocity", "connected_fraud_cards",
                  "email_fraud_rate", "address_fraud_rate", "graph_risk_score")
#: Slots that each category column is hashed into.
SLOTS = 64
#: Rows of the training table in a task.
TASK_ROWS = 50_000


def dealt(df: DataFrame, key: str = "TransactionID", rows: int = TASK_ROWS) -> DataFrame:
    """``df`` stored once, read in partitions of about ``rows`` rows by a hash of ``key``.

    Training keeps a row as one number per feature whatever its size on disk, so partitions that Spark cuts by bytes would
    grow to gigabytes in a task's memory; and every round of training, scoring or averaging would compute ``df`` again.
    """
    whole = stored(df)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartition(max(tasks, -(-whole.count() // rows)), key)


def class_weight(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """H2: negatives / max(1, positives), as a ``weight`` column (1 for negatives)."""
    st = scalar_row(df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")))
    w = st["neg"].cast("double") / F.greatest(st["pos"], F.lit(1)).cast("double")
    return df.withColumn("weight", F.when(F.col(label) == 1, w).otherwise(1.0))


def train(df: DataFrame, num_cols: list[str], cat_cols: list[str], label: str = "isFraud", model: str = "gbt",
          max_iter: int = 20, max_depth: int = 4, seed: int = 7, slots: int = SLOTS):
    """H1: fit ``FeatureHasher`` per category column, ``VectorAssembler``, ``VectorSlicer``, classifier with class weights.

    The vector holds the numeric columns in order, then of each category column those of its ``slots`` entries (1 at the
    slot that its value hashes to) that some row fills.  Any number of categories trains; those that share a slot are not
    told apart.  The vectors are made once, and kept on the executors' disks while every pass of the fit reads them.
    """
    hashers = [FeatureHasher(inputCols=[c], outputCol=f"{c}_slots", categoricalCols=[c], numFeatures=slots) for c in cat_cols]
    vec = VectorAssembler(inputCols=list(num_cols) + [f"{c}_slots" for c in cat_cols], outputCol="slots",
                          handleInvalid="keep")
    if model == "gbt":
        clf = GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=max_iter,
                            maxDepth=max_depth, stepSize=0.1, seed=seed)
    else:
        clf = LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=max_iter,
                                 regParam=0.01, standardization=True)
    weighted = class_weight(df, label)
    head = Pipeline(stages=hashers + [vec]).fit(weighted)
    rows = head.transform(weighted).select(label, "weight", "slots").persist(StorageLevel.DISK_ONLY)
    try:
        filled = rows.agg(Summarizer.numNonZeros(F.col("slots")).alias("n")).first()["n"]  # one number per entry
        kept = [i for i, n in enumerate(filled or [1] * (len(num_cols) + slots * len(cat_cols))) if i < len(num_cols) or n]
        slicer = VectorSlicer(inputCol="slots", outputCol="features", indices=kept)
        return PipelineModel([*head.stages, slicer, clf.fit(slicer.transform(rows).drop("slots"))])
    finally:
        rows.unpersist()


def column_spans(model) -> list[tuple[str, int, int]]:
    """``(column, first, end)`` of every input column in the feature vector of a fitted pipeline."""
    *hashers, vec, slicer, _ = model.stages
    slots = {h.getOutputCol(): (h.getInputCols()[0], h.getNumFeatures()) for h in hashers}
    kept, spans, at = slicer.getIndices(), [], 0
    for c in vec.getInputCols():
        name, width = slots.get(c, (c, 1))
        spans.append((name, bisect_left(kept, at), bisect_left(kept, at + width)))
        at += width
    return spans


def score(model, df: DataFrame) -> DataFrame:
    """H3: probability of the positive class per row."""
    out = model.transform(df)
    return out.withColumn("model_probability", vector_to_array("probability")[1]).select(*df.columns, "model_probability")


def importances(model, keep=GRAPH_FEATURES) -> DataFrame:
    """H9: tree feature importances per input column (the six graph features by default, all with ``keep=None``)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(imp[lo:hi].sum())) for n, lo, hi in column_spans(model) if not keep or n in keep]
    return spark.createDataFrame(rows, "feature string, importance double")


def attributions(model, df: DataFrame, k: int = 10, id_col: str = "TransactionID") -> DataFrame:
    """H8: per row the top-``k`` linear attributions ``sum of w_j * (x_j - mean_j)`` of a column by absolute value.

    The means are one aggregation; the rest stays inside the row: the attributions of all columns are an array, sorted
    and cut there (ties by name), so nothing is exploded before the cut and nothing is shuffled.  No rows give no rows.
    """
    w = [float(x) for x in model.stages[-1].coefficients.toArray()]
    feats = model.transform(df).select(id_col, "features")
    if feats.isEmpty():
        return df.sparkSession.createDataFrame([], f"{id_col} long, feature string, attribution double, rank int")
    centre = [float(v) for v in feats.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]]  # one number per feature
    x = F.col("x")

    def attribution(lo: int, hi: int) -> Column:
        if hi == lo:
            return F.lit(0.0)
        if hi - lo == 1:
            return w[lo] * (x[lo] - centre[lo])
        weights = F.array(*[F.lit(v) for v in w[lo:hi]])
        at_mean = sum(a * b for a, b in zip(w[lo:hi], centre[lo:hi]))
        return F.aggregate(F.zip_with(F.slice(x, lo + 1, hi - lo), weights, lambda a, b: a * b), F.lit(0.0),
                           lambda t, v: t + v) - at_mean

    every = F.array(*[F.struct((-F.abs(a)).alias("order"), F.lit(n).alias("feature"), a.alias("attribution"))
                      for n, a in ((n, attribution(lo, hi)) for n, lo, hi in column_spans(model))])
    top = F.slice(F.array_sort(every), 1, k)
    return (feats.select(id_col, vector_to_array("features").alias("x")).select(id_col, F.posexplode(top).alias("_r", "_a"))
            .select(id_col, "_a.feature", "_a.attribution", (F.col("_r") + 1).alias("rank")))


def fed_avg(df: DataFrame, feature_cols: list[str], label: str = "isFraud", parts: int = 5, rounds: int = 3,
            lr: float = 0.1, epochs: int = 5, id_col: str = "TransactionID") -> DataFrame:
    """Federated averaging.  Every part (id mod ``parts``) runs ``epochs`` full-batch logistic gradient
    steps from the current global weights, then the global weights become the row-weighted mean of the
    parts' weights; ``rounds`` times.

    Each local step is one distributed aggregation (``groupBy(part)`` sums of the gradient, partially
    aggregated), so no part is ever gathered into one task; only the weight vectors - one per part,
    length = number of features - reach the driver.  Returns one row per round with the global weights.
    """
    import numpy as np

    d = len(feature_cols)
    data = df.select(F.pmod(F.col(id_col), F.lit(parts)).alias("part"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_cols],
                     F.col(label).cast("double").alias("y"))
    # standardise with global statistics (one aggregation) so the steps are well conditioned
    st = scalar_row(data.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(feature_cols)],
                             *[F.stddev(c).alias(f"s{i}") for i, c in enumerate(feature_cols)]))
    data = data.select("part", "y", *[((F.col(c) - st[f"m{i}"]) / F.greatest(F.coalesce(st[f"s{i}"], F.lit(1.0)),
                                                                              F.lit(1e-9))).alias(f"x{i}")
                                      for i, c in enumerate(feature_cols)]).cache()
    xs = [F.col(f"x{i}") for i in range(d)]
    global_w = np.zeros(d + 1)
    history = []
    try:
        for r in range(rounds):
            local = {p: global_w.copy() for p in range(parts)}
            n_rows = {p: 0 for p in range(parts)}
            for _ in range(epochs):
                wmap = F.create_map(*[x for p, w in local.items()
                                      for x in (F.lit(p), F.array(*[F.lit(float(v)) for v in w]))])
                wp = wmap[F.col("part")]
                z = wp[0]
                for i, x in enumerate(xs):
                    z = z + wp[i + 1] * x
                err = 1.0 / (1.0 + F.exp(-z)) - F.col("y")
                grads = data.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(err).alias("g0"),
                                                 *[F.sum(err * x).alias(f"g{i + 1}") for i, x in enumerate(xs)])
                for row in grads.collect():  # one row per part: the gradient vector, bounded by the schema
                    p, n = int(row["part"]), int(row["n"])
                    g = np.array([row[f"g{j}"] for j in range(d + 1)])
                    local[p] = local[p] - lr * g / max(1, n)
                    n_rows[p] = n
            total = max(1, sum(n_rows.values()))
            global_w = sum(n_rows[p] * local[p] for p in local) / total
            history.append((r + 1, [float(v) for v in global_w]))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(history, "round int, weights array<double>")
