"""Training on hashed categories, holdout figures and attributions."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from ringwise import catalog_ml
from ringwise.catalog import txn
from ringwise.operators import evaluate as ev, ml, prep
from ringwise.operators.features import upstream
from ringwise.operators.graph_features import attach, build_graph_features


@pytest.fixture(scope="module")
def rows(spark):
    """60 domains of which every fourth is mostly fraud, one numeric column that tells nothing, one that helps a little."""
    h = F.pmod(F.xxhash64("TransactionID"), F.lit(100))
    return (spark.range(6000).select(F.col("id").alias("TransactionID"), F.concat(F.lit("d"), F.col("id") % 60).alias("domain"),
                                     F.pmod(F.col("id") * 7919, F.lit(101)).cast("double").alias("noise"))
            .withColumn("isFraud", F.when(F.substring("domain", 2, 3).cast("int") % 4 == 0, h < 90).otherwise(h < 5).cast("int"))
            .withColumn("hint", F.col("isFraud") + h / 40.0))


@pytest.mark.parametrize("kind", ["gbt", "lr"])
def test_sixty_domains_train_and_hold_out(spark, rows, kind):
    df = prep.holdout(rows)
    model = ml.train(df.where("split = 'train'"), ["noise"], ["domain"], model=kind, max_iter=10, slots=1024)
    s = ml.score(model, df.where("split = 'test'"))
    assert s.count() == df.where("split = 'test'").count()
    fig = ev.auc(s, y="isFraud", p="model_probability").first()
    assert fig.auc > (0.9 if kind == "lr" else 0.75)


def test_importances_sum_over_a_columns_slots(rows):
    model = ml.train(rows, ["noise", "hint"], ["domain"], max_iter=4)
    got = {r.feature: r.importance for r in ml.importances(model, keep=None).collect()}
    assert set(got) == {"noise", "hint", "domain"} and sum(got.values()) == pytest.approx(1.0)
    assert got["domain"] > got["noise"]


def test_attributions_are_whole_and_stay_in_the_row(spark, rows):
    small = rows.where("TransactionID < 300")
    model = ml.train(small, ["noise", "hint"], ["domain"], model="lr", max_iter=20)
    out = ml.attributions(model, small, k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.TransactionID, []).append(r)
    assert len(got) == 300 and all([x.rank for x in v] == [1, 2, 3] for v in got.values())
    lr = model.stages[-1]
    w = lr.coefficients.toArray()
    feats = {r.TransactionID: r.features.toArray() for r in model.transform(small).collect()}
    mean = sum(feats.values()) / len(feats)
    for tid, v in list(got.items())[:20]:
        parts = w * (feats[tid] - mean)
        want = {n: parts[lo:hi].sum() for n, lo, hi in ml.column_spans(model)}
        assert {x.feature: pytest.approx(x.attribution, abs=1e-9) for x in v} == want
        assert [abs(x.attribution) for x in v] == sorted((abs(x.attribution) for x in v), reverse=True)


def test_attributions_of_no_rows(rows):
    model = ml.train(rows.where("TransactionID < 300"), ["noise", "hint"], ["domain"], model="lr", max_iter=2)
    assert ml.attributions(model, rows.where("TransactionID < 0")).count() == 0


def test_training_tasks_hold_a_bounded_number_of_rows(spark, rows):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        parts = [c for c in ml.dealt(rows, rows=300).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(parts) == 6000 and len(parts) == 20 and max(parts) < 450


@pytest.mark.parametrize("kind", ["gbt", "lr"])
def test_empty_slots_are_left_out_and_change_nothing(rows, kind):
    one = rows.where("TransactionID < 2000").coalesce(1).sortWithinPartitions("TransactionID")
    num, cat = ["noise", "hint"], ["domain"]
    model = ml.train(one, num, cat, model=kind, max_iter=5, slots=256)
    size = len(model.transform(one).first().features)
    assert len(num) < size <= len(num) + 60  # 60 domains; the vector of before had 258 entries
    assert ml.column_spans(model) == [("noise", 0, 1), ("hint", 1, 2), ("domain", 2, size)]
    *hashers, vec, _, _ = model.stages
    every = Pipeline(stages=[*hashers, vec]).fit(one).transform(ml.class_weight(one)).withColumnRenamed("slots", "features")
    clf = (GBTClassifier(labelCol="isFraud", weightCol="weight", maxIter=5, maxDepth=4, stepSize=0.1, seed=7) if kind == "gbt" else
           LogisticRegression(labelCol="isFraud", weightCol="weight", maxIter=5, regParam=0.01, standardization=True))
    whole = {r.TransactionID: r.probability[1] for r in clf.fit(every).transform(every).collect()}
    got = {r.TransactionID: r.model_probability for r in ml.score(model, one).collect()}
    assert got == pytest.approx(whole, abs=1e-9)
    # a category that no training row had fills no slot of its own
    odd = one.limit(3).withColumn("domain", F.lit("never seen"))
    assert ml.score(model, odd).count() == 3


def test_vectors_are_made_once_and_let_go(spark, rows, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    def count(x):
        made.add(1)
        return x
    counted = rows.where("TransactionID < 500").withColumn("hint", F.udf(count, "double").asNondeterministic()("hint")).select(
        "TransactionID", "domain", "noise", "isFraud", "hint")
    ml.train(counted, ["noise", "hint"], ["domain"], max_iter=2)
    assert made.value <= 1000  # the vectors, and at most once more for the class weights; every pass of the fit before
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_the_graph_of_the_training_table_needs_no_feature_joins(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog_ml, "build_graph_features", lambda t: (seen.append(t), build_graph_features(t))[1])
    out = catalog_ml._train_frame(spark, "/root/testdata/sf0.001")
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    t = upstream(txn(spark, "/root/testdata/sf0.001"))
    want = prep.prepare(attach(t, build_graph_features(t)), catalog_ml.NUM, catalog_ml.CAT, keep=("TransactionID", "isFraud"))
    assert sorted(out.collect()) == sorted(want.collect())
