"""Hand-made tables for the quirks: ring type none, risk steps, bins, hot node plan equality."""

import pytest
from pyspark.sql import functions as F

from ringwise.functions.decisions import confidence, decide, ring_type, risk_step
from ringwise.operators.evaluate import bucket
from ringwise.plans.shared_links import other_fraud_counts, other_fraud_counts_naive


def test_ring_type_and_risk(spark):
    rows = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 2, 0), (0, 0, 5)]
    df = spark.createDataFrame(rows, "d int, e int, a int")
    out = df.select(ring_type("d", "e", "a").alias("t"), risk_step(F.col("d") + F.col("e") + F.col("a")).alias("r"),
                    ((F.col("d") + F.col("e") + F.col("a")) >= 2).alias("ring")).collect()
    assert [r.t for r in out] == ["none", "none", "none", "device", "multiple", "address"]
    assert [r.r for r in out] == [0.0, 0.3, 0.5, 0.5, 0.7, 0.9]
    assert out[2].ring is True and out[2].t == "none"   # (1,1,0): in a ring with type none


def test_decision_and_confidence(spark):
    df = spark.createDataFrame([(0.9, 0.72, 0.0, False), (0.3, 0.72, 0.6, False), (0.3, 0.72, 0.0, True),
                                (0.1, 0.72, 0.9, True)], "p double, t double, r double, ring boolean")
    out = df.select(decide("p", "t", "r", "ring").alias("d")).withColumn("c", confidence(F.lit(0.3), "d")).collect()
    assert [r.d for r in out] == ["BLOCK", "FLAG", "FLAG", "APPROVE"]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(0.05,), (0.29,), (0.57,), (0.95,), (1.0,)], "p double")
    got = [r.b for r in df.select(bucket("p").alias("b")).collect()]
    assert got == [5, 29, 57, 95, 100]
    # every 4-decimal score lands in the bucket that p >= i/100 defines
    grid = spark.range(0, 10001).select((F.col("id") / 10000.0).alias("p"))
    bad = grid.where(~((F.col("p") >= bucket("p") / 100.0) & ((bucket("p") == 100) | (F.col("p") < (bucket("p") + 1) / 100.0))))
    assert bad.count() == 0


def test_hot_node_plan_equals_naive(spark):
    # one email with 200 cards (every third is fraud), card c7 also on a second email, plus devices
    rows = [(f"c{i}", "email", "hot") for i in range(200)] + [("c7", "email", "other"), ("x1", "email", "other"),
                                                               ("x2", "email", "other")]
    rows += [(f"c{i}", "device", f"d{i % 7}") for i in range(0, 200, 3)]
    edges = spark.createDataFrame(rows, "card_id string, node_type string, node_id string").distinct()
    fraud = spark.createDataFrame([(f"c{i}",) for i in range(0, 200, 3)] + [("x1",)], "card_id string")
    a = {(r.card_id, r.node_type): r.n_fraud for r in other_fraud_counts(edges, fraud).collect()}
    b = {(r.card_id, r.node_type): r.n_fraud for r in other_fraud_counts_naive(edges, fraud).collect()}
    for k, v in a.items():
        assert v == b.get(k, 0), k
    assert all(a.get(k) == v for k, v in b.items())


@pytest.mark.parametrize("max_nodes", [12, 2])
def test_two_hot_nodes_and_a_wide_card(spark, max_nodes):
    # two hot nodes that share cards, a card on both and on a cold one, and cards of very many nodes, one of them fraud
    rows = [(f"c{i}", "address", "hot1") for i in range(150)] + [(f"c{i}", "address", "hot2") for i in range(100, 250)]
    rows += [("c120", "address", "cold"), ("y", "address", "cold"), ("lone", "address", "nobody")]
    rows += [(w, "address", f"n{i}") for w in ("wide1", "wide2") for i in range(40)] + [("wide1", "address", "hot1")]
    rows += [(f"z{i}", "address", f"n{i}") for i in range(0, 40, 5)]
    edges = spark.createDataFrame(rows, "card_id string, node_type string, node_id string").distinct()
    ids = [f"c{i}" for i in range(0, 250, 4)] + ["y", "wide1", "z0", "z5", "elsewhere"]
    fraud = spark.createDataFrame([(i,) for i in ids], "card_id string")
    a = {r.card_id: r.n_fraud for r in other_fraud_counts(edges, fraud, max_nodes).collect()}
    b = {r.card_id: r.n_fraud for r in other_fraud_counts_naive(edges, fraud).collect()}
    assert len(a) == len({r[0] for r in rows})
    assert {k: v for k, v in a.items() if v} == b


def test_threshold_override_and_reset():
    from ringwise.operators.evaluate import thresholds_in_force
    defaults = {"VIP": 0.72, "Regular": 0.88}
    assert thresholds_in_force(defaults) == defaults
    assert thresholds_in_force(defaults, 0.123456) == {"VIP": 0.1235, "Regular": 0.1235}
    with pytest.raises(ValueError):
        thresholds_in_force(defaults, 1.2)


def test_legacy_keys_fall_back_to_the_other_address_column(spark):
    from ringwise.functions.keys import legacy_node_ids
    cols = "TransactionID long, isFraud int, card1 int, card2 double, card3 double, DeviceType string, DeviceInfo string, " \
           "P_emaildomain string, R_emaildomain string, {}"
    row = (1, 0, 1, 2.0, 3.0, None, "x", "a", None)
    old = legacy_node_ids(spark.createDataFrame([(*row, -5.0), (*row, None)], cols.format("id_01 double")))
    assert [r.ip_id for r in old.collect()] == ["-5.0", "None"]
    both = legacy_node_ids(spark.createDataFrame([(*row, "found", -5.0)], cols.format("id_15 string, id_01 double")))
    assert both.first().ip_id == "found"
