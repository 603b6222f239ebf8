"""Invariants beside the SQL twins (communities, stream, synthesis, dedup)."""

import uuid

from pyspark.sql import functions as F

from ringwise.operators import augment, graph as g, graph_algo as ga
from ringwise.operators.rings import card_check
from ringwise.operators.segments import fit_segments
from ringwise.session import checkpoint_dir
from ringwise.sources import adapter
from ringwise.streaming import stream as st

SF = "/root/testdata/sf0.001"


def test_communities_cover_every_vertex_once(spark):
    e = g.typed_edges(adapter.transactions(spark, SF))
    c = ga.communities(e, levels=1, turns=3)
    verts = ga.vertex_edges(e).select("src").distinct().count()
    assert c.count() == verts
    assert c.select("v").distinct().count() == verts


def test_two_cliques_split(spark):
    # two groups of cards sharing one device each, bridged by a single card on both devices
    rows = [(f"a{i}", "device", "d1") for i in range(6)] + [(f"b{i}", "device", "d2") for i in range(6)]
    rows += [("a0", "device", "d2")]
    e = spark.createDataFrame(rows, "card_id string, node_type string, node_id string")
    c = {r.v: r.community for r in ga.communities(e).collect()}
    assert len({c[f"a{i}"] for i in range(1, 6)}) == 1
    assert len({c[f"b{i}"] for i in range(6)}) == 1
    assert c["a1"] != c["b1"]


def test_pagerank_sums_for_bipartite_graph(spark):
    rows = [(f"c{i}", "email", "e1") for i in range(4)] + [("c0", "device", "d1"), ("c1", "device", "d1")]
    e = spark.createDataFrame(rows, "card_id string, node_type string, node_id string")
    r = {x.v: x.rank for x in ga.pagerank(e, iters=30).collect()}
    # symmetric cards have equal rank; the hub outranks a leaf
    assert abs(r["c2"] - r["c3"]) < 1e-9 and r["email:e1"] > r["c2"]


def test_stream_equals_batch(spark):
    t = adapter.transactions(spark, SF)
    base = checkpoint_dir(spark).rstrip("/") + f"/test-stream-{uuid.uuid4().hex}"
    payload = st.to_payload(t, ["fraud_probability", "D1", "D15"])
    st.replay(payload, f"{base}/in", rows_per_file=500)
    risk, params = card_check(g.typed_edges(t), g.card_nodes(t)), fit_segments(t)
    q = st.route_stream(st.score_stream(st.read_txn_stream(spark, "json", f"{base}/in"), risk, params),
                        f"{base}/out", f"{base}/ckpt")
    q.processAllAvailable()
    q.stop()
    streamed = spark.read.parquet(f"{base}/out/predictions").select("transaction_id", "decision", "confidence")
    batch = st.score_stream(spark.read.schema(st.MESSAGE_SCHEMA).json(f"{base}/in"), risk, params) \
        .select("transaction_id", "decision", "confidence")
    assert streamed.count() == batch.count() == t.count()
    assert streamed.exceptAll(batch).count() == 0
    # routed sinks partition the predictions by decision
    alerts = spark.read.parquet(f"{base}/out/alerts")
    assert alerts.where(F.col("decision") != "FLAG").count() == 0


def test_synthesis_repeats_and_counts(spark):
    t = adapter.transactions(spark, SF)
    a = augment.synthesise(t, 50, seed=9).select("transaction_id", "pattern", "TransactionAmt").collect()
    b = augment.synthesise(t, 50, seed=9).select("transaction_id", "pattern", "TransactionAmt").collect()
    assert sorted(a) == sorted(b) and len(a) == 50
    assert {r.pattern for r in a} <= set(augment.PATTERNS)
    n = t.count()
    m = augment.mix(t, 0.2, seed=1)
    assert m.where("synthetic").count() == max(1, int(0.2 * n))
    assert m.count() == n + max(1, int(0.2 * n))
