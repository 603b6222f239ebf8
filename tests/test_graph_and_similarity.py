"""Communities by modularity, edge rounds with hubs, and block-pruned similarity search against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwise.operators import graph as g
from ringwise.operators import graph_algo as ga
from ringwise.operators import similar
from ringwise.plans import edge_rounds
from ringwise.sources import adapter

SF = "/root/testdata/sf0.001"


def modularity(edges, comm):
    """Plain Python: share of edges inside communities less what degrees alone would give."""
    m, inside, degree = len(edges), {}, {}
    for a, b in edges:
        for v in (a, b):
            degree[comm[v]] = degree.get(comm[v], 0) + 1
        if comm[a] == comm[b]:
            inside[comm[a]] = inside.get(comm[a], 0) + 1
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def typed(spark, pairs):
    return spark.createDataFrame([(c, "device", d) for c, d in pairs], "card_id string, node_type string, node_id string")


def bicliques(n, size, ring=True):
    pairs = [(f"c{i}_{a}", f"d{i}_{b}") for i in range(n) for a in range(size) for b in range(size)]
    return pairs + [(f"c{i}_0", f"d{(i + 1) % n}_0") for i in range(n)] if ring else pairs


def test_ring_of_cliques(spark):
    pairs = bicliques(6, 4)
    found, reached = ga.louvain(typed(spark, pairs))
    comm = {r.v: r.community for r in found.collect()}
    cliques = [{comm[f"c{i}_{a}"] for a in range(4)} | {comm[f"device:d{i}_{a}"] for a in range(4)} for i in range(6)]
    assert all(len(c) == 1 for c in cliques) and len({next(iter(c)) for c in cliques}) == 6
    assert all(a <= b for a, b in zip(reached, reached[1:]))
    assert reached[-1] == pytest.approx(modularity([(c, f"device:{d}") for c, d in pairs], comm))


def test_modularity_never_falls_and_beats_labels_alone(spark):
    e = g.typed_edges(adapter.transactions(spark, SF))
    found, reached = ga.louvain(e)
    comm = {r.v: r.community for r in found.collect()}
    plain = [(r.card_id, f"{r.node_type}:{r.node_id}") for r in e.collect()]
    assert set(comm) == {v for p in plain for v in p}
    assert all(a <= b for a, b in zip(reached, reached[1:])) and reached[-1] > 0.2
    assert reached[-1] == pytest.approx(modularity(plain, comm))


def test_communities_of_nothing_and_of_parts(spark):
    assert ga.communities(typed(spark, [("a", "x")]).limit(0)).count() == 0
    comm = {r.v: r.community for r in ga.communities(typed(spark, bicliques(3, 3, ring=False) + [("lone", "own")])).collect()}
    assert len(set(comm.values())) == 4 and comm["lone"] == comm["device:own"]


def test_hubs_change_nothing(spark, monkeypatch):
    pairs = [(f"c{i}", "hub") for i in range(40)] + bicliques(4, 3)
    plain = {r.v: (r.community,) for r in ga.communities(typed(spark, pairs)).collect()}
    ranks = {r.v: r["rank"] for r in ga.pagerank(typed(spark, pairs), iters=8).collect()}
    monkeypatch.setattr(edge_rounds, "HUBS", 10)
    rounds = edge_rounds.EdgeRounds(ga.vertex_edges(typed(spark, pairs)).withColumn("w", F.lit(1)))
    assert [r.src for r in rounds.hubs.collect()] == ["device:hub"]
    assert {r.v: (r.community,) for r in ga.communities(typed(spark, pairs)).collect()} == plain
    again = {r.v: r["rank"] for r in ga.pagerank(typed(spark, pairs), iters=8).collect()}
    assert again.keys() == ranks.keys() and all(abs(again[v] - ranks[v]) < 1e-9 for v in ranks)


def test_a_round_never_exchanges_the_edges(spark):
    rounds = edge_rounds.EdgeRounds(ga.vertex_edges(typed(spark, bicliques(4, 3))).withColumn("w", F.lit(1)))
    values = rounds.edges.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("rank"))
    plan = rounds.send(values).groupBy("dst").agg(F.sum("rank"))._jdf.queryExecution().executedPlan().toString()
    scan = plan[:plan.index("bucketed_")] if "bucketed_" in plan else plan
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2, plan  # degrees and the sums
    assert scan.rstrip().splitlines()[-1].count("Exchange") == 0


# ---------------------------------------------------------------- similarity

def clustered(n, dims, seed, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] / np.sqrt(dims) + noise * rng.standard_normal((n, dims)) / np.sqrt(dims)
    return x.astype(np.float32)


def brute(x, queries, k):
    u = x.astype(np.float64)
    u /= np.where((size := np.sqrt((u ** 2).sum(axis=1, keepdims=True))) > 0, size, 1)
    out = {}
    for q in queries:
        s = np.round(u @ u[q], 9)
        out[q] = [(int(j), float(s[j])) for j in sorted((j for j in range(len(x)) if j != q), key=lambda j: (-s[j], j))[:k]]
    return out


def lists(df):
    got = {}
    for r in df.orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append((r.b, r.similarity))
    return got


@pytest.mark.parametrize("rows", [600, 3000])
def test_lists_are_exact_and_most_blocks_are_left_out(spark, rows):
    x = clustered(rows, 16, rows)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    wanted = F.col("id") % 10 == 0
    got = lists(similar.similar_many(df, wanted, 5, dims=16, block_rows=rows // 30))
    want = brute(x, range(0, rows, 10), 5)
    recall = np.mean([len({b for b, _ in got[q]} & {b for b, _ in want[q]}) / 5 for q in want])
    assert got.keys() == want.keys() and recall > 0.999
    # blocks a query is sent to beside its own: far fewer than there are, at both sizes
    index = similar.sign_index(df, dims=16, block_rows=rows // 30)
    blocks = index.select("block").distinct().count()
    asked = index.where(wanted)
    sent = similar.routes(asked, similar._within(asked, index, 5), index, 5).count()
    assert blocks > 15 and sent < 0.5 * blocks * (rows // 10)


def test_odd_vectors_copies_and_few_rows(spark):
    x = clustered(40, 4, 1)
    x[5:25] = x[5]                       # half of the rows are one vector
    x[30] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(100, None), (101, [1.0]), (102, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("unit", F.lit(1)).withColumn("block", F.lit(2))
    got = lists(similar.similar_many(df, F.lit(True), 6, dims=4, block_rows=7))
    want = brute(x, range(40), 6)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)
    assert [b for b, _ in got[7]] == [5, 6, 8, 9, 10, 11]
    two = lists(similar.similar_many(df.where("vec_id < 2"), F.lit(True), 6, dims=4))
    assert {k: len(v) for k, v in two.items()} == {0: 1, 1: 1}
    assert similar.similar_many(df.limit(0), F.lit(True), 6, dims=4).count() == 0


def test_no_side_of_the_card_check_passes_the_driver(spark):
    from ringwise.plans.shared_links import other_fraud_counts, other_fraud_counts_naive
    edges = spark.createDataFrame([(f"c{c}", "device", f"d{(c * 7 + j * 3) % 11}") for c in range(40) for j in range(1 + c % 5)],
                                  "card_id string, node_type string, node_id string").distinct()
    fraud = spark.createDataFrame([(f"c{c}",) for c in range(0, 40, 3)], "card_id string")
    for most in (12, 2):
        out = other_fraud_counts(edges, fraud, most)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        want = {(r.card_id, r.node_type): r.n_fraud for r in other_fraud_counts_naive(edges, fraud).collect()}
        got = {(r.card_id, r.node_type): r.n_fraud for r in out.collect()}
        assert {k: v for k, v in got.items() if v} == want


def test_queries_pass_a_block_in_batches(spark):
    from ringwise.operators import similar as sm
    rng = np.random.default_rng(3)
    emb = spark.createDataFrame([(i, [float(v) for v in rng.standard_normal(8)]) for i in range(900)], "vec_id long, embedding array<double>")
    out = sm.similar_many(emb, F.col("id") % 2 == 0, k=3, dims=8, block_rows=200)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan  # a group of all a block's queries would be held at once
    x = np.array([r.embedding for r in emb.orderBy("vec_id").collect()])
    x /= np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    got = {}
    for r in out.collect():
        got.setdefault(r.a, {})[r["rank"]] = r.b
    for a in range(0, 900, 2):
        s = np.round(x @ x[a], 9)
        s[a] = -np.inf
        assert [got[a][k] for k in (1, 2, 3)] == sorted(range(900), key=lambda j: (-s[j], j))[:3]
    assert len(got) == 450
