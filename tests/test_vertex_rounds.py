"""Rounds over numbered vertices: one graph for communities and ranks, moves against plain Python, what is exchanged."""

import threading

import pytest
from pyspark.sql import functions as F

from ringwise import catalog_algo
from ringwise.operators import graph_algo as ga
from ringwise.plans import edge_rounds
from ringwise.session import at_once, stored


def typed(spark, pairs):
    return spark.createDataFrame([(c, "device", d) for c, d in pairs], "card_id string, node_type string, node_id string")


PAIRS = [(f"c{i}", f"d{i % 4}") for i in range(12)] + [(f"c{i}", f"d{(i * 5 + 1) % 7}") for i in range(0, 12, 2)] + [("é", "d1")]


def test_numbers_stand_in_the_order_of_the_names(spark):
    graph = ga.VertexGraph(typed(spark, sorted(set(PAIRS))))
    rows = sorted((r.v, r.name) for r in graph.names.collect())
    assert [n for _, n in rows] == sorted({n for c, d in PAIRS for n in (c, f"device:{d}")}, key=lambda n: n.encode())
    assert len({v for v, _ in rows}) == len(rows) and rows[-1][0] < graph.size


def test_ranks_and_communities_share_one_graph(spark, monkeypatch):
    made = []
    init = edge_rounds.EdgeRounds.__init__
    monkeypatch.setattr(edge_rounds.EdgeRounds, "__init__", lambda self, e: (made.append(1), init(self, e))[1])
    graph = ga.VertexGraph(typed(spark, sorted(set(PAIRS))))
    comm = ga.communities(graph, levels=1)
    ranks = {r.v: r["rank"] for r in ga.pagerank(graph, iters=4).collect()}
    assert len(made) == 1 and {r.v for r in comm.collect()} == ranks.keys()
    linked = {}
    for c, d in set(PAIRS):
        linked.setdefault(c, []).append(f"device:{d}")
        linked.setdefault(f"device:{d}", []).append(c)
    want = dict.fromkeys(linked, 1.0)
    for _ in range(4):
        want = {v: 0.15 + 0.85 * sum(want[u] / len(linked[u]) for u in linked[v]) for v in linked}
    assert ranks == pytest.approx(want, abs=1e-8)


def moves(edges, state, twice_m):
    """Plain Python: ``v -> (inside, wants, next if it may move)`` in whole numbers of any size."""
    total, out = {}, {}
    for v, k, own, draw, c in state:
        total[c] = total.get(c, 0) + k
    comm = {v: c for v, _, _, _, c in state}
    for v, k, own, draw, c in state:
        w = {}
        for a, b, x in edges:
            if b == v and a != b:
                w[comm[a]] = w.get(comm[a], 0) + x
        stay = w.get(c, 0) * twice_m - k * (total[c] - k)
        others = [(k * total[t] - x * twice_m, t) for t, x in w.items() if t != c]
        wants = bool(others) and -min(others)[0] > stay
        out[v] = (w.get(c, 0), wants, min(others)[1] if wants and draw & 2 else c)
    return out, total


@pytest.mark.parametrize("hubs", [edge_rounds.HUBS, 10])
@pytest.mark.parametrize("scale", [1, 2 ** 29])  # products of long and of wider numbers
def test_a_round_of_moves(spark, monkeypatch, scale, hubs):
    monkeypatch.setattr(edge_rounds, "HUBS", hubs)
    one = [(a, 20 + (a * 7 + j * 3) % 9) for a in range(20) for j in range(1 + a % 4)] + [(a, 40) for a in range(20)] + [(3, 3)]
    weight = {}
    for a, b in one:
        for e in ((a, b), (b, a)):
            weight[e] = weight.get(e, 0) + scale
    edges = [(a, b, w) for (a, b), w in weight.items()]
    ends = sorted({a for a, _, _ in edges})
    k = {v: sum(w for a, _, w in edges if a == v) for v in ends}
    state = [(v, k[v], weight.get((v, v), 0), v % 4, ends[i // 3 * 3]) for i, v in enumerate(ends)]
    twice_m = sum(k.values())
    want, total = moves(edges, state, twice_m)
    rounds = edge_rounds.EdgeRounds(spark.createDataFrame([(a, b, w, k[b]) for a, b, w in edges],
                                                          "src long, dst long, w long, to_k long"))
    assert rounds.has_hubs == (hubs == 10)
    df = stored(spark.createDataFrame([(*s, total[s[4]]) for s in state], "v long, k long, own long, draw long, c long, total long"))
    done = stored(ga.move_round(df, rounds, twice_m, 1 << 43, 1))
    assert {r.v: (r.inside, r.wants, r.next) for r in done.collect()} == want
    q = sum(want[s[0]][0] + s[2] for s in state) * twice_m - sum(t * t for t in total.values())
    assert ga.modularity_sum(done, twice_m) == (q, sum(x[1] for x in want.values()))


def test_a_round_of_moves_neither_joins_nor_sorts_what_arrives(spark):
    graph = ga.VertexGraph(typed(spark, sorted(set(PAIRS))))
    state = stored(graph.degrees.select("v", "k", "own", F.lit(1).cast("long").alias("draw"), F.col("v").alias("c"), F.col("k").alias("total")))
    plan = ga.move_round(state, graph.rounds, 2 * len(set(PAIRS)), graph.size, 0)._jdf.queryExecution().executedPlan().toString()
    # one join sends along the edges, one puts the best move beside its vertex; sums and best are hashed
    assert plan.count("Join") == 2 and "SortAggregate" not in plan and "Sort [" not in plan, plan


def test_what_hubs_send_is_summed_before_it_moves(spark, monkeypatch):
    monkeypatch.setattr(edge_rounds, "HUBS", 6)
    rounds = edge_rounds.EdgeRounds(ga.vertex_edges(typed(spark, [(f"c{i}", "hub") for i in range(40)])).withColumn("w", F.lit(1)))
    values = stored(rounds.edges.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("x")))
    plan = rounds.send_hot(values).groupBy("dst").agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan, plan


def test_a_turn_without_hubs_writes_one_table(spark, monkeypatch):
    graph = ga.VertexGraph(typed(spark, sorted(set(PAIRS))))
    tables, moved, rounds = [], [], ga.move_round
    monkeypatch.setattr(ga, "stored", lambda df: (tables.append(df.columns), stored(df))[1])
    monkeypatch.setattr(ga, "move_round", lambda *a: (moved.append(rounds(*a)), moved[-1])[1])
    ga.louvain(graph, levels=1)
    states = [t for t in tables if {"draw", "c"} <= set(t)]
    # the first state, then what each turn found; the old code wrote a state with totals for every turn as well
    assert len(moved) > 2 and len(states) == 1 + len(moved), states
    plans = [m._jdf.queryExecution().optimizedPlan().toString() for m in moved[1:]]
    assert all("(draw" in p and "& 1)" in p for p in plans)  # one code for all turns, compiled once


def test_draws_by_shifting_are_those_of_the_turns(spark):
    graph = ga.VertexGraph(typed(spark, sorted(set(PAIRS))))
    found, _ = ga.louvain(graph, levels=1, turns=3)
    edges = [(a, b, 1) for a, b in ((r.src, r.dst) for r in graph.rounds.edges.collect())]
    k = {r.v: r.k for r in graph.degrees.collect()}
    name = {r.v: r.name for r in graph.names.collect()}
    draw = {r.name: r.draw for r in graph.names.select("name", ga.draws([0, 1, 2, 3]).alias("draw")).collect()}
    m2, comm, best = sum(k.values()), {v: v for v in k}, None
    for turn in range(4):
        state = [(v, k[v], 0, 2 if draw[name[v]] >> turn & 1 else 0, comm[v]) for v in sorted(k)]
        want, total = moves(edges, state, m2)
        q = sum(x[0] for x in want.values()) * m2 - sum(t * t for t in total.values())
        if best is None or q > best[0]:
            best = (q, comm)
        comm = {v: x[2] for v, x in want.items()}
    assert {r.v: r.community for r in found.collect()} == {name[v]: name[c] for v, c in best[1].items()}


def test_works_at_once_run_beside_each_other_and_raise(spark):
    met = threading.Barrier(2, timeout=60)
    assert at_once(lambda: (met.wait(), spark.range(3).count())[1], lambda: (met.wait(), "b")[1]) == [3, "b"]
    with pytest.raises(ZeroDivisionError):
        at_once(lambda: spark.range(3).count(), lambda: 1 / 0)


def test_communities_and_ranks_do_not_wait_for_each_other(spark, monkeypatch):
    met, done = threading.Barrier(2, timeout=120), []
    for name in ("communities", "pagerank"):
        monkeypatch.setattr(ga, name, lambda *a, f=getattr(ga, name): (met.wait(), done.append(1), f(*a))[2])
    catalog_algo._comm_ranks(spark, "/root/testdata/sf0.001")
    assert len(done) == 2
