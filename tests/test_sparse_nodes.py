"""Sparse nodes meet in pairs of sets, hot ones by subsets: same counts at every border, rows that grow with the links."""

import random

import pytest

from ringwise.plans import shared_links
from ringwise.plans.shared_links import other_fraud_counts, other_fraud_counts_naive

EDGE = "card_id string, node_type string, node_id string"


@pytest.mark.parametrize("max_nodes,sparse", [(12, 32), (12, 2), (2, 0), (3, 4)])
def test_borders_change_nothing(spark, max_nodes, sparse):
    r = random.Random(max_nodes + sparse)
    rows = {(f"c{c}", t, f"n{min(r.randrange(60), r.randrange(60))}") for c in range(200) for t in ("device", "email")
            for _ in range(r.randrange(7))}
    edges = spark.createDataFrame(sorted(rows), EDGE)
    fraud = spark.createDataFrame([(f"c{c}",) for c in r.sample(range(240), 80)], "card_id string")
    got = {(x.card_id, x.node_type): x.n_fraud for x in other_fraud_counts(edges, fraud, max_nodes, sparse).collect()}
    assert got.keys() == {x[:2] for x in rows}
    assert {k: v for k, v in got.items() if v} == {(x.card_id, x.node_type): x.n_fraud
                                                   for x in other_fraud_counts_naive(edges, fraud).collect()}


@pytest.mark.parametrize("cards", [20, 60])
def test_cards_of_many_sparse_nodes_emit_no_subsets(spark, monkeypatch, cards):
    # eleven devices a card, each shared with one other card, and one email of all cards
    rows = [(f"c{c}", "device", f"d{(c * 10 + j) % (cards * 10)}") for c in range(cards) for j in range(11)]
    rows += [(f"c{c}", "email", "hot") for c in range(cards)] + [(f"c{c}", "email", f"own{c}") for c in range(cards)]
    edges, fraud = spark.createDataFrame(rows, EDGE), spark.createDataFrame([(f"c{c}",) for c in range(cards)], "card_id string")
    made, cut = [], shared_links.subsets
    monkeypatch.setattr(shared_links, "subsets", lambda links: made.append(cut(links)) or made[-1])
    got = {(x.card_id, x.node_type): x.n_fraud for x in other_fraud_counts(edges, fraud).collect()}
    assert sum(m.count() for m in made) <= 3 * cards  # 2,047 a card, were its devices cut into subsets
    assert got == {(f"c{c}", t): n for c in range(cards) for t, n in (("device", 2), ("email", cards - 1))}
