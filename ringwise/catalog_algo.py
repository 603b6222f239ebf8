"""Registered graph-algorithm queries (G15-G17, G19, G20) with oracles that unroll the rounds."""

from __future__ import annotations

from ringwise.catalog import _g, register, txn
from ringwise.operators import graph as g
from ringwise.operators import graph_algo as ga
from ringwise.session import at_once, stored

ITERS, DAMP = 30, 0.85


def _pr_sql(iters: int = ITERS, d: float = DAMP) -> tuple[str, dict]:
    ctes = {
        "ue": """
  SELECT card_id AS src, node_type || ':' || node_id AS dst FROM edges UNION ALL
  SELECT node_type || ':' || node_id, card_id FROM edges""",
        "deg": "SELECT src, count(*) AS deg FROM ue GROUP BY src",
        "w": "SELECT ue.src, ue.dst, CAST(1 AS DOUBLE) / deg AS w FROM ue JOIN deg ON ue.src = deg.src",
        "r0": "SELECT src AS v, CAST(1.0 AS DOUBLE) AS rank FROM deg",
    }
    for i in range(1, iters + 1):
        ctes[f"r{i}"] = (f"SELECT w.dst AS v, CAST({repr(1.0 - d)} AS DOUBLE) + CAST({d} AS DOUBLE) * sum(r.rank * w.w)"
                         f" AS rank FROM w JOIN r{i - 1} r ON r.v = w.src GROUP BY w.dst")
    body = (f"SELECT v, CASE WHEN contains(v, ':') THEN split_part(v, ':', 1) ELSE 'card' END AS kind,"
            f" round(rank, 9) AS rank FROM r{iters}")
    return body, ctes


_body, _ctes = _pr_sql()


@register("g15_pagerank", _g(_body, "edges", **_ctes))
def q_g15(spark, sf):
    return ga.pagerank(g.typed_edges(txn(spark, sf)), ITERS, DAMP)


LEVELS, TURNS = 3, 8


def _louvain_ctes(levels: int = LEVELS, turns: int = TURNS) -> dict:
    """The community rounds unrolled: every level runs all its turns and keeps the first state of highest modularity."""
    ctes = {"le0": "SELECT src, dst, CAST(1 AS BIGINT) AS w FROM (SELECT card_id AS src, node_type || ':' || node_id AS dst"
                   " FROM edges UNION ALL SELECT node_type || ':' || node_id, card_id FROM edges) x",
            "lm": "SELECT CAST(sum(w) AS HUGEINT) AS m2 FROM le0",
            "lf0": "SELECT DISTINCT src AS v, src AS community FROM le0"}
    for lv in range(levels):
        e = f"le{lv}"
        ctes[f"ls{lv}_0"] = (f"SELECT src AS v, CAST(sum(w) AS HUGEINT) AS k, CAST(sum(CASE WHEN src = dst THEN w ELSE 0 END)"
                             f" AS HUGEINT) AS own, src AS c FROM {e} GROUP BY src")
        for t in range(turns + 1):
            n = f"{lv}_{t}"
            ctes[f"lt{n}"] = f"SELECT c, sum(k) AS total FROM ls{n} GROUP BY c"
            ctes[f"ll{n}"] = (f"SELECT e.src AS v, s.c AS dest, CAST(sum(e.w) AS HUGEINT) AS w FROM {e} e JOIN ls{n} s"
                              f" ON s.v = e.dst WHERE e.src <> e.dst GROUP BY e.src, s.c")
            ctes[f"lb{n}"] = (f"SELECT l.v, l.dest, l.w * m2 - s.k * t.total AS score FROM ll{n} l JOIN ls{n} s ON s.v = l.v"
                              f" JOIN lt{n} t ON t.c = l.dest, lm WHERE l.dest <> s.c"
                              f" QUALIFY row_number() OVER (PARTITION BY l.v ORDER BY l.w * m2 - s.k * t.total DESC, l.dest) = 1")
            ctes[f"lp{n}"] = (f"SELECT s.*, coalesce(o.w, 0) AS inside, coalesce(b.score > coalesce(o.w, 0) * m2 - s.k *"
                              f" (t.total - s.k), false) AS wants, b.dest FROM ls{n} s JOIN lt{n} t ON t.c = s.c"
                              f" LEFT JOIN ll{n} o ON o.v = s.v AND o.dest = s.c LEFT JOIN lb{n} b ON b.v = s.v, lm")
            ctes[f"lq{n}"] = (f"SELECT {t} AS t, (SELECT sum(inside + own) FROM lp{n}) * m2"
                              f" - (SELECT sum(total * total) FROM lt{n}) AS q FROM lm")
            if t < turns:
                ctes[f"ls{lv}_{t + 1}"] = (f"SELECT v, k, own, CASE WHEN wants AND substr(md5(v || ':{lv * 100 + t}'), 1, 1) < '8'"
                                           f" THEN dest ELSE c END AS c FROM lp{n}")
        ctes[f"lw{lv}"] = ("SELECT t FROM (" + " UNION ALL ".join(f"SELECT * FROM lq{lv}_{t}" for t in range(turns + 1))
                           + ") q ORDER BY q DESC, t LIMIT 1")
        ctes[f"lk{lv}"] = " UNION ALL ".join(f"SELECT v, c FROM ls{lv}_{t} WHERE {t} = (SELECT t FROM lw{lv})"
                                             for t in range(turns + 1))
        ctes[f"lf{lv + 1}"] = f"SELECT f.v, k.c AS community FROM lf{lv} f JOIN lk{lv} k ON k.v = f.community"
        ctes[f"le{lv + 1}"] = (f"SELECT a.c AS src, b.c AS dst, CAST(sum(e.w) AS BIGINT) AS w FROM {e} e JOIN lk{lv} a"
                               f" ON a.v = e.src JOIN lk{lv} b ON b.v = e.dst GROUP BY a.c, b.c")
    ctes["comm"] = (f"SELECT v, CASE WHEN contains(v, ':') THEN split_part(v, ':', 1) ELSE 'card' END AS kind, community"
                    f" FROM lf{levels}")
    return ctes


_COMM = _louvain_ctes()
_RANK = {**_ctes, "ranks": _body}


#: What cards and links are made of.
LINKED = ["TransactionID", "isFraud", "TransactionAmt", "Transaction_Hour", "card1", "card2", "card3", "card4", "card6",
          "DeviceType", "DeviceInfo", "P_emaildomain", "addr1"]


def _graph(spark, sf):
    """The columns of the transactions that make the graph, written once, and its vertices on numbers."""
    t = stored(txn(spark, sf).select(*LINKED))
    return t, ga.VertexGraph(g.typed_edges(t))


def _comm(spark, sf):
    t, e = _graph(spark, sf)
    return t, ga.communities(e, LEVELS, TURNS)


def _comm_ranks(spark, sf):
    """Communities and ranks of one graph; neither waits for the other."""
    t, e = _graph(spark, sf)
    return t, *at_once(lambda: ga.communities(e, LEVELS, TURNS), lambda: stored(ga.pagerank(e, ITERS, DAMP)))


@register("g16_communities", _g("SELECT * FROM comm", "edges", **_COMM))
def q_g16(spark, sf):
    return _comm(spark, sf)[1]


@register("g17_community_risk", _g("""
SELECT community AS ring_id, count(*) AS ring_size, round(avg(fraud_rate), 4) AS avg_fraud_rate,
  CAST(sum(fraud_txn) AS BIGINT) AS total_fraud_txn, CAST(sum(total_txn) AS BIGINT) AS total_txn
FROM comm JOIN cards ON v = card_id WHERE kind = 'card' GROUP BY community HAVING count(*) >= 3
ORDER BY avg_fraud_rate DESC, ring_id LIMIT 20""", "edges", "cards", **_COMM))
def q_g17(spark, sf):
    t, c = _comm(spark, sf)
    return ga.community_risk(c, g.card_nodes(t))


@register("g19_members", _g("""
SELECT community, row_number() OVER (PARTITION BY community ORDER BY rank DESC, card_id) AS pos, card_id, fraud_rate,
  rank AS pagerank, total_txn, fraud_txn
FROM comm JOIN ranks ON comm.v = ranks.v JOIN cards ON comm.v = card_id WHERE comm.kind = 'card'
QUALIFY pos <= 50""", "edges", "cards", **_COMM, **_RANK))
def q_g19(spark, sf):
    t, c, r = _comm_ranks(spark, sf)
    return ga.members(c, r, g.card_nodes(t))


@register("g20_node_rings", _g("""
SELECT comm.kind AS node_type, comm.v AS node_key, community, rank AS pagerank FROM comm JOIN ranks ON comm.v = ranks.v""",
                               "edges", **_COMM, **_RANK))
def q_g20(spark, sf):
    t, c, r = _comm_ranks(spark, sf)
    return ga.node_rings(c, r)
