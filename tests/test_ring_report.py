"""The ring report (A7): its lines from the DuckDB texts of its parts, and one join of transactions with predictions."""

from ringwise.catalog import ORACLE
from ringwise.catalog_rings import q_a7
from ringwise.checks.compare import duck

SF = "/root/testdata/sf0.001"


def test_lines_and_one_scoring(spark, monkeypatch):
    kept, store = [], q_a7.__globals__["stored"]
    monkeypatch.setitem(q_a7.__globals__, "stored", lambda df: kept.append(df.columns) or store(df))
    got = {(r.section, r.pos): r.line for r in q_a7(spark, SF).collect()}
    assert sum("yhat" in cols for cols in kept) == 1  # read by the missed cards and by the recall
    con = duck(SF)
    found, new_recall = con.execute(f"SELECT found, new_recall FROM ({ORACLE['g14_lift']})").fetchone()
    total, hits = con.execute(f"SELECT count(*), count_if(y_graph = 1 AND yhat = 1) FROM ({ORACLE['g13_override']}) "
                              "WHERE CAST(transaction_id AS BIGINT) % 29 = 0").fetchone()
    want = {("summary", 0): f"Missed frauds inside rings: {found} of {total}; recall {hits / total:.4f} -> {new_recall:.4f}"}
    for query, section, key in (("g1_device_rings", "device", "device"), ("g2_email_rings", "email", "email_domain"),
                                ("g3_address_rings", "address", "address")):
        top = con.execute(f"SELECT {key}, card_count, fraud_card_count FROM ({ORACLE[query]}) "
                          f"ORDER BY fraud_card_count DESC, card_count DESC, {key} LIMIT 10").fetchall()
        want |= {(section, i): f"{i}. {k}: {c} cards, {f} fraud cards" for i, (k, c, f) in enumerate(top, 1)}
    assert got == want
