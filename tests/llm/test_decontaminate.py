"""Hits of the automaton equal a brute-force search of every window in every text."""

import hashlib
import random
import re

import pytest

from ringwise.llm import decontaminate as dc
from ringwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    windows = []
    for item_id, text in items:
        w = words(text)
        if w:
            k = min(window, len(w))
            windows += [("" if item_id is None else str(item_id), tuple(w[i:i + k])) for i in range(len(w) - k + 1)]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        grams = {}
        for k in {len(x) for _, x in windows}:
            for i in range(len(w) - k + 1):
                grams.setdefault(tuple(w[i:i + k]), []).append(i)
        for item_id, x in windows:
            for i in grams.get(x, ()):
                hit.update(range(i, i + len(x)))
                found.add(item_id)
        out.append((doc_id, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed=3):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "dé", "ü", "e5", "f", "g"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice((1, 2, 3, 5, 9, 10, 11, 14, 30))))) for i in range(25)]
    items += [(100, items[3][1]), (101, None), (102, "..."), (None, "x y z"), (7, "two  rows, one-id"), (103, "a a a a a a a a a a a a a")]
    items = [x for x in items if x[1] is None or len(x[1].split()) > 1 or seed % 2]
    docs = []
    for i in range(60):
        t = [r.choice(vocab) for _ in range(r.choice((0, 3, 30, 80)))]
        for _ in range(r.choice((0, 1, 2))):
            it = words(r.choice(items)[1])
            a = r.randrange(len(it) + 1)
            t[r.randrange(len(t) + 1):0] = it[a:] if r.random() < .5 else it
        docs.append((i, r.choice((" ", ", ", "\n")).join(t).upper() if i % 3 else " ".join(t)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, "a " * 3000), (902, "a " * 3000)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, spans string, item_id int"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_planted_cases(spark, monkeypatch):
    for seed in (2, 3, 4):
        docs, items = cases(seed)
        got = sorted(map(tuple, dc.report(*frames(spark, docs, items)).collect()), key=str)
        assert got == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 40)  # several automata, one pass each
    assert sorted(map(tuple, dc.report(*frames(spark, docs, items)).collect()), key=str) == brute(docs, items)


def test_query_on_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op7_benchmark_decontamination"](spark, SF).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c")], [])
    assert [tuple(r)[:4] for r in dc.report(docs, items).collect()] == [(1, 3, 0, 0)]
    docs, items = frames(spark, [], [(1, "a b")])
    assert dc.report(docs, items).count() == 0


def test_passages_are_cut_and_mostly_copied_documents_dropped(spark):
    item = " ".join(f"q{i}" for i in range(20))
    own = " ".join(f"own{i}" for i in range(40))
    rows = [(1, own), (2, f"{own}. {item.title()}! {own}"), (3, f"own {item}"), (4, None), (5, f"{own}\n{item}")]
    docs = spark.createDataFrame([(i, t, -1, "z") for i, t in rows], "doc_id long, text string, n_chars int, items string")
    out = {r.doc_id: r for r in dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert set(out) == {1, 2, 4, 5}
    assert out[1].text == own and out[1].n_chars == -1 and out[1]["items"] == "z" and out[4].text is None
    assert out[2].text == f"{own}. {own}" and out[2].n_chars == len(out[2].text)
    assert out[5].text == f"{own}\n"


@pytest.mark.parametrize("block", [60, 2_000_000])
def test_passages_are_found_and_cut_by_one_worker(spark, monkeypatch, block):
    """Each mapInArrow of a stage holds a Python worker of its own for every running task."""
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    docs, items = frames(spark, *cases())
    out = dc.decontaminate(docs, items)
    passes = len(list(dc.item_blocks(items, 10)))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == passes
    found = dc.scan(docs, items).collect()
    want = [(r.doc_id, dc._cut((r.text or "").encode(), s).decode() if s else r.text, r.spans, r.item_id) for r in found
            if sum(x.b - x.a for x in r._dc_spans) <= r._dc_words * 0.5 for s in [[(x.a, x.b) for x in r._dc_spans if x.b - x.a > 9]]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and 0 < len(want) < len(found)
