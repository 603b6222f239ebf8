"""The join equals brute force over all pairs: given documents, planted groups, and odd rows."""

import random
import re

import numpy as np
import pytest

from ringwise.llm import ngram_join as nj
from ringwise.llm.components import connected_components
from ringwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, n, threshold):
    sets = {}
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[i] = {tuple(words[j:j + n]) for j in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= threshold * len(s | t):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {(i, len(sets[i]), find(i)) for i in ids}


def planted(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []

    def add(text):
        rows.append((len(rows), text))

    for size in (3, 4, 9, 12, 20, 30, 60, 150, 400):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, max(1, size // 40)))):
                at = r.randrange(len(copy))
                copy[at:at + 1] = r.choice(([], [r.choice(words)], [r.choice(words), copy[at]]))
            add(" ".join(copy))
    chain = [r.choice(words) for _ in range(120)]
    for i in range(25):  # each links to the next, the ends do not link
        chain = chain[:4 * i] + [f"new{i}"] + chain[4 * i + 1:]
        add("\n".join(chain))
    common = " ".join(r.choice(words) for _ in range(80))
    for i in range(30):  # a shared passage, own rest
        add(common + " " + " ".join(f"own{i}x{j}" for j in range(r.choice((6, 20, 60)))))
    for text in (None, "", " \n\t", "one", "ONE", "one two", "One  two", "two one", "a b c", "a b c"):
        add(text)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,threshold", [(3, 90), (5, 80), (2, 60)])
def test_planted_groups_equal_brute_force(spark, n, threshold):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, component string, node int")
    got = {tuple(r) for r in nj.near_groups(df, n, threshold).collect()}
    assert got == brute(rows, n, threshold)


def test_query_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op2_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute(rows, 3, 90)


def test_empty_table_and_odd_rows(spark):
    schema = "doc_id long, text string"
    assert nj.near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d"), (9, "a b c d")]
    got = sorted(map(tuple, nj.near_groups(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 0, None), (4, 2, 4), (4, 2, 4), (9, 2, 4)], key=str)


def test_blocks_of_a_tile_meet(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)
    rows = planted(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in nj.near_groups(df, 3, 90).collect()} == brute(rows, 3, 90)


def test_bitmaps_never_bound_below_the_intersection():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 500, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(r.integers(0, 500, r.integers(1, 300)).astype(np.uint64))
        ba, bb = (np.frombuffer(nj.bitmap(x), np.uint64) for x in (a, b))
        assert nj.bound(ba, bb, np.int64(len(a)), np.int64(len(b))) >= len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (3, 1), (100, 101), (101, 102)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), *((x, 5) for x in range(5, 10)), (100, 100), (101, 100), (102, 100)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_small_tables_go_to_few_files(spark, tmp_path, monkeypatch):
    """Without coalescing by adaptive execution, small tables would be written in a file for each shuffle partition."""
    from ringwise import session
    folder, names = tmp_path / "shared", ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(folder))
    before = {k: spark.conf.get(k) for k in names}
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    try:
        for k, v in zip(names, ("61", "false")):
            spark.conf.set(k, v)
        kept = nj.drop_near_copies(df, 3, 90)
        got = {r.doc_id for r in kept.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i for i, _, c in brute(rows, 3, 90) if i == c}
    made = [len(list(p.glob("part-*.parquet"))) for p in folder.glob("stored-*")]
    assert len(made) > 8 and max(made) <= 7, made


def test_near_copies_go_whatever_the_filter_lets_through(spark, monkeypatch):
    """With a filter of 64 bits nearly every row meets the ids; null and int ids, own columns and repeated rows stay."""
    rows = planted()
    monkeypatch.setattr(nj, "FILTER_BITS", 64)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, rows[0][1], "n"), (None, None, "m")], "doc_id int, text string, maybe string")
    got = sorted(((r.doc_id, r.maybe) for r in nj.drop_near_copies(df, 3, 90).collect()), key=str)
    want = [(i, "x") for i, _, c in brute(rows, 3, 90) if i == c] + [(None, "n"), (None, "m")]
    assert got == sorted(want, key=str)
