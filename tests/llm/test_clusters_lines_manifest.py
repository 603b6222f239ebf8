"""Shallot clustering, reversible line dedup and the Merkle log against plain Python."""

import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringwise.checks.compare import compare, duck
from ringwise.llm import line_dedup as ld
from ringwise.llm import merkle as mk
from ringwise.llm import shallot as sh
from ringwise.llm.queries import ORACLE, QUERIES
from ringwise.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_shallot_clusters", "op12_line_dedup", "op13_merkle_manifest"])
def test_matches_sql(spark, name):
    rep = compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name])
    assert rep["ok"], rep


# ---------------------------------------------------------------- Shallot

def lloyd(rows, k, rounds):
    """Full scans in plain Python integers; ``rows`` are (id, integer vector)."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(q) for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in rows:
            groups[near(q)[1]].append(q)
        for j, g in groups.items():
            cents[j] = [sum(v) // len(g) for v in zip(*g)]
    return sorted((r[0] is not None, r[0] or 0, near(r[1])[1], near(r[1])[0]) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10 ** 6))
def test_search_equals_a_full_scan_with_ties(k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (40, 3)).astype(np.int64)
    c, s = np.zeros(40, dtype=np.int64), np.full(40, min(1, k - 1))
    u, low = np.full(40, np.inf), np.zeros(40)
    points, moved = rng.integers(-2, 3, (k, 3)).astype(np.int64), None
    for _ in range(4):
        sh.search(x, c, s, u, low, sh.Centroids(points, moved))
        d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (c == d.argmin(axis=1)).all()
        new = points + rng.integers(-1, 2, points.shape)
        moved = np.sqrt(((new - points) ** 2).sum(axis=1)) * (1 + sh.SLACK)
        points = new


def test_clusters_with_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], "x") for i in range(60)]
    rows += [(7, rows[7][1], "again"), (None, [0.1, 0.2, 0.3, 0.4], None), (100, rows[8][1], "copy")]
    odd = [(200, None, ""), (201, [1.0, 2.0], ""), (202, [1.0, None, 0.0, 0.0], ""), (203, [float("nan")] * 4, ""),
           (204, [float("inf"), 0.0, 0.0, 0.0], ""), (205, [], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, c string").withColumn("q", F.lit(1))
    got = sh.report(df, k=5, rounds=3, dims=4)
    plain = lloyd([(i, [int(np.floor(64 * v)) for v in q]) for i, q, _ in rows], 5, 3)
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance) for r in got.collect()) == plain
    assert {r.inertia for r in got.collect()} == {sum(p[3] for p in plain)}
    few = sh.report(df.where("vec_id in (1, 2)"), k=5, rounds=3, dims=4).collect()
    assert {r.cluster for r in few} == {0, 1} and all(r.distance == 0 for r in few)
    assert sh.report(df.limit(0), k=5, dims=4).count() == 0


def test_most_distances_are_never_taken(spark):
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, (16, 8)).astype(np.int64)
    x = np.repeat(points, 100, axis=0) + rng.integers(-5, 6, (1600, 8))
    c, s, u, low = np.zeros(1600, np.int64), np.ones(1600, np.int64), np.full(1600, np.inf), np.zeros(1600)
    sh.search(x, c, s, u, low, sh.Centroids(points))
    cents, asked = sh.Centroids(points, np.ones(16)), []
    cents.squared = lambda a, b: asked.append(len(b)) or ((a - points[b]) ** 2).sum(axis=1)
    sh.search(x, c, s, u, low, cents)
    assert sum(asked) == 0          # bounds separate every vector after a small move


# ---------------------------------------------------------------- line dedup

def plain_lines(rows):
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = ld.line_key(line.encode())
            if k and i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if i is None or first.get(ld.line_key(x.encode()), i) == i]
        out.append((i is None, i or 0, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out)


def lines_of(index, df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.kept, r.n_lines, r.n_dropped) for r in index.apply(df).collect())


def some_docs(n, seed):
    rng = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  A shared LINE with blanks\t", "äöüäöüäöü"]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) if rng.random() > .1 else None) for i in range(n)]


def test_keys():
    assert ld.line_key(b"  ABCDEFGHIJ\x0b") == ld.line_key(b"abcdefghij")
    assert ld.line_key(b"abcdefghi  ") is None and ld.line_key("äöüäöüäöü".encode()) is None
    assert ld.line_key("äöüäöüäöüß".encode()) is not None
    assert ld.line_key("ÄÖÜÄÖÜÄÖÜß".encode()) != ld.line_key("äöüäöüäöüß".encode())


def test_insert_delete_and_back(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 16)      # several shards, and filters that must grow
    rows = some_docs(60, 1) + [(None, "a line nobody else has"), (None, "Line number 3 of the pool"), (5, "Line number 3 of the pool")]
    schema = "doc_id long, text string"
    df = spark.createDataFrame(rows, schema)
    a = ld.LineIndex.empty(spark).insert(df.where("doc_id < 20"))
    b = a.insert(df.where("doc_id >= 20"))
    assert b.shards > 1
    assert lines_of(b, df) == plain_lines(rows)
    gone = spark.createDataFrame([(i,) for i in range(0, 30)] + [(999,), (None,)], "doc_id long")
    c = b.delete(gone)
    left = [r for r in rows if r[0] is None or r[0] >= 30]
    assert lines_of(c, df.where("doc_id is null or doc_id >= 30")) == plain_lines(left)
    # reference counts and filters are those of an index that never saw the deleted documents
    fresh = ld.LineIndex.empty(spark).insert(df.where("doc_id >= 30"))
    assert sorted(map(tuple, c.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
    held = {r.shard: ld.Cuckoo.load(r.slots) for r in c.filters.collect()}
    assert sum(int((f.slots != 0).sum()) for f in held.values()) == c.refs.count()
    d = c.insert(df.where("doc_id < 30"))
    assert lines_of(d, df) == plain_lines(rows)
    assert lines_of(b, df) == plain_lines(rows)    # the older version is still there
    assert lines_of(d.insert(df.where("doc_id = 7 and text is null")).insert(df.limit(0)), df) == plain_lines(rows)
    e = d.delete(df.select("doc_id"))
    assert e.refs.count() == 0 and all(not ld.Cuckoo.load(r.slots).slots.any() for r in e.filters.collect())


def test_false_alarms_are_settled(spark, monkeypatch):
    """A filter that knows everything must not change the result, nor lose keys on deletion."""
    monkeypatch.setattr(ld, "_sift", lambda cuckoo, keys: np.ones(len(keys), dtype=bool))
    rows = some_docs(30, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = ld.LineIndex.empty(spark).insert(df)
    assert lines_of(index, df) == plain_lines(rows)
    assert lines_of(index.delete(df.where("doc_id < 9")), df.where("doc_id >= 9")) == plain_lines(rows[9:])


def test_hot_lines_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT", 20)
    rows = [(i, f"The line of every document\nline of {i} alone, and long enough") for i in range(80)]
    rows += [(200, ""), (201, None), (202, "x" * 300_000 + "\n" + "The line of every document")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("keys", F.lit(2))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.kept, r.n_lines, r.n_dropped) for r in ld.dedup_lines(df).collect())
    assert got == plain_lines(rows)
    assert ld.dedup_lines(df.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_cuckoo_filter(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2 ** 63, (3000, 2)).astype(np.uint64)
    f = ld.Cuckoo.empty(1024)                      # 73 % load
    f.add(keys[:1500])
    f.add(keys[1500:])
    assert f.knows(keys).all() and int((f.slots != 0).sum()) == 3000
    f.remove(keys[::2])
    assert f.knows(keys[1::2]).all() and int((f.slots != 0).sum()) == 1500
    assert f.knows(rng.integers(0, 2 ** 63, (5000, 2)).astype(np.uint64)).mean() < 0.005
    f.remove(keys[1::2])
    assert not f.slots.any()
    with pytest.raises(RuntimeError):
        f.remove(keys[:1])


# ---------------------------------------------------------------- Merkle log

def plain_tree(nodes):
    """Levels of a tree of arity three in plain Python."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([mk.digest_of("".join(low[i:i + 3])) for i in range(0, len(low), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for low in levels[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(low)))
        out.append((i % 3, [low[j] for j in run if j != i]))
        i //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 81, 100, 243, 250])
def test_log_positions_and_proofs(n):
    nodes = [mk.digest_of(str(i)) for i in range(n)]
    levels = plain_tree(nodes)
    log = mk.grow(nodes, 0, n, 0, 99)
    assert [mk.position(level, i, n) for level, i, _ in log] == list(range(len(log))) and len(log) == mk.log_size(n)
    assert all(levels[level][i] == d for level, i, d in log)
    # aligned builders of two levels write the same log
    parts, low, base = [], nodes, 0
    while True:
        here = [x for a in range(0, len(low), 9) for x in mk.grow(low[a:a + 9], a, n, base, 2)]
        parts += [x for x in here if base == 0 or x[0] > base]
        if mk.root_level(n) <= base + 2:
            break
        base += 2
        low = [d for level, _, d in here if level == base]
    assert sorted(parts, key=lambda x: mk.position(x[0], x[1], n)) == log
    segment = {mk.position(level, i, n): d for level, i, d in log}
    for i, path in enumerate(mk.proofs(segment, 0, n, n, 0, [], 99)):
        assert [(int(s[0]), [s[1 + k:65 + k] for k in range(0, len(s) - 1, 64)]) for s in path] == plain_path(levels, i)
        assert mk.fold(nodes[i], path) == levels[-1][0]
        assert mk.fold(mk.digest_of("other"), path) != levels[-1][0] or n == 0


def plain_manifest(rows):
    def leaf(r, text):
        vals = [r[0], r[1], r[2], r[3], text]
        return mk.digest_of("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = plain_tree([built[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, d, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = plain_path(built[s], i) + plain_path(top, at)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            f = leaf(r, r[4].replace("\n", "")) if bad else d
            for k, sib in path:
                f = mk.digest_of("".join(sib[:k]) + f + "".join(sib[k:]))
            out.append((r[0] is None, r[0] or 0, d, built[s][-1][0], top[-1][0],
                        mk.digest_of("".join(x for _, sib in path for x in sib)), f, f == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_against_plain_python(spark, height):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "ä", "", None, "hot", "hot", "hot"]), rng.choice(["en", None]), rng.choice([5, None]),
             rng.choice([None, "", "one\ntwo", "né\n", "x" * 70_000 + "\n"])) for i in range(60)]
    rows += [(3, "hot", "en", 1, "again\n"), (3, "hot", "en", 1, "again\n"), (None, "hot", None, None, "no id\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("tree", F.lit(1)).withColumn("idx", F.lit(2))
    path = f"{checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    got = mk.manifest(df, path, height).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                  for r in got) == plain_manifest(rows)
    assert 0 < sum(not r.verified for r in got) < len(got)
    # the log of every tree has each place once
    log = spark.read.parquet(f"{path}/sources").where(f"layer = 0 or level > layer * {height}")
    for r in log.groupBy("tree").agg(F.max("n").alias("n"), F.collect_list("pos").alias("p")).collect():
        assert sorted(r.p) == list(range(mk.log_size(r.n)))


def test_manifest_of_one_and_none(spark):
    one = spark.createDataFrame([(4, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    r = mk.report(one).first()
    assert r.leaf == mk.digest_of("1:4----") == r.subroot == r.root and r.verified and r.proof_sha256 == mk.digest_of("")
    assert mk.report(one.limit(0)).count() == 0
