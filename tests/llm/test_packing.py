"""Packing: every id in exactly one piece, no gaps, ids equal the tokenizer's, little slack, exact subset sums."""

import collections
import itertools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from ringwise.llm import packing
from ringwise.llm.queries import QUERIES, TOKENIZER, public_file

SF = "/root/testdata/sf0.001"


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(public_file(TOKENIZER))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert sum(r.length for r in own) == len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert sum(r.length for r in own) <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(r.length for r in rows), len(by_seq)


def test_query_on_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    used, sequences = check(QUERIES["op6_min_slack_packing"](spark, SF).collect(), docs, 4096)
    assert sequences <= -(-used // 4096) + 1


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    odd = [None, "", " \n\t ", "it's we'LL I'd 'quoted' don't,", "<|endoftext|> x <|startoftext|>", "a<|b|>c <| x",
           "Café café CAFÉ É ÀÖØö÷×ß ẞ İ ǅ", "x y z　w\x1cq\x85r", "１２３ 12 3½ ² ٣", "日本語。テスト！", "—…“a”—,",
           "😀😀 a😀b", "w" * 5000, "word " * 3000, "a,b;c--d!?...", "\x00 \x01a\x7f", "naïve'S o'Clock", "é, É."]
    r = random.Random(2)
    odd += ["".join(r.choice("aB é'.,́ 1<|\nß—") for _ in range(60)) for _ in range(60)]
    docs = dict(enumerate(odd))
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in docs.items()],
                               "doc_id long, text string, length int, sequence_id string").repartition(3)
    rows = packing.pack(df, public_file(TOKENIZER), 512).collect()
    used, sequences = check(rows, docs, 512)
    assert sequences <= -(-used // 512) + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, public_file(TOKENIZER)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(r.offset for r in packing.pack(twice, public_file(TOKENIZER), 64).collect()) == [0, 3, 6]


def test_fill_is_the_best_subset_sum():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        capacity = r.randint(1, 70)
        got = packing.fill(counts, capacity)
        assert all(k <= counts[x] for x, k in got)
        best = max(s for s in (sum(x * k for x, k in zip(counts, ks)) for ks in
                   itertools.product(*(range(n + 1) for n in counts.values()))) if s <= capacity)
        assert sum(x * k for x, k in got) == best


def test_plan_places_every_piece_once():
    r = random.Random(6)
    counts = {r.randint(1, 99): r.choice((1, 2, 40, 10**9)) for _ in range(40)}
    used = collections.Counter()
    for times, chosen in packing.plan(counts, 100):
        assert sum(x * k for x, k in chosen) <= 100
        for x, k in chosen:
            used[x] += times * k
    assert used == collections.Counter(counts)
