"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton accepts every substring of every item's word sequence.  A document's words are streamed through it; the
state and the length of the longest match that ends at each word are tracked.  A word is *hit* when it lies inside an
occurrence of a window (``window`` consecutive words of an item; an item with fewer words is one window by itself):
at every word where the match is at least ``window`` long, the last ``window`` words are hit, and a short item is hit
where its whole sequence is a suffix of the match.

Most words never reach the automaton: only runs of words in which every neighbouring pair of words is a pair of some
item can hold a window, and those runs are found by vectorised lookups.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, one automaton each, so what travels to the executors is
bounded; every block is one more pass over the documents, whose spans are united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwise.llm.arrow import chunks

#: Item words in one automaton.
BLOCK_WORDS = 2_000_000

#: Bytes of a word: digits, letters (A-Z as a-z) and everything beyond ASCII; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids, with what a window or a short item that ends in a state hits."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[int]] = []
        self.ids = [i for i, _ in items]
        sequences = []
        for _, words in items:
            seq = [self.words.setdefault(w, len(self.words)) for w in words]
            sequences.append(seq)
            last, states = 0, []
            for w in seq:
                last = self._extend(last, w)
                states.append(last)
            ends.append(states)
        n = len(self.len)
        # items whose windows end in a state: every item passes its states up the links to the state of length `window`
        self.at_window: list[int] = self._lift()
        owners: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, (seq, states) in enumerate(zip(sequences, ends)):
            if len(seq) >= window:
                for s in states[window - 1:]:
                    owners.setdefault(self.at_window[s], set()).add(k)
            elif seq:
                self.short.setdefault(states[-1], []).append((len(seq), k))
        self.owners = {s: tuple(sorted(x)) for s, x in owners.items()}
        self.least = min([window if len(s) >= window else len(s) for s in sequences if s], default=window)
        # nearest state on the way up (itself included) where a short item ends
        self.up_short = [-1] * n
        if self.short:
            for s in sorted(range(n), key=self.len.__getitem__):
                self.up_short[s] = s if s in self.short else (self.up_short[self.link[s]] if s else -1)
        pairs = {(a, b) for seq in sequences for a, b in zip(seq, seq[1:])}
        self.pairs = np.unique(np.array([a * len(self.words) + b for a, b in pairs] or [-1], np.int64))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _lift(self) -> list[int]:
        """For each state of length >= window: the state up the links that holds the last `window` words; else -1."""
        out = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            if self.len[s] >= self.window:
                up = self.link[s]
                out[s] = out[up] if up > 0 and self.len[up] >= self.window else s
        return out

    def stream(self, ids: list[int], start: int, spans: list[list[int]], items: set[int]) -> None:
        """Feed words; adds hit spans [from, to) (merged, in order of end) and the items that occur."""
        state, matched = 0, 0
        nxt, link, length = self.next, self.link, self.len
        for at, w in enumerate(ids, start):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            back = 0
            if matched >= self.window:
                back = self.window
                items.update(self.owners.get(self.at_window[state], ()))
            s = self.up_short[state] if self.short else -1
            while s > 0:
                for size, k in self.short[s]:
                    if size <= matched:
                        back = max(back, size)
                        items.add(k)
                s = self.up_short[link[s]]
            if back:
                a = at + 1 - back
                if spans and spans[-1][1] >= a:
                    a = min(a, spans[-1][0])
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                spans.append([a, at + 1])

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        spans: list[list[int]] = []
        items: set[int] = set()
        if len(words) < self.least:
            return spans, items
        ids = np.array(list(map(self.words.get, words, [-1] * len(words))), np.int64)
        if self.least == 1:
            runs = [(0, len(ids))]
        else:
            pair = ids[:-1] * len(self.words) + ids[1:]
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            ok = (self.pairs[near] == pair) & (ids[:-1] >= 0) & (ids[1:] >= 0)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
            runs = [(a, b + 1) for a, b in zip(edge[::2], edge[1::2]) if b - a + 1 >= self.least]
        for a, b in runs:
            self.stream(ids[a:b].tolist(), int(a), spans, items)
        return spans, items


def _union(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(benchmark: DataFrame, window: int) -> Iterator[Automaton]:
    """Automata over ``benchmark(item_id, text)`` in order of item_id, each of at most BLOCK_WORDS words (or one item)."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        words = normal_words(r["text"].encode("utf-8", "replace"))
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((r["item_id"] or "", words))
        size += len(words)
    if block:
        yield Automaton(block, window)


_SPANS = "array<struct<a:int,b:int>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, then=None, schema=None) -> DataFrame:
    """``docs`` with ``_dc_words int``, ``_dc_spans`` (hit word ranges [a, b), disjoint, in order), ``_dc_items`` (ids).

    All columns of ``docs`` stay; they may have any names but these.  Null text has no words.  Item ids are compared
    as strings; repeated items count once by id; a null id is the empty string.  ``then`` takes the last pass's batches
    on to rows of ``schema``, in the same worker.
    """
    out = docs.select("*", F.lit(0).alias("_dc_words"), F.array().cast(_SPANS).alias("_dc_spans"),
                      F.array().cast("array<string>").alias("_dc_items"))
    blocks = list(item_blocks(benchmark, window)) or [Automaton([], window)]
    for automaton in blocks:
        def run(batches: Iterator[pa.RecordBatch], auto=automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in chunks(batch):
                    counts, spans, items = [], [], []
                    old = zip(part.column("_dc_spans").to_pylist(), part.column("_dc_items").to_pylist())
                    for text, (before, seen) in zip(texts, old):
                        words = normal_words(text)
                        found, own = auto.find(words)
                        counts.append(len(words))
                        spans.append([{"a": a, "b": b} for a, b in
                                      _union([*((x["a"], x["b"]) for x in before), *found])])
                        items.append(sorted({*seen, *(auto.ids[k] for k in own)}))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-3], pa.array(counts, pa.int32()),
                         pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                         pa.array(items, pa.list_(pa.string()))], names=part.schema.names)

        if then is not None and automaton is blocks[-1]:
            return out.mapInArrow(lambda batches, run=run: then(run(batches)), schema)
        out = out.mapInArrow(run, out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = scan(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("_dc_spans", F.lit(0), lambda t, x: t + x["b"] - x["a"]).cast("long")
    return found.select(
        "doc_id", F.col("_dc_words").cast("long").alias("n_words"), hit.alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_dc_items")).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, longest: int = 9,
                  coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages.

    Hit spans longer than ``longest`` words are cut out of the text, with the separators that follow each of their
    words; a document of whose words more than ``coverage`` are hit is dropped.  Other texts stay as they are,
    and ``n_chars``, if there is one, is counted anew for changed texts.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                at = part.schema.get_field_index("text")
                stay, out, dirty = [], [], []
                for text, null, n, spans in zip(texts, part.column("text").is_null().to_pylist(),
                                                part.column("_dc_words").to_pylist(), part.column("_dc_spans").to_pylist()):
                    stay.append(sum(x["b"] - x["a"] for x in spans) <= n * coverage)
                    if not stay[-1]:
                        continue
                    spans = [(x["a"], x["b"]) for x in spans if x["b"] - x["a"] > longest]
                    dirty.append(bool(spans))
                    out.append(None if null else _cut(text, spans).decode("utf-8", "replace") if spans
                               else text.decode("utf-8", "replace"))
                mask = pa.array(stay, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out, pa.string()) if i == at else c.filter(mask) for i, c in enumerate(part.columns[:-3])]
                    + [pa.array(dirty, pa.bool_())], names=[*part.schema.names[:-3], "_dc_dirty"])

    # found and cut by one worker: another one for each task would stay in the executor's memory
    out = scan(docs, benchmark, window, cut, T.StructType([*docs.schema.fields, T.StructField("_dc_dirty", T.BooleanType())]))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_dc_dirty"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*names)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the words of the spans; what separates a cut word from the next one goes with it."""
    fold = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    starts = np.flatnonzero(fold & ~np.concatenate([[False], fold[:-1]]))
    keep = np.ones(len(text), bool)
    for a, b in spans:
        keep[starts[a]:starts[b] if b < len(starts) else len(text)] = False
    return np.frombuffer(text, np.uint8)[keep].tobytes()
