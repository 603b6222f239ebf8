"""Minimum-bin-slack packing of tokenised documents into fixed windows.

A document of ``capacity`` tokens or more gives full windows of its own; what is left of every document (1 to
``capacity - 1`` tokens) is one piece.  Only the *histogram* of piece lengths decides the packing, so the plan is made
on at most ``capacity - 1`` numbers, however many documents there are: for the longest length left, a subset-sum
dynamic programme over the multiset of remaining lengths (bit ``s`` of a big integer: sum ``s`` can be reached) finds
the filling closest to the window's end; backtracking through the stages gives how many pieces of each length it
takes; and the filling is repeated as often as the counts allow.  Every step uses a length up, so the number of
fillings is bounded by the number of lengths.

Pieces then learn their place by rank: the r-th piece of a length goes where the plan put the r-th piece of that
length.  Ranks come from counts per written file and length, so no task sees all pieces of a length.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwise.llm.arrow import chunks
from ringwise.session import files, stored

#: Words, and as many words without their punctuation, whose ids a worker keeps in each of two generations.
CACHE_WORDS = 200_000


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Lengths with how many of each (from ``counts``) whose sum is the largest not over ``capacity``."""
    reach, stages = 1, []
    full = 1 << capacity
    for length in sorted(counts, reverse=True):
        most = min(counts[length], capacity // length)
        if most <= 0:
            continue
        stages.append((length, most, reach))
        step, left = 1, most
        while left > 0:  # 1, 2, 4, ... pieces of this length, then the rest: every number up to `most`
            take = min(step, left)
            reach |= reach << (take * length)
            left -= take
            step *= 2
        reach &= (full << 1) - 1
        if reach & full:
            break
    best, out = reach.bit_length() - 1, []
    for length, most, before in reversed(stages):
        k = next(k for k in range(most + 1) if best >= k * length and before >> (best - k * length) & 1)
        if k:
            out.append((length, k))
            best -= k * length
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings in order, each with how often it is used: every piece is placed exactly once.

    Each filling holds the longest length left; the subset-sum fills the rest of the window.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = dict(fill({k: v for k, v in rest.items() if v and k <= capacity - longest}, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((times, sorted(chosen.items(), reverse=True)))
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def places(fillings: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset) in order of rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, chosen in fillings:
        offset = 0
        for length, k in chosen:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, k, offset))
            used[length] = rank + times * k
            offset += length * k
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


class Recent(dict):
    """Results of ``make`` by key.  A full generation becomes the old one; keys still in use move up from there."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes; equal to encoding the whole text at once.

    White space always ends a token of this tokenizer family, so a text is the concatenation of its words' ids, and
    each distinct word is tokenised once per worker.  Words of Latin letters with trailing ASCII punctuation are
    tokenised as letters and punctuation apart, which this vocabulary's rule also does.  Any text in which a special
    token is written out is encoded as a whole.
    """

    def __init__(self, tokenizer_json: str):
        import re

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.core = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.as_char = {b: chr(b) if b in printable else chr(next(other)) for b in range(256)}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Recent(self._word, CACHE_WORDS)
        self.cores = Recent(self._core, CACHE_WORDS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, word: bytes) -> bytes:
        if word.isascii():
            plain = word.decode()
        else:
            plain = word.decode().lower().encode().decode("latin-1").translate(self.as_char)
        tokens = self.tokenizer.model.tokenize(plain)
        return b"".join([self.as_bytes[t.id] for t in tokens])

    def _word(self, word: bytes) -> bytes:
        m = self.core.fullmatch(word)
        if not m:
            return self._whole(word.decode())
        return self.cores[m[1]] + (self.words[m[2]] if m[2] else b"")

    def forget(self) -> None:
        for kept in (self.words, self.cores):
            kept.clear()
            kept.old = {}

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._whole(text.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def encoder_of(tokenizer_json: str) -> Encoder:
    """The worker's encoder, kept from task to task; a task forgets its words when it ends, as idle workers add up."""
    held = sys.modules.setdefault("_ringwise_encoders", types.ModuleType("_ringwise_encoders")).__dict__
    key = str(zlib.crc32(tokenizer_json.encode())) + str(len(tokenizer_json))
    if key not in held:
        held[key] = Encoder(tokenizer_json)
    return held[key]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece, with its rank among the task's pieces of its length.

    ``doc_id, start, length, ids_crc32, doc_tokens, full`` (a whole window), ``file`` (task), ``rank``.
    """
    tokenizer_json = Path(tokenizer_file).read_text()  # read once on the driver; executors need no file
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, full boolean, file int, "
              "rank long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_json)
        end = np.array([end_id], "<u4").tobytes()
        ranks: dict[int, int] = {}
        file = TaskContext.get().partitionId()
        window = 4 * capacity
        for batch in batches:
            for part, texts in chunks(batch):
                out: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    ids = memoryview(encoder.encode(text) + end)
                    n = len(ids) // 4
                    for a in range(0, len(ids), window):
                        piece = ids[a:a + window]
                        size = len(piece) // 4
                        rank = ranks.get(size, 0)
                        ranks[size] = rank + 1
                        out.append((doc_id, a // 4, size, zlib.crc32(piece), n, size == capacity, file, rank))
                cols = list(zip(*out)) if out else [()] * 8
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "full",
                                                        "file", "rank"])
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` -> per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Ids are the tokenizer's, without special tokens, then ``end_id``; a null or empty text is that one id.  Every id
    lies in exactly one piece; pieces of a sequence follow each other without gaps from offset 0.  Rows are packed as
    they come: repeated or null doc_ids are packed each, other columns are ignored.
    """
    cut = stored(pieces(docs, tokenizer_file, capacity, end_id))
    # how many pieces of a length the files before have: rank within the file -> rank among all
    per_file = cut.groupBy("length", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    n_files = files(cut.count())
    starts = stored(per_file.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(n_files))
    totals = {r["length"]: r["n"] for r in  # at most `capacity` rows
              starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = totals.pop(capacity, 0)
    table = places(plan(totals, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            length = t.column("length").to_numpy()
            rank = t.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own, size = order[a:b], int(length[order[a]])
                if size == capacity:
                    sequence[own] = rank[own]
                    continue
                rows = table[size]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                turn, index = np.divmod(rank[own] - row[:, 0], row[:, 2])
                sequence[own] = whole + row[:, 1] + turn
                offset[own] = row[:, 3] + index * size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    # one row per task and length grows with the data: a sort-merge join, never a broadcast
    ranked = (cut.join(starts.select("length", "file", "before").hint("merge"), ["length", "file"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("rank") + F.col("before")).cast("long").alias("rank")).coalesce(n_files))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long")
