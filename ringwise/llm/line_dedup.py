"""Incremental line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased; lines whose key has fewer than
``LEAST`` code points are never touched.  The index has three tables, each version of which is kept:

* ``postings(doc_id, key)``: the distinct keys of every document;
* ``refs(key, refs, first_doc)``: exactly how many documents hold a key, and the smallest of them;
* ``filters(shard, slots)``: per shard a cuckoo filter of the keys in ``refs``, four 16-bit fingerprints a bucket.

``insert`` pre-aggregates a batch by key and shows every shard's keys to its filter: a key the filter does not know is
new and is appended to ``refs`` unseen; only the others meet the exact table, which also settles false alarms.  ``delete``
takes the documents' postings out of the counts, removes from the filters every key that nobody holds any more (what a
Bloom filter cannot do) and looks up the next smallest holder where the first one went.  ``apply`` drops a document's
lines whose key has a smaller holder.  Filters grow from ``refs`` when a shard would pass its load.

A key held by very many documents is one row of ``refs``; in ``apply`` the at most ``HOT`` keys that hold more than a
``1 / HOT`` share of all postings are sent to every task, so no join key has more rows than that share.

Defined results: null or empty text is one empty line; a row without an id stays whole and holds no line; rows that
repeat an id are the same holder, each loses the same lines; inserting an id again counts again until it is deleted;
deleting an unknown id changes nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ringwise.llm.arrow import chunks, mix
from ringwise.session import stored

#: Fewest code points of a key that counts, and the white space stripped from both ends of a line (fixed values).
LEAST, BLANK = 10, b" \t\n\x0b\x0c\r"
#: Keys a shard is sized for, and fingerprints of a bucket.
SHARD_KEYS, WIDTH = 1 << 17, 4
#: Highest share of a shard's slots that may be taken, and kicks after which an insertion gives up.
LOAD, KICKS = 0.8, 2000
#: Bound on the keys that ``apply`` sends to every task.
HOT = 10_000


# ---------------------------------------------------------------- cuckoo filter

class Cuckoo:
    """Cuckoo filter over 16-byte keys; a bucket's fingerprints lie left-aligned, 0 is free.  All methods take arrays."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots, np.uint64(len(slots) - 1)

    @classmethod
    def empty(cls, buckets: int) -> Cuckoo:
        return cls(np.zeros((buckets, WIDTH), dtype=np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, dtype=np.uint16).reshape(-1, WIDTH).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket; ``keys`` is an (n, 2) array of unsigned 64-bit halves."""
        return ((keys[:, 0] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)), (keys[:, 1] & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.uint64) ^ (mix(mark) & self.mask)).astype(np.int64)

    def knows(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._place(keys)
        there = self._other(at, mark)
        return ((self.slots[at] == mark[:, None]) | (self.slots[there] == mark[:, None])).any(axis=1)

    def add(self, keys: np.ndarray) -> None:
        mark, at = self._place(keys)
        for turn in range(KICKS):
            if not len(mark):
                return
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            slot = (self.slots[at] != 0).sum(axis=1) + rank
            fits = slot < WIDTH
            self.slots[at[fits], slot[fits]] = mark[fits]
            left = ~fits
            mark, at, rank = mark[left], at[left], rank[left]
            if turn:
                # one newcomer a bucket takes the place of an older fingerprint, which moves on
                kick = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else rank
                victim = (turn + at[kick]) % WIDTH
                out = self.slots[at[kick], victim].copy()
                self.slots[at[kick], victim] = mark[kick]
                mark[kick] = out
            at = self._other(at, mark)
        raise RuntimeError("cuckoo filter over its load: give the shard more buckets")

    def remove(self, keys: np.ndarray) -> None:
        mark, at = self._place(keys)
        tried = np.zeros(len(mark), dtype=np.int8)
        while len(mark):
            _, pick = np.unique(at, return_index=True)
            hit = self.slots[at[pick]] == mark[pick][:, None]
            found = hit.any(axis=1)
            b, hole = at[pick[found]], hit[found].argmax(axis=1)
            last = (self.slots[b] != 0).sum(axis=1) - 1
            self.slots[b, hole] = self.slots[b, last]
            self.slots[b, last] = 0
            lost = pick[~found]
            tried[lost] += 1
            if (tried > 1).any():
                raise RuntimeError("a key to be removed is not in the filter")
            at[lost] = self._other(at[lost], mark[lost])
            rest = np.ones(len(mark), dtype=bool)
            rest[pick[found]] = False
            mark, at, tried = mark[rest], at[rest], tried[rest]


def _halves(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, 2)


# ---------------------------------------------------------------- lines and keys

def line_key(line: bytes) -> bytes | None:
    """Digest of a line's key; None where the key is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, key)``: the distinct keys of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in chunks(b):
                row, keys = [], []
                for i, text in enumerate(texts):
                    here = {line_key(x) for x in text.split(b"\n")}
                    here.discard(None)
                    row += [i] * len(here)
                    keys += sorted(here)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())),
                                                  pa.array(keys, pa.binary())], names=["doc_id", "key"])
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary")


# ---------------------------------------------------------------- index

def _sift(cuckoo: Cuckoo, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may know; the others are added."""
    known = cuckoo.knows(keys)
    cuckoo.add(keys[~known])
    return known


def _add(cuckoo: Cuckoo, keys: np.ndarray) -> np.ndarray:
    cuckoo.add(keys)
    return np.ones(len(keys), dtype=bool)


def _remove(cuckoo: Cuckoo, keys: np.ndarray) -> np.ndarray:
    cuckoo.remove(keys)
    return np.ones(len(keys), dtype=bool)


def _power(n: float) -> int:
    p = 1
    while p < n:
        p *= 2
    return p


@dataclass(frozen=True)
class LineIndex:
    """One version of the index; ``insert`` and ``delete`` give the next one and leave this one as it is."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int = 1
    buckets: int = 1

    @classmethod
    def empty(cls, spark: SparkSession, id_type: str = "long") -> LineIndex:
        return cls(spark.createDataFrame([], f"doc_id {id_type}, key binary"),
                   spark.createDataFrame([], f"key binary, refs long, first_doc {id_type}"),
                   spark.createDataFrame([], "shard int, slots binary"))

    def _shown(self, rows: DataFrame, work) -> DataFrame:
        """``work(cuckoo, keys)`` on every shard's rows ``(key, n, first_doc)``: the rows with its answer as ``known``,
        and per shard one row with the filter's new ``slots``."""
        buckets, id_type = self.buckets, dict(rows.dtypes)["first_doc"]
        kinds = [pa.binary(), pa.int64(), to_arrow_type(rows.schema["first_doc"].dataType)]

        def run(key: tuple, table: pa.Table, held: pa.Table) -> pa.Table:
            cuckoo = Cuckoo.load(held.column("slots")[0].as_py()) if held.num_rows else Cuckoo.empty(buckets)
            n, known, cols = table.num_rows, [], [pa.nulls(1, kind) for kind in kinds]
            if n:  # a side without rows may come without columns
                table = table.sort_by("key")
                raw = b"".join(table.column("key").to_pylist())
                known = work(cuckoo, np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2))
                cols = [pa.concat_arrays([table.column(c).combine_chunks(), blank])
                        for c, blank in zip(("key", "n", "first_doc"), cols)]
            return pa.table([pa.repeat(key[0], n + 1), *cols, pa.array([*map(bool, known), None], pa.bool_()),
                             pa.array([None] * n + [cuckoo.dump()], pa.binary())],
                            names=["shard", "key", "n", "first_doc", "known", "slots"])
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        return stored(rows.select(shard.alias("shard"), "key", "n", "first_doc").groupBy("shard")
                      .cogroup(self.filters.groupBy("shard"))
                      .applyInArrow(run, f"shard int, key binary, n long, first_doc {id_type}, known boolean, slots binary"))

    def _with_filters(self, rows: DataFrame, work) -> LineIndex:
        return replace(self, filters=_filters(self._shown(rows, work)))

    def _room_for(self, keys: int) -> LineIndex:
        """This index with filters that hold so many keys below their load; they are rebuilt from ``refs`` where needed."""
        shards = max(self.shards, _power(keys / SHARD_KEYS))
        each = keys / shards
        buckets = max(self.buckets, _power((each + 6 * each ** 0.5 + 16) / (WIDTH * LOAD)))
        if (shards, buckets) == (self.shards, self.buckets):
            return self
        bare = replace(self, shards=shards, buckets=buckets, filters=self.filters.limit(0))
        return bare._with_filters(self.refs.select("key", F.col("refs").alias("n"), "first_doc"), _add)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of ``docs(doc_id, text)`` added."""
        lines = stored(line_keys(docs))
        new = stored(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")))
        here = self._room_for(self.refs.count() + new.count())
        shown = here._shown(new, _sift)
        here = replace(here, filters=_filters(shown))
        asked = shown.where("known").select("key", "n", F.col("first_doc").alias("_first"))
        fresh = shown.where("not known").select("key", F.col("n").alias("refs"), "first_doc")
        merged = stored(here.refs.join(asked, "key", "full_outer").select(
            "key", (F.coalesce("refs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("refs"),
            F.least("first_doc", "_first").alias("first_doc"), F.col("refs").isNull().alias("_alarm"),
            F.coalesce("n", F.lit(0)).alias("n")))
        # a false alarm is a new key after all: its fingerprint has to be there when it is removed one day
        alarms = merged.where("_alarm").select("key", "n", "first_doc")
        if not alarms.isEmpty():
            here = here._with_filters(alarms, _add)
        return replace(here, postings=self.postings.unionByName(lines),
                       refs=merged.select("key", "refs", "first_doc").unionByName(fresh))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids(doc_id)``."""
        ids = stored(ids.select("doc_id").where("doc_id is not null").distinct())
        rest = stored(self.postings.join(ids, "doc_id", "left_anti"))
        out = self.postings.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        touched = stored(self.refs.join(out, "key").select("key", (F.col("refs") - F.col("n")).alias("refs"), "n", "first_doc"))
        alive = touched.where("refs > 0").select("key", "refs", "first_doc")
        orphans = alive.join(ids.select(F.col("doc_id").alias("first_doc")), "first_doc", "left_semi").select("key")
        heirs = rest.join(orphans, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("_heir"))
        refs = (self.refs.join(touched.select("key"), "key", "left_anti")
                .unionByName(alive.join(heirs, "key", "left").select(
                    "key", "refs", F.coalesce("_heir", "first_doc").alias("first_doc"))))
        dead = touched.where("refs = 0").select("key", "n", "first_doc")
        return replace(self, postings=rest, refs=stored(refs))._with_filters(dead, _remove)

    def losses(self, lines: DataFrame | None = None) -> DataFrame:
        """``(doc_id, keys)``: the keys a document loses because a document with a smaller id holds them."""
        lines = self.postings if lines is None else lines
        shared = self.refs.where("refs > 1")
        least = (self.refs.agg(F.sum("refs")).first()[0] or 0) // HOT
        hot = F.broadcast(shared.where(F.col("refs") > least).select("key", "first_doc"))
        cold = shared.where(F.col("refs") <= least).select("key", "first_doc")
        met = lines.join(hot, "key").unionByName(lines.join(hot, "key", "left_anti").join(cold, "key"))
        return met.where("doc_id <> first_doc").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """``(doc_id, kept, n_lines, n_dropped)`` of every row; ``lines`` are its postings where they are at hand."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in (x for b in batches for x in chunks(b)):
                kept, count, dropped = [], [], []
                for text, keys in zip(texts, part.column("keys").to_pylist()):
                    lines_, keys = text.split(b"\n"), set(keys or ())
                    stay = [x for x in lines_ if line_key(x) not in keys] if keys else lines_
                    kept.append(b"\n".join(stay))
                    count.append(len(lines_))
                    dropped.append(len(lines_) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()),
                     pa.array(dropped, pa.int64())], names=["doc_id", "kept", "n_lines", "n_dropped"])
        rows = docs.select("doc_id", "text")
        met = (rows.where("doc_id is not null")
               .join(self.losses(line_keys(docs) if lines is None else lines), "doc_id", "left")
               .unionByName(rows.where("doc_id is null").withColumn("keys", F.lit(None).cast("array<binary>"))))
        return met.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, kept string, n_lines long, n_dropped long")


def _filters(shown: DataFrame) -> DataFrame:
    return shown.where("slots is not null").select("shard", "slots")


def dedup_lines(docs: DataFrame, blocks: int = 2) -> DataFrame:
    """Every row of ``docs`` without the lines that a smaller id holds.

    The documents enter an empty index in ``blocks`` hashed blocks, so that the filters of the earlier ones decide which
    keys of the next must meet the exact table.
    """
    index = LineIndex.empty(docs.sparkSession, dict(docs.dtypes)["doc_id"])
    block: Column = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    for i in range(blocks):
        index = index.insert(docs.where(block == i))
    return index.apply(docs, index.postings)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.*, coalesce(doc_id <> first_doc, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id"""
