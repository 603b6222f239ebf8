"""Exact n-gram Jaccard self-join of documents, by size-banded tiles and hashed bitmap signatures.

A document is the set of its distinct word shingles (64-bit hashes).  Two documents link when
``100 * |intersection| >= threshold * |union|``.

*Tiles.*  A pair that links differs in at most ``D(s) = s * (100 - threshold) / threshold`` shingles, ``s`` being the
smaller size.  Sizes are cut into bands; a band with largest size ``S`` deals the universe of shingles into more than
``D(S)`` parts by hash, so two linked documents agree completely in at least one non-empty part (by counting: the
differing shingles touch at most D parts).  One part's content within one band is a tile key; documents meet only in a
tile.  A document takes the keys of its own band and of the lower bands a linked smaller partner could lie in.  In the
rare case that so many parts of both are empty that the counting would not hold, empty parts are keys as well.  No
link is lost; random neighbours do not meet, because a key needs many equal shingles, not one.

*Rare keys first.*  Linked documents have all but ``D`` of their non-empty parts in common.  With the keys of a band in
one order, rarest first, each of the two therefore holds their first common key among its ``D + 1`` first ones, so a
document enters only those tiles; keys that only it has come first and need no tile at all.  Bands deal more parts than
counting needs, so what many documents share (a passage) is what is left out.  Sets with too few non-empty parts for the
counting enter all tiles.

*Signatures.*  Each set is also hashed into a bitmap.  A bit of A that B lacks stands for a shingle of A that B lacks,
so ``|A and B| <= |A| - bits(A & ~B)``, and the same for B; pairs whose bound is too low are dropped before their texts
are fetched.  What remains is decided by intersecting the two sorted shingle arrays.

*Links instead of all pairs.*  First every document is tested against the smallest id of its tiles only (a star), and
the links found are joined to components.  Then only tiles that still hold two components are looked at: their rows are
dealt into blocks, every block meets every other block of its tile in a task of its own, and pairs of different
components that pass the bound are tested exactly.  Equal sets are one node throughout.  So a group of copies costs
its size, not its square, and yet every link between different components is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.llm.arrow import chunks, mix, word_hashes
from ringwise.llm.components import connected_components
from ringwise.session import few, files, stored

#: 64-bit words of a bitmap signature.
BITMAP_WORDS = 16
#: Bits of the filter that keeps texts without a tile partner out of the text join (1 MB).
FILTER_BITS = 1 << 23
#: Texts that fill a file.
FILE_TEXTS = 5000
#: Rows of a tile's block: a task compares two blocks.
BLOCK = 512
#: A band's largest size over its smallest.
BAND = 1.5
#: Parts dealt beyond the D + 2 that counting needs, as a share of D: so many frequent keys a document can leave out.
SPARE = 0.5
_U = np.uint64
_ODD = mix(np.arange(1, 9, dtype=np.uint64)) | _U(1)


def bands(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest size of every band, and the largest number of differing shingles of a linked pair whose smaller is in it."""
    tops, top = [], 1
    while (top + 1) * (100 - threshold) // threshold == 0:
        top += 1
    while len(tops) < 63 and top < 1 << 34:  # a set of over 10^10 shingles is beyond a row
        tops.append(top)
        top = max(top + 1, int((top + 1) * BAND))
    tops = np.array(tops, np.int64)
    return tops, tops * (100 - threshold) // threshold


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a word-hash sequence; a shorter sequence is one shingle; none without words."""
    if not len(words):
        return words
    if len(words) < n:
        return mix((words * _ODD[:len(words)]).sum(dtype=np.uint64, keepdims=True) ^ (_ODD[7:] + _U(len(words))))
    size = len(words) - n + 1
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += words[j:j + size] * _ODD[j]
    return np.unique(mix(total))


def tile_keys(s: np.ndarray, threshold: int, tops: np.ndarray, differ: np.ndarray
              ) -> tuple[np.ndarray, list[int], list[int]]:
    """Keys of the tiles that a set lies in: one for each non-empty part of each band it can be linked in.

    The band is in a key's top six bits.  Also the bands, and how many non-empty parts the set has in each.
    """
    n = len(s)
    low = np.searchsorted(tops, -(-n * threshold // 100))
    out, used, fulls = [np.zeros(0, np.uint64)], [], []
    for band in range(int(low), int(np.searchsorted(tops, n)) + 1):
        d = int(differ[band])
        if d == 0:
            continue  # only equal sets link
        parts = d + 2 + int(d * SPARE)
        part = (s % _U(parts)).astype(np.int64)
        g = mix(s + _U(band))
        if n < 1 << 20:  # sums of 32-bit halves are exact in doubles
            lo = np.bincount(part, (g & _U(0xFFFFFFFF)).astype(float), parts).astype(np.uint64)
            hi = np.bincount(part, (g >> _U(32)).astype(float), parts).astype(np.uint64)
        else:
            lo, hi = np.zeros(parts, np.uint64), np.zeros(parts, np.uint64)
            np.add.at(lo, part, g & _U(0xFFFFFFFF))
            np.add.at(hi, part, g >> _U(32))
        full = np.bincount(part, minlength=parts) > 0
        keys = mix(lo + hi * _ODD[4] + np.arange(1, parts + 1, dtype=np.uint64) * _ODD[5] + np.array([band + 1], np.uint64) * _ODD[6:7])
        keys = keys >> _U(6) | _U(band) << _U(58)
        count = int(full.sum())
        out.append(keys[full] if count > d else keys)
        used.append(band)
        fulls.append(count)
    return np.concatenate(out), used, fulls


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
    bits[(mix(s) % _U(BITMAP_WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection from bitmaps [..., words] and sizes."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def links(inter, na, nb, threshold: int):
    return 100 * inter >= threshold * (na + nb - inter)


def _sets(n: int):
    """Per chunk of a batch: (the slice, list of sorted shingle arrays)."""
    def each(batch: pa.RecordBatch, name: str = "text"):
        for part, texts in chunks(batch, name):
            words, at = word_hashes(texts)
            yield part, [shingles(words[a:b], n) for a, b in zip(at, at[1:])]
    return each


def signatures(docs: DataFrame, n: int = 3, threshold: int = 90) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, d1, d2, bits, keys``: size, 128-bit digest, bitmap, tile keys; and
    ``bands``, ``fulls``: the bands it has keys of and its non-empty parts there."""
    tops, differ = bands(threshold)
    sets = _sets(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in sets(batch):
                size = np.array([len(s) for s in found], np.int64)
                d1 = np.array([s.sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
                d2 = np.array([mix(s ^ _ODD[3]).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
                tiles = [tile_keys(s, threshold, tops, differ) if len(s) else (s, [], []) for s in found]
                keys = [k for k, _, _ in tiles]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(d1), pa.array(d2),
                     pa.array([bitmap(s) for s in found], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([b for _, b, _ in tiles], pa.list_(pa.int32())),
                     pa.array([f for _, _, f in tiles], pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bits", "keys", "bands", "fulls"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bits binary, keys array<long>, "
             "bands array<int>, fulls array<int>")


def _words64(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)


def bounded(pairs: DataFrame, sig: DataFrame, threshold: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose bitmaps do not rule a link out."""
    s = sig.select("doc_id", "n_shingles", "bits")
    both = (pairs.join(s.toDF("a", "na", "ba"), "a").join(s.toDF("b", "nb", "bb"), "b"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
                ok = links(bound(_words64(t.column("ba")), _words64(t.column("bb")), na, nb), na, nb, threshold)
                yield t.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def exact(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Of ``pairs(a, b)`` those that link, by intersecting their sorted shingle arrays."""
    sets = _sets(n)

    def run(batches):
        for t in batches:
            other = [s for _, found in sets(t, "tb") for s in found]
            at = 0
            keep = []
            for _, found in sets(t, "ta"):
                for s in found:
                    o = other[at]
                    at += 1
                    inter = len(np.intersect1d(s, o, assume_unique=True))
                    keep.append(bool(len(s) and links(inter, len(s), len(o), threshold)))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
            .select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _tile_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """``rows(tile, i, j, block, node, component, n_shingles, bits, band)`` -> pairs (a, b) of two components that may link.

    Rows come sorted by (tile, i, j); each such run holds two blocks at most (one if i = j).  A pair is looked at in the
    tiles of its smaller set's band; sizes and bitmaps must not rule it out.
    """
    tops, _ = bands(threshold)

    def run(batches):
        def meet(t: pa.Table):
            node = t.column("node").to_numpy()
            comp = t.column("component").to_numpy()
            size = t.column("n_shingles").to_numpy()
            bits = _words64(t.column("bits").combine_chunks())
            block = t.column("block").to_numpy()
            i, j, band = (t.column(c)[0].as_py() for c in ("i", "j", "band"))
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for a in range(0, len(left), 64):
                own = left[a:a + 64]
                inter = bound(bits[own, None], bits[None, right], size[own, None], size[None, right])
                ok = links(inter, size[own, None], size[None, right], threshold)
                ok &= comp[own, None] != comp[None, right]
                ok &= np.searchsorted(tops, np.minimum(size[own, None], size[None, right])) == band
                if i == j:
                    ok &= node[own, None] < node[None, right]
                x, y = np.nonzero(ok)
                if len(x):
                    u, v = node[own[x]], node[right[y]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = np.stack([t.column(c).to_numpy() for c in ("tile", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if held and last != tuple(key[a]):
                    yield from meet(pa.concat_tables(held))
                    held = []
                held.append(t.slice(a, b - a))
                last = tuple(key[a])
        if held:
            yield from meet(pa.concat_tables(held))

    return (rows.select("tile", "i", "j", "block", "node", "component", "n_shingles", "bits", "band")
            .repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
            .mapInArrow(run, "a long, b long").distinct())


def may_hold(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: true where ``ids(doc_id)`` holds their doc_id, false for most others.

    A hashed bitmap of FILTER_BITS bits whatever the number of ids, sent to every task as a table of 63-bit words (2 MB at
    most); with very many ids more rows pass, and the exact join behind it takes longer.
    """
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    words = stored(ids.select(bit.alias("b")).selectExpr("b div 63 as _w", "shiftleft(1L, cast(b % 63 as int)) as v")
                   .groupBy("_w").agg(F.bit_or("v").alias("_v")).coalesce(files(FILTER_BITS // 63)))
    return (rows.withColumn("_b", bit).withColumn("_w", F.expr("_b div 63")).join(F.broadcast(words), "_w", "left")
            .withColumn("maybe", F.expr("coalesce(getbit(_v, cast(_b % 63 as int)) = 1, false)")).drop("_b", "_w", "_v"))


def linked(docs: DataFrame, n: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The stored ``signatures`` of ``docs(doc_id, text)``, and ``node, component`` of every document with a link."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signatures(docs, n, threshold))
    size = sig.count()
    nodes = sig.where("n_shingles > 0 and doc_id is not null")

    tops, differ = bands(threshold)
    # equal sets: one node, the smallest id
    same = (nodes.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").drop("c"))
    copies = stored(nodes.select("doc_id", "n_shingles", "d1", "d2").join(same, ["n_shingles", "d1", "d2"])
                    .where("doc_id <> node").select("doc_id", "node").distinct().coalesce(files(size)))

    # tiles with two documents or more, copies aside
    known = copies.select("doc_id").distinct()
    marked = may_hold(nodes, known)
    nodes = (marked.where("not maybe").unionByName(marked.where("maybe").join(known, "doc_id", "left_anti"))
             .drop("maybe"))
    over = "over (partition by key)"
    keyed = (nodes.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
             .selectExpr("node", "key", f"count(1) {over} as c", f"min(node) {over} as leader",
                         f"bit_xor(xxhash64(node)) {over} as members").where("c > 1")
             .withColumn("band", F.shiftrightunsigned("key", 58).cast("int")))
    # of a band's keys the rarest D + 1, those that no other document has being the first
    most = F.array(*[F.lit(int(d)) for d in differ])
    held = (nodes.select(F.col("doc_id").alias("node"), "n_shingles", F.explode(F.arrays_zip("bands", "fulls")).alias("b"))
            .select("node", F.col("b.bands").alias("band"), F.col("b.fulls").alias("full"),
                    F.least(F.expr(f"n_shingles * {100 - threshold} div {threshold}"), most[F.col("b.bands")]).alias("differ")))
    mine = "over (partition by node, band"
    rare = (keyed.join(held, ["node", "band"])
            .selectExpr("*", f"row_number() {mine} order by c, key) as nth", f"count(1) {mine}) as common")
            .where("full <= differ or nth <= differ + 1 - (full - common)"))
    # tiles of a band with the same members are one
    shared = stored(few(rare.groupBy("node", "leader", "c", "members", "band").agg(F.count(F.lit(1)).alias("keys"))
                        .select("node", "leader", F.xxhash64("leader", "c", "members", "band").alias("tile"), "band", "keys"),
                        files(4 * size)))

    meet = shared.select(F.col("node").alias("doc_id")).distinct()
    some = may_hold(docs, meet).where("maybe").drop("maybe").join(meet.hint("merge"), "doc_id", "left_semi")
    texts = stored(some.coalesce(1 + meet.count() // FILE_TEXTS))

    star = (shared.where("node <> leader").groupBy("node").agg(F.min("leader").alias("leader"))
            .select(F.col("leader").alias("a"), F.col("node").alias("b")))
    first = stored(few(exact(bounded(star, nodes, threshold), texts, n, threshold), files(size)))
    comp = connected_components(first.toDF("u", "v"), about=first.count())

    # tiles that still hold two components
    labelled = (shared.select("node", "tile", "band").join(comp, "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
    mixed = (labelled.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                          F.count(F.lit(1)).alias("c"))
             .where("lo <> hi").select("tile", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    rows = (labelled.join(mixed, "tile")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
            .join(nodes.select(F.col("doc_id").alias("node"), "n_shingles", "bits"), "node"))
    rest = stored(_tile_pairs(rows, threshold).coalesce(files(shared.count())))
    second = exact(rest, texts, n, threshold)

    edges = first.unionByName(second).toDF("u", "v")
    about = first.count() + rest.count() + copies.count()
    comp = connected_components(edges.unionByName(copies.toDF("u", "v")), about=about)
    return sig, stored(comp.coalesce(files(2 * about)))


def near_groups(docs: DataFrame, n: int = 3, threshold: int = 90) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links).

    Words are runs without ASCII white space, A-Z lower-cased.  A text with fewer than ``n`` words is one shingle; one
    without words (or null) has none and links with nothing.  ``doc_id`` is the document's key: rows that repeat it are
    answered each, and rows without it get their own size and a null component.  Other columns are ignored.
    """
    sig, comp = linked(docs, n, threshold)
    return (sig.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("component_id", F.coalesce("component", "doc_id"))
            .select("doc_id", "n_shingles", "component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without all but one document (the smallest doc_id) of each group of near copies.

    Of rows that repeat the kept doc_id, all stay only if they are the same document; rows without doc_id stay.
    """
    _, comp = linked(docs, n, threshold)
    gone = comp.where("component <> node").select(F.col("node").alias("doc_id"))
    # only texts that the filter lets through meet the ids; merged, so that the scan keeps its tasks
    rows = may_hold(docs.select("doc_id", F.struct("*").alias("_n_row")), gone)
    stays = rows.where("maybe").join(gone.hint("merge"), "doc_id", "left_anti").coalesce(1 + gone.count() // FILE_TEXTS)
    return rows.where("not maybe").select("_n_row.*").unionByName(stays.select("_n_row.*"))
