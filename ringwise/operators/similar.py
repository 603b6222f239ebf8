"""Similarity search over embeddings (L1-L4).

Vectors are ``array<float>``; maths runs in higher-order array functions on
the JVM.  The single query row is attached as a scalar subquery (one row,
bounded), never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ringwise.functions.params import scalar_row
from ringwise.session import stored


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(df: DataFrame, col: str = "embedding", out: str = "unit") -> DataFrame:
    """L1: non-finite -> 0, then L2-normalise; a zero vector stays as is."""
    clean = F.transform(F.col(col), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0)
                        .otherwise(x.cast("double")))
    n = _norm(clean)
    return df.withColumn(out, F.when(n > 0, F.transform(clean, lambda x: x / n)).otherwise(clean))


def similar(emb: DataFrame, query_id: int, k: int = 10, id_col: str = "vec_id",
            col: str = "embedding") -> DataFrame:
    """L3: top-``k`` cosine neighbours of one row, itself excluded."""
    q = scalar_row(emb.where(F.col(id_col) == query_id).select(F.col(col).alias("v")))["v"]
    # the query vector becomes a column first: subqueries may not sit inside lambda functions
    with_q = emb.where(F.col(id_col) != query_id).withColumn("_q", q)
    sim = _dot(F.col(col), F.col("_q")) / (_norm(F.col(col)) * _norm(F.col("_q")))
    return (with_q.select(id_col, F.round(sim, 9).alias("similarity"))
            .orderBy(F.desc("similarity"), id_col).limit(k))


# ---------------------------------------------------------------- L4: many rows at once

#: Rows of a block of the index, and the most blocks (their centres go to every task: 32,768 x dims doubles).
BLOCK_ROWS, MOST_BLOCKS = 50_000, 32_768
#: Sign bits of a row's signature, and rows of one matrix product.
SIGN_BITS, STEP = 32, 4096
#: Slack of the angle tests and of similarities rounded to nine places, above all rounding.
ANGLE_SLACK, COSINE_SLACK = 1e-6, 2e-9


def sign_index(emb: DataFrame, id_col: str = "vec_id", col: str = "embedding", dims: int = 64,
               block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """``(id, unit, block)``: unit vectors in the order of their signs against random hyperplanes, in blocks.

    Rows whose first signs agree point into one region; a region with too many rows is split by its further signs, and
    equal signatures by id, so no block outgrows ``block_rows`` by more than the sampling error of a range partitioning.
    Non-finite components count as 0; a vector that is null or of another length is left out.
    """
    planes = np.random.default_rng(seed).standard_normal((dims, SIGN_BITS))
    weights = 1 << np.arange(SIGN_BITS - 1, -1, -1, dtype=np.int64)
    id_type = dict(emb.dtypes)[id_col]

    def sign(batches):
        for b in batches:
            flat = b.column(col).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.where(np.isfinite(flat), flat, 0.0).reshape(b.num_rows, dims)  # L1, a batch at a time
            size = np.sqrt((x ** 2).sum(axis=1, keepdims=True))
            x = np.divide(x, size, out=x, where=size > 0)
            units = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), x.reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column("id"), units, pa.array((x @ planes > 0) @ weights, pa.int64())],
                                             names=["id", "unit", "sig"])
    signed = stored(emb.where(F.size(col) == dims).select(F.col(id_col).alias("id"), col)
                    .mapInArrow(sign, f"id {id_type}, unit array<double>, sig long"))
    n = signed.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // block_rows)))
    dealt = stored(signed.repartitionByRange(blocks, "sig", "id").select("id", "unit", F.spark_partition_id().alias("part")))
    # a session may deal into more partitions than asked for: neighbouring ones are one block
    parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    return dealt.select("id", "unit", F.expr(f"cast(part * {blocks}L div {max(parts, blocks)} as int)").alias("block"))


def _matrix(table, name: str = "unit") -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def cones(index: DataFrame) -> list[tuple[int, np.ndarray, float]]:
    """Per block its number, mean direction and the widest angle of a row to it (at most MOST_BLOCKS)."""
    def cone(key, table):
        x = _matrix(table)
        mean = x.sum(axis=0)
        size = np.sqrt((mean ** 2).sum())
        mean = mean / size if size > 0 else mean
        flat = (x ** 2).sum(axis=1) == 0  # a zero vector has no direction: its block is never left out
        wide = np.pi if flat.any() or size == 0 else float(np.arccos(np.clip(x @ mean, -1, 1)).max())
        return pa.table([pa.repeat(key[0], 1), pa.array([mean.tolist()]), pa.array([wide])], names=["block", "mean", "wide"])
    rows = index.groupBy("block").applyInArrow(cone, "block int, mean array<double>, wide double").collect()
    return [(r.block, np.array(r.mean), r.wide) for r in rows]


def _within(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of a block for every query sent there: ``asked(id, unit, block)`` -> ``(a, b, similarity)``."""
    id_type = dict(index.dtypes)["id"]
    kind = to_arrow_type(index.schema["id"].dataType)

    schema = pa.schema([("a", kind), ("b", kind), ("similarity", pa.float64())])

    def nearest(queries, x, xid):
        """Best rows of one block for a few queries; its rows ascend by id, so of equal similarities the smaller id is first."""
        q, qid, parts = _matrix(queries), queries.column("id").combine_chunks(), []
        own = pa.compute.index_in(qid, xid).to_numpy(zero_copy_only=False)
        for i, row in enumerate(np.round(q @ x.T, 9)):
            if own[i] == own[i]:
                row[int(own[i])] = -np.inf
            cut = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            at = np.flatnonzero(row >= cut)
            at = at[np.argsort(-row[at], kind="stable")][:k]
            at = at[row[at] > -np.inf]
            parts.append((np.full(len(at), i), at, row[at]))
        i, j, s = (np.concatenate(p) for p in zip(*parts))
        return pa.RecordBatch.from_arrays([qid.take(pa.array(i)), xid.take(pa.array(j)), pa.array(s)], schema=schema)

    def search(batches):
        """Sorted rows: those of a block, then its queries, which pass a few at a time; one block is held, never its queries."""
        block, rows, x, xid = None, [], None, None
        for b in batches:
            at, asks = b.column("block").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1), b.num_rows]
            start = 0
            for end in ends if b.num_rows else []:
                run = pa.Table.from_batches([b.slice(start, end - start)])
                if at[start] != block:
                    block, rows, x, xid = at[start], [], None, None
                if not asks[start]:
                    rows.append((run.column("id").combine_chunks(), _matrix(run).copy()))
                elif rows or x is not None:
                    if x is None:
                        xid, x, rows = pa.concat_arrays([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), []
                    for lo in range(0, run.num_rows, STEP // 16):
                        yield nearest(run.slice(lo, STEP // 16), x, xid)
                start = end
    dealt = (index.select("block", "id", "unit", F.lit(False).alias("query"))
             .unionByName(asked.select("block", "id", "unit", F.lit(True).alias("query")))
             .repartition("block").sortWithinPartitions("block", "query", "id"))
    return dealt.mapInArrow(search, f"a {id_type}, b {id_type}, similarity double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def routes(asked: DataFrame, first: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``(id, unit, block)``: the blocks beside its own that may still change a query's list ``first(a, b, similarity)``."""
    edges = cones(index)
    id_type = dict(index.dtypes)["id"]
    number = np.array([b for b, _, _ in edges], dtype=np.int32)
    means, wide = np.array([m for _, m, _ in edges]), np.array([w for _, _, w in edges])

    def send(batches):
        for b in batches:
            for lo in range(0, b.num_rows, STEP // 16):
                part = b.slice(lo, STEP // 16)  # a query may go to every block, so few of them are sent at a time
                x, least = _matrix(pa.Table.from_batches([part])), part.column("least").to_numpy(zero_copy_only=False)
                near = np.arccos(np.clip(x @ means.T, -1, 1)) - wide[None, :] - ANGLE_SLACK
                reach = np.where(np.isnan(least), np.pi, np.arccos(np.clip(least - COSINE_SLACK, -1, 1)))
                go = (near <= reach[:, None]) | ((x ** 2).sum(axis=1) == 0)[:, None]
                go &= number[None, :] != part.column("block").to_numpy()[:, None]
                i, j = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(i)), part.column("unit").take(pa.array(i)),
                                                  pa.array(number[j])], names=["id", "unit", "block"])
    bound = first.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    return (asked.join(bound, F.col("id") == F.col("a"), "left").select("id", "unit", "block", "least")
            .mapInArrow(send, f"id {id_type}, unit array<double>, block int"))


def similar_many(emb: DataFrame, wanted: Column, k: int = 10, id_col: str = "vec_id", col: str = "embedding",
                 dims: int = 64, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """L4: top-``k`` cosine neighbours ``(a, b, similarity, rank)`` of every row for which ``wanted`` (over ``id``) holds.

    Each query first meets the rows of its own block, which gives its k-th best similarity so far.  A block is a cone
    around its mean direction; where even the nearest edge of the cone is farther than that k-th neighbour, no row of it
    can enter the list and the query does not go there.  Nothing that could matter is left out, so the lists equal L3's.
    Rows move in whole blocks and only ``k`` rows a query and block come out, never the pairs.  Ids must be distinct.
    """
    index = sign_index(emb, id_col, col, dims, block_rows, seed)
    asked = index.where(wanted)
    own = stored(_within(asked, index, k))
    return _best(own.unionByName(_within(routes(asked, own, index, k), index, k)), k)
