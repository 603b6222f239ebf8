"""Exact centroid clustering by Shallot search over integer vectors.

Every vector carries its centroid, its second-nearest centroid, an upper bound of the distance to the first and a lower
bound of the distance to all others.  Bounds are widened by what the centroids moved; a vector whose bounds still
separate is done without a distance.  Any other starts from the closer of its two remembered centroids and walks that
centroid's neighbours in order of distance, inside a ball that shrinks with every better second: a centroid farther
from the start than (distance to the start + second-best distance) cannot matter, nor can any behind it in the order.
Whoever survives is compared by exact integer squared distance, equal ones by the smaller number.  Bounds are rounded
outwards, so the result equals a full scan.

A round reads the stored state once, in Arrow batches, and writes the next state to the shared folder; only vectors
that changed cluster enter the sums (minus there, plus here).  What reaches the driver are k x dims sums.

Defined results: vectors of another length, or with a null or non-finite component, are left out; an empty table gives
an empty table; fewer vectors than ``k`` give as many centroids; repeated rows each count, and equal ids among the
starting candidates are ordered by their vectors; a null id hashes as the text ``null``; further columns are ignored.
A component beyond +-2**27 after scaling is an error, because its squared distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwise.session import stored

#: Largest scaled component: 64 squared differences of twice this size still fit a long.
LIMIT = 1 << 27
#: Relative widening of bounds, far above the rounding of a double's square root.
SLACK = 1e-12


def _up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def whole_vectors(emb: DataFrame, id_col: str, col: str, dims: int, scale: int) -> DataFrame:
    """``(vec_id, q)`` of usable vectors: ``q`` holds ``floor(scale * x)`` per component."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) <= LIMIT, F.floor(y)).otherwise(
            F.raise_error(F.lit("vector component too large: the squared distance would not fit a long"))).cast("int")
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (emb.where((F.size(col) == dims) & fine)
            .select(F.col(id_col).alias("vec_id"), F.transform(col, whole).alias("q")))


def starting_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64)


class Centroids:
    """Integer centroids with the distances and neighbour orders that one round needs."""

    def __init__(self, points: np.ndarray, moved: np.ndarray | None = None):
        self.points, k = points, len(points)
        between = np.array([((points - p) ** 2).sum(axis=1) for p in points])
        self.gap = _down(between)
        own = np.arange(k)
        self.order = np.array([[j for j in np.lexsort((own, between[i])) if j != i] for i in range(k)],
                              dtype=np.int64).reshape(k, k - 1)
        self.half = (self.gap[own, self.order[:, 0]] / 2) if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if moved is None else moved
        far = np.sort(self.moved)[::-1]
        top = int(np.argmax(self.moved))
        self.others_moved = np.full(k, far[0])
        self.others_moved[top] = far[1] if k > 1 else 0.0

    def squared(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x - self.points[c]) ** 2).sum(axis=1)


def search(x: np.ndarray, c: np.ndarray, s: np.ndarray, u: np.ndarray, low: np.ndarray, cents: Centroids) -> None:
    """One Shallot round over the rows of ``x``; centroid, second and bounds are changed in place."""
    u += cents.moved[c]
    low -= cents.others_moved[c]
    open_ = np.flatnonzero(~(u < np.maximum(low, cents.half[c])))
    if not len(open_):
        return
    first = cents.squared(x[open_], c[open_])
    u[open_] = _up(first)
    still = ~(u[open_] < np.maximum(low[open_], cents.half[c[open_]]))
    open_, first = open_[still], first[still]
    if not len(open_) or len(cents.points) == 1:
        low[open_] = np.inf
        return
    xs, best, second = x[open_], c[open_].copy(), s[open_].copy()
    best_d, second_d = first, cents.squared(xs, second)
    turn = (second_d < best_d) | ((second_d == best_d) & (second < best))
    best[turn], second[turn] = second[turn], best[turn]
    best_d[turn], second_d[turn] = second_d[turn], best_d[turn]
    start, known, reach = best.copy(), second.copy(), _up(best_d)
    going = np.arange(len(open_))
    for r in range(cents.order.shape[1]):
        near = cents.order[start[going], r]
        inside = cents.gap[start[going], near] <= reach[going] + _up(second_d[going])
        going, near = going[inside], near[inside]
        if not len(going):
            break
        new = near != known[going]
        at, j = going[new], near[new]
        d = cents.squared(xs[at], j)
        wins = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
        w, o = at[wins], at[~wins]
        second[w], second_d[w] = best[w], best_d[w]
        best[w], best_d[w] = j[wins], d[wins]
        dj, jj = d[~wins], j[~wins]
        runs = (dj < second_d[o]) | ((dj == second_d[o]) & (jj < second[o]))
        second[o[runs]], second_d[o[runs]] = jj[runs], dj[runs]
    c[open_], s[open_], u[open_], low[open_] = best, second, _up(best_d), _down(second_d)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("q").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, -1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).copy()


def assign(state: DataFrame, cents: Centroids) -> DataFrame:
    """The state with every vector at its nearest centroid; ``was`` is the cluster it had before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, s, u, low = (_column(b, n) for n in ("c", "s", "u", "low"))
            was = np.where(np.isinf(u), -1, c)
            search(_matrix(b), c, s, u, low, cents)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("q"), *(pa.array(a) for a in (c, s, u, low, was))],
                names=["vec_id", "q", "c", "s", "u", "low", "was"])
    kind = dict(state.dtypes)["vec_id"]
    return state.select("vec_id", "q", "c", "s", "u", "low").mapInArrow(
        run, f"vec_id {kind}, q array<int>, c long, s long, u double, low double, was long")


def changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and component sums that every cluster gained (exact Python integers): k x dims numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for b in batches:
            x, c, was = _matrix(b), _column(b, "c"), _column(b, "was")
            for j in range(k):
                into, out = c == j, was == j
                n[j] += int(into.sum()) - int(out.sum())
                total[j] += x[into].sum(axis=0) - x[out].sum(axis=0)
        yield pa.RecordBatch.from_pylist([{"c": j, "total": [int(n[j]), *total[j].tolist()]} for j in range(k)])
    rows = (state.where("c <> was").select("q", "c", "was").mapInArrow(run, "c long, total array<long>")
            .select("c", F.posexplode("total").alias("at", "value"))
            .groupBy("c", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    out = np.zeros((k, dims + 1), dtype=object)
    for r in rows:
        out[r.c, r.at] = int(r.value)
    return out[:, 0], out[:, 1:]


def cluster(emb: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id",
            col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(state, centroids)`` after ``rounds`` rounds of assignment and update, and a last assignment."""
    vectors = stored(whole_vectors(emb, id_col, col, dims, scale))
    points = starting_centroids(vectors, k)
    start = vectors.select("vec_id", "q", F.lit(0).cast("long").alias("c"),
                           F.lit(min(1, len(points) - 1)).cast("long").alias("s"),
                           F.lit(float("inf")).alias("u"), F.lit(0.0).alias("low"))
    if not len(points):
        return start.withColumn("was", F.lit(-1).cast("long")), points
    state, moved = start, None
    n, total = np.zeros(len(points), dtype=object), np.zeros(points.shape, dtype=object)
    for _ in range(rounds):
        state = stored(assign(state, Centroids(points, moved)))
        dn, dt = changes(state, *points.shape)
        n, total = n + dn, total + dt
        new = np.array([[int(v) // int(m) for v in t] if m else p.tolist() for m, t, p in zip(n, total, points)],
                       dtype=np.int64)
        moved = _up(((new - points) ** 2).sum(axis=1))
        points = new
    return stored(assign(state, Centroids(points, moved))), points


def report(emb: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """Per vector: its cluster, squared distance, the inertia of its cluster and of all, and its centroid's digest.

    The per-cluster figures are ``k`` rows, sent to every task.
    """
    state, points = cluster(emb, k, rounds, dims, scale)
    kind = dict(state.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = _column(b, "c")
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(c.astype(np.int32)),
                                                  pa.array(((_matrix(b) - points[c]) ** 2).sum(axis=1))],
                                                 names=["vec_id", "cluster", "distance"])
    out = state.select("vec_id", "q", "c").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    if not len(points):
        return out.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"),
                          F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    sums = {r.cluster: int(r.d) for r in
            out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = out.sparkSession.createDataFrame(
        [(j, sums.get(j, 0), sum(sums.values()),
          hashlib.sha256(",".join(str(int(v)) for v in p).encode()).hexdigest()) for j, p in enumerate(points)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """DuckDB SQL of ``report``: every round scans all centroids."""
    squared = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    ctes = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x:
  CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, q FROM v ORDER BY h, q LIMIT {k}) x)"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, r, c, d, q FROM (SELECT v.vec_id, v.r, v.q, c.c,
  CAST({squared} AS BIGINT) AS d FROM v, c{n} c) x QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m.q, c{n}.q) AS q FROM c{n} LEFT JOIN (
  SELECT c, list(CASE WHEN t >= 0 THEN t // n ELSE -((n - 1 - t) // n) END ORDER BY i) AS q FROM (
    SELECT c, i, CAST(sum(q[i]) AS BIGINT) AS t, count(*) AS n FROM a{n}, range(1, {dims + 1}) g(i) GROUP BY c, i) s
  GROUP BY c) m ON m.c = c{n}.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
