"""Merkle manifest of a dataset as a postorder append log.

A tree of arity three has its nodes written in completion order: a leaf, and after it every node whose last leaf it was;
what is still open at the end is closed from the bottom up.  The place of a node in that log follows from subtree sizes
alone (``position``), so a sibling is addressed without an index.  Leaves are numbered within their tree by a range
partitioned sort and per-partition offsets, so a hot source is spread over many tasks.  Aligned builders take
``3**HEIGHT`` consecutive nodes each and write one closed piece of the log; their top nodes are the input of the next layer
of builders, until a tree has one node.  The subroots form one more tree.  Proofs come from the top layer down: a
builder's piece of the log and the proof of its top node give the proofs of its lowest nodes.

Texts are read once and never shuffled; only digests move.  Every builder's group is bounded by ``3**HEIGHT`` nodes.

Defined results: a null field is ``-``; a null id sorts first and is never tampered with; equal ids of one source are
ordered by their leaf (whole repeats are alike anyway); an empty table gives an empty table; columns beside the five
fields are ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwise.session import checkpoint_dir, stored

ARITY = 3
#: Levels of one aligned builder: 2,187 nodes at its bottom.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def completed(leaves: int) -> int:
    """Nodes that are complete once so many leaves are in: the leaves, a third of them, a ninth, and so on."""
    n = 0
    while leaves:
        n += leaves
        leaves //= ARITY
    return n


def root_level(n: int) -> int:
    level, wide = 0, 1
    while wide < n:
        level, wide = level + 1, wide * ARITY
    return level


def position(level: int, index: int, n: int) -> int:
    """Place in the postorder log of node ``index`` of ``level`` in a tree of ``n`` leaves."""
    end = (index + 1) * ARITY ** level
    if end <= n:
        return completed(end - 1) + level
    first_open = 1
    while n % ARITY ** first_open == 0:
        first_open += 1
    return completed(n) + level - first_open


def log_size(n: int) -> int:
    return position(root_level(n), 0, n) + 1


def grow(digests: list[str], first: int, n: int, base: int, height: int = HEIGHT) -> list[tuple[int, int, str]]:
    """``(level, index, digest)`` in completion order of one builder: ``digests`` are nodes ``first``, ... of level ``base``."""
    top = min(base + height, root_level(n)) - base
    waiting: list[list[str]] = [[] for _ in range(top + 1)]
    out, last = [], first

    def write(level: int, d: str) -> None:
        out.append((base + level, last // ARITY ** level, d))
        waiting[level].append(d)

    def close(level: int) -> None:
        d = digest_of("".join(waiting[level]))
        waiting[level].clear()
        write(level + 1, d)

    for last, d in enumerate(digests, first):
        write(0, d)
        level = 0
        while level < top and len(waiting[level]) == ARITY:
            close(level)
            level += 1
    for level in range(top):
        if waiting[level]:
            close(level)
    return out


def fold(digest: str, path: list[str]) -> str:
    """Root that a node and its proof give; a step is the node's place in its run, then the siblings' digests."""
    for step in path:
        cut = 1 + 64 * int(step[0])
        digest = digest_of(step[1:cut] + digest + step[cut:])
    return digest


def proofs(segment: dict[int, str], first: int, count: int, n: int, base: int, above: list[str],
           height: int = HEIGHT) -> list[list[str]]:
    """Paths of one builder's lowest nodes: ``segment`` is its piece of the log by position, ``above`` the path of its top."""
    top = min(base + height, root_level(n))
    paths = {first // ARITY ** (top - base): above}
    for level in range(top - 1, base - 1, -1):
        wide = -(-n // ARITY ** level)
        below = {}
        lo, hi = first // ARITY ** (level - base), (first + count - 1) // ARITY ** (level - base)
        for j in range(lo, hi + 1):
            run = range(j - j % ARITY, min(j - j % ARITY + ARITY, wide))
            step = str(j % ARITY) + "".join(segment[position(level, i, n)] for i in run if i != j)
            below[j] = [step, *paths[j // ARITY]]
        paths = below
    return [paths[j] for j in range(first, first + count)]


# ---------------------------------------------------------------- leaves and their numbers

def _field(x: Column) -> Column:
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of the length-marked fields; ``changed`` replaces a field by another expression."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, digest, forged)``; ``forged`` is the leaf of the tampered row where tampering changes something."""
    text = F.col("text")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "doc_id",
                       leaf_digest().alias("digest"), F.when(hit, leaf_digest(text=bare)).alias("forged"))


def number(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx`` (0, 1, ... within ``tree`` in the given order) and ``n`` (rows of the tree)."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = dealt.groupBy(part.alias("_part"), "tree").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("tree")
    runs = runs.select("_part", "tree", F.sum("_n").over(w).alias("n"),
                       (F.sum("_n").over(w.orderBy("_part")) - F.col("_n") - F.col("_low")).alias("_shift"))
    return (dealt.withColumn("_part", part).join(runs, ["_part", "tree"])
            .withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


# ---------------------------------------------------------------- log and proofs

LOG = "tree string, layer int, n long, block long, pos long, level int, idx long, digest string, root boolean"


def _layer(nodes: DataFrame, layer: int, height: int, carry: list[str]) -> DataFrame:
    """One layer of aligned builders over ``(tree, n, idx, digest, carry...)``: their pieces of the log."""
    kinds = dict(nodes.dtypes)
    extra = "".join(f", {c} {kinds[c]}" for c in carry)
    names = [c.split()[0] for c in LOG.split(", ")] + carry

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        n, first = group.column("n")[0].as_py(), group.column("idx")[0].as_py()
        made = grow(group.column("digest").to_pylist(), first, n, layer * height, height)
        top = root_level(n)
        # the carried columns belong to the builder's lowest nodes
        at = pa.array([i - first if level == layer * height else None for level, i, _ in made], pa.int64())
        cols = [pa.repeat(key[0], len(made)), pa.array([layer] * len(made), pa.int32()),
                pa.array([n] * len(made)), pa.repeat(key[1], len(made)),
                pa.array([position(level, i, n) for level, i, _ in made], pa.int64()),
                pa.array([level for level, _, _ in made], pa.int32()), pa.array([i for _, i, _ in made], pa.int64()),
                pa.array([d for _, _, d in made]), pa.array([level == top for level, _, _ in made])]
        cols += [group.column(c).combine_chunks().take(at) for c in carry]
        return pa.table(cols, names=names)

    block = F.floor(F.col("idx") / F.lit(ARITY ** height)).cast("long")
    return (nodes.select(F.col("tree"), block.alias("block"), "n", "idx", "digest", *carry)
            .groupBy("tree", "block").applyInArrow(build, LOG + extra))


def append_log(nodes: DataFrame, path: str, height: int = HEIGHT, carry: list[str] = ()) -> list[DataFrame]:
    """Write the log of all trees under ``path`` and return it by layers; ``carry`` stays with the leaves."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    layers: list[DataFrame] = []
    while not layers or ARITY ** (len(layers) * height) < most:
        k, at = len(layers), f"{path}/layer={len(layers)}"
        made = _layer(nodes, k, height, list(carry) if k == 0 else [])
        made.write.parquet(at)
        layers.append(nodes.sparkSession.read.schema(made.schema).parquet(at))
        nodes = layers[-1].where((F.col("level") == (k + 1) * height) & ~F.col("root")).select("tree", "n", "idx", "digest")
    return layers


def roots(layers: list[DataFrame]) -> DataFrame:
    """``(tree, n, digest)`` of the root of every tree."""
    parts = [x.where("root").select("tree", "n", "digest") for x in layers]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(roots(layers[1:]))


def _down(layer: DataFrame, above: DataFrame, k: int, height: int, finish, schema: str, carry: list[str]) -> DataFrame:
    """Paths of a layer's lowest nodes: its log pieces beside ``above(tree, block, path)``, one row a builder."""
    def extract(key: tuple, log: pa.Table, over: pa.Table) -> pa.Table:
        base, n = k * height, log.column("n")[0].as_py()
        segment = dict(zip(log.column("pos").to_pylist(), log.column("digest").to_pylist()))
        low = log.filter(pa.compute.equal(log.column("level"), base)).sort_by("idx")
        found = proofs(segment, low.column("idx")[0].as_py(), low.num_rows, n, base,
                       over.column("path")[0].as_py(), height)
        return finish(key[0], low, found)
    return (layer.select("tree", "block", "n", "pos", "level", "idx", "digest", *carry).groupBy("tree", "block")
            .cogroup(above.groupBy("tree", "block")).applyInArrow(extract, schema))


def _paths(tree: str, low: pa.Table, found: list[list[str]]) -> pa.Table:
    return pa.table([pa.repeat(tree, low.num_rows), low.column("idx"), low.column("digest"),
                     pa.array(found, pa.list_(pa.string()))], names=["tree", "idx", "digest", "path"])


def paths_down(layers: list[DataFrame], of_trees: DataFrame, height: int, finish, schema: str,
               carry: list[str] = ()) -> DataFrame:
    """Proofs of all leaves, from the top layer to the lowest; ``of_trees(tree, n, path)`` leads on from each root."""
    above = None
    for k in range(len(layers) - 1, -1, -1):
        here = of_trees.where((F.col("n") <= ARITY ** ((k + 1) * height)) & (F.col("n") > (ARITY ** (k * height) if k else 0)))
        ends = here.select("tree", F.lit(0).cast("long").alias("block"), "path")
        above = ends if above is None else above.select("tree", F.col("idx").alias("block"), "path").unionByName(ends)
        if k:
            above = stored(_down(layers[k], above, k, height, _paths,
                                 "tree string, idx long, digest string, path array<string>", []))
    return _down(layers[0], above, 0, height, finish, schema, list(carry))


def manifest(docs: DataFrame, path: str, height: int = HEIGHT) -> DataFrame:
    """Log of the dataset under ``path`` and, per document, its leaf, roots and the outcome of its proof."""
    numbered = stored(number(stored(leaves(docs)), "doc_id", "digest"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    layers = append_log(numbered, f"{path}/sources", height, ["doc_id", "forged"])
    subroots = stored(roots(layers))
    top = append_log(number(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"),
                     f"{path}/top", height, ["name"])
    root = roots(top).first()
    if root is None:
        return docs.sparkSession.createDataFrame([], schema)
    root = root.digest

    def named(tree: str, low: pa.Table, found: list[list[str]]) -> pa.Table:
        return pa.table([low.column("name"), pa.array(found, pa.list_(pa.string()))], names=["tree", "path"])

    over = docs.sparkSession.createDataFrame([("", subroots.count(), [])], "tree string, n long, path array<string>")
    of_trees = stored(paths_down(top, over, height, named, "tree string, path array<string>", ["name"])
                      .join(subroots.select("tree", "n", F.col("digest").alias("subroot")), "tree"))

    def judged(tree: str, low: pa.Table, found: list[list[str]]) -> pa.Table:
        leaf, forged = low.column("digest").to_pylist(), low.column("forged").to_pylist()
        folded = [fold(f or d, p) for d, f, p in zip(leaf, forged, found)]
        return pa.table([pa.repeat(tree, len(leaf)), low.column("doc_id"), low.column("digest"),
                         pa.array([digest_of("".join(s[1:] for s in p)) for p in found]), pa.array(folded)],
                        names=["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

    out = paths_down(layers, of_trees.select("tree", "n", "path"), height, judged,
                     f"tree string, doc_id {kind}, leaf string, proof_sha256 string, folded_root string", ["doc_id", "forged"])
    return (out.join(of_trees.select("tree", "subroot"), "tree").withColumn("root", F.lit(root))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def report(docs: DataFrame) -> DataFrame:
    """``manifest`` with its log in the shared folder."""
    return manifest(docs, f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/merkle-{uuid.uuid4().hex}")


def oracle(levels: int = 10, top_levels: int = 6) -> str:
    """DuckDB SQL of ``report`` for up to ``3**levels`` documents a source and ``3**top_levels`` sources."""
    def field(c: str, x: str | None = None) -> str:
        s = f"CAST({x or c} AS VARCHAR)"
        return f"coalesce(strlen({s}) || ':' || {s}, '-')"

    def leaf(text: str = "text") -> str:
        return "sha256(" + " || ".join(field(c, text if c == "text" else None) for c in FIELDS) + ")"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"
    ctes = [f"""lf AS MATERIALIZED (SELECT source, doc_id, {leaf()} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS forged FROM documents)""",
            """s0 AS MATERIALIZED (SELECT source, doc_id, leaf, coalesce(forged, leaf) AS f0, '' AS p0,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS c FROM lf)""",
            "sn0 AS MATERIALIZED (SELECT source AS t, i AS j, leaf AS d, c FROM s0)"]

    def climb(kind: str, count: int) -> None:
        for h in range(count):
            ctes.append(f"""{kind}n{h + 1} AS MATERIALIZED (SELECT t, j // 3 AS j,
  CASE WHEN any_value(c) > 1 THEN sha256(string_agg(d, '' ORDER BY j)) ELSE any_value(d) END AS d, any_value((c + 2) // 3) AS c
  FROM {kind}n{h} GROUP BY t, j // 3)""")
            ctes.append(f"""{kind}p{h} AS MATERIALIZED (SELECT a.t, a.j, a.c > 1 AS up,
  coalesce(string_agg(b.d, '' ORDER BY b.j) FILTER (WHERE b.j < a.j), '') AS l,
  coalesce(string_agg(b.d, '' ORDER BY b.j) FILTER (WHERE b.j > a.j), '') AS r
  FROM {kind}n{h} a JOIN {kind}n{h} b ON a.t IS NOT DISTINCT FROM b.t AND a.j // 3 = b.j // 3 GROUP BY a.t, a.j, a.c)""")
    climb("s", levels)
    ctes.append(f"""tn0 AS MATERIALIZED (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS j, d,
  count(*) OVER () AS c, t AS source FROM sn{levels})""")
    climb("t", top_levels)
    for h in range(levels):
        ctes.append(f"""s{h + 1} AS MATERIALIZED (SELECT s.* REPLACE (s.i // 3 AS i,
  CASE WHEN p.up THEN sha256(p.l || s.f0 || p.r) ELSE s.f0 END AS f0, s.p0 || p.l || p.r AS p0) FROM s{h} s JOIN sp{h} p
  ON s.source IS NOT DISTINCT FROM p.t AND s.i = p.j)""")
    ctes.append(f"""t0 AS MATERIALIZED (SELECT s.* EXCLUDE (i), n.j AS i, n.d AS subroot FROM s{levels} s JOIN tn0 n
  ON s.source IS NOT DISTINCT FROM n.source)""")
    for h in range(top_levels):
        ctes.append(f"""t{h + 1} AS MATERIALIZED (SELECT s.* REPLACE (s.i // 3 AS i,
  CASE WHEN p.up THEN sha256(p.l || s.f0 || p.r) ELSE s.f0 END AS f0, s.p0 || p.l || p.r AS p0) FROM t{h} s JOIN tp{h} p
  ON s.i = p.j)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, r.d AS root, sha256(p0) AS proof_sha256, f0 AS folded_root, f0 = r.d AS verified
FROM t{top_levels}, tn{top_levels} r"""
