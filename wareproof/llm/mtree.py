"""Operator 5: exact top-k inner products by best-first search in M-trees.

Vectors become whole numbers. A bounded sample gives pivots; every vector goes to its nearest pivot's shard, and a shard
of more than ``SHARD`` vectors is split by a hash, so a crowded spot is several shards. Each shard is an M-tree
(Ciaccia, Patella and Zezula, 1997) in pages: a node has a routing vector, a covering radius, its distance to the
routing vector above, and the largest norm below it; a leaf entry has its distance to the routing vector of its page.

An inner product follows from norms and the distance, 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, so distances bound it from
above. A block of queries opens nodes from the highest bound down until no bound reaches a k-th score; before a distance is
computed, the triangle inequality over the stored ones may already rule the node or entry out. It
starts with the k-th scores among the sample, and meets every shard once, joined by the shard's number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareproof.llm.common import written

SCALE = 1024
SAMPLE = 1024
MAX_PIVOTS = 256
SHARD = 4096
PAGE = 64
FAN = 16
BLOCK = 256

VECTORS = "vec_id bigint, dim int, near int, vec binary"
TREES = "shard bigint, ids binary, vecs binary, entry_distance binary, nodes binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


# ---- one tree ------------------------------------------------------------------------------------

# A node: rows [first, last) of its subtree, its children [child, child + n) in the list of nodes (none in a leaf), the
# row of its routing vector, radius, distance to the routing vector above, largest squared norm.
NODE = np.dtype([("first", "i4"), ("last", "i4"), ("child", "i4"), ("n", "i4"), ("center", "i4"), ("radius", "f8"), ("up", "f8"), ("norm", "f8")])


def _distances(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - center) ** 2).sum(axis=1))


def build(vecs: np.ndarray, page: int = PAGE, fan: int = FAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, nodes (the root first) and each row's distance to the routing vector of its page."""
    x = vecs.astype(np.float64)
    norms = (x**2).sum(axis=1)
    order = np.arange(len(x))
    nodes: list[tuple | None] = [None]
    entry = np.zeros(len(x))
    middle = int(np.argmin(_distances(x, x.mean(axis=0))))
    todo = [(0, 0, len(x), middle, 0.0)]  # node, its rows, row of its routing vector, distance to the one above
    while todo:
        at, lo, hi, center, up = todo.pop()
        rows = order[lo:hi]
        reach = _distances(x[rows], x[center])
        child, n = 0, 0
        if hi - lo > page:
            # Routing vectors spread over the node: the ranks by distance from its own, evenly spaced.
            ranked = rows[np.argsort(reach, kind="stable")]
            picks = ranked[np.linspace(0, len(ranked) - 1, fan).astype(int)]
            to_picks = np.stack([_distances(x[rows], x[p]) for p in picks], axis=1)
            nearest = to_picks.argmin(axis=1)
            if len(np.unique(nearest)) == 1:  # equal vectors do not part: cut them evenly
                nearest = np.arange(len(rows)) * fan // len(rows)
            by_pick = np.argsort(nearest, kind="stable")
            order[lo:hi] = rows[by_pick]
            counts = np.bincount(nearest, minlength=fan)
            child, start = len(nodes), lo
            for k in np.flatnonzero(counts):
                route = int(picks[k])
                todo.append((len(nodes), start, start + int(counts[k]), route, float(np.linalg.norm(x[route] - x[center]))))
                nodes.append(None)
                start, n = start + int(counts[k]), n + 1
        else:
            entry[lo:hi] = reach
        nodes[at] = (lo, hi, child, n, center, reach.max(initial=0), up, norms[rows].max(initial=0))
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x))
    out = np.array(nodes, dtype=NODE)
    out["center"] = place[out["center"]]
    return order, out, entry


def products(vecs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Whole inner products, a row per query; beyond 64 bits they stop at the ends of the range."""
    most = int(np.abs(vecs).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, vecs.shape[1])
    if most < 1 << 53:  # then sums of doubles are exact, and faster
        return (queries.astype(np.float64) @ vecs.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return queries @ vecs.T
    ends = np.iinfo(np.int64)
    whole = queries.astype(object) @ vecs.T.astype(object)
    return np.array([[min(max(int(v), ends.min), ends.max) for v in row] for row in whole], dtype=np.int64).reshape(len(queries), len(vecs))


class Best:
    """The k best scores of every query so far, smaller ids first among equals."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.bound = k, floors.copy()
        self.score = [np.zeros(0, dtype=np.int64) for _ in floors]
        self.ids = [np.zeros(0, dtype=np.int64) for _ in floors]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows for query ``q``. Scores below ``bound`` cannot be among the k best; those equal to it can."""
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        keep = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[keep], ids[keep]
        if len(keep) == self.k:
            self.bound[q] = max(self.bound[q], float(score[keep[-1]]))


def search(tree: tuple[np.ndarray, ...], query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[Best, int]:
    """The k best rows of a tree, other than its own, with scores of at least its floor, for every query of a block; and
    how many distances and products were computed.

    Queries go through the tree together, nodes with the highest bound of any query first; at a node only those go
    on whose bound there reaches their k-th score.
    """
    ids, vecs, x, norms, entry, nodes = tree
    q = queries.astype(np.float64)
    own = (q**2).sum(axis=1)
    slack = 1e-9 * (own.max(initial=0) + float(norms.max(initial=0))) + 1e-6
    loose = 1e-6 * np.sqrt(own.max(initial=0) + float(norms.max(initial=0))) + 1e-9  # of a root of a difference of squares
    best = Best(k, floors)

    def distances(who: np.ndarray, centers: np.ndarray) -> np.ndarray:
        square = own[who][:, None] + norms[centers][None, :] - 2 * q[who] @ x[centers].T
        return np.sqrt(np.maximum(square, 0))

    def upper(who: np.ndarray, norm: np.ndarray, least: np.ndarray) -> np.ndarray:
        return (own[who][:, None] + norm[None, :] - np.maximum(least - loose, 0) ** 2) / 2 + slack

    everyone, root = np.arange(len(q)), np.zeros(1, dtype=np.int64)
    to_root, computed = distances(everyone, nodes["center"][root]), len(q)
    bounds = upper(everyone, nodes["norm"][root], to_root - nodes["radius"][root])[:, 0]
    heap = [(-float(bounds.max()), 0, everyone, bounds, to_root[:, 0])] if len(q) else []
    while heap:
        _, at, who, bounds, distance = heapq.heappop(heap)
        on = bounds >= best.bound[who]
        who, distance = who[on], distance[on]
        if not len(who):
            continue
        node = nodes[at]
        if node["n"] == 0:
            rows = np.arange(node["first"], node["last"])
            open_ = upper(who, norms[rows], np.abs(distance[:, None] - entry[rows][None, :])) >= best.bound[who][:, None]
            open_ &= ids[rows][None, :] != query_ids[who][:, None]
            some, wanted = np.flatnonzero(open_.any(axis=0)), np.flatnonzero(open_.any(axis=1))
            if not len(some):
                continue
            score = products(vecs[rows[some]], queries[who[wanted]])
            computed += score.size
            good = open_[np.ix_(wanted, some)] & (score >= best.bound[who[wanted]][:, None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                best.add(int(who[wanted[i]]), score[i, good[i]], ids[rows[some[good[i]]]])
            continue
        below = np.arange(node["child"], node["child"] + node["n"])
        least = np.abs(distance[:, None] - nodes["up"][below][None, :]) - nodes["radius"][below][None, :]
        open_ = upper(who, nodes["norm"][below], least) >= best.bound[who][:, None]
        below, open_ = below[open_.any(axis=0)], open_[:, open_.any(axis=0)]
        if not len(below):
            continue
        far = distances(who, nodes["center"][below])
        computed += far.size
        reach = np.where(open_, upper(who, nodes["norm"][below], far - nodes["radius"][below][None, :]), -np.inf)
        for c, child in enumerate(below.tolist()):
            on = reach[:, c] >= best.bound[who]
            if on.any():
                heapq.heappush(heap, (-float(reach[on, c].max()), child, who[on], reach[on, c], far[on, c]))
    return best, computed


# ---- the index -----------------------------------------------------------------------------------

def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i8").reshape(len(blobs), dim)


def quantised(table: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, vec): floor(scale * x) of every component, as little-endian 64-bit numbers. Rows without an id, null
    vectors and those with null or non-finite components are left out; components stop at the ends of 64 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs = [], []
            for one in batch.column("v"):
                x = np.floor(scale * one.values.to_numpy(zero_copy_only=False).astype(np.float64))
                x = np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0)).astype("<i8")
                dims.append(len(x))
                vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "vec"])

    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).mapInArrow(run, "vec_id bigint, dim int, vec binary")


def _sample(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """At most ``SAMPLE`` vectors by a hash of their ids: dim -> ids, vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    return {
        dim: (np.array([r.vec_id for r in own], dtype=np.int64), _matrix([r.vec for r in own], dim))
        for dim in {r.dim for r in rows} if (own := [r for r in rows if r.dim == dim])
    }


def _near(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            near = np.full(batch.num_rows, -1, dtype=np.int32)
            for dim in np.unique(dims).tolist():
                if dim in pivots and dim:
                    rows, p = np.flatnonzero(dims == dim), pivots[dim].astype(np.float64)
                    x = _matrix(batch.column("vec").take(pa.array(rows)).to_pylist(), dim).astype(np.float64)
                    near[rows] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(near), batch.column("vec")], ["vec_id", "dim", "near", "vec"])
    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, dim, members in zip(batch.column("shard").to_pylist(), batch.column("dim").to_pylist(), batch.column("members"), strict=True):
            ids = members.values.field("vec_id").to_numpy()
            vecs = _matrix(members.values.field("vec").to_pylist(), dim)
            order, nodes, entry = build(vecs)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), *(
                pa.array([a.tobytes()], pa.binary()) for a in (ids[order], vecs[order], entry, nodes)
            )], ["shard", "ids", "vecs", "entry_distance", "nodes"])


def index(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """The trees, a row per shard, and the shards of every length of vectors: (dim, first, last)."""
    near = written(vectors.mapInArrow(_near(pivots), VECTORS), "near")
    counts = near.groupBy("dim", "near").agg(F.count("*").alias("n"))
    splits = counts.withColumn("splits", F.expr(f"(n + {SHARD - 1}) DIV {SHARD}"))
    before = Window.orderBy("dim", "near").rowsBetween(Window.unboundedPreceding, -1)  # a row per pivot
    firsts = written(splits.withColumn("first", F.coalesce(F.sum("splits").over(before), F.lit(0))), "shards")
    shard = F.col("first") + F.pmod(F.xxhash64("vec_id", "vec"), F.col("splits"))
    placed = near.join(firsts, ["dim", "near"]).select(shard.alias("shard"), "dim", F.struct("vec_id", "vec").alias("m"))
    grouped = placed.groupBy("shard", "dim").agg(F.collect_list("m").alias("members"))
    ranges = firsts.groupBy("dim").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("splits") - 1).alias("last"))
    return written(grouped.mapInArrow(_trees, TREES), "trees"), ranges


def _searches(k: int, sample: dict[int, tuple[np.ndarray, np.ndarray]]):
    def floors(query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The k-th scores among the sample."""
        if queries.shape[1] not in sample:
            return np.full(len(queries), -np.inf)
        ids, vecs = sample[queries.shape[1]]
        scores = products(vecs, queries).astype(np.float64)
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
        return np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(queries), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vecs, entry, nodes = (
                    np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t)
                    for c, t in (("ids", "<i8"), ("vecs", "<i8"), ("entry_distance", "<f8"), ("nodes", NODE))
                )
                dim = batch.column("dim")[row].as_py()
                vecs = vecs.reshape(len(ids), dim)
                x = vecs.astype(np.float64)
                tree = (ids, vecs, x, (x**2).sum(axis=1), entry, nodes)
                queries = batch.column("queries")[row].values
                q_ids, q = queries.field("vec_id").to_numpy(), _matrix(queries.field("vec").to_pylist(), dim)
                best, _ = search(tree, q_ids, q, k, floors(q_ids, q))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(q_ids, [len(x) for x in best.ids])), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score)),
                ], ["query_id", "vec_id", "score"])
    return run


def top_k(table: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by ``every`` the ``k`` other vectors of the
    highest inner products, all if there are fewer; ties go to the smaller id.

    Vectors of different lengths have no inner product and are no candidates of each other; vectors of no components score 0.
    Ids should be unique: rows with a query's id are all its own, and a repeated query is searched once per row
    and its results are ranked together. Null or non-finite vectors and null ids take no part; other columns are
    ignored; an empty table gives no rows. Only the sample (``SAMPLE`` vectors) and its pivots reach the driver.
    """
    vectors = written(quantised(table, vec_id, vector, scale), "vectors")
    n = vectors.count()
    sample = _sample(vectors)
    n_pivots = min(MAX_PIVOTS, n // SHARD + 1)
    trees, ranges = index(vectors, {dim: vecs[:n_pivots] for dim, (_, vecs) in sample.items()})
    asked = vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    blocks = n // (every * BLOCK) + 1
    queries = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "vec")).alias("queries"))
    met = queries.join(ranges, "dim").select("dim", "queries", F.explode(F.sequence("first", "last")).alias("shard"))
    found = met.join(trees, "shard").mapInArrow(_searches(k, sample), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
