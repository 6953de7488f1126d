"""Exact top-k inner products by ball-tree branch and bound.

Rows are cut into shards of bounded size, and each shard becomes a ball tree where it is read. A block of queries visits a
shard's nodes by their upper bound on the inner product, best first; a node is opened for those queries of the block that it
could still serve, and a leaf is scored for all of them by one matrix product. Upper bounds are the least of three: the
ball's, q.c + |q| r; the norm's, |q| times the longest vector; and the cone's, from the widest angle to the center. A query's
current k-th score is shared: within a task it goes from shard to shard; between tasks, a first round over one group of
shards gives every query a k-th score with which the second round starts on all others.

Queries and shards meet in blocks: a task gets one group of query blocks and one group of shards, both of bounded size.
Scores are exact integers (in doubles only where sums stay below 2**53); ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
SHARD_ROWS = 8192
SHARDS_A_GROUP = 8
QUERIES_A_GROUP = 2048
FLOOR = -(2**63)


def _cut(score: int) -> int:
    return max(FLOOR, min(2**63 - 1, score))


def _below(score: int) -> float:
    """The score as a double, or the next smaller one where doubles are too coarse."""
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), -np.inf))


class BallTree:
    """Arrays of one shard: vectors and ids in leaf order, and nodes (center, radius, norms, first row, end row, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        points = vectors.astype(np.float64)
        norms = np.sqrt((points**2).sum(axis=1))
        centers, radii, longest, angles, self.spans, self.children, least = [], [], [], [], [], [], []
        perm = np.arange(len(ids))
        stack = [(0, len(ids), -1)]
        while stack:
            first, end, parent = stack.pop()
            rows = perm[first:end]
            own = points[rows]
            center = own.mean(axis=0)
            far = np.sqrt(((own - center) ** 2).sum(axis=1))
            radius = float(far.max(initial=0.0))
            node = len(radii)
            centers.append(center)
            radii.append(radius)
            longest.append(float(norms[rows].max(initial=0.0)))
            length = float(np.sqrt(center @ center))
            with np.errstate(divide="ignore", invalid="ignore"):
                cosines = own @ center / (norms[rows] * length)
            widest = cosines.min() if length and (norms[rows] > 0).all() else -1.0
            angles.append(float(np.arccos(np.clip(widest, -1.0, 1.0))))
            self.spans.append((first, end))
            self.children.append([])
            least.append(int(ids[rows].min()))
            if parent >= 0:
                self.children[parent].append(node)
            if end - first > LEAF and radius > 0 and (own != own[0]).any():
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                side = own @ (b - a)
                cut = np.argsort(side, kind="stable")
                half = (end - first) // 2
                perm[first:end] = rows[cut]
                stack += [(first, first + half, node), (first + half, end, node)]
            else:
                rows = np.sort(rows)  # by id, for ties among equal vectors
                if (own == own[0]).all():  # one row an id
                    new = np.append(True, np.diff(ids[rows]) != 0)
                    self.spans[node] = (first, first + int(new.sum()))
                    rows = np.concatenate([rows[new], rows[~new]])
                perm[first:end] = rows
        self.ids, self.vectors = ids[perm], vectors[perm]
        self.centers, self.radii, self.longest, self.angles, self.least = np.array(centers), np.array(radii), np.array(longest), np.array(angles), np.array(least)

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """(nodes, queries): no vector of the node has a larger inner product, rounding included."""
        length = np.sqrt((queries**2).sum(axis=1))
        inner = self.centers @ queries.T
        ball = inner + self.radii[:, None] * length
        norm = self.longest[:, None] * length
        center = np.sqrt((self.centers**2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(inner / (center[:, None] * length), -1.0, 1.0))
        near = np.where(np.isnan(angle), 0.0, angle) - self.angles[:, None]  # the least angle to a vector of the node
        # With an obtuse least angle the shortest vector counts, for which 0 is an upper bound.
        cone = np.where(near <= 0, norm, norm * np.maximum(np.cos(np.minimum(near, np.pi)), 0.0))
        out = np.minimum(np.minimum(ball, norm), cone + 1e-7 * norm)
        return out + 1e-9 * (np.abs(out) + norm) + 1e-6

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]], kth: np.ndarray) -> int:
        """Merges this shard's rows into ``best``, for each query its (score, -id) from the best on; equal ones count once.

        ``kth`` is the score below which a query takes nothing more; it rises. Gives the number of leaf scorings, a query each.
        """
        exact = self.vectors.dtype != object and queries.dtype != object
        points = queries.astype(np.float64)
        if exact:
            most = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * self.vectors.shape[1]
            exact = most < 2**53
        upper = self.upper(points)
        worst = np.array([b[-1][1] if len(b) >= k else FLOOR for b in best])  # -id of the k-th
        scored = 0
        heap = [(-float(upper[0].max(initial=-np.inf)), 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth.min():
                break
            bound = upper[node]
            # Where it can only tie with the k-th, its ids must be smaller.
            serve = np.flatnonzero((bound >= kth) & ~((bound < kth + 1.0) & (-self.least[node] < worst)))
            if not len(serve):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-float(upper[child][serve].max()), child))
                continue
            first, end = self.spans[node]
            if end - first > LEAF:
                end = first + k + 1  # equal vectors in the order of ids
            rows, ids = self.vectors[first:end], self.ids[first:end]
            if exact:
                scores = (points[serve] @ rows.astype(np.float64).T).astype(np.int64)
            else:
                scores = queries[serve].astype(object) @ rows.astype(object).T
            scored += len(serve)
            hits = (scores >= kth[serve][:, None]) & (ids[None, :] != query_ids[serve][:, None])
            for at in np.flatnonzero(hits.any(axis=1)):
                q = serve[at]
                new = {(_cut(int(scores[at, r])), -int(ids[r])) for r in np.flatnonzero(hits[at])}
                best[q] = sorted({*best[q], *new}, reverse=True)[:k]
                if len(best[q]) >= k:
                    kth[q], worst[q] = max(kth[q], _below(best[q][-1][0])), best[q][-1][1]
        return scored


def _pack(ids: np.ndarray, vectors: list, floors: np.ndarray | None = None) -> dict:
    """Vectors of one width (missing trailing components are 0), as int64 where sums of products stay exact."""
    width = max(map(len, vectors))
    most = max((np.abs(v).max(initial=0.0) for v in vectors), default=0.0)
    small = most < 2**24 and width < 2**14
    out = np.zeros((len(vectors), width), dtype=np.int64 if small else object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v.astype(np.int64) if small else [int(x) for x in v]
    return {"ids": ids, "vectors": out} | ({} if floors is None else {"floors": floors})


def _blocks(rows: int, tree: bool):
    """Packs the rows (id, vector, floor) of each task into blocks of bounded size: (block, data)."""

    def run(batches):
        held, n = [], 0
        part = TaskContext.get().partitionId()

        def flush(taken):
            ids, vectors, floors = (np.concatenate([x[0] for x in taken]), [v for x in taken for v in x[1]], np.concatenate([x[2] for x in taken]))
            data = _pack(ids, vectors, None if tree else floors)
            return pa.RecordBatch.from_arrays([pa.array([part * (1 << 20) + n], pa.int64()), pa.array([pickle.dumps(BallTree(**data) if tree else data, protocol=5)], pa.binary())], names=["block", "data"])

        for batch in batches:
            column = batch.column(1)
            whole = np.floor(256.0 * pc.list_flatten(column).to_numpy(zero_copy_only=False))
            ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
            vectors = np.split(whole, ends[:-1])
            ids, floors = batch.column(0).to_numpy(), pc.fill_null(batch.column(2), FLOOR).to_numpy()
            at = 0
            while at < batch.num_rows:
                take = min(rows - sum(len(x[0]) for x in held), batch.num_rows - at)
                held.append((ids[at : at + take], vectors[at : at + take], floors[at : at + take]))
                at += take
                if sum(len(x[0]) for x in held) >= rows:
                    yield flush(held)
                    held, n = [], n + 1
        if held:
            yield flush(held)

    return run


def meet(trees: list[BallTree], data: dict, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The best of each query of a block over the trees, and how often a leaf was scored for a query."""
    ids, queries, kth = data["ids"], data["vectors"], np.array([_below(int(x)) for x in data["floors"]])
    best: list[list[tuple[int, int]]] = [[] for _ in ids]
    scored = 0
    for tree in trees:
        width = tree.vectors.shape[1]
        fitted = np.zeros((len(queries), width), dtype=queries.dtype)
        fitted[:, : min(width, queries.shape[1])] = queries[:, :width]
        scored += tree.search(ids, fitted, k, best, kth)
    return best, scored


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trees = [pickle.loads(x) for x in left.column("data").to_pylist()]
        out = [], [], []
        for data in map(pickle.loads, right.column("data").to_pylist()):
            best, _ = meet(trees, data, k)
            for query_id, found in zip(data["ids"].tolist(), best, strict=True):
                for score, other in found:
                    out[0].append(query_id)
                    out[1].append(-other)
                    out[2].append(score)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def _round(shards: DataFrame, queries: DataFrame, groups: list[int], query_groups: int, k: int) -> DataFrame:
    right = queries.mapInArrow(_blocks(QUERIES_A_GROUP // 8, False), "block long, data binary").withColumn("h", F.pmod(F.xxhash64("block"), F.lit(query_groups)))
    left = shards.where(F.col("g").isin(groups) if len(groups) < 2 else F.col("g") >= min(groups))
    left = left.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_groups - 1).cast("long"))))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(min(groups)).cast("long"), F.lit(max(groups)).cast("long"))))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_meet(k), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides the ``k`` best other rows.

    Components become floor(256 x). Rows with a null id, or whose vector is null or holds null or non-finite components,
    take no part; missing trailing components count as 0; an empty vector is all zeros. Rows that share an id are never
    each other's results; a repeated query row gives its results once, repeated candidates count once each by (id, score).
    Other columns, whatever their names, are not looked at.
    Scores beyond the range of long are cut to it. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("id"), e.cast("array<double>").alias("v"))
    n = rows.count()
    groups = max(1, n // (SHARD_ROWS * SHARDS_A_GROUP), min(4 * spark.sparkContext.defaultParallelism, n // 2048))
    query_groups = max(1, n // every // QUERIES_A_GROUP)
    nothing = F.lit(None).cast("long")
    size = max(256, min(SHARD_ROWS, n // groups // 4))
    shards = rows.select("id", "v", nothing.alias("floor")).mapInArrow(_blocks(size, True), "block long, data binary").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    first = _round(shards, queries.select("id", "v", nothing.alias("floor")), [0], query_groups, k)
    found = first
    if groups > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        again = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "floor")
        found = first.unionByName(_round(shards, again, [1, groups - 1], query_groups, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
