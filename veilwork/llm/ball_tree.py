"""Exact top-k by inner product: ball-tree branch and bound over shards of vectors.

1. Queries come in blocks of ``block`` rows, each block sent to all tasks; every vector is searched for every block.
2. A task cuts its vectors into shards and builds a ball tree over each: nodes are halved across their widest
   direction down to ``leaf`` vectors, and keep their centre and radius.
3. No vector of a node scores above q . centre + |q| * radius. Nodes below the query's current k-th score are
   left with all below them; leaves are visited in the order of their bounds, the best first.
4. The k-th score is shared: a block starts from the k-th best among its own queries, which are candidates too,
   and a task carries it on from shard to shard. Ties are never cut off.

Components are floor(scale * x), so scores are whole numbers; bounds are rounded up.

Defined cases: vectors that are null or empty, or hold null or non-finite components, and rows with null vec_id,
take no part; vectors meet only vectors of their length; equal rows are candidates each, but no row meets its own
vec_id; fewer candidates than k give all of them; no query gives no row; other columns are not read. Scores
beyond 64 bits are not meant to be had.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
EVERY = 50
BLOCK = 4096
SHARD = 16_384
LEAF = 128
NONE = np.iinfo(np.int64).min + 1  # its negative exists
_OUT = "query_id long, slot int, vec_id long, score long"


class BallTree:
    """Nodes in rows: centre, radius, children (0 for leaves), and the vectors of each as a range of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        ranges, children, todo = [(0, len(vectors))], [(0, 0)], [0]
        for node in todo:
            a, b = ranges[node]
            if b - a > leaf:
                own = vectors[self.order[a:b]]
                far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                across = own @ (own[((own - far) ** 2).sum(axis=1).argmax()] - far)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(across, half)]
                children[node] = (len(ranges), len(ranges) + 1)
                todo += children[node]
                ranges += [(a, a + half), (a + half, b)]
                children += [(0, 0), (0, 0)]
        self.ranges, self.children = ranges, children
        self.centres = np.stack([vectors[self.order[a:b]].mean(axis=0) for a, b in ranges])
        self.radii = np.array([np.sqrt(((vectors[self.order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(ranges, self.centres)])

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Leaves, and by query the bound of each; minus infinity where the leaf or a node above it is cut off."""
        norms = np.sqrt((queries**2).sum(axis=1))
        bound = queries @ self.centres.T + np.outer(norms, self.radii)
        bound += 1 + 1e-9 * (np.abs(bound) + np.outer(norms, np.sqrt((self.centres**2).sum(axis=1))))
        bound[bound < least[:, None]] = -np.inf
        for node, (left, right) in enumerate(self.children):
            if left:
                gone = bound[:, node] == -np.inf
                bound[gone, left] = bound[gone, right] = -np.inf
        leaves = [node for node, (left, _) in enumerate(self.children) if not left]
        return leaves, bound[:, leaves]


class Best:
    """The k best of each query: scores falling, ids rising among equal scores."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = least.copy()

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores.max(axis=1) >= self.kth()[which]
        which, scores = which[some], scores[some]
        if len(which):
            scores = np.concatenate([self.scores[which], scores], axis=1)
            ids = np.concatenate([self.ids[which], np.broadcast_to(ids, (len(which), len(ids)))], axis=1)
            first = np.lexsort((ids, -scores), axis=1)[:, : self.scores.shape[1]]
            self.scores[which], self.ids[which] = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while all sums stay below 2**53."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if largest < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best, leaf: int = LEAF) -> None:
    """Branch and bound of all queries over one shard."""
    tree = BallTree(vectors.astype(np.float64), leaf)
    leaves, bound = tree.bounds(queries.astype(np.float64), best.kth())
    place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
    low = 0
    for high in (1, 4, 16, len(leaves)):  # by the order of bounds; the k-th scores rise in between
        for n, node in enumerate(leaves):
            turn = (place[:, n] >= low) & (place[:, n] < high) & (bound[:, n] >= best.kth()) & (bound[:, n] > -np.inf)
            which = np.flatnonzero(turn)
            if len(which):
                own = tree.order[slice(*tree.ranges[node])]
                scores = products(queries[which], vectors[own])
                scores[query_ids[which][:, None] == ids[own][None, :]] = NONE
                best.offer(which, scores, ids[own])
        low = high


def _search(queries, k: int, shard: int, leaf: int):
    """Task: the k best of its vectors for each query of the block, none below the shared score."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = queries.value
        best = {dim: Best(len(q_ids), k, least) for dim, (q_ids, _, _, least) in blocks.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dim: [] for dim in blocks}

        def close(dim: int) -> None:
            parts, held[dim] = held[dim], []
            if parts:
                q_ids, _, q, _ = blocks[dim]
                search(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), q_ids, q, best[dim], leaf)

        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            sizes, flat, begin = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for dim in set(sizes.tolist()) & blocks.keys():
                rows = np.flatnonzero(sizes == dim)
                held[dim].append((ids[rows], flat[begin[rows][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= shard:
                    close(dim)
        for dim in blocks:
            close(dim)
            q_ids, slots, _, least = blocks[dim]
            found = (best[dim].scores > NONE) & (best[dim].scores >= least[:, None])
            q, _ = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[q]), pa.array(slots[q]), pa.array(best[dim].ids[found]), pa.array(best[dim].scores[found])],
                names=["query_id", "slot", "vec_id", "score"],
            )

    return task


def _shared_floor(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """For each query of a block the k-th best score among the block's other queries."""
    if len(ids) <= k:
        return np.full(len(ids), NONE)
    scores = products(vectors, vectors)
    scores[ids[:, None] == ids[None, :]] = NONE
    return np.partition(scores, -k, axis=1)[:, -k]


def usable(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, v) and columns to keep: whole-number components of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    wide = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(wide, finite))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(scale * x).cast("long")).alias("v"), *keep)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, shard: int = SHARD, leaf: int = LEAF, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query its k best other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, column)
    asked = usable(vectors.where(is_query), column).distinct()
    blocks = -(-asked.count() // block)
    found = [spark.createDataFrame([], _OUT)]
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "v").collect()  # about one block
        by_dim: dict[int, list] = {}
        for slot, row in enumerate(own):
            by_dim.setdefault(len(row["v"]), []).append((row["vec_id"], slot, row["v"]))
        sent = {}
        for dim, items in by_dim.items():
            ids, slots, q = np.array([i[0] for i in items]), np.array([i[1] for i in items], np.int32), np.array([i[2] for i in items])
            sent[dim] = (ids, slots, q, _shared_floor(ids, q, k))
        found.append(rows.mapInArrow(_search(spark.sparkContext.broadcast(sent), k, shard, leaf), _OUT))
    merged = reduce(DataFrame.union, found)
    order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(vectors: DataFrame, n: int = EVERY) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % n == 0)
