"""Approximate nearest neighbours by vantage-point trees, one per shard, with pruning by the triangle inequality that a factor relaxes.

Nearness is the inner product.  A shard adds one coordinate, ``sqrt(M**2 - |x|**2)`` for its largest norm M (0 for queries),
which turns the largest inner product into the smallest Euclidean distance, so the triangle inequality holds.  A node has a
vantage point and the range of its children's distances to it; a child is passed over when ``factor * gap > radius``, where
gap is how far the query's distance lies outside the child's range and radius the distance of the query's k-th best so far.
``factor = 1`` is exact search; a larger one passes over more.  Queries go through a tree in blocks: first each down to its
own leaf, which sets its radius, then all of them over the tree with pruning.

Shards and blocks of queries are packed into one row each and joined by shard, so the work is spread over shards times
``REPLICAS``, and no row count but shards, blocks and results depends on the data.  Shards have about ``SHARD_ROWS`` vectors,
by the hash of the id.  Every vector is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do rows with a
null vec_id; vectors meet only queries of their own dimension; equal scores go to the smaller vec_id; rows that repeat a
vec_id are candidates each, as a query the id counts once (its smallest vector), and none of them is a candidate of its own
query; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
REPLICAS = 4
LEAF = 64
#: Bound of the rounding of an inner product, against the sum of the squared norms.
ROUNDING = 1e-12


class Tree:
    """Vectors in the order of their leaves, and nodes (low row, high row, vantage vector, child ranges, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max(initial=0.0))
        extra = np.sqrt(np.maximum(self.top - norms, 0.0))
        lifted = np.column_stack([vectors, extra])
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.leaf = leaf
        if len(ids):
            self._grow(lifted, order, 0, len(order))
        self.ids, self.vectors = ids[order], vectors[order]

    def _grow(self, lifted: np.ndarray, order: np.ndarray, low: int, high: int) -> int:
        me = len(self.nodes)
        self.nodes.append((low, high, None, None, -1, -1))
        if high - low <= self.leaf:
            return me
        own = order[low:high]
        # The vantage point: of a few spread rows, the one whose distances to a few others vary most.
        tries, others = lifted[own[:: max(1, len(own) // 8)][:8]], lifted[own[:: max(1, len(own) // 64)]]
        spread = ((tries[:, None, :] - others[None, :, :]) ** 2).sum(axis=2) ** 0.5
        vantage = tries[int(spread.std(axis=1).argmax())]
        away = np.sqrt(((lifted[own] - vantage) ** 2).sum(axis=1))
        ranked = np.argsort(away, kind="stable")
        order[low:high], away = own[ranked], away[ranked]
        mid = (high - low) // 2
        ranges = (float(away[0]), float(away[mid - 1]), float(away[mid]), float(away[-1]))
        left = self._grow(lifted, order, low, low + mid)
        right = self._grow(lifted, order, low + mid, high)
        self.nodes[me] = (low, high, vantage, ranges, left, right)
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For a block of queries: (which query, vec_id, score) of the k best found each, and the number of inner products taken."""
        if not self.nodes or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        state = _Best(len(queries), k)
        lifted = np.column_stack([queries, np.zeros(len(queries))])
        base = np.einsum("ij,ij->i", queries, queries) + self.top
        # Rounding is in proportion to the squared norms: what lies within it of a bound counts as inside.
        state.slack, size = ROUNDING * base, np.sqrt(base)
        met = np.full(len(queries), -1)
        self._down(0, np.arange(len(queries)), lifted, queries, query_ids, state, met)
        work = [(0, np.arange(len(queries)))]
        while work:
            node, active = work.pop()
            low, high, vantage, ranges, left, right = self.nodes[node]
            if vantage is None:
                self._leaf(low, high, active[met[active] != node], queries, query_ids, state)
                continue
            away = np.sqrt(((lifted[active] - vantage) ** 2).sum(axis=1))
            radius = np.sqrt(np.maximum(base[active] - 2 * state.worst[active], 0.0) + 4 * state.slack[active])
            for child, a, b in ((right, ranges[2], ranges[3]), (left, ranges[0], ranges[1])):
                gap = np.maximum(np.maximum(a - away, away - b), 0.0)
                keep = ~(factor * gap > radius * (1 + 1e-9) + 1e-9 * size[active])
                if keep.any():
                    work.append((child, active[keep]))
        return (*state.rows(), state.taken)

    def _down(self, node: int, active: np.ndarray, lifted: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, state: _Best, met: np.ndarray) -> None:
        low, high, vantage, ranges, left, right = self.nodes[node]
        if vantage is None:
            met[active] = node
            self._leaf(low, high, active, queries, query_ids, state)
            return
        away = np.sqrt(((lifted[active] - vantage) ** 2).sum(axis=1))
        inner = away <= (ranges[1] + ranges[2]) / 2
        for child, part in ((left, active[inner]), (right, active[~inner])):
            if len(part):
                self._down(child, part, lifted, queries, query_ids, state, met)

    def _leaf(self, low: int, high: int, active: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, state: _Best) -> None:
        if not len(active):
            return
        scores = queries[active] @ self.vectors[low:high].T
        state.taken += scores.size
        near = scores >= (state.worst - state.slack)[active][:, None]
        near &= self.ids[low:high][None, :] != query_ids[active][:, None]
        q, v = np.nonzero(near)
        if len(q):
            exact = np.einsum("ij,ij->i", queries[active[q]], self.vectors[low + v])
            state.offer(active[q], self.ids[low + v], exact)


class _Best:
    """The k best candidates of each query: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.taken = k, 0
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.worst, self.slack = np.full(n, -np.inf), np.zeros(n)

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = np.unique(q)
        all_q = np.concatenate([np.repeat(own, self.k), q])
        all_id = np.concatenate([self.id[own].ravel(), ids])
        all_score = np.concatenate([self.score[own].ravel(), scores])
        order = np.lexsort((all_id, -all_score, all_q))
        all_q, all_id, all_score = all_q[order], all_id[order], all_score[order]
        first = np.searchsorted(all_q, own)
        take = first[:, None] + np.arange(self.k)
        self.id[own], self.score[own] = all_id[take], all_score[take]
        self.worst[own] = self.score[own, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, place = np.nonzero(np.isfinite(self.score))
        return q, self.id[q, place], self.score[q, place]


def usable(vector: Column) -> Column:
    """Not null, empty or zero, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def shards(rows: DataFrame, count: int, leaf: int = LEAF) -> DataFrame:
    """(dim, shard, tree): one row per shard with its pickled tree."""

    def build(key, group):
        dim = key[0].as_py()
        group = group.combine_chunks()
        ids = group.column("vec_id").to_numpy()
        vectors = _matrix(group.column("v").combine_chunks(), dim)
        order = np.argsort(ids, kind="stable")
        tree = Tree(ids[order], vectors[order], leaf)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """The k nearest vectors found for each query row: query_id, rank (from 1), vec_id, score.  Both tables have vec_id and embedding."""
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("dim", F.size("v"))
    asked = queries.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.groupBy("q").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n_shards = max(1, -(-rows.count() // shard_rows))
    n_blocks = max(1, -(-asked.count() // block_rows))
    trees = shards(rows, n_shards, leaf).withColumn("replica", F.explode(F.array(*map(F.lit, range(REPLICAS)))))

    def pack(key, group):
        dim = key[0].as_py()
        group = group.combine_chunks()
        block = (group.column("q").to_numpy(), _matrix(group.column("v").combine_chunks(), dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "queries": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})

    blocks = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int")).groupBy("dim", "block").applyInArrow(pack, "dim int, block int, queries binary")
    blocks = blocks.withColumn("replica", F.pmod("block", F.lit(REPLICAS))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    pairs = trees.join(blocks, ["dim", "shard", "replica"]).select("shard", "tree", "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, (ids, block) = pickle.loads(batch.column(1)[i].as_buffer()), pickle.loads(batch.column(2)[i].as_buffer())
                q, found, scores, _ = tree.search(ids, block, k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    met = pairs.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
