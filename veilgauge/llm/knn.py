"""Exact inner-product search: a k-d tree for each shard of the vectors, best-first, with the k-th score carried along.

Vectors are dealt out to shards of bounded size by a hash of their id. A task builds the tree of one shard: it splits at the median of the
component that spreads widest and keeps each node's tight bounding box. A box bounds a query's inner product from above, component by component. The search opens the node of
the highest bound first and stops as soon as no bound reaches the k-th score found so far.

A query is first answered in one shard. Its k-th score from there goes with it to the other shards, where most nodes are then ruled out by
their boxes. Queries travel in blocks, so that a task holds one shard and one block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.llm.common import staged

SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
LEAF = 256
EXACT = 2.0**53
LONG = 2**63 - 1


class Tree:
    """Median splits of ``points`` along the widest component, down to leaves of at most ``LEAF`` rows, in arrays."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        order = np.arange(len(points))
        spans, low, high, left = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            node = len(spans)
            box = points[order[a:b]]
            lo, hi = box.min(axis=0), box.max(axis=0)
            spans.append((a, b))
            low.append(lo)
            high.append(hi)
            left.append([])
            if parent >= 0:
                left[parent].append(node)
            axis = int(np.argmax(hi - lo)) if len(lo) else 0
            if b - a > LEAF and len(lo) and hi[axis] > lo[axis]:
                middle = (b - a) // 2
                part = np.argpartition(box[:, axis], middle)
                order[a:b] = order[a:b][part]
                stack += [(a + middle, b, node), (a, a + middle, node)]
        self.points, self.ids, self.spans, self.children = points[order], ids[order], spans, left
        self.low, self.high = np.array(low), np.array(high)
        self.largest = float(np.abs(points).max()) if points.size else 0.0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product that each box allows to each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, k: int, bounds: np.ndarray, kth: float) -> list[tuple[float, int]]:
        """At most ``k`` pairs of (score, id) with scores of ``kth`` or more, best first, ties to the smaller id."""
        best_score, best_id = np.zeros(0), np.zeros(0, dtype=np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            score = self.points[a:b] @ query
            near = np.flatnonzero((score >= kth) & (self.ids[a:b] != own))
            if not len(near):
                continue
            score, ids = np.concatenate([best_score, score[near]]), np.concatenate([best_id, self.ids[a:b][near]])
            top = np.lexsort((ids, -score))[:k]
            best_score, best_id = score[top], ids[top]
            if len(top) == k:
                kth = max(kth, best_score[-1])
        return list(zip(best_score.tolist(), best_id.tolist()))


def _plain(query: list[int], points: list[list[int]], ids: list[int], own: int, k: int, kth: float) -> list[tuple[int, int]]:
    """The same in unlimited integers, for components too large for exact floating-point sums; scores stop at the limits of a long."""
    scores = [(max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(query, p)))), i) for p, i in zip(points, ids) if i != own]
    return sorted((s for s in scores if s[0] >= kth), key=lambda s: (-s[0], s[1]))[:k]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


RESULT = "query_id long, query_key long, vec_id long, score long"


def _search(k: int):
    def run(key, queries: pa.Table, points: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if queries.num_rows and points.num_rows:
            q, p = _matrix(queries.column("vector")), _matrix(points.column("vector"))
            q_ids, q_keys = queries.column("query_id").to_pylist(), queries.column("query_key").to_pylist()
            kths = queries.column("kth").fill_null(-LONG - 1).to_pylist()
            ids = points.column("vec_id").to_numpy()
            size = np.abs(q).max(initial=0.0) * np.abs(p).max(initial=0.0) * max(p.shape[1], 1)
            if size < EXACT:
                tree = Tree(p, ids)
                bounds = tree.bounds(q)
                for i, own in enumerate(q_ids):
                    rows += [(own, q_keys[i], v, int(s)) for s, v in tree.search(q[i], own, k, bounds[i], float(kths[i]))]
            else:
                plain = [[int(x) for x in v] for v in p]
                for i, own in enumerate(q_ids):
                    found = _plain([int(x) for x in q[i]], plain, ids.tolist(), own, k, kths[i])
                    rows += [(own, q_keys[i], v, s) for s, v in found]
        names = ["query_id", "query_key", "vec_id", "score"]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components to ``floor(256 * x)``; vectors that are null or have components that are null or not finite are left out."""
    for batch in batches:
        ids, out = [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if vec_id is None or not vector.is_valid or vector.values.null_count:
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                x = np.floor(256 * x)
            if np.isfinite(x).all():
                ids.append(vec_id)
                out.append(x)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "vector"])


def top_scores(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, query_key, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``every`` the ``k`` other rows
    of the highest inner products, ties to the smaller id. Components are ``floor(256 * x)``.

    Vectors that are null, have a null or non-finite component, or a null id take no part. Rows that carry the query's id are not its candidates; a query
    given twice with equal vectors is answered once, with different vectors once for each (``query_key``). Only vectors of the query's length are
    candidates; empty vectors score 0 with each other. Scores beyond a long stop at its limits. Fewer than ``k`` candidates give fewer rows. Other columns are not read.
    """
    whole = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_whole, "vec_id long, vector array<double>")
    whole = staged(whole.withColumn("size", F.size("vector")))
    queries = whole.filter(F.pmod("vec_id", F.lit(every)) == 0).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_key"), "vector", "size"
    ).dropDuplicates(["query_id", "query_key"])
    n, asked = whole.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / QUERY_ROWS))
    block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")
    home = F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(shards)).cast("int")
    queries = staged(queries.withColumns({"block": block, "home": home}))
    points = whole.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["size", "shard", "block"]

    def answer(asks: DataFrame) -> DataFrame:
        asks = asks.select("query_id", "query_key", "vector", "kth", *keys)
        return asks.groupBy(*keys).cogroup(points.select("vec_id", "vector", *keys).groupBy(*keys)).applyInArrow(_search(k), RESULT)

    at_home = staged(answer(queries.withColumn("kth", F.lit(None).cast("long")).withColumn("shard", F.col("home"))))
    found = at_home
    if shards > 1:
        kth = at_home.groupBy("query_id", "query_key").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        kth = kth.filter(F.col("n") == k).select("query_id", "query_key", F.col("least").alias("kth"))
        others = queries.join(kth, ["query_id", "query_key"], "left")
        others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
        found = at_home.unionByName(answer(others))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_key", "rank", "vec_id", "score")
