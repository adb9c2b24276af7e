"""Exact top-k inner-product search with one KD-tree for each shard of the vectors.

A tree halves a shard at the median of its widest coordinate and keeps the tight bounding box of every
node. For a query q the largest inner product a box can hold is ``sum(max(q * low, q * high))``;
traversal takes the node with the largest bound first and stops when no bound reaches the query's kth
score. Each query first searches one shard; the kth score found there goes along to all other shards,
so most of their nodes are never opened.

Queries travel to shards as rows: a shard's vectors arrive first, then the queries stream past its
tree, so memory holds one bounded shard however many queries there are.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a
null ``vec_id``; of several vectors under one ``vec_id`` the smallest one counts, so repeated rows count
once; vectors meet vectors of the same length only; ties go to the smaller ``vec_id``; a table without
queries gives no rows; other input columns are ignored. Integers beyond 2**63 are cut to a long's range
in the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cutledger.llm import common as cm

SHARD_ROWS, LEAF_ROWS = 4096, 64
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Tree:
    """KD-tree over integer vectors in float64 (exact below 2**53) or Python integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.ids, self.vectors = ids, vectors
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._grow(np.arange(len(ids)), leaf_rows)
        self.low, self.high = np.array(self.low, vectors.dtype), np.array(self.high, vectors.dtype)

    def _grow(self, rows: np.ndarray, leaf_rows: int) -> int:
        own, node = self.vectors[rows], len(self.rows)
        low, high = (own.min(axis=0), own.max(axis=0)) if own.shape[1] else (own[0], own[0])
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > leaf_rows and (high > low).any():
            order = np.argsort(own[:, np.argmax(high - low)], kind="stable")
            half = len(rows) // 2
            self.children[node] = (self._grow(rows[order[:half]], leaf_rows), self._grow(rows[order[half:]], leaf_rows))
            self.rows[node] = None
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product each node's box allows for each query."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, own_id: int, query: np.ndarray, bounds: np.ndarray, k: int, kth) -> list[tuple]:
        """The shard's best ``(score, -vec_id)`` for a query that still reach ``kth``, the kth score known so far."""
        best: list[tuple] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if kth is not None and -bound < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            reach = np.ones(len(rows), bool) if kth is None else (scores >= kth).astype(bool)
            for s, i in zip(scores[reach], self.ids[rows[reach]], strict=True):
                if i != own_id:
                    entry = (s, -int(i))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                kth = best[0][0] if kth is None else max(kth, best[0][0])
        return best


def _matrix(vectors: list) -> np.ndarray:
    """Float64 where every product and sum is exact, else Python integers."""
    m = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    if m.size and np.abs(m).max() ** 2 * m.shape[1] >= 2.0**53:
        return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return m


def _search_shards(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None
        for got in batches:
            rows = got.to_pydict()
            keys = list(zip(rows["dim"], rows["shard"], strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and rows["is_query"][end] == rows["is_query"][at]:
                    end += 1
                if keys[at] != shard:
                    shard, ids, vectors, tree = keys[at], [], [], None
                if not rows["is_query"][at]:
                    ids += rows["vec_id"][at:end]
                    vectors += rows["v"][at:end]
                elif ids:
                    queries = _matrix(rows["v"][at:end])
                    own = _matrix(vectors)
                    if queries.dtype != own.dtype or (own.size and own.dtype != object and np.abs(own).max() * np.abs(queries).max() * own.shape[1] >= 2.0**53):
                        own, queries = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (own, queries))
                    if tree is None or tree.vectors.dtype != own.dtype:
                        tree = Tree(np.array(ids, np.int64), own)
                    bounds = tree.bounds(queries)
                    hits = [(q, -i, max(-(2**63), min(2**63 - 1, int(s)))) for q, v, b, kth in zip(rows["vec_id"][at:end], queries, bounds, rows["kth"][at:end], strict=True)
                            for s, i in tree.search(q, v, b, k, kth)]
                    yield cm.batch(HITS, {name: [h[c] for h in hits] for c, name in enumerate(HITS.names)})
                at = end

    return run


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, v, dim)``: ``floor(scale * component)`` of every usable vector, one row a ``vec_id``."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    wide = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return (
        vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` largest inner products of each query (``vec_id`` divisible by ``every``) among all other vectors."""
    whole = cm.saved(whole_vectors(vectors))
    shards = whole.groupBy("dim").count().select("dim", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards"))
    placed = whole.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    lanes = ["dim", "shard", "is_query", "vec_id", "v", "kth"]
    none = F.lit(None).cast("double")
    data = placed.select("dim", "shard", F.lit(False).alias("is_query"), "vec_id", "v", none.alias("kth"))
    queries = placed.where(F.col("vec_id") % every == 0)

    def search(routed: DataFrame) -> DataFrame:
        rows = data.unionByName(routed).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "is_query")
        return rows.mapInArrow(_search_shards(k), "query_id long, vec_id long, score long")

    first = cm.saved(search(queries.select("dim", "shard", F.lit(True).alias("is_query"), "vec_id", "v", none.alias("kth"))))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("known"))
    asked = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    elsewhere = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).where("other <> shard")
    rest = search(elsewhere.select("dim", F.col("other").alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v", F.col("known").alias("kth")).select(*lanes))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
