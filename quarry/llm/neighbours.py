"""Nearest neighbours by inner product: vantage-point trees on shards.

Inner product becomes distance by one more coordinate: with M the largest norm of a shard, x goes to
(x, sqrt(M^2 - |x|^2)) and a query to (q, 0), and then |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each shard builds a
tree: a vantage point splits the rest at its median distance. A query first goes down to one leaf, which bounds
its k-th distance; then subtrees are left out whose triangle-inequality bound times ``factor`` exceeds it. Factor one
is exact; a larger one leaves out more. What is reported is scored again on the original vectors."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch

SHARD_ROWS = 8192
#: Queries that pass a tree in one task, and those searched at once.
STRIPE_QUERIES, BLOCK_QUERIES = 1 << 18, 4096
LEAF = 256
#: Candidates kept beyond k before exact scores decide, for products that differ in rounding alone.
MARGIN = 4


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = -1
    inner: Node | None = None
    outer: Node | None = None
    inner_range: tuple[float, float] = (0.0, 0.0)
    outer_range: tuple[float, float] = (0.0, 0.0)


class Tree:
    """A vantage-point tree on rows of ``x``, for largest inner products."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        norms = (x**2).sum(1)
        self.x, self.most = x, float(norms.max())
        self.lifted = np.column_stack([x, np.sqrt(np.maximum(0, self.most - norms))])
        self.scored = 0
        self.root = self._build(np.arange(len(x)), leaf, np.random.default_rng(len(x)))

    def __getstate__(self) -> dict:
        return {"x": self.x, "most": self.most, "root": self.root, "scored": 0}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.lifted = np.column_stack([self.x, np.sqrt(np.maximum(0, self.most - (self.x**2).sum(1)))])

    def _build(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows)
        at = int(rng.integers(len(rows)))
        point, rest = int(rows[at]), np.delete(rows, at)
        d = np.sqrt(((self.lifted[rest] - self.lifted[point]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        a, b = order[:half], order[half:]
        node = Node(point=point, inner_range=(float(d[a[0]]), float(d[a[-1]])), outer_range=(float(d[b[0]]), float(d[b[-1]])))
        node.inner, node.outer = self._build(rest[a], leaf, rng), self._build(rest[b], leaf, rng)
        return node

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows of the k largest products found (-1: none) and these products."""
        self.q, self.k, self.factor = queries, k, factor
        self.lift = np.column_stack([queries, np.zeros(len(queries))])
        self.squares = (queries**2).sum(1) + self.most
        self.best = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)
        self.first = np.full(len(queries), -1)
        self._descend(self.root, np.arange(len(queries)))
        self._visit(self.root, np.arange(len(queries)))
        return self.row, self.best

    def _to(self, node: Node, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((self.lift[at] - self.lifted[node.point]) ** 2).sum(1))
        return tuple(np.maximum(0, np.maximum(d - high, low - d)) for low, high in (node.inner_range, node.outer_range))

    def _offer(self, at: np.ndarray, rows: np.ndarray) -> None:
        product = self.q[at] @ self.x[rows].T
        self.scored += product.size
        both = np.concatenate([self.best[at], product], axis=1)
        kept = np.argpartition(-both, self.k - 1, axis=1)[:, : self.k]
        held = np.concatenate([self.row[at], np.broadcast_to(rows, product.shape)], axis=1)
        self.best[at], self.row[at] = np.take_along_axis(both, kept, 1), np.take_along_axis(held, kept, 1)

    def _descend(self, node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.rows is not None:
            self.first[at] = id(node) % (1 << 62)
            self._offer(at, node.rows)
            return
        inner, outer = self._to(node, at)
        self._descend(node.inner, at[inner <= outer])
        self._descend(node.outer, at[inner > outer])

    def _visit(self, node: Node, at: np.ndarray) -> None:
        if node.rows is not None:
            at = at[self.first[at] != id(node) % (1 << 62)]
            if len(at):
                self._offer(at, node.rows)
            return
        self._offer(at, np.array([node.point]))
        for side, child in enumerate((node.inner, node.outer)):
            bound = self._to(node, at)[side]
            reach = np.sqrt(np.maximum(0, self.squares[at] - 2 * self.best[at].min(1)))  # infinite until k are found
            going = at[~(bound * self.factor > reach * (1 + 1e-9) + 1e-9)]
            if len(going):
                self._visit(child, going)


def _matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _planted(key: tuple, rows: pa.Table) -> pa.Table:
    """The tree of a shard, with the ids that each of its vectors stands for."""
    dimension, shard = (k.as_py() for k in key)
    ids = rows["ids"].to_pylist()
    by_least = np.argsort([i[0] for i in ids])  # the tree should not follow the order that rows came in
    tree = Tree(_matrix(rows["vector"].combine_chunks(), dimension)[by_least])
    return pa.table([pa.array([dimension], pa.int32()), pa.array([shard], pa.int32()), pa.array([pickle.dumps((tree, [ids[i] for i in by_least]))], pa.binary())], names=["dimension", "shard", "tree"])


def _found(tree: Tree, ids: list[list[int]], own: list[int], q: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """The ``k`` best rows of a shard for some queries, exactly scored."""
    x, dimension = tree.x, q.shape[1]
    held = min(k + 1 + MARGIN, len(x))
    row, best = tree.search(q, held, factor)
    # where all that is held is within rounding of the k-th other, more rows may be
    rounding = dimension * 2.0**-50 * np.sqrt((q**2).sum(1)) * math.sqrt(float((x**2).sum(1).max()))
    edge = np.sort(best, axis=1)[:, -min(k + 1, held)] - 2 * rounding
    cut = (best.min(1) >= edge) & (held < len(x))
    out: list[tuple[int, int, float]] = []
    for me, query, rows, products, least, more in zip(own, q, row, best, edge.tolist(), cut.tolist(), strict=True):
        if more:
            products = x @ query
            rows = np.flatnonzero(products >= least)
            products = products[rows]
        exact = [(-math.fsum((query * x[r]).tolist()), i) for r, p in zip(rows.tolist(), products.tolist(), strict=True) if p > -math.inf for i in ids[r][: k + 1] if i != me]
        out += [(me, i, -s) for s, i in sorted(exact)[:k]]
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])


def _passing(k: int, factor: float):
    """Sorted rows of (dimension, shard, stripe, tree, id, vector), a tree before its queries -> what each query finds in each tree."""

    def run(batches):
        place, tree, ids = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dimension", "shard", "stripe")), strict=True))
            planted = np.flatnonzero(batch.column("tree").is_valid().to_numpy(zero_copy_only=False)).tolist()
            cuts = sorted({0, *planted, *(i + 1 for i in planted), *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)})
            for lo, hi in pairwise(cuts):
                if (pickled := batch.column("tree")[lo]).is_valid:
                    place, (tree, ids) = keys[lo], pickle.loads(pickled.as_py())
                elif keys[lo] == place:  # else no vector of this dimension is in the shard
                    for at in range(lo, hi, BLOCK_QUERIES):
                        part = batch.slice(at, min(BLOCK_QUERIES, hi - at))
                        yield _found(tree, ids, part.column("id").to_pylist(), _matrix(part.column("vector"), place[0]), k, factor)

    return run


def nearest(df: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, stripe_queries: int = STRIPE_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides, the ``k`` other rows of largest inner product found.

    Ties go to the smaller id; with fewer candidates all are given. Null ids, and vectors that are null, zero or
    hold null or non-finite components, take no part. Of rows with one id one stays, the smallest
    vector. Vectors of different lengths are not compared. An empty table gives no rows. Other columns are
    not read. Equal vectors are searched once and stand for their ``k`` + 1 smallest ids, which is all that a result can hold of them."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours")
    vector = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull())
    usable = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists(vector, lambda v: v != 0)
    rows = scratch.keep(rows.filter(F.coalesce(usable, F.lit(False))).groupBy("id").agg(F.min("vector").alias("vector")), "rows")
    # the smallest ids of each vector: first in 64 parts, then of these, so that a vector that very many rows share is no one task's
    part = Window.partitionBy("vector", "salt").orderBy("id")
    least = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    least = least.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    distinct = scratch.keep(least.withColumn("dimension", F.size("vector")), "distinct")
    asked = rows.filter(F.col("id") % every == 0).withColumn("dimension", F.size("vector"))
    shards = max(1, -(-distinct.count() // shard_rows))
    stripes = max(1, -(-asked.count() // stripe_queries))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    trees = scratch.keep(sharded.groupBy("dimension", "shard").applyInArrow(_planted, "dimension int, shard int, tree binary"), "trees")
    # each tree is made once and goes once to each stripe, whose queries pass it in blocks
    left = trees.withColumn("stripe", each(stripes)).select("dimension", "shard", "stripe", "tree", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"))
    right = asked.withColumn("shard", each(shards)).select("dimension", "shard", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(None).cast("binary").alias("tree"), "id", "vector")
    place = ["dimension", "shard", "stripe"]
    passing = left.union(right).repartition(*place).sortWithinPartitions(*place, F.col("tree").isNull())
    found = passing.mapInArrow(_passing(k, factor), "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
