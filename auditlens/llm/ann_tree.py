"""Approximate nearest neighbours by inner product: hierarchical k-means tree with best-bin-first search.

1. The tree is fitted on a bounded sample: the ``SAMPLE`` rows per leaf, at most ``FIT_ROWS``, with the smallest id hashes.
   A node splits by k-means into up to ``BRANCH`` children until ``SAMPLE`` rows or fewer are left. The number of leaves
   follows the square root of the table, so leaves and the leaves that a query visits both grow slowly.
2. Every row of the table goes down the tree to its leaf. The leaves are counted; one with more than twice the mean is dealt
   into blocks by id hash (a vector that many rows share is one leaf, but many blocks).
3. Calibration: ``PROBES`` queries are compared with all rows. Each probe's queue of nodes, best centroid first, gives the
   visit in which each true neighbour is met; visits widen until the mean recall reaches ``RECALL``.
4. Every query visits that many leaves by its own priority queue, and more until they hold k other rows. Its visits meet the
   blocks by key; a block's products come from one matrix product, and every pair within its rounding error of the k-th best is
   summed again component by component, so equal vectors get equal scores. The square root of the visits come first: their k-th best
   score bounds what the other visits send on, so pairs do not grow with queries times visits. The last k are picked by a window
   whose limit also applies before the shuffle.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part, as do rows with a NULL
vec_id and vectors of another than the most frequent length (ties: the shorter). Of rows that repeat a vec_id the one with the smallest
vector takes part. Fewer than k candidates give all of them; a single vector or an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.llm import store
from auditlens.llm.store import staged

K = 20
EVERY = 20
BRANCH = 8
#: Sample rows per leaf, and at most in all.
SAMPLE = 24
FIT_ROWS = 49_152
#: Leaves are this times the square root of the number of rows.
LEAVES = 0.3
PROBES = 256
RECALL = 0.96
#: Components of a matrix product at once.
_CELLS = 1 << 21


@dataclass
class Tree:
    """children[node]: (centroids, child nodes); leaf_of[node]: the leaf's number."""

    children: dict[int, tuple[np.ndarray, list[int]]]
    leaf_of: dict[int, int]

    def assign(self, v: np.ndarray) -> np.ndarray:
        """Leaf numbers of the rows of ``v``: the nearest centroid at every level."""
        leaf = np.zeros(len(v), np.int64)
        stack = [(0, np.arange(len(v)))]
        while stack:
            node, rows = stack.pop()
            if node in self.leaf_of:
                leaf[rows] = self.leaf_of[node]
            elif len(rows):
                centroids, nodes = self.children[node]
                near = _nearest(v[rows], centroids)
                stack += [(child, rows[near == c]) for c, child in enumerate(nodes)]
        return leaf

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by best bin first: the queue holds open nodes by the inner product with their centroid."""
        queue, order = [(0.0, 0, 0)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                yield self.leaf_of[node]
                continue
            centroids, nodes = self.children[node]
            for score, child in zip((centroids @ q).tolist(), nodes):
                order += 1
                heapq.heappush(queue, (-score, order, child))


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(axis=1) - 2 * (v @ centroids.T), axis=1)


def _kmeans(v: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, nearest): Lloyd's rounds from far-apart starts; centroids without rows go."""
    centroids, far = v[:1], ((v - v[0]) ** 2).sum(axis=1)
    while len(centroids) < k and far.max() > 0:
        centroids = np.vstack([centroids, v[np.argmax(far)]])
        far = np.minimum(far, ((v - centroids[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = _nearest(v, centroids)
        used = np.unique(near)
        centroids = np.array([v[near == c].mean(axis=0) for c in used])
    return centroids, _nearest(v, centroids)


def fit_tree(v: np.ndarray, branch: int = BRANCH, sample: int = SAMPLE) -> Tree:
    tree, stack, nodes = Tree({}, {}), [(0, np.arange(len(v)))], 1
    while stack:
        node, rows = stack.pop()
        parts = min(branch, math.ceil(len(rows) / sample))
        centroids, near = _kmeans(v[rows], parts) if parts > 1 else (v[:0], None)
        filled = [c for c in range(len(centroids)) if (near == c).any()]
        if len(filled) < 2:
            tree.leaf_of[node] = len(tree.leaf_of)
            continue
        below = list(range(nodes, nodes + len(filled)))
        nodes += len(filled)
        tree.children[node] = centroids[filled], below
        stack += [(child, rows[near == c]) for child, c in zip(below, filled)]
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): the rows that take part, one per id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL").filter(fine)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    size = sizes.orderBy(F.desc("n"), "size").first()
    if size is None:
        return rows
    rows = rows.filter(F.size("v") == size["size"])
    twice = rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1")
    if twice.isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list<double> array of equal, positive lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): each query's k best candidates of other ids, ties to smaller ids; with
    ``floor``, a score per query, only candidates that reach it.

    A matrix product picks all that may be among them; their scores are sums in component order.
    """
    out = []
    step = max(1, _CELLS // max(len(v), 1))
    slack = 4e-16 * v.shape[1] * np.sqrt((v ** 2).sum(axis=1).max(initial=0.0))
    for s in range(0, len(q), step):
        part = q[s:s + step]
        near = part @ v.T
        near[q_ids[s:s + step, None] == v_ids[None, :]] = -np.inf
        least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(part), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[s:s + step])
        least = least - 2 * slack * np.sqrt((part ** 2).sum(axis=1))
        row, col = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        score = np.zeros(len(row))
        for d in range(v.shape[1]):
            score += part[row, d] * v[col, d]
        order = np.lexsort((v_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        if floor is not None:
            keep &= score >= floor[row + s]
        out.append((row[keep] + s, col[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _exact(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, leaf, score): the k nearest of all rows for a few given queries."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            row, col, score = best(q, q_ids, _matrix(b.column("v")), ids, k) if len(ids) else (ids, ids, ids * 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[col]), b.column("leaf").take(pa.array(col)), pa.array(score)],
                                             ["query_id", "vec_id", "leaf", "score"])

    return _top(rows.select("vec_id", "v", "leaf").mapInArrow(task, "query_id long, vec_id long, leaf long, score double"), k)


def _block_task(k: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if len(q_ids) and len(ids):
            q, v = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
            row, col, score = best(q, q_ids, v, ids, k, left.column("floor").to_numpy())
        else:
            row, col, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return pa.table({"query_id": pa.array(q_ids[row]), "vec_id": pa.array(ids[col]), "score": pa.array(score)})

    return task


@dataclass
class Index:
    """``rows``: (vec_id, v, leaf, block) of every usable row; ``size``: rows per leaf; ``blocks``: blocks per leaf."""

    tree: Tree
    rows: DataFrame
    size: list[int]
    blocks: list[int]


def build(vectors: DataFrame, folder: str, leaves: float = LEAVES, fit_rows: int = FIT_ROWS) -> Index | None:
    """The index of every usable row; None without any."""
    clean = staged(usable(vectors), folder, "clean")
    n = clean.count()
    if not n:
        return None
    wanted = min(n, fit_rows, max(1, round(leaves * math.sqrt(n))) * SAMPLE)
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").toArrow().column("v").combine_chunks()
    tree = fit_tree(_matrix(sample))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(_matrix(b.column("v"))))], ["vec_id", "v", "leaf"])

    placed = staged(clean.mapInArrow(assign, "vec_id long, v array<double>, leaf long"), folder, "placed")
    size = [0] * len(tree.leaf_of)
    for r in placed.groupBy("leaf").count().collect():  # as many rows as leaves
        size[r["leaf"]] = r["count"]
    usual = 2 * math.ceil(n / len(size))
    blocks = [max(1, math.ceil(s / usual)) for s in size]
    many = F.get(F.array(*[F.lit(b) for b in blocks]), F.col("leaf").cast("int"))
    return Index(tree, placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), many).cast("int")), size, blocks)


def calibrate(index: Index, queries: DataFrame, k: int = K, recall: float = RECALL, probes: int = PROBES) -> int:
    """Leaves to visit, so that the probes' mean recall against all rows reaches ``recall``."""
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).select("vec_id", "v").toArrow()
    ids, v = chosen.column("vec_id").to_numpy(), _matrix(chosen.column("v").combine_chunks())
    truth: dict[int, list[int]] = {}
    for r in _exact(index.rows, ids, v, k).select("query_id", "leaf").collect():  # probes * k rows
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    met = np.zeros(len(index.size) + 1)
    for i, q in zip(ids.tolist(), v):
        if i in truth:
            visit = {leaf: n for n, leaf in enumerate(index.tree.visits(q), 1)}
            for leaf in truth[i]:
                met[visit[leaf]] += 1 / len(truth[i])
    if not truth:
        return 1
    visits = 1
    while visits < len(index.size) and met[:visits + 1].sum() < recall * len(truth):
        visits += 1
    return visits


def _visited(index: Index, queries: DataFrame, after: int, visits: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the pairs of each query (vec_id, v, floor) and the leaves that it visits after the
    first ``after``, up to ``visits`` and until all its visits hold k other rows."""
    tree, size, blocks = index.tree, index.size, index.blocks

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, leaf, block = [], [], []
            for i, q in enumerate(_matrix(b.column("v"))):
                held, fresh = 0, after == 0
                for n, at in enumerate(tree.visits(q), 1):
                    held += size[at]
                    if fresh:
                        row += [i] * blocks[at]
                        leaf += [at] * blocks[at]
                        block += range(blocks[at])
                    if n >= visits and held > k:
                        break
                    fresh = fresh or (n >= after and held > k)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("vec_id", "v", "floor")), pa.array(leaf, pa.int64()), pa.array(block, pa.int32())],
                                             ["vec_id", "v", "floor", "leaf", "block"])

    asked = queries.select("vec_id", "v", "floor").mapInArrow(plan, "vec_id long, v array<double>, floor double, leaf long, block int")
    return (asked.groupBy("leaf", "block").cogroup(index.rows.select("vec_id", "v", "leaf", "block").groupBy("leaf", "block"))
            .applyInArrow(_block_task(k), "query_id long, vec_id long, score double"))


def search(index: Index, queries: DataFrame, visits: int, folder: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that each query's first ``visits`` leaves hold."""
    few = math.isqrt(visits)
    first = staged(_top(_visited(index, queries.withColumn("floor", F.lit(float("-inf"))), 0, few, k), k).drop("rank"), folder, "first")
    full = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
    bounded = queries.join(full.drop("n"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = _visited(index, bounded, few, visits, k)
    return _top(first.unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose vec_id is divisible by ``every``, against all other rows."""
    spark = vectors.sparkSession
    folder = store.scratch(spark, "ann")
    index = build(vectors.select("vec_id", "embedding"), folder)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.filter(F.col("vec_id") % every == 0)
    return search(index, queries, calibrate(index, queries, k, recall), folder, k)


def op12_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
