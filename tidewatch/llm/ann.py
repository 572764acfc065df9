"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.blocks import matrix, one_each
from tidewatch.llm.scratch import cut

#: The trees are fitted on so many rows at most, chosen by a hash of their ids; every row is indexed.
SAMPLE = 20_000
TREES, LEAF = 8, 256
#: A query visits this share of all trees' leaves, and so many at least.  Vectors without structure need such a share.
SHARE, LEAST_VISITS = 0.08, 64
#: No tree is deeper, which bounds the model: 2 ** DEEPEST thresholds of four bytes for each tree.
DEEPEST = 18


class Trees:
    """Each tree splits every level along one random direction, at the median of the node's sample rows."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.depth = int(np.clip(np.ceil(np.log2(max(total, 1) / LEAF)), 1, DEEPEST))
        self.axes = rng.standard_normal((TREES, self.depth, d)).astype(np.float32)
        self.cuts = np.zeros((TREES, (1 << self.depth) - 1), np.float32)
        for t in range(TREES):
            along = sample @ self.axes[t].T
            members = {0: np.arange(len(sample))}
            for level in range(self.depth):
                below = {}
                for node, rows in members.items():
                    at = np.median(along[rows, level])
                    self.cuts[t, node] = at
                    right = along[rows, level] > at
                    for side, part in ((1, rows[~right]), (2, rows[right])):
                        # a child with too few sample rows is split as its parent's rows would be
                        below[2 * node + side] = part if len(part) >= 8 else rows
                members = below

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), TREES), np.int64)
        for t in range(TREES):
            along, node = x @ self.axes[t].T, np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (along[:, level] > self.cuts[t, node])
            out[:, t] = node
        return out

    def search(self, x: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The ``visits`` most promising (tree, leaf) pairs for one query, all trees in one queue.

        A branch's priority is the distance to the farthest splitting plane it lies beyond.
        """
        along = np.einsum("tld,d->tl", self.axes, x) / np.linalg.norm(self.axes, axis=2)
        scale = np.linalg.norm(self.axes, axis=2)
        queue = [(0.0, t, 0, 0) for t in range(TREES)]
        out: list[tuple[int, int]] = []
        while queue and len(out) < visits:
            price, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                gap = along[t, level] - self.cuts[t, node] / scale[t, level]
                right = gap > 0
                heapq.heappush(queue, (max(price, abs(gap)), t, level + 1, 2 * node + 1 + (not right)))
                node, level = 2 * node + 1 + right, level + 1
            out.append((t, node))
        return out


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vec: str = "embedding", share: float = SHARE) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's k nearest rows found, by Euclidean distance, ties to the smaller id.

    Vectors that are null, empty or all zeros, or that hold null or a number that isn't finite, take
    no part, nor do rows without an id; rows that repeat an id count once; a row is never its own
    answer; rows of another length than the sample's first are no candidates.  Equal vectors are
    indexed once, with the k + 1 smallest of their ids, since no other of them can be an answer.
    """
    x, q = one_each(rows, id, vec, zero=False), one_each(queries, id, vec, zero=False)
    x, _ = cut(spark, x)
    # the sample is a bounded one; the model that is sent to the tasks is bounded by DEEPEST
    sample = x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
    out = "query_id long, rank int, id long, score double"
    if not len(sample):
        return spark.createDataFrame([], out)
    d = len(sample[0])
    kind = "float32" if x.schema["vec"].dataType.elementType.simpleString() == "float" else "float64"
    trees = Trees(np.stack([np.asarray(v, np.float32) for v in sample if len(v) == d]), x.count())
    model = spark.sparkContext.broadcast(trees)
    visits = max(LEAST_VISITS, round(share * TREES * (1 << trees.depth)))
    width = F.size("vec") == d
    twins = Window.partitionBy("vec").orderBy("id")
    few = x.where(width).withColumn("n", F.row_number().over(twins)).where(F.col("n") <= k + 1)
    classes = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = q.where(width).groupBy("vec").agg(F.min("id").alias("class"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), kind)
            leaf = model.value.leaves(v.astype(np.float32))
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(leaf[:, t]), b.column(0), pa.array([r.tobytes() for r in v], pa.binary())], names=["tree", "leaf", "ids", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), kind)
            for i, c in enumerate(b.column(0).to_pylist()):
                at = model.value.search(v[i].astype(np.float32), visits)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in at], pa.int32()), pa.array([n for _, n in at], pa.int64()), pa.array([c] * len(at), pa.int64()), pa.array([v[i].tobytes()] * len(at), pa.binary())], names=["tree", "leaf", "class", "vec"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Exact distances of each visitor to the leaf's vectors; its best k + 1 of each leaf remain."""
        lk = left.column("tree").to_numpy().astype(np.int64) * (1 << 32) + left.column("leaf").to_numpy()
        rk = right.column("tree").to_numpy().astype(np.int64) * (1 << 32) + right.column("leaf").to_numpy()
        lo, ro = np.argsort(lk, kind="stable"), np.argsort(rk, kind="stable")
        lk, rk = lk[lo], rk[ro]
        lv, rv, cls = left.column("vec").to_pylist(), right.column("vec").to_pylist(), right.column("class").to_numpy()
        first = left.column("ids").combine_chunks()
        ids, head = first.to_pylist(), first.flatten().to_numpy()[first.offsets.to_numpy()[:-1]] if len(first) else np.empty(0)
        res: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for key in np.unique(rk).tolist():
            a, b = np.searchsorted(lk, [key, key + 1])
            if a == b:
                continue
            at = lo[a:b]
            block = np.frombuffer(b"".join([lv[i] for i in at]), kind).reshape(b - a, -1).astype(np.float64)
            for r in ro[slice(*np.searchsorted(rk, [key, key + 1]))].tolist():
                diff = block - np.frombuffer(rv[r], kind)
                dist = np.sqrt((diff * diff).sum(axis=1))
                near = np.flatnonzero(dist <= np.partition(dist, k)[k]) if len(dist) > k + 1 else np.arange(len(dist))
                res.append((np.full(len(near), cls[r]), at[near], dist[near]))
        if not res:
            return pa.table({"class": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        c, row, dist = (np.concatenate(x) for x in zip(*res, strict=True))
        order = np.lexsort((head[row], dist, c))
        c, row, dist = c[order], row[order], dist[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (head[row[1:]] != head[row[:-1]])])  # other trees bring a vector again
        c, row, dist = c[new], row[new], dist[new]
        top = np.arange(len(c)) - np.searchsorted(c, c) <= k
        return pa.table({"class": pa.array(c[top], pa.int64()), "ids": pa.array([ids[i] for i in row[top]], pa.list_(pa.int64())), "score": pa.array(dist[top])})

    parts = max(64, trees.cuts.shape[1] * TREES // 64)
    part = F.pmod(F.xxhash64("tree", "leaf"), F.lit(parts)).alias("part")
    left = classes.select("ids", "vec").mapInArrow(index, "tree int, leaf long, ids array<long>, vec binary").select(part, "*")
    right = asked.select("class", "vec").mapInArrow(visit, "tree int, leaf long, class long, vec binary").select(part, "*")
    near = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(rerank, "class long, ids array<long>, score double")
    near = near.select("class", F.explode("ids").alias("id"), "score").distinct()
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    pairs = q.where(width).join(asked, "vec").select(F.col("id").alias("query_id"), "class").join(best, "class").where("query_id <> id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
