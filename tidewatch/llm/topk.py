"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components fall into ``GROUPS`` groups, each with its own local score (a partial inner
product); a score is the sum of its local scores.  For blocks of queries against blocks of rows:

1. every group's list gives its best k entries, whose exact sums give each query a k-th best score:
   a cutoff that no true answer can fall below; the largest over all blocks is kept;
2. with the cutoff, every group sends the entries whose local score reaches the uniform threshold
   (cutoff divided by the groups); an entry that reaches it nowhere sums to less than the cutoff;
3. the entries sent are resolved to exact scores, and those below the cutoff go.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.blocks import one_each, pack
from tidewatch.llm.scratch import cut

GROUPS = 4
#: Row blocks that a task meets with each block of queries, at most.
BLOCKS_TOGETHER = 16
NONE = -(1 << 62)


def split_dims(d: int) -> list[slice]:
    edges = [round(d * g / GROUPS) for g in range(GROUPS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """The type of exact products over the whole width: a float while every sum is exactly representable, else an integer."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object if top >= 1 << 62 else np.int64


def local_scores(q: np.ndarray, x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Each group's local scores; the query's own row is out of reach in all of them."""
    kind = exact_kind(q, x)  # the groups' sums are added in the same type
    q, x = q.astype(kind), x.astype(kind)
    got = [q[:, s] @ x[:, s].T for s in split_dims(q.shape[1])]
    low = -np.inf if got[0].dtype.kind == "f" else NONE // len(got)
    for g in got:
        g[own] = low
    return got


def first_phase(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Each query's best k scores among the groups' own best k entries, descending."""
    n = parts[0].shape[1]
    k = min(k, n)
    seen = np.zeros(parts[0].shape, bool)
    for p in parts:
        if p.dtype == object:
            p = p.astype(float)
        np.put_along_axis(seen, np.argpartition(p, n - k, axis=1)[:, n - k :], True, 1)
    total = sum(parts).astype(np.float64)
    total[~seen] = -np.inf
    return -np.sort(-total, axis=1)[:, :k]


def later_phases(parts: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row indices and exact scores of the entries that reach the cutoff."""
    sent = np.zeros(parts[0].shape, bool)
    for p in parts:
        sent |= p >= (cutoff / len(parts))[:, None]
    i, j = np.nonzero(sent)
    score = sum(p[i, j] for p in parts)
    keep = (score >= cutoff[i]) & (score > float(NONE))
    return i[keep], j[keep], score[keep]


def exact_topk(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vec: str = "vec") -> DataFrame:
    """``(query_id, rank, id, score)``: each query's k rows of largest inner product, ties to the smaller id.

    Vectors are arrays of whole numbers.  Null vectors and those that hold null or a number that is
    not finite take no part, nor do rows without an id; rows that repeat an id count once; a row is
    never its own answer; vectors of another length than the query's are not candidates; fewer
    candidates than k give fewer ranks; no queries or no rows give an empty result.
    """
    q, x = one_each(queries, id, vec), one_each(rows, id, vec)
    packed, _ = cut(spark, pack(x, "int64").withColumn("g", F.xxhash64("ids")))
    count = packed.count()
    groups = max(min(count, 64), -(-count // BLOCKS_TOGETHER))
    # a group is a few whole blocks, however many rows hold one vector
    right = packed.select(F.pmod("g", F.lit(groups)).alias("g"), "n", F.col("ids").alias("x_ids"), F.col("vecs").alias("x_vecs"))

    def pairs(block: DataFrame) -> DataFrame:
        left = block.select("ids", "vecs", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
        return right.join(left, "g").select("x_ids", "x_vecs", "ids", "vecs", "extra")

    def opened(b: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(b.num_rows):
            xi, xv, qi, qv, extra = (None if (s := b.column(c)[i]).as_py() is None else s.as_buffer() for c in range(5))
            xi, qi = np.frombuffer(xi, np.int64), np.frombuffer(qi, np.int64)
            xv, qv = np.frombuffer(xv, np.int64).reshape(len(xi), -1), np.frombuffer(qv, np.int64).reshape(len(qi), -1)
            if xv.shape[1] == qv.shape[1]:
                for at in range(0, len(qi), 512):
                    part = slice(at, at + 512)
                    yield qi[part], xi, local_scores(qv[part], xv, qi[part, None] == xi[None, :]), None if extra is None else np.frombuffer(extra, np.float64)[part]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, _, parts, _ in opened(b):
                best = first_phase(parts, k)
                if best.shape[1] == k:
                    yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(best[:, -1])], names=["id", "cutoff"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, xi, parts, cutoff in opened(b):
                i, j, score = later_phases(parts, cutoff)
                score = score.astype(np.int64)
                order = np.lexsort((xi[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                top = place < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[i[top]]), pa.array(xi[j[top]]), pa.array(score[top])], names=["query_id", "id", "score"])

    cutoffs = pairs(pack(q, "int64")).mapInArrow(gather, "id bigint, cutoff double").groupBy("id").agg(F.max("cutoff").alias("cutoff"))
    again = q.join(cutoffs, "id", "left").select("id", "vec", F.coalesce("cutoff", F.lit(float(NONE))).alias("cutoff"))
    found = pairs(pack(again, "int64", "cutoff")).mapInArrow(collect, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
