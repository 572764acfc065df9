"""Patch correspondence, trajectory residuals and saliency over a table of patch tokens."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pi_shift(spark: SparkSession, rows: int, cols: int, stride: int, length: int, diagonal: bool) -> DataFrame:
    """``src, dst`` of patches that move left (and up) by the stride, rounded half to even; those that leave are absent."""
    if diagonal and rows != cols:
        raise ValueError("a diagonal shift needs a square grid")
    by = F.bround(F.lit(cols * stride / length), 0).cast("int")
    g = spark.range(rows * cols).select(F.col("id").cast("int").alias("src"), F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    r = F.col("r") - by if diagonal else F.col("r")
    return g.where((F.col("c") - by >= 0) & (F.col("c") - by < cols) & (r >= 0)).select("src", (r * cols + F.col("c") - by).cast("int").alias("dst"))


def pi_identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("src"), F.col("id").cast("int").alias("dst"))


def moved_patches(tokens: DataFrame, pi: DataFrame) -> DataFrame:
    """``w, src, dst`` of every token whose patch the map holds; ``pi`` has a row a patch of the grid."""
    return tokens.select("w", F.col("patch").alias("src")).join(F.broadcast(pi), "src").select("w", "src", "dst")


def squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def lag_prediction(tokens: DataFrame) -> DataFrame:
    """The window before as prediction: ``w, patch, pred``; the first window has none."""
    return tokens.select((F.col("w") + 1).alias("w"), "patch", F.col("vec").alias("pred"))


def traj_residuals(tokens: DataFrame, pred: DataFrame, pi: DataFrame) -> DataFrame:
    """``w, patch, r``: squared distance of each prediction to the actual token where the patch has moved."""
    moved = pred.join(F.broadcast(pi), pred.patch == pi.src).select("w", F.col("src").alias("patch"), F.col("dst"), "pred")
    actual = tokens.select("w", F.col("patch").alias("dst"), "vec", "label")
    return moved.join(actual, ["w", "dst"]).select("w", "patch", squared("vec", "pred").alias("r"), "label")


def traj_score(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy("w").agg(F.avg("r").alias("s"))


def traj_score_ext(residuals: DataFrame) -> DataFrame:
    """Mean, maximum, sample deviation and the 95th percentile as an order statistic."""
    xs = F.array_sort(F.collect_list("r"))
    at = F.least(F.floor(F.count("*") * F.lit(0.95)), F.count("*") - 1).cast("int") + 1
    return residuals.groupBy("w").agg(F.avg("r").alias("mean"), F.max("r").alias("max"), F.stddev_samp("r").alias("std"), F.element_at(xs, at).alias("p95"))


def traj_residuals_soft(tokens: DataFrame, pred: DataFrame, soft: DataFrame) -> DataFrame:
    """Residuals to the actual tokens mixed by ``soft(i, j, p)``."""
    flat = tokens.select("w", F.col("patch").alias("j"), F.posexplode("vec").alias("d", "x"))
    mixed = flat.join(F.broadcast(soft), "j").groupBy("w", "i", "d").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
    want = pred.select("w", F.col("patch").alias("i"), F.posexplode("pred").alias("d", "y"))
    return mixed.join(want, ["w", "i", "d"]).groupBy("w", F.col("i").alias("patch")).agg(F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("r"))


def trimmed_huber(residuals: DataFrame, delta: float, trim: float) -> DataFrame:
    """Mean Huber loss of the residuals' roots without the largest floor(n * trim)."""
    e = F.sqrt("r")
    loss = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - delta / 2))
    r = residuals.withColumn("loss", loss)
    r = r.withColumn("rk", F.row_number().over(Window.partitionBy("w").orderBy("loss", "patch"))).withColumn("n", F.count("*").over(Window.partitionBy("w")))
    return r.where(F.col("rk") <= F.col("n") - F.floor(F.col("n") * F.lit(trim))).groupBy("w").agg(F.avg("loss").alias("s"))


def ot_plan(tokens: DataFrame, epsilon: float = 0.1, steps: int = 100, tol: float = 1e-6) -> DataFrame:
    """Entropic transport between the tokens of windows w and w + 1: ``w, i, j, p``, all pairs of windows in parallel.

    Cost: half the squared distance; uniform marginals; log-domain Sinkhorn until the marginals'
    largest error is ``tol`` or after ``steps``.
    """
    nxt = tokens.select((F.col("w") - 1).alias("w"), F.col("patch").alias("j"), F.col("vec").alias("b"))
    cost = tokens.select("w", F.col("patch").alias("i"), F.col("vec").alias("a")).join(nxt, "w").select("w", "i", "j", (squared("a", "b") / 2).alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="i", columns="j", values="c")
        k = -c.to_numpy() / epsilon
        n, m = k.shape
        la, lb, f, g = -np.log(n), -np.log(m), np.zeros(n), np.zeros(m)
        lse = lambda x, axis: (t := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(t, axis)).sum(axis=axis))
        for _ in range(steps):
            f = la - lse(k + g[None, :], 1)
            g = lb - lse(k + f[:, None], 0)
            p = np.exp(k + f[:, None] + g[None, :])
            if max(np.abs(p.sum(axis=1) - 1 / n).max(), np.abs(p.sum(axis=0) - 1 / m).max()) <= tol:
                break
        i, j = np.meshgrid(c.index, c.columns, indexing="ij")
        return pd.DataFrame({"w": pdf["w"].iloc[0], "i": i.ravel(), "j": j.ravel(), "p": p.ravel()})

    return cost.groupBy("w").applyInPandas(solve, "w long, i int, j int, p double")


def to_unit(df: DataFrame, v: str = "v") -> DataFrame:
    """Divided by each window's largest value; 0 where all are 0."""
    top = F.max(v).over(Window.partitionBy("w"))
    return df.withColumn(v, F.when(top > 0, F.col(v) / top).otherwise(0.0))


def timestep_saliency_line(importance: DataFrame, length: int, image: int, cols: int) -> DataFrame:
    """Each time step's share of the patch column above it: ``w, t, v`` from ``w, row, col, v``."""
    col = F.least(F.lit(cols - 1), F.floor(F.col("id") * (image - 1) / max(1, length - 1) / (image / cols)))
    at = importance.sparkSession.range(length).select(F.col("id").alias("t"), col.cast("int").alias("col"))
    sums = importance.groupBy("w", "col").agg(F.sum("v").alias("v"))
    return to_unit(sums.join(F.broadcast(at), "col").select("w", "t", "v"))


def timestep_saliency_pair(importance: DataFrame, length: int, rows: int) -> DataFrame:
    """Each pair (i, j) credits its patch's importance to both steps: ``w, t, v`` from ``w, row, col, v``."""
    at = importance.sparkSession.range(length).select(F.col("id").alias("t"), F.least(F.lit(rows - 1), F.floor(F.col("id") * rows / length)).cast("int").alias("k"))
    size = F.broadcast(at.groupBy("k").agg(F.count("*").alias("n")))
    # a patch holds n(row) * n(col) pairs: a step of its row meets n(col) of them, and the other way round
    by_row = importance.join(size.withColumnRenamed("k", "col"), "col").groupBy("w", F.col("row").alias("k")).agg(F.sum(F.col("v") * F.col("n")).alias("v"))
    by_col = importance.join(size.withColumnRenamed("k", "row"), "row").groupBy("w", F.col("col").alias("k")).agg(F.sum(F.col("v") * F.col("n")).alias("v"))
    both = by_row.unionByName(by_col).groupBy("w", "k").agg(F.sum("v").alias("v"))
    return to_unit(both.join(F.broadcast(at), "k").select("w", "t", "v"))


def topk_windows(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k highest-scored anomalous and the k lowest-scored normal windows."""
    sign = F.when(F.col("label") == 1, -F.col("s")).otherwise(F.col("s"))
    r = F.row_number().over(Window.partitionBy(*keys, "label").orderBy(sign, "t"))
    return scores.withColumn("rk", r).where(F.col("rk") <= k)
