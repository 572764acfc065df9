"""Pairwise transforms of windows: angular fields and recurrence cells, as joins of a window with itself."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, i, j`` with ``columns`` of both steps: each window's steps meet in one array and are unfolded twice."""
    one = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("xs"))
    left = one.select(*keys, "xs", F.explode("xs").alias("a"))
    both = left.select(*keys, "a", F.explode("xs").alias("b"))
    return both.select(*keys, F.col("a.i").alias("i"), F.col("b.i").alias("j"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in columns for s in "ab"])


def gaf_cells(cells: DataFrame, keys: list[str], difference: bool = False) -> DataFrame:
    """Angular field of ``keys, ch, i, v``: ``keys, i, j, v`` in [0, 1]; a constant field is 0.5."""
    by = Window.partitionBy(*keys, "ch")
    width = F.max("v").over(by) - F.min("v").over(by)
    unit = F.when(width > 1e-8 * F.greatest(F.lit(1.0), F.abs(F.max("v").over(by))), 2 * (F.col("v") - F.min("v").over(by)) / width - 1).otherwise(0.0)
    angle = cells.withColumn("theta", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), unit))))
    p = pairs(angle, [*keys, "ch"], ["theta"])
    v = F.sin(F.col("theta_a") - F.col("theta_b")) if difference else F.cos(F.col("theta_a") + F.col("theta_b"))
    mean = p.groupBy(*keys, "i", "j").agg(F.avg(v).alias("v"))
    span = Window.partitionBy(*keys)
    lo, hi = F.min("v").over(span), F.max("v").over(span)
    return mean.withColumn("v", F.when(hi - lo > 1e-12, (F.col("v") - lo) / (hi - lo)).otherwise(0.5))


def distance(metric: str) -> Column:
    """Distance of the vectors xs_a and xs_b."""
    zip2 = lambda f: F.zip_with("x_a", "x_b", f)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    if metric == "euclidean":
        return F.sqrt(total(zip2(lambda a, b: (a - b) * (a - b))))
    if metric == "cityblock":
        return total(zip2(lambda a, b: F.abs(a - b)))
    if metric == "cosine":
        norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
        return 1 - total(zip2(lambda a, b: a * b)) / (norm("x_a") * norm("x_b"))
    raise ValueError(f"unknown metric {metric}")


def distance_cells(frames: DataFrame, keys: list[str], metric: str = "euclidean") -> DataFrame:
    """``keys, i, j, d`` of a table ``keys, i, x`` of vectors."""
    return pairs(frames, keys, ["x"]).withColumn("d", distance(metric)).drop("x_a", "x_b")


def recurrence_threshold(frames: DataFrame, keys: list[str], metric: str = "euclidean", q: float = 0.1) -> DataFrame:
    return distance_cells(frames, keys, metric).groupBy(*keys).agg(F.percentile("d", F.lit(q)).alias("thr"))


def recurrence_cells(frames: DataFrame, keys: list[str], metric: str = "euclidean", threshold: float | str | None = None) -> DataFrame:
    """1 less the distances taken to [0, 1] (1 where all are equal), or with a threshold whether they lie below it."""
    d = distance_cells(frames, keys, metric)
    if threshold == "auto":
        d = d.join(recurrence_threshold(frames, keys, metric), keys)
        return d.select(*keys, "i", "j", (F.col("d") < F.col("thr")).cast("double").alias("v"))
    if threshold is not None:
        return d.select(*keys, "i", "j", (F.col("d") < threshold).cast("double").alias("v"))
    by = Window.partitionBy(*keys)
    lo, hi = F.min("d").over(by), F.max("d").over(by)
    return d.select(*keys, "i", "j", F.when(hi > lo, 1 - (F.col("d") - lo) / (hi - lo)).otherwise(1.0).alias("v"))


def multi_view(views: dict[str, DataFrame]) -> DataFrame:
    """Several views' cells in one table."""
    if not views:
        raise ValueError("no views")
    out = None
    for name, df in views.items():
        part = df.withColumn("view", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
