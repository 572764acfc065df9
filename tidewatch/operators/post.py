"""Smoothing, normalising and aligning of score streams (``keys, t, s``)."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranges import halo, numbered, own


def smoothed(df: DataFrame, keys: list[str], window: int, t: str, s: str, whole: Column, near: Column, inside: Column, short: bool) -> DataFrame:
    """Replaces ``s`` by ``inside`` of the steps near it, or by ``whole`` of a series no longer than the window.

    ``inside`` may use ``near`` (an aggregate of the steps at most half a window away), the step's
    number ``__i``, the series' length ``__n``, and its first and last values ``__a`` and ``__b``.
    Steps are numbered and framed in blocks, so a long series is many tasks; ``short`` series take plain windows.
    """
    if window <= 0 or window % 2 == 0:
        raise ValueError("the window must be odd and positive")
    p = window // 2
    if short:
        by = Window.partitionBy(*keys)
        order, value = by.orderBy(t), F.when(F.col("__n") <= window, F.col("__m")).otherwise(inside)
        rows = df.withColumns({"__i": F.row_number().over(order) - 1, "__near": near.over(order.rowsBetween(-p, p)), "__n": F.count("*").over(by), "__a": F.min_by(s, t).over(by), "__b": F.max_by(s, t).over(by), "__m": whole.over(by)})
        return rows.withColumn(s, value).select(df.columns)
    ends = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__n"), F.min_by(s, t).alias("__a"), F.max_by(s, t).alias("__b"), whole.alias("__m"))
    seen = halo(numbered(df, keys, t), "__i", p, p)
    seen = seen.withColumn("__near", near.over(Window.partitionBy(*keys, "__blk").orderBy("__i").rangeBetween(-p, p))).where(own("__i"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    out = seen.join(ends, same).withColumn(s, F.when(F.col("__n") <= window, F.col("__m")).otherwise(inside))
    return out.select(df.columns)


def smooth_mean(df: DataFrame, keys: list[str], window: int, t: str = "t", s: str = "s", short: bool = False) -> DataFrame:
    """Centred mean of an odd window, edges repeated; a series no longer than the window becomes its mean."""
    p, i, n = window // 2, F.col("__i"), F.col("__n")
    inside = (F.col("__near") + F.greatest(F.lit(0), p - i) * F.col("__a") + F.greatest(F.lit(0), i + p - n + 1) * F.col("__b")) / window
    return smoothed(df, keys, window, t, s, F.avg(s), F.sum(s), inside, short)


def smooth_median(df: DataFrame, keys: list[str], window: int, t: str = "t", s: str = "s", short: bool = False) -> DataFrame:
    """Centred median of an odd window, edges repeated; a series no longer than the window becomes its median."""
    p, i, n = window // 2, F.col("__i"), F.col("__n")
    more = F.concat(F.array_repeat("__a", F.greatest(F.lit(0), p - i).cast("int")), "__near", F.array_repeat("__b", F.greatest(F.lit(0), i + p - n + 1).cast("int")))
    return smoothed(df, keys, window, t, s, F.median(s), F.collect_list(s), F.element_at(F.array_sort(more), p + 1), short)


def minmax(c: Column, by, eps: float = 0.0) -> Column:
    lo, width = F.min(c).over(by), F.max(c).over(by) - F.min(c).over(by)
    return F.when(width > eps, (c - lo) / width).otherwise(0.0)


def zscore(c: Column, by, eps: float = 0.0) -> Column:
    sd = F.stddev_pop(c).over(by)
    return F.when(sd > eps, (c - F.avg(c).over(by)) / sd).otherwise(0.0)


def with_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates of the key to its rows by a join, so that a large key is many tasks."""
    stats = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(stats, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])


def norm_minmax(df: DataFrame, keys: list[str], s: str = "s", eps: float = 0.0, short: bool = False) -> DataFrame:
    if short:
        return df.withColumn(s, minmax(F.col(s), Window.partitionBy(*keys), eps))
    lo, width = F.col("__lo"), F.col("__hi") - F.col("__lo")
    return with_stats(df, keys, __lo=F.min(s), __hi=F.max(s)).withColumn(s, F.when(width > eps, (F.col(s) - lo) / width).otherwise(0.0)).drop("__lo", "__hi")


def norm_zscore(df: DataFrame, keys: list[str], s: str = "s", eps: float = 1e-12) -> DataFrame:
    sd = F.col("__sd")
    return with_stats(df, keys, __mu=F.avg(s), __sd=F.stddev_pop(s)).withColumn(s, F.when(sd > eps, (F.col(s) - F.col("__mu")) / sd).otherwise(0.0)).drop("__mu", "__sd")


def norm_zscore01(df: DataFrame, keys: list[str], s: str = "s") -> DataFrame:
    """z-score, then to [0, 1]."""
    return norm_minmax(norm_zscore(df, keys, s, 0.0), keys, s)


def zscore_ref(df: DataFrame, reference: DataFrame, keys: list[str], s: str = "s", eps: float = 1e-8) -> DataFrame:
    """z-score with the reference's frozen mean and deviation."""
    stats = reference.groupBy(*keys).agg(F.avg(s).alias("mu"), F.stddev_pop(s).alias("sd"))
    return df.join(stats, keys).withColumn(s, F.when(F.col("sd") >= eps, (F.col(s) - F.col("mu")) / F.col("sd")).otherwise(0.0)).drop("mu", "sd")


def minmax_ref(df: DataFrame, reference: DataFrame, keys: list[str], s: str = "s") -> DataFrame:
    """Scaled by the reference's range, which it may leave; without a range, by its own."""
    stats = reference.groupBy(*keys).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    own = minmax(F.col(s), Window.partitionBy(*keys))
    out = df.join(stats, keys)
    return out.withColumn(s, F.when(F.col("hi") > F.col("lo"), (F.col(s) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(own)).drop("lo", "hi")


def average_rank(keys: list[str], s: str = "s") -> Column:
    """Average rank among equal values, from 1."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(s)) + (F.count("*").over(Window.partitionBy(*keys, s)) - 1) / 2


def rank_norm(df: DataFrame, keys: list[str], s: str = "s") -> DataFrame:
    return df.withColumn(s, average_rank(keys, s) / F.count("*").over(Window.partitionBy(*keys)))


def align_head(df: DataFrame, keys: list[str], view: str = "view", t: str = "t") -> DataFrame:
    """All views of a key cut to the shortest, from the start."""
    n = df.groupBy(*keys, view).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("n"))
    return df.join(n, keys).where(F.col(t) < F.col("n")).drop("n")


def align_tail(df: DataFrame, keys: list[str], view: str = "view", t: str = "t") -> DataFrame:
    """The last steps of all views, as many as the shortest has, numbered anew."""
    n = F.count("*").over(Window.partitionBy(*keys, view))
    back = df.withColumn("n", n).withColumn("back", F.row_number().over(Window.partitionBy(*keys, view).orderBy(F.desc(t))))
    low = F.min("n").over(Window.partitionBy(*keys))
    return back.withColumn("low", low).where(F.col("back") <= F.col("low")).withColumn(t, F.col("low") - F.col("back")).drop("n", "back", "low")


def align_pad(scores: DataFrame, labels: DataFrame, keys: list[str], t: str = "t", s: str = "s") -> DataFrame:
    """Scores to the labels' length: missing ones are 0, extra ones go; any label above 0 is 1."""
    out = labels.join(scores.select(*keys, t, s), [*keys, t], "left")
    return out.withColumn(s, F.coalesce(s, F.lit(0.0))).withColumn("label", (F.col("label") > 0).cast("int"))
