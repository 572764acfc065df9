"""Cleaning, splitting and normalising of series kept as long tables (``entity, split, t, ch, v``)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def forward_fill(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """NaN and null take the last value before them; what leads a series takes 0."""
    seen = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(v, F.coalesce(F.last(F.when(~F.isnan(v), F.col(v)), ignorenulls=True).over(seen), F.lit(0.0)))


def zero_nonfinite(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumn(v, F.coalesce(finite(F.col(v)), F.lit(0.0)))


def mean_impute(df: DataFrame, keys: list[str], v: str = "v", split: str = "split") -> DataFrame:
    """What is not finite takes the train mean of its key, or 0 without one."""
    mean = F.avg(F.when(F.col(split) == "train", finite(F.col(v)))).over(Window.partitionBy(*keys))
    return df.withColumn(v, F.coalesce(finite(F.col(v)), mean, F.lit(0.0)))


def time_split(df: DataFrame, keys: list[str], ratio: float, t: str = "t", label: str = "label") -> DataFrame:
    """The first share of each series becomes train without its anomalous rows, the rest test; both are numbered anew."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    n = F.count("*").over(Window.partitionBy(*keys))
    out = df.withColumn("split", F.when(F.col(t) < F.floor(n * F.lit(ratio)), "train").otherwise("test"))
    out = out.where((F.col("split") == "test") | (F.col(label) == 0))
    return out.withColumn(t, (F.row_number().over(Window.partitionBy(*keys, "split").orderBy(t)) - 1).cast("long"))


def half_split(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("split", F.when(F.col(t) < F.floor(n / 2), "train").otherwise("test"))


def train_stats(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    x = F.col(v)
    return df.where(F.col("split") == "train").groupBy(*keys).agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def standardize(df: DataFrame, keys: list[str], v: str = "v", eps: float = 0.0) -> DataFrame:
    """(v - mean) / population deviation of train; a deviation of ``eps`` or less counts as 1."""
    out = df.join(train_stats(df, keys, v), keys)
    return out.withColumn(v, (F.col(v) - F.col("mu")) / F.when(F.col("sd") > eps, F.col("sd")).otherwise(1.0)).drop("mu", "sd", "lo", "hi")


def minmax_train(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    out = df.join(train_stats(df, keys, v), keys)
    width = F.col("hi") - F.col("lo")
    return out.withColumn(v, F.when(width > 0, (F.col(v) - F.col("lo")) / width).otherwise(0.0)).drop("mu", "sd", "lo", "hi")


def temporal_val_split(df: DataFrame, keys: list[str], ratio: float, t: str = "t") -> DataFrame:
    """The first floor(n * ratio) steps, at least one and not all, are validation."""
    n = F.count("*").over(Window.partitionBy(*keys))
    cut = F.greatest(F.lit(1), F.least(F.floor(n * F.lit(ratio)), n - 1))
    return df.withColumn("split", F.when(F.col(t) < cut, "val").otherwise("test"))


def anchor_split_with_gap(df: DataFrame, keys: list[str], k: int, delta: int, share: float = 0.2, t: str = "t") -> DataFrame:
    """Sequence anchors k - 1 .. T - delta - 1: the last share is validation, k anchors before it are left out.

    Where that leaves no anchor to train on, there is no gap.
    """
    by = Window.partitionBy(*keys)
    a = df.withColumn("steps", F.count("*").over(by)).where((F.col(t) >= k - 1) & (F.col(t) <= F.col("steps") - delta - 1))
    a = a.withColumn("i", F.col(t) - (k - 1)).withColumn("n", F.count("*").over(by))
    a = a.withColumn("nv", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share))))
    first = F.col("n") - F.col("nv")
    gap = F.when(first - k > 0, F.lit(k)).otherwise(0)
    part = F.when(F.col("i") >= first, "val").when(F.col("i") < first - gap, "train")
    return a.withColumn("part", part).where(F.col("part").isNotNull()).drop("steps", "i", "n", "nv")


def even_positions(n: Column, m: Column) -> Column:
    """Positions trunc(linspace(0, n - 1, m)) of n rows, each once; all of them if m reaches n."""
    spread = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: F.floor(i * (n - 1) / F.greatest(m - 1, F.lit(1))))
    return F.when(m >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array_distinct(spread))


def even_subsample(df: DataFrame, keys: list[str], m: int, t: str = "t") -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    at = n.select(*keys, F.explode(even_positions(F.col("n"), F.lit(m).cast("long"))).alias("i"))
    ranked = df.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy(t)) - 1).cast("long"))
    return ranked.join(at, [*keys, "i"], "left_semi").drop("i")


def stratified_subsample(df: DataFrame, keys: list[str], m: int, t: str = "t", label: str = "label") -> DataFrame:
    """At most m rows with both classes: anomalies up to half, the slack of either class to the other, each spaced evenly."""
    c = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    both = c.groupBy(*keys).agg(F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("neg"))
    pos = F.least(F.col("pos"), F.greatest(F.lit(m // 2), m - F.col("neg")))
    take = both.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias(label), F.col("pos").alias("n"), pos.alias("k")), F.struct(F.lit(0).alias(label), F.col("neg").alias("n"), F.least(F.col("neg"), m - pos).alias("k")))).alias("x")).select(*keys, "x.*").where("k > 0")
    at = take.select(*keys, label, F.explode(even_positions(F.col("n"), F.col("k").cast("long"))).alias("i"))
    ranked = df.withColumn("i", (F.row_number().over(Window.partitionBy(*keys, label).orderBy(t)) - 1).cast("long"))
    return ranked.join(at, [*keys, label, "i"], "left_semi").drop("i")
