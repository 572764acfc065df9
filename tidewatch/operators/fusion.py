"""Fusion of several score streams of a key into one."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import post


def weights_column(weights: dict[str, float], view: str = "view") -> Column:
    """Each view's share; weights must be positive in sum and not negative."""
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative and must not sum to zero")
    return F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w / total)])[F.col(view)]


NORMS = {"sum": None, "rank": post.rank_norm, "zscore": post.norm_zscore, "minmax": post.norm_minmax}


def fuse(df: DataFrame, keys: list[str], weights: dict[str, float], method: str = "sum", view: str = "view") -> DataFrame:
    """Weighted mean of the views at every step, each view normalised first as ``method`` says.

    Weights and views must be the same: a view without a weight, or a weight whose view no row has, is an error.
    """
    views = {r[0] for r in df.select(view).distinct().limit(len(weights) + 1).collect()}
    if views and views != set(weights):
        raise ValueError(f"weights of {sorted(weights)} do not fit views {sorted(map(str, views))}")
    aligned = post.align_head(df, keys, view)
    norm = NORMS[method]
    scaled = norm(aligned, [*keys, view]) if norm else aligned
    return scaled.groupBy(*keys, "t").agg(F.sum(F.col("s") * weights_column(weights, view)).alias("s"), F.max("label").alias("label"))


def fuse_confidence(residuals: DataFrame, keys: list[str], view: str = "view") -> DataFrame:
    """Views of each window weighted by 1 / (variance of their patch residuals + 1e-8); the score is the mean residual."""
    one = residuals.groupBy(*keys, view).agg(F.avg("r").alias("s"), (1 / (F.var_pop("r") + 1e-8)).alias("c"))
    return one.groupBy(*keys).agg((F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("s"))


def fuse_conf_global(df: DataFrame, keys: list[str], view: str = "view") -> DataFrame:
    """Each view weighted by 1 / (variance of its scores + 1e-8), over rank-normalised scores."""
    by = Window.partitionBy(*keys, view)
    ranked = post.rank_norm(df.withColumn("c", 1 / (F.var_pop("s").over(by) + 1e-8)), [*keys, view])
    return ranked.groupBy(*keys, "t").agg((F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("s"), F.max("label").alias("label"))


def view_disagreement(df: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation across the views at every step."""
    return df.groupBy(*keys, "t").agg(F.stddev_pop("s").alias("s"))


def ensemble(df: DataFrame, keys: list[str], method: str = "mean_disagree", lam: float = 0.5) -> DataFrame:
    """Mean plus ``lam`` deviations, mean, greatest, or mean of ranks, z-scores or [0, 1] scores of the views."""
    norm = {"rank_mean": post.rank_norm, "rank": post.rank_norm, "zscore": post.norm_zscore, "minmax": post.norm_minmax}.get(method)
    scaled = norm(df, [*keys, "view"]) if norm else df
    agg = {"mean_disagree": F.avg("s") + lam * F.stddev_pop("s"), "max": F.max("s")}.get(method, F.avg("s"))
    return scaled.groupBy(*keys, "t").agg(agg.alias("s"), F.max("label").alias("label"))


def multiscale(df: DataFrame, keys: list[str], method: str = "zscore", view: str = "view") -> DataFrame:
    """Right-aligned views: mean of their ranks, of their z-scores taken to [0, 1], or of their [0, 1] scores."""
    norm = {"rank": post.rank_norm, "zscore": post.norm_zscore01, "minmax": post.norm_minmax}[method]
    return norm(post.align_tail(df, keys, view), [*keys, view]).groupBy(*keys, "t").agg(F.avg("s").alias("s"), F.max("label").alias("label"))


def pair(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Two views side by side: ``keys, t, label, a, b``."""
    left = df.where(F.col("view") == a).select(*keys, "t", "label", F.col("s").alias("a"))
    return left.join(df.where(F.col("view") == b).select(*keys, "t", F.col("s").alias("b")), [*keys, "t"])


def hybrid(df: DataFrame, keys: list[str], a: str, b: str, weight: float | None = None) -> DataFrame:
    """weight * a + (1 - weight) * b, or the greater of both without a weight."""
    s = F.greatest("a", "b") if weight is None else weight * F.col("a") + (1 - weight) * F.col("b")
    return pair(df, keys, a, b).select(*keys, "t", "label", s.alias("s"))


def dual_signal(df: DataFrame, keys: list[str], a: str, b: str, alpha: float) -> DataFrame:
    """alpha * z(a) + (1 - alpha) * z(b), each standardised within its key."""
    by = Window.partitionBy(*keys)
    z = lambda c: post.zscore(F.col(c), by, 1e-8)
    return pair(df, keys, a, b).select(*keys, "t", "label", (alpha * z("a") + (1 - alpha) * z("b")).alias("s"))


def views_combined(df: DataFrame, keys: list[str], weights: dict[str, float], lam: float) -> DataFrame:
    """z-score fusion plus ``lam`` times the z-scores' deviation, median-smoothed over 7 steps and taken to [0, 1]."""
    z = post.norm_zscore(df.where(F.col("view").isin(*weights)), [*keys, "view"])
    out = z.groupBy(*keys, "t").agg((F.sum(F.col("s") * weights_column(weights)) + lam * F.stddev_pop("s")).alias("s"), F.max("label").alias("label"))
    return post.norm_minmax(post.smooth_median(out, keys, 7), keys)
