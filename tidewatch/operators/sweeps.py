"""Sweeps over configurations, each one job over a small table of settings, and model selection."""

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import fusion, metrics, post, prep
from tidewatch.operators.ranges import by_size
from tidewatch.sources.shared import written


def settings(df: DataFrame, name: str, values: list) -> DataFrame:
    """A small table of settings with their ordinal ``o``; first of equals means least ordinal."""
    return F.broadcast(df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("o", name)))


def alpha_scores(pairs: DataFrame, keys: list[str], alphas: list[float], window: int = 5, short: bool = False) -> DataFrame:
    """alpha * z(a) + (1 - alpha) * z(b), smoothed and taken to [0, 1], for every alpha: ``keys, alpha, o, t, s, label``."""
    by = Window.partitionBy(*keys)
    z = pairs.select(*keys, "t", "label", post.zscore(F.col("a"), by, 1e-8).alias("a"), post.zscore(F.col("b"), by, 1e-8).alias("b"))
    out = z.crossJoin(settings(pairs, "alpha", alphas)).withColumn("s", F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b")).drop("a", "b")
    grid = [*keys, "alpha", "o"]
    return post.norm_minmax(post.smooth_mean(out, grid, window, short=short), grid, short=short) if window > 1 else out


def alpha_sweep(pairs: DataFrame, keys: list[str], alphas: list[float], window: int = 5) -> DataFrame:
    """AUC for every alpha; scores count as equal from nine digits on, whatever the order they were summed in."""
    return grid_scores(pairs, keys, [window], alphas).drop("window")


def first_best(df: DataFrame, keys: list[str], setting: list[str], metric: str) -> DataFrame:
    """The setting of the greatest metric, of equals the one of least ordinal ``o``."""
    best = F.max_by(F.struct(*setting, metric), F.struct(F.col(metric), -F.col("o")))
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def alpha_cov(pairs: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """Without labels: the alpha whose fused scores have the largest deviation over mean, both of absolute values."""
    out = alpha_scores(pairs, keys, alphas, 1)
    cov = out.groupBy(*keys, "alpha", "o").agg((F.stddev_pop(F.abs("s")) / F.avg(F.abs("s"))).alias("cov"))
    return first_best(cov, keys, ["alpha"], "cov")


def lambda_sweep(df: DataFrame, keys: list[str], lambdas: list[float]) -> DataFrame:
    """Mean of the views' z-scores plus lambda times their deviation: AUC for each key and lambda."""
    z = post.norm_zscore(df, [*keys, "view"]).groupBy(*keys, "t").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d"), F.max("label").alias("label"))
    out = z.crossJoin(settings(df, "lam", lambdas)).select(*keys, "lam", "o", "t", "label", F.round(F.col("m") + F.col("lam") * F.col("d"), 9).alias("s"))
    return metrics.auc_roc(out, [*keys, "lam", "o"])


def over_entities(swept: DataFrame, group: list[str], setting: str, metric: str = "auc_roc") -> DataFrame:
    return swept.groupBy(*group, setting, "o").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))


def grid_scores(pairs: DataFrame, keys: list[str], windows: list[int], alphas: list[float]) -> DataFrame:
    """AUC of every smoothing window and weight; ``o`` is the place in the grid.

    The pairs are computed once and written, and the scores of one series meet in one shuffle; long series go in blocks.
    """

    def of(rows: DataFrame, short: bool) -> DataFrame:
        parts = []
        for i, w in enumerate(windows):
            scores = alpha_scores(rows, keys, alphas, w, short).withColumn("s", F.round("s", 9))
            swept = metrics.auc_roc(scores if short else written(scores), [*keys, "alpha", "o"], short)
            parts.append(swept.select(*keys, F.lit(w).alias("window"), "alpha", (F.lit(i * len(alphas)) + F.col("o")).alias("o"), "auc_roc"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return by_size(written(pairs.select(*keys, "t", "label", "a", "b")), keys, partial(of, short=True), partial(of, short=False))


def grid_best(grid: DataFrame, group: list[str]) -> DataFrame:
    """The setting of the best mean over all entities of a group."""
    mean = grid.groupBy(*group, "window", "alpha", "o").agg(F.avg("auc_roc").alias("mean"))
    return first_best(mean.withColumn("mean", F.round("mean", 9)), group, ["window", "alpha"], "mean")


def grid_loo(grid: DataFrame, group: list[str], entity: str) -> DataFrame:
    """Each entity with the setting that is best on all others: the others' mean is (sum - own) / (n - 1)."""
    by = Window.partitionBy(*group, "o")
    ok = grid.where("auc_roc is not null")
    others = F.round((F.sum("auc_roc").over(by) - F.col("auc_roc")) / (F.count("*").over(by) - 1), 9)
    return first_best(ok.withColumn("others", others), [*group, entity], ["window", "alpha", "auc_roc"], "others")


def grid_on_parts(pairs: DataFrame, keys: list[str], windows: list[int], alphas: list[float], ratio: float = 0.5) -> DataFrame:
    """:func:`grid_scores` of the validation prefix and of the rest, each normalised by itself: adds ``split``."""
    return grid_scores(prep.temporal_val_split(pairs, keys, ratio), [*keys, "split"], windows, alphas)


def grid_val(grid: DataFrame, group: list[str]) -> DataFrame:
    """``group, scope, window, alpha, val, test``: chosen by the mean on validation, reported on the rest.

    Scope ``own``: each group's best setting; scope ``global``: the setting of the best mean over all
    groups, of those that every group has.
    """
    setting = ["window", "alpha", "o"]
    mean = grid.groupBy(*group, "split", *setting).agg(F.round(F.avg("auc_roc"), 9).alias("auc"))
    val = mean.where("split = 'val' and auc is not null").drop("split").withColumnRenamed("auc", "val")
    test = mean.where("split = 'test'").drop("split").withColumnRenamed("auc", "test")
    own = first_best(val, group, setting, "val").withColumn("scope", F.lit("own"))
    each = val.groupBy(*setting).agg(F.round(F.avg("val"), 9).alias("over_all"), F.count("*").alias("n"))
    each = each.withColumn("most", F.max("n").over(Window.partitionBy())).where("n = most")  # one row a setting
    best = first_best(each, [], setting, "over_all").drop("over_all")
    one = val.join(F.broadcast(best), setting).withColumn("scope", F.lit("global"))
    return own.unionByName(one).join(test, [*group, *setting], "left").select(*group, "scope", "window", "alpha", "val", "test")


def weighted(pairs: DataFrame, keys: list[str], method: str, weight: float) -> DataFrame:
    """weight * a + (1 - weight) * b of the pair's z-scores, ranks or [0, 1] scores: ``keys, t, label, s``."""
    scale = {"zscore": lambda c: post.zscore(F.col(c), Window.partitionBy(*keys)), "rank": lambda c: post.average_rank(keys, c) / F.count("*").over(Window.partitionBy(*keys)), "minmax": lambda c: post.minmax(F.col(c), Window.partitionBy(*keys))}[method]
    z = pairs.select(*keys, "t", "label", scale("a").alias("a"), scale("b").alias("b"))
    return z.select(*keys, "t", "label", (F.lit(weight) * F.col("a") + (1 - F.lit(weight)) * F.col("b")).alias("s"))


def finished_auc(df: DataFrame, keys: list[str], window: int, smooth: str = "mean", short: bool = False) -> DataFrame:
    """AUC of scores that are smoothed (an even window takes one more step) and taken to [0, 1]."""
    window += 1 - window % 2
    out = {"mean": post.smooth_mean, "median": post.smooth_median}[smooth](df, keys, window, short=short) if window > 1 else df
    scores = post.norm_minmax(out, keys, short=short).withColumn("s", F.round("s", 9))
    return metrics.auc_roc(scores if short else written(scores), keys, short)


def apply_config(pairs: DataFrame, keys: list[str], dataset: str, configs: dict) -> DataFrame:
    """``dataset, keys, before, after, delta``: each data set's ``(method, weight, window, smooth)`` against ranks' mean over 7 steps.

    Data sets without a configuration are left out.  The pairs are computed once and written.
    """
    pairs = written(pairs.select(*dict.fromkeys([dataset, *keys]), "t", "label", "a", "b"))
    where = pairs.select(dataset, *keys).distinct() if dataset not in keys else None

    def of(rows: DataFrame, short: bool) -> DataFrame:
        before = finished_auc(weighted(rows, keys, "rank", 0.5), keys, 7, short=short).withColumnRenamed("auc_roc", "before")
        parts = [finished_auc(weighted(rows.where(F.col(dataset) == name), keys, method, weight), keys, window, smooth, short) for name, (method, weight, window, smooth) in configs.items()]
        after = parts[0]
        for p in parts[1:]:
            after = after.unionByName(p)
        return before.join(after.withColumnRenamed("auc_roc", "after"), keys)

    out = by_size(pairs.where(F.col(dataset).isin(*configs)), keys, partial(of, short=True), partial(of, short=False))
    out = out if where is None else out.join(where, keys)
    return out.select(*dict.fromkeys([dataset, *keys]), "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def ensemble_auto(df: DataFrame, keys: list[str], window: int = 7, methods: tuple[str, ...] = ("mean_disagree", "mean", "max", "rank_mean")) -> DataFrame:
    """``keys, method, auc_roc`` of the ensemble that the labels favour (an oracle), of equals the first method."""

    def of(rows: DataFrame, short: bool) -> DataFrame:
        parts = [finished_auc(fusion.ensemble(rows, keys, m), keys, window, short=short).withColumn("method", F.lit(m)).withColumn("o", F.lit(i)) for i, m in enumerate(methods)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    out = by_size(written(df.select(*keys, "view", "t", "s", "label")), keys, partial(of, short=True), partial(of, short=False))
    return first_best(out.withColumn("auc_roc", F.round("auc_roc", 9)), keys, ["method"], "auc_roc")


def ablation_delta(ledger: DataFrame, entity: list[str], axis: str, reference: str, metric: str) -> DataFrame:
    """Mean and median over entities of each variant's metric less the reference's."""
    ref = ledger.where(F.col(axis) == reference).select(*entity, F.col(metric).alias("ref"))
    d = ledger.where(F.col(axis) != reference).join(ref, entity).withColumn("d", F.col(metric) - F.col("ref"))
    return d.groupBy(axis).agg(F.avg("d").alias("mean_delta"), F.median("d").alias("median_delta"), F.count("d").alias("n"))
