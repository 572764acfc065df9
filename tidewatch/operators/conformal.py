"""Conformal calibration with control of the false-alarm rate, set-based."""

from functools import partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranges import by_size, counted
from tidewatch.sources.shared import written


def order_index(n: Column, alpha: Column) -> Column:
    """The 1-based order statistic of n calibration scores at level alpha."""
    return F.greatest(F.lit(1), F.least(F.ceil((n.cast("double") + 1) * (1 - alpha)), n))


def conformal_threshold(cal: DataFrame, keys: list[str], alpha: float | Column, alpha_columns: list[str] = ()) -> DataFrame:
    """``keys, n_cal, thr``: the order statistic of the calibration scores that alpha asks for."""
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    of = counted(cal, [*keys, *alpha_columns], "s", F.count("*"))
    at = order_index(F.col("total__"), a)
    return of.where((F.col("until__") - F.col("n__") < at) & (at <= F.col("until__"))).select(*keys, *alpha_columns, F.col("total__").alias("n_cal"), F.col("v__").alias("thr"))


def conformal_p(cal: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Adds p = (1 + number of calibration scores >= s) / (n + 1), by running counts of both tables' distinct scores."""
    both = cal.select(*keys, "s", F.lit(1).alias("cal")).unionByName(test.select(*keys, "s", F.lit(0).alias("cal")))
    of = counted(both, keys, "s", F.sum("cal"), falling=True)
    of = of.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "v__", "until__", "total__")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("s").eqNullSafe(F.col("v__")))
    return test.select(*keys, "t", "s", "label").join(of, same).select(*keys, "t", "s", "label", ((1 + F.col("until__")) / (F.col("total__") + 1)).alias("p_value"))


def flag_fixed(test: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    return test.join(thresholds, keys).withColumn("flag", F.col("s") > F.col("thr"))


def normals_split(df: DataFrame, keys: list[str], ratio: float, leave_one: bool) -> DataFrame:
    """Adds ``part``: the first share of the normal rows is cal, other normals are normal, anomalies anomaly."""
    rank = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("t"))
    n = F.sum(1 - F.col("label")).over(Window.partitionBy(*keys))
    k = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))
    k = F.least(k, n - 1) if leave_one else k
    return df.select("*", rank.alias("__r"), k.alias("__k")).withColumn("part", F.when(F.col("label") == 1, "anomaly").when(F.col("__r") <= F.col("__k"), "cal").otherwise("normal")).drop("__r", "__k")


def far_at_alpha(df: DataFrame, keys: list[str], alphas: list[float], ratio: float = 0.5, normalise: bool = False) -> DataFrame:
    """``keys, alpha, n_cal, threshold, far, coverage``; with ``normalise`` in z-space and at least one normal held out."""
    parts = normals_split(df, keys, ratio, normalise).crossJoin(F.broadcast(levels(df, alphas)))
    cal = parts.where("part = 'cal'")
    thr = conformal_threshold(cal, keys, F.col("alpha"), ["alpha"])
    rest = parts.where("part <> 'cal'").join(thr, [*keys, "alpha"])
    if normalise:  # (s - mean) / (sd + 1e-10) is compared with the threshold taken the same way
        stats = cal.groupBy(*keys, "alpha").agg(F.avg("s").alias("mu"), (F.stddev_pop("s") + 1e-10).alias("sd"))
        rest = rest.join(stats, [*keys, "alpha"])
        hit = (F.col("s") - F.col("mu")) / F.col("sd") > (F.col("thr") - F.col("mu")) / F.col("sd")
    else:
        hit = F.col("s") > F.col("thr")
    rest = rest.withColumn("hit", hit.cast("double"))
    share = lambda p: F.avg(F.when(F.col("part") == p, F.col("hit")))
    return rest.groupBy(*keys, "alpha").agg(F.max("n_cal").alias("n_cal"), F.max("thr").alias("threshold"), share("normal").alias("far"), share("anomaly").alias("coverage"))


def levels(df: DataFrame, alphas: list[float]) -> DataFrame:
    """A table of the levels, one row each."""
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))


def bonferroni_alpha(alpha: Column, n: Column) -> Column:
    return F.least(F.lit(1 - 1e-10), F.greatest(F.lit(1e-10), alpha / n))


def norm_threshold(cal: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """The order statistic in z-space, mapped back: ``keys, n_cal, mu, sd, thr_z, thr``."""
    stats = cal.groupBy(*keys).agg(F.avg("s").alias("mu"), F.stddev_pop("s").alias("sd"))
    out = conformal_threshold(cal, keys, alpha).join(stats, keys)
    z = (F.col("thr") - F.col("mu")) / (F.col("sd") + 1e-10)
    return out.select(*keys, "n_cal", "mu", "sd", z.alias("thr_z"), (z * (F.col("sd") + 1e-10) + F.col("mu")).alias("thr"))


def train_tail(df: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """The last floor(n * ratio) of the rows, at least one and not all; rows of another split than train are an error.

    The check runs with the rows: whoever holds a table of both splits filters it first, in plain sight.
    """
    checked = F.when(F.col("split") == "train", F.col("split")).otherwise(F.raise_error(F.lit("calibration takes train rows only")))
    train = df.withColumn("split", checked)
    n = F.count("*").over(Window.partitionBy(*keys))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t")))
    return train.select("*", back.alias("__b"), n.alias("__n")).where(F.col("__b") <= F.greatest(F.lit(1), F.least(F.floor(F.col("__n") * F.lit(ratio)), F.col("__n") - 1))).drop("__b", "__n")


def far_eval(df: DataFrame, keys: list[str], alphas: list[float], ratio: float = 0.2) -> DataFrame:
    """Calibration on the train tail, evaluation on test, for each level.

    The scores are computed once and written: scores that were computed twice might differ by a bit and miss each other.
    """
    rows = written(df.select(*keys, "split", "t", "s", "label"))
    return by_size(rows, keys, partial(far_eval_short, keys=keys, alphas=alphas, ratio=ratio), partial(far_eval_long, keys=keys, alphas=alphas, ratio=ratio))


def far_eval_short(df: DataFrame, keys: list[str], alphas: list[float], ratio: float) -> DataFrame:
    """:func:`far_eval` of series that a task may sort whole: ranks and thresholds by windows over each series alone."""
    by, part = Window.partitionBy(*keys), Window.partitionBy(*keys, "split")
    count = F.count("*").over(part)
    back = F.row_number().over(part.orderBy(F.desc("t")))
    cal = (F.col("split") == "train") & (F.col("__b") <= F.greatest(F.lit(1), F.least(F.floor(F.col("__n") * F.lit(ratio)), F.col("__n") - 1)))
    rows = df.withColumns({"__b": back, "__n": count}).withColumn("__cal", cal.cast("int")).where("__cal = 1 or split = 'test'")
    rank = F.row_number().over(Window.partitionBy(*keys, "__cal").orderBy("s"))
    rows = rows.withColumns({"__r": rank, "__above": F.sum("__cal").over(by.orderBy(F.desc("s"))), "n_cal": F.sum("__cal").over(by)})  # the frame holds equal scores
    thr = [F.max(F.when((F.col("__cal") == 1) & (F.col("__r") == order_index(F.col("n_cal"), F.lit(a))), F.col("s"))).over(by) for a in alphas]
    test = rows.withColumn("__thr", F.array(*thr)).where("__cal = 0 and n_cal > 0").withColumn("p_value", (1 + F.col("__above")) / (F.col("n_cal") + 1))
    share = lambda i, label: F.avg(F.when(F.col("label") == label, (F.col("s") > F.col("__thr")[i]).cast("double")))
    each = F.array(*[F.struct(F.lit(a).alias("alpha"), share(i, 0).alias("far"), share(i, 1).alias("coverage")) for i, a in enumerate(alphas)])
    out = test.groupBy(*keys).agg(each.alias("__x"), F.avg("p_value").alias("mean_p"), F.count("*").alias("n_test"), F.max("n_cal").alias("n_cal"))
    return with_gaps(out.withColumn("x", F.explode("__x")).select(*keys, "x.alpha", "x.far", "x.coverage", "mean_p", "n_test", "n_cal"))


def with_gaps(out: DataFrame) -> DataFrame:
    return out.select("*", F.abs(F.col("far") - F.col("alpha")).alias("gap"), (F.col("far") <= F.col("alpha")).alias("controlled"))


def far_eval_long(df: DataFrame, keys: list[str], alphas: list[float], ratio: float) -> DataFrame:
    cal = train_tail(df.where("split = 'train'"), keys, ratio)
    test = conformal_p(cal, df.where("split = 'test'"), keys).crossJoin(F.broadcast(levels(df, alphas)))
    thr = conformal_threshold(cal.crossJoin(F.broadcast(levels(df, alphas))), keys, F.col("alpha"), ["alpha"])
    hit = test.join(thr, [*keys, "alpha"]).withColumn("hit", (F.col("s") > F.col("thr")).cast("double"))
    far = F.avg(F.when(F.col("label") == 0, F.col("hit")))
    out = hit.groupBy(*keys, "alpha").agg(far.alias("far"), F.avg(F.when(F.col("label") == 1, F.col("hit"))).alias("coverage"), F.avg("p_value").alias("mean_p"), F.count("*").alias("n_test"), F.max("n_cal").alias("n_cal"))
    return with_gaps(out)


def far_summary(evals: DataFrame, group: list[str]) -> DataFrame:
    """Over entities: mean and sample deviation of the rate, mean coverage, share controlled, and whether all gaps are under 0.02."""
    return evals.groupBy(*group, "alpha").agg(F.avg("far").alias("far_mean"), F.stddev_samp("far").alias("far_std"), F.avg("coverage").alias("coverage"), F.avg(F.col("controlled").cast("double")).alias("controlled"), F.min((F.col("gap") < 0.02).cast("int")).alias("all_close"))


def fixed_quantile_eval(df: DataFrame, keys: list[str], alpha: float, digits: int | None = None) -> DataFrame:
    """The plain train quantile as threshold, to ``digits`` if given: its rate, gap and recall on test."""
    q = F.percentile("s", F.lit(1 - alpha))
    thr = df.where("split = 'train'").groupBy(*keys).agg((q if digits is None else F.round(q, digits)).alias("thr"))
    hit = df.where("split = 'test'").join(thr, keys).withColumn("hit", (F.col("s") > F.col("thr")).cast("double"))
    far = F.avg(F.when(F.col("label") == 0, F.col("hit")))
    return hit.groupBy(*keys).agg(F.max("thr").alias("thr"), far.alias("far"), F.avg(F.when(F.col("label") == 1, F.col("hit"))).alias("recall")).withColumn("gap", F.abs(F.col("far") - F.lit(alpha)))
