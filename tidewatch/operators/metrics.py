"""Detection metrics of every key (entity, view, method) from ``keys, t, s, label``."""

from functools import partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranges import by_size, numbered, running
from tidewatch.sources.shared import written

LEVELS = [90.0, 91.0, 92.0, 93.0, 94.0, 95.0, 96.0, 97.0, 98.0, 99.0, 99.5, 99.9]


def points(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a distinct score, ``keys, thr, pos, n``, written in ranges of falling scores, which ``block`` numbers."""
    one = df.groupBy(*keys, F.col("s").alias("thr")).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    return written(one.repartitionByRange(*keys, F.desc("thr")).withColumn("block", F.spark_partition_id()))


def curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a distinct threshold: ``keys, thr, pos, n, tp, fp, p, seen, total`` of predictions s >= thr.

    ``seen`` counts these, ``p`` and ``total`` the key's positive rows and all its rows.  The scores are written once.
    Those of a long series are grouped and lie in ranges; running sums take two levels, so that it is many tasks.
    """
    return by_size(written(df.select(*keys, "s", "label")), keys, partial(curve_short, keys=keys), partial(curve_long, keys=keys))


def curve_long(df: DataFrame, keys: list[str]) -> DataFrame:
    return curve_of(points(df, keys), keys)


def curve_short(df: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`curve` of series that a task may sort whole, best in rows that lie by key: one sort, and no table of groups in memory."""
    order = Window.partitionBy(*keys).orderBy(F.desc("s"))
    own, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {"tp": F.sum("label").over(own), "seen": F.count(F.lit(1)).over(own), "p": F.sum("label").over(whole), "total": F.count(F.lit(1)).over(whole), "__next": F.lead("s").over(order)}
    # the last row of equal scores stands for all of them
    last = df.select(*keys, "s", "label").withColumns(sums).where((F.col("seen") == F.col("total")) | ~F.col("s").eqNullSafe(F.col("__next")))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0))
    out = last.withColumns({"pos": F.col("tp") - before("tp"), "n": F.col("seen") - before("seen")})
    return out.select(*keys, (F.col("s") + F.lit(0)).alias("thr"), "pos", "n", "tp", (F.col("seen") - F.col("tp")).alias("fp"), "p", "seen", "total")


def curve_of(one: DataFrame, keys: list[str]) -> DataFrame:
    out = running(one, keys, F.col("block"), [F.desc("thr")], {"tp": F.col("pos"), "seen": F.col("n")})
    whole = one.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sum("pos").alias("p"), F.sum("n").alias("total"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return out.join(whole, same).select(*keys, "thr", "pos", "n", "tp", (F.col("seen") - F.col("tp")).alias("fp"), "p", "seen", "total")


def area() -> Column:
    """Area under the curve's steps, ties counted half; null unless both classes are there."""
    p, n = F.max("p").cast("double"), F.max("total").cast("double")
    won = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2))
    return F.when((p > 0) & (p < n), won / (p * (n - p)))


def average_precision() -> Column:
    """Of a curve's points; not a number without a positive row."""
    p = F.max("p")
    return F.when(p == 0, F.lit(float("nan"))).otherwise(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p)


def auc_roc(df: DataFrame, keys: list[str], short: bool | None = None) -> DataFrame:
    """Area under the curve, equal scores counted half; null unless both classes are there.

    Whoever knows whether all series are ``short`` or long says so; else they are parted by size here.
    """
    of = {None: curve, True: curve_short, False: curve_long}[short]
    return of(df, keys).groupBy(*keys).agg(area().alias("auc_roc"))


def pr_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    return curve(df, keys).select(*keys, "thr", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).alias("recall"))


def auc_pr(df: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision over distinct thresholds."""
    return curve(df, keys).groupBy(*keys).agg(average_precision().alias("auc_pr"))


def f1(tp: Column, fp: Column, p: Column) -> Column:
    """2 tp / (2 tp + fp + fn), 0 without a true positive."""
    return F.when(tp > 0, 2 * tp / (tp + fp + p)).otherwise(0.0)


def best() -> Column:
    """The greatest F1 and, of equals, the lowest threshold."""
    return F.max(F.struct(f1(F.col("tp"), F.col("fp"), F.col("p")).alias("f1"), (-F.col("thr")).alias("low")))


def areas(c: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``keys, auc_roc, auc_pr, best_f1, best_threshold`` of one curve, and ``more`` of its aggregates."""
    out = c.groupBy(*keys).agg(area().alias("auc_roc"), average_precision().alias("auc_pr"), best().alias("b"), *more)
    rest = [x for x in out.columns if x not in (*keys, "auc_roc", "auc_pr", "b")]
    return out.select(*keys, "auc_roc", "auc_pr", F.col("b.f1").alias("best_f1"), (-F.col("b.low")).alias("best_threshold"), *rest)


def best_f1(df: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest F1 and, of equals, the lowest threshold."""
    return curve(df, keys).groupBy(*keys).agg(best().alias("b")).select(*keys, F.col("b.f1").alias("best_f1"), (-F.col("b.low")).alias("best_threshold"))


def ones_numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of label 1 with ``seg``, the same for all rows of a run of consecutive steps."""
    ones = numbered(df.where(F.col("label") == 1), keys, "t", "__one")
    return ones.withColumn("seg", F.col("t") - F.col("__one") - 1).drop("__one")


def anomaly_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of label 1: ``keys, seg, start, end``, both ends included."""
    return ones_numbered(df, keys).groupBy(*keys, "seg").agg(F.min("t").alias("start"), F.max("t").alias("end"))


def with_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``seg``, the same for all rows of a run of label 1, null elsewhere."""
    rest = df.where(~F.coalesce(F.col("label") == 1, F.lit(False))).withColumn("seg", F.lit(None).cast("long"))
    return ones_numbered(df, keys).select(*df.columns, F.col("seg").cast("long").alias("seg")).unionByName(rest)


def point_adjust(df: DataFrame, keys: list[str], thr: Column) -> DataFrame:
    """Predictions s >= thr, where a hit anywhere in an anomalous run counts for all of it."""
    out = with_segments(df.withColumn("pred", (F.col("s") >= thr).cast("int")), keys)
    return out.withColumn("pred", F.when(F.col("seg").isNull(), F.col("pred")).otherwise(F.max("pred").over(Window.partitionBy(*keys, "seg")))).drop("seg")


def f1_of_predictions(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    tp, fp, p = F.sum(F.col("pred") * F.col("label")), F.sum(F.col("pred") * (1 - F.col("label"))), F.sum("label")
    return df.groupBy(*keys).agg(f1(tp, fp, p).alias(name))


def f1_pa(df: DataFrame, thresholds: DataFrame, keys: list[str], name: str = "f1_pa") -> DataFrame:
    """F1 after point adjustment at each key's threshold ``thr``."""
    return f1_of_predictions(point_adjust(df.join(thresholds, keys), keys, F.col("thr")), keys, name)


def f1_pa_oracle(df: DataFrame, keys: list[str], levels: list[float] = LEVELS) -> DataFrame:
    """The best point-adjusted F1 over score percentiles."""

    def of(rows: DataFrame, short: bool) -> DataFrame:
        c = (curve_short if short else curve_long)(rows, keys)
        return oracle_of(rows, c.groupBy(*keys).agg(F.max("p").alias("p"), at_levels(levels).alias("levels")), keys, len(levels), short)

    return by_size(written(df.select(*keys, "t", "s", "label")), keys, partial(of, short=True), partial(of, short=False))


def at_levels(levels: list[float]) -> Column:
    """An aggregate of a curve: for each percentile its interpolated ``thr``, and ``fp``, how many negative scores reach it."""
    # of the scores in rising order, those of a point take the places from total - seen on
    first = F.col("total") - F.col("seen")

    def at(x: float) -> Column:
        h, last = (F.col("total") - 1) * F.lit(x / 100), (F.max("total") - 1) * F.lit(x / 100)
        a, b = first <= F.floor(h), first <= F.ceil(h)
        one, two = F.max(F.when(a, F.col("thr"))), F.max(F.when(b, F.col("thr")))
        low, high = F.least(one, two), F.greatest(one, two)
        thr = low + (last - F.floor(last)) * (high - low)
        # no score lies between these two
        fp = F.when(thr <= low, F.min(F.when(a, F.col("fp")))).when(thr <= high, F.min(F.when(b, F.col("fp")))).otherwise(0)
        return F.struct(thr.alias("thr"), fp.alias("fp"))

    return F.array(*[at(x) for x in levels])


def percentiles(curve: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """``keys, thr, p``: the distinct interpolated percentiles of the scores, from the running counts."""
    q = curve.groupBy(*keys).agg(F.max("p").alias("p"), at_levels(levels).alias("q"))
    return q.select(*keys, F.explode(F.array_distinct(F.col("q.thr"))).alias("thr"), "p")


def oracle_of(df: DataFrame, one: DataFrame, keys: list[str], levels: int, short: bool = False) -> DataFrame:
    """``one``, a row a key with ``p`` and :func:`at_levels`, with ``f1_pa_oracle`` in their place.

    A run is hit at a threshold if its largest score reaches it, so a row a run is enough; rows outside runs count as in
    the curve.
    """
    if short:
        ones = df.where(F.col("label") == 1).withColumn("seg", F.col("t") - F.row_number().over(Window.partitionBy(*keys).orderBy("t")))
    else:
        ones = ones_numbered(df, keys)
    runs = ones.groupBy(*keys, "seg").agg(F.max("s").alias("__s"), F.count("*").alias("__n")).drop("seg")
    met = one.where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True))).join(runs, keys, "left")
    q = [F.col("levels")[i] for i in range(levels)]
    tp = [F.sum(F.when(F.col("__s") >= x["thr"], F.col("__n"))).alias(f"__tp{i}") for i, x in enumerate(q)]
    rest = [c for c in one.columns if c not in keys]
    got = met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], *tp)
    f = [f1(F.col(f"__tp{i}"), x["fp"], F.col("p")) for i, x in enumerate(q)]
    return got.select(*keys, *[c for c in rest if c not in ("p", "levels")], F.array_max(F.array(*f)).alias("f1_pa_oracle"))


def val_threshold(val: DataFrame, keys: list[str], far: float = 0.05) -> DataFrame:
    """The validation scores' quantile of 1 - far."""
    return val.groupBy(*keys).agg(F.percentile("s", F.lit(min(max(1 - far, 0.0), 1.0))).alias("thr"))


def f1_val(df: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """F1 at the validation threshold; 0 where all predictions agree."""
    pred = df.join(thresholds, keys).withColumn("pred", (F.col("s") >= F.col("thr")).cast("int"))
    tp, fp, p = F.sum(F.col("pred") * F.col("label")), F.sum(F.col("pred") * (1 - F.col("label"))), F.sum("label")
    return pred.groupBy(*keys).agg(F.when(F.min("pred") == F.max("pred"), 0.0).otherwise(f1(tp, fp, p)).alias("f1_validation"))


def all_metrics(df: DataFrame, keys: list[str], val: DataFrame | None = None) -> DataFrame:
    """One row a key with every metric; without validation scores theirs are null.

    The scores are computed once and written; one pass over a curve gives the areas, the best F1 and the percentiles.
    """

    def without_val(rows: DataFrame, short: bool) -> DataFrame:
        c = (curve_short if short else curve_long)(rows, keys)
        one = areas(c, keys, F.max("p").alias("p"), at_levels(LEVELS).alias("levels"))
        return oracle_of(rows, one, keys, len(LEVELS), short)

    df = written(df.select(*keys, "t", "s", "label"))
    out = by_size(df, keys, partial(without_val, short=True), partial(without_val, short=False))
    if val is None:
        return out.select("*", *[F.lit(None).cast("double").alias(n) for n in ("f1_validation", "f1_pa_validation", "threshold_validation")])
    thr = written(val_threshold(val, keys))
    out = out.join(f1_val(df, thr, keys), keys).join(f1_pa(df, thr, keys, "f1_pa_validation"), keys)
    return out.join(thr.withColumnRenamed("thr", "threshold_validation"), keys)


def f1_pa_at_best(df: DataFrame, keys: list[str]) -> DataFrame:
    return f1_pa(df, best_f1(df, keys).select(*keys, F.col("best_threshold").alias("thr")), keys)


def metric_guards(df: DataFrame, keys: list[str]) -> DataFrame:
    """What is wrong with each key's input, in order of weight; null where nothing is."""
    bad = F.sum(F.when(F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf")), 1).otherwise(0))
    odd = F.sum(F.when(F.col("label").isin(0, 1), 0).otherwise(1))
    note = F.when(bad > 0, "not finite").when(odd > 0, "not binary").when(F.min("label") == F.max("label"), "one class")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), note.alias("note"))
