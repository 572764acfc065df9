"""Ledger analytics and the statistical tests that compare methods over entities."""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.post import average_rank
from tidewatch.operators.ranges import running
from tidewatch.sources.shared import written


def macro_mean(ledger: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count of the finite values of each metric."""
    fin = lambda m: F.when(~F.isnan(m), F.col(m))
    return ledger.groupBy(*group).agg(*[f(fin(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))])


def multiseed(ledger: DataFrame, group: list[str], metric: str, seed: str = "seed") -> DataFrame:
    """Mean over entities for each seed, then over seeds; stable below a deviation of 0.02."""
    per = ledger.groupBy(*group, seed).agg(F.avg(metric).alias("m"))
    return per.groupBy(*group).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.count("*").alias("n_seeds")).withColumn("stable", F.col("std") < 0.02)


def canonical_ledger(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Both ledgers' series in one table with flags of where they are."""
    x = a.select(key, F.col(metric).alias("a"), F.lit(True).alias("in_a"))
    y = b.select(key, F.col(metric).alias("b"), F.lit(True).alias("in_b"))
    return x.join(y, key, "full_outer").select(key, "a", "b", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def canonical_summary(ledger: DataFrame) -> DataFrame:
    long = ledger.select(F.explode(F.array(F.struct(F.lit("a").alias("method"), F.col("a").alias("m")), F.struct(F.lit("b").alias("method"), F.col("b").alias("m")))).alias("x")).select("x.*").where("m is not null")
    return long.groupBy("method").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.median("m").alias("median"), F.min("m").alias("min"), F.max("m").alias("max"))


def paired_common(ledger: DataFrame, entity: str, method: str) -> DataFrame:
    """The rows of the entities that every method has."""
    k = ledger.select(method).distinct().agg(F.count("*").alias("k"))
    full = ledger.groupBy(entity).agg(F.count_distinct(method).alias("n")).join(F.broadcast(k), F.col("n") == F.col("k"), "left_semi")
    return ledger.join(full, entity, "left_semi")


def paired_differences(ledger: DataFrame, group: list[str], entity: str, metric: str, a: str, b: str) -> DataFrame:
    x = ledger.where(F.col("method") == a).select(*group, entity, F.col(metric).alias("x"))
    return x.join(ledger.where(F.col("method") == b).select(*group, entity, F.col(metric).alias("y")), [*group, entity]).select(*group, entity, (F.col("x") - F.col("y")).alias("d"))


def wilcoxon(diffs: DataFrame, group: list[str]) -> DataFrame:
    """Signed-rank statistic and two-sided p; exact for up to 50 pairs without ties and zeros, else by the tie-corrected normal.

    A group whose differences are all zero has W = 0 and p = 1.
    """
    d = diffs.where("d <> 0").withColumn("m", F.abs("d"))
    d = d.select("*", average_rank(group, "m").alias("rk"), F.count("*").over(Window.partitionBy(*group, "m")).cast("double").alias("c"))
    one = d.groupBy(*group).agg(F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rk")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"), F.sum(F.col("c") * F.col("c") - 1).alias("ties"))
    zeros = diffs.groupBy(*group).agg(F.count("*").alias("n_all"))
    whole = zeros.join(one, group, "left").select(*group, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w_plus", "w_minus")], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ties", F.lit(0.0)).alias("ties"), "n_all")
    out = whole.withColumn("w", F.least("w_plus", "w_minus"))

    def p_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[wilcoxon_p(w, int(n), ties, n == a) for w, n, ties, a in zip(b["w"], b["n"], b["ties"], b["n_all"], strict=True)])

    return out.mapInPandas(p_values, out.withColumn("p", F.lit(0.0)).schema).drop("n_all", "ties")


def wilcoxon_p(w: float, n: int, ties: float, whole: bool) -> float:
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0 and whole:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if var <= 0 else math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


def cohens_d(diffs: DataFrame, group: list[str], floor: float = 1e-10) -> DataFrame:
    """Mean difference over its sample deviation, and the effect's name."""
    out = diffs.groupBy(*group).agg((F.avg("d") / F.greatest(F.stddev_samp("d"), F.lit(floor))).alias("effect"))
    return out.withColumn("size", effect_label(F.col("effect")))


def effect_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "Negligible").when(F.abs(d) < 0.5, "Small").when(F.abs(d) < 0.8, "Medium").otherwise("Large")


#: Places of a leaf of the tree that a resample's draws are dealt by.
LEAF = 4096


def node_seed(seed: int, group: int, low: int, high: int) -> np.random.Generator:
    return np.random.default_rng([seed, group & ((1 << 63) - 1), low, high])


def leaf_draws(seed: int, group: int, n: int, leaf: int, resamples: int) -> np.ndarray:
    """How many of its ``n`` draws each resample has in a leaf.

    The draws of a node are dealt to its halves by a binomial that the node's own seed gives, from the
    root down, so every leaf finds its share alone and the shares of all leaves sum to ``n``.
    """
    low, high, own = 0, -(-n // LEAF), np.full(resamples, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        places = lambda a, b: min(b * LEAF, n) - a * LEAF
        left = node_seed(seed, group, low, high).binomial(own, places(low, mid) / places(low, high))
        low, high, own = (low, mid, left) if leaf < mid else (mid, high, own - left)
    return own


def bootstrap_ci(values: DataFrame, group: list[str], v: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of resamples drawn with replacement; draws repeat with the seed.

    Values lie in leaves of LEAF places in their order; one pass draws each leaf's share of every
    resample, and the leaves' sums of a resample are added up.  Nulls take no part.
    """
    one = values.where(F.col(v).isNotNull()).groupBy(*group, F.col(v).cast("double").alias("v__")).agg(F.count("*").alias("c__"))
    one = written(one.repartitionByRange(*group, "v__").withColumn("block__", F.spark_partition_id()))
    until, n = F.col("until__"), F.col("c__")
    placed = running(one, group, F.col("block__"), [F.col("v__")], {"until__": n})
    size = one.groupBy(*group).agg(F.sum("c__").alias("n__"))
    # equal values lie in one run of places; a row a leaf that the run reaches says how many lie there
    runs = placed.join(size, group).withColumn("leaf__", F.explode(F.sequence(F.floor((until - n) / LEAF), F.floor((until - 1) / LEAF))))
    runs = runs.withColumn("k__", F.least(until, (F.col("leaf__") + 1) * LEAF) - F.greatest(until - n, F.col("leaf__") * LEAF))
    runs = runs.withColumn("g__", F.xxhash64(*[F.col(k).cast("string") for k in group]))
    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in group)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v__")
        x = np.repeat(pdf["v__"].to_numpy(), pdf["k__"].to_numpy())
        n, leaf, g = (int(pdf[c].iloc[0]) for c in ("n__", "leaf__", "g__"))
        own, rng = leaf_draws(seed, g, n, leaf, resamples), node_seed(seed, g, leaf, leaf)
        out = np.zeros(resamples)
        step = max(1, (1 << 22) // LEAF)
        for at in range(0, resamples, step):  # some millions of draws at a time
            part = own[at : at + step]
            some = np.flatnonzero(part)
            if len(some):
                got = x[rng.integers(0, len(x), int(part.sum()), np.int32)]
                out[at + some] = np.add.reduceat(got, (np.cumsum(part) - part)[some])
        return pdf[group].head(1).reset_index(drop=True).assign(n__=n, sums__=[out])

    drawn = runs.groupBy(*group, "leaf__").applyInPandas(draw, f"{kinds}, n__ long, sums__ array<double>")
    means = drawn.select(*group, "n__", F.posexplode("sums__").alias("b__", "x__")).groupBy(*group, "b__").agg((F.sum("x__") / F.max("n__")).alias("m__"))
    return means.groupBy(*group).agg(F.percentile("m__", F.lit(0.025)).alias("low"), F.percentile("m__", F.lit(0.975)).alias("high"), F.avg("m__").alias("mean"))


def bonferroni(tests: DataFrame, p: str = "p", level: float = 0.05) -> DataFrame:
    """Whether each p lies below the level shared among all tests of the (small) table."""
    k = tests.agg(F.count("*").alias("k"))
    return tests.crossJoin(F.broadcast(k)).withColumn("significant", F.col(p) < level / F.col("k"))


def cv_stability(ledger: DataFrame, group: list[str], metric: str) -> DataFrame:
    out = ledger.groupBy(*group).agg((100 * F.stddev_pop(metric) / F.avg(metric)).alias("cv"))
    return out.withColumn("stability", F.when(F.col("cv") < 1, "stable").when(F.col("cv") < 2, "moderate").otherwise("high"))


def improvement_counts(diffs: DataFrame, group: list[str], entity: str, top: int = 5) -> DataFrame:
    """Entities improved, and the sums of the ``top`` greatest and least differences."""
    r = diffs.select("*", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("d"), entity)).alias("hi"), F.row_number().over(Window.partitionBy(*group).orderBy("d", entity)).alias("lo"))
    return r.groupBy(*group).agg(F.count_if(F.col("d") > 0).alias("improved"), F.count("*").alias("n"), F.sum(F.when(F.col("hi") <= top, F.col("d"))).alias("top"), F.sum(F.when(F.col("lo") <= top, F.col("d"))).alias("bottom"))


def extreme_differences(diffs: DataFrame, group: list[str], entity: str, top: int = 5) -> DataFrame:
    """``group, side, rank, entity, d``: the ``top`` greatest and least differences as rows, ties by entity."""
    ends = [("top", F.desc("d")), ("bottom", F.asc("d"))]
    parts = [diffs.where(F.col("d").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(order, entity))).where(F.col("rank") <= top).select(*group, F.lit(side).alias("side"), "rank", entity, "d") for side, order in ends]
    return parts[0].unionByName(parts[1])


def acf(df: DataFrame, keys: list[str], lags: int = 10) -> DataFrame:
    """Biased autocorrelation at lags 1..lags and whether it passes 1.96 / sqrt(n); 0 without variance."""
    by = Window.partitionBy(*keys)
    c = df.select(*keys, "t", (F.col("s") - F.avg("s").over(by)).alias("c"), F.count("*").over(by).alias("n"))
    order = by.orderBy("t")
    c = c.select("*", *[F.lead("c", k).over(order).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = c.groupBy(*keys, "n").agg(F.sum(F.col("c") * F.col("c")).alias("c0"), *[F.sum(F.col("c") * F.coalesce(f"l{k}", F.lit(0.0))).alias(f"c{k}") for k in range(1, lags + 1)])
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("c0") > 1e-12, F.col(f"c{k}") / F.col("c0")).otherwise(0.0).alias("acf")) for k in range(1, lags + 1)])
    return sums.select(*keys, "n", F.explode(each).alias("x")).select(*keys, "x.*", (F.abs(F.col("x.acf")) > 1.96 / F.sqrt("n")).alias("significant"))


def runs_test(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs about the median: ``n1, n0, runs, z``; z is null where it isn't defined."""
    up = df.withColumn("up", (F.col("s") > F.median("s").over(Window.partitionBy(*keys))).cast("int"))
    new = F.when(F.col("up") == F.lag("up").over(Window.partitionBy(*keys).orderBy("t")), 0).otherwise(1)
    one = up.withColumn("new", new).groupBy(*keys).agg(F.sum("up").cast("double").alias("n1"), F.sum(1 - F.col("up")).cast("double").alias("n0"), F.sum("new").alias("runs"))
    n, prod = F.col("n1") + F.col("n0"), 2 * F.col("n1") * F.col("n0")
    var = prod * (prod - n) / (n * n * (n - 1))
    return one.withColumn("z", F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (n > 1) & (var > 0), (F.col("runs") - (prod / n + 1)) / F.sqrt(var)))


def kruskal_blocks(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Tie-corrected Kruskal-Wallis statistic and p over whole consecutive blocks, null under three blocks or without variety; and the blocks' means' least, greatest and population deviation."""
    n = F.count("*").over(Window.partitionBy(*keys))
    b = df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1) / size)).withColumn("n", n)
    b = b.where(F.col("block") < F.floor(F.col("n") / size)).drop("n")
    r = b.select(*keys, "block", "s", average_rank(keys).alias("rk"), F.count("*").over(Window.partitionBy(*keys, "s")).cast("double").alias("c"), F.count("*").over(Window.partitionBy(*keys)).cast("double").alias("n"))
    per = r.groupBy(*keys, "block", "n").agg(F.avg("s").alias("m"), F.sum("rk").alias("rs"), F.count("*").cast("double").alias("nb"), F.sum(F.col("c") * F.col("c") - 1).alias("tie"))
    one = per.groupBy(*keys, "n").agg(F.sum(F.col("rs") * F.col("rs") / F.col("nb")).alias("q"), F.count("*").alias("blocks"), F.sum("tie").alias("tie"), F.min("m").alias("mean_min"), F.max("m").alias("mean_max"), F.stddev_pop("m").alias("mean_std"))
    n = F.col("n")
    fix = 1 - F.col("tie") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / fix
    out = one.select(*keys, "blocks", F.when((F.col("blocks") >= 3) & (fix > 0), h).alias("h"), "mean_min", "mean_max", "mean_std")

    def p_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[None if x is None or math.isnan(x) else chi2_tail(x, int(k) - 1) for x, k in zip(b["h"], b["blocks"], strict=True)])

    return out.mapInPandas(p_values, out.withColumn("p", F.lit(None).cast("double")).schema)


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution, by the series of the lower incomplete gamma function."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return max(0.0, 1 - total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def exchangeability(df: DataFrame, keys: list[str], size: int = 50) -> DataFrame:
    """Whether a series' normal rows look exchangeable: few significant lags, runs and blocks unsuspicious."""
    normal = df.where("label = 0")
    lags = acf(normal, keys).groupBy(*keys).agg(F.count_if(F.col("significant")).alias("n_lags"))
    out = lags.join(runs_test(normal, keys).select(*keys, "z"), keys).join(kruskal_blocks(normal, keys, size), keys)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = [1.0 if pd.isna(z) else math.erfc(abs(z) / math.sqrt(2)) for z in b["z"]]
            blocks = [1.0 if pd.isna(h) else chi2_tail(h, int(k) - 1) for h, k in zip(b["h"], b["blocks"], strict=True)]
            yield b.assign(p_runs=runs, p_blocks=blocks, violated=[n >= 3 or p < 0.05 or q < 0.05 for n, p, q in zip(b["n_lags"], runs, blocks, strict=True)])

    return out.mapInPandas(judge, out.select("*", F.lit(0.0).alias("p_runs"), F.lit(0.0).alias("p_blocks"), F.lit(True).alias("violated")).schema)


def regime_features(long: DataFrame, keys: list[str]) -> DataFrame:
    """Channels, anomaly share, and spectral entropy and periodicity averaged over channels."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["v"].to_numpy(float)
        return pdf[[*keys, "ch"]].head(1).assign(entropy=spectral_entropy(x), periodicity=periodicity(x), anomaly=pdf["label"].mean())

    per = long.groupBy(*keys, "ch").applyInPandas(one, long.select(*keys, "ch", F.lit(0.0).alias("entropy"), F.lit(0.0).alias("periodicity"), F.lit(0.0).alias("anomaly")).schema)
    return per.groupBy(*keys).agg(F.count("*").alias("n_channels"), F.avg("anomaly").alias("anomaly_ratio"), F.avg("entropy").alias("spectral_entropy"), F.avg("periodicity").alias("periodicity"), (F.count("*") / 3).alias("channel_third"))


def spectral_entropy(x: np.ndarray) -> float:
    """Entropy of the power spectrum over the log of its nonzero bins; 0 for a constant."""
    if x.std() < 1e-10:
        return 0.0
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    p = power[power > 0] / power.sum()
    return 0.0 if len(p) < 2 else float(-(p * np.log(p)).sum() / np.log(len(p)))


def periodicity(x: np.ndarray) -> float:
    """The largest absolute autocorrelation over lags 1 .. n // 2 - 1, by FFT."""
    n, c = len(x), x - x.mean()
    if n < 4 or c.std() < 1e-10:
        return 0.0
    a = np.fft.irfft(np.abs(np.fft.rfft(c, 2 * n)) ** 2)[: n // 2]
    return float(np.abs(a[1:] / a[0]).max()) if len(a) > 1 else 0.0


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns; null under three rows."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, average_rank(group, x).alias("rx"), average_rank(group, y).alias("ry"))
    return r.groupBy(*group).agg(F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def gain_table(ledger: DataFrame, entity: list[str], metric: str, a: str, b: str) -> DataFrame:
    """Method a less method b for each entity, with the regime that the sign gives."""
    d = paired_differences(ledger, entity[:-1], entity[-1], metric, a, b)
    return d.select(*entity, F.col("d").alias("gain"), F.when(F.col("d") > 0, "gain").when(F.col("d") < 0, "loss").otherwise("even").alias("regime"))


def comparison_pivot(ledger: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """Mean of the metric, methods by data sets."""
    return ledger.groupBy(row).pivot(column, values).agg(F.avg(metric))


def comparison_sources(ledgers: list[tuple[str, DataFrame]], row: str, column: str, metric: str) -> DataFrame:
    """``row, column, value, source, note, best``: the mean metric with where it comes from.

    ``ledgers`` are candidates in order of preference, each with its name: a cell takes the first that
    has a value for it.  ``note`` says how many others have one too; ``best`` marks the greatest
    values of each column.  The cells are written once: a mean that is computed again, from blocks that
    arrive in another order, may differ in its last bits from the greatest of its column.
    """
    one = lambda i, name, df: df.groupBy(row, column).agg(F.avg(metric).alias("value")).where("value is not null").select(row, column, "value", F.lit(i).alias("i"), F.lit(name).alias("source"))
    every = reduce(DataFrame.unionByName, [one(i, name, df) for i, (name, df) in enumerate(ledgers)])
    cell = every.groupBy(row, column).agg(F.min(F.struct("i", "value", "source")).alias("c"), (F.count("*") - 1).alias("others"))
    note = F.when(F.col("others") > 0, F.concat(F.col("others").cast("string"), F.lit(" more"))).otherwise("")
    out = written(cell.select(row, column, F.col("c.value").alias("value"), F.col("c.source").alias("source"), note.alias("note")))
    most = out.groupBy(column).agg(F.max("value").alias("most"))
    return out.join(most, column).select(row, column, "value", "source", "note", (F.col("value") == F.col("most")).alias("best"))


def best_view(ledger: DataFrame, entity: list[str], metric: str, view: str = "method") -> DataFrame:
    """Each entity's best view (of equals the first by name) and its metric."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(view).alias("v")))
    return ledger.where(F.col(metric).isNotNull()).groupBy(*entity).agg(best.alias("b")).select(*entity, F.col("b.v").alias("best_view"), (-F.col("b.m")).alias("best"))
