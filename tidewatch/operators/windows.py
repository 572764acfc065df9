"""Sliding windows, their labels and features."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranges import halo, own, steps


def framed(df: DataFrame, keys: list[str], length: int, stride: int, over: dict[str, Column], t: str) -> DataFrame:
    """Aggregates over each whole window, in blocks of steps with copied overlaps.

    A window holds the ``length`` steps from its start on; steps are numbered by ``t`` without gaps,
    and a window that misses one is not whole.
    """
    ahead = Window.partitionBy(*keys, "__blk").orderBy(t).rangeBetween(0, length - 1)
    seen = halo(df, t, 0, length - 1).select("*", *[a.over(ahead).alias(n) for n, a in over.items()], (F.count("*").over(ahead) == length).alias("__whole"))
    return seen.where(own(t) & F.col("__whole") & (F.col(t) % stride == 0))


def sliding_windows(df: DataFrame, keys: list[str], length: int, stride: int, columns: list[str], t: str = "t") -> DataFrame:
    """``keys, w, start, xs``: whole windows only, each an array of its rows' values in order."""
    out = framed(df, keys, length, stride, {"xs": F.collect_list(F.struct(t, *columns))}, t)
    return out.select(*keys, F.floor(F.col(t) / stride).alias("w"), F.col(t).alias("start"), F.transform("xs", lambda x: F.array(*[x[c] for c in columns])).alias("xs"))


def window_aggregate(df: DataFrame, keys: list[str], length: int, stride: int, aggregates: dict[str, Column], t: str = "t") -> DataFrame:
    """``keys, w`` and aggregates over each whole window, without arrays."""
    out = framed(df, keys, length, stride, {f"__{n}": a for n, a in aggregates.items()}, t)
    return out.select(*keys, F.floor(F.col(t) / stride).alias("w"), *[F.col(f"__{n}").alias(n) for n in aggregates])


def flatten(df: DataFrame, keys: list[str], length: int, stride: int, columns: list[str], t: str = "t", most: int = 5000, pca: bool = False) -> DataFrame:
    """``keys, w, f``: each whole window's values in one vector; vectors of more than ``most`` numbers are refused.

    So wide a vector should be reduced first: a caller that says so with ``pca`` gets it whatever its length.
    """
    if length * len(columns) > most and not pca:
        raise ValueError(f"windows of {length * len(columns)} numbers: over {most}, reduce them")
    return sliding_windows(df, keys, length, stride, columns, t).select(*keys, "w", F.flatten("xs").alias("f"))


def window_labels(df: DataFrame, keys: list[str], length: int, stride: int) -> DataFrame:
    """1 if any step of the window is 1."""
    return window_aggregate(df, keys, length, stride, {"label": F.max("label")})


def mean_pool(df: DataFrame, keys: list[str], length: int, stride: int, columns: list[str]) -> DataFrame:
    return window_aggregate(df, keys, length, stride, {"label": F.max("label"), **{c: F.avg(c) for c in columns}})


def last_step(df: DataFrame, keys: list[str], length: int, stride: int, columns: list[str]) -> DataFrame:
    return window_aggregate(df, keys, length, stride, {c: F.last(c) for c in columns})


def pool_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The mean token of each window."""
    d = tokens.select(*keys, F.posexplode("vec").alias("d", "x")).groupBy(*keys, "d").agg(F.avg("x").alias("x"))
    return d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("f"))


def token_sequences(frames: DataFrame, keys: list[str], k: int, delta: int, vec: str = "vec", t: str = "t") -> DataFrame:
    """For sample i the k frames from i on, ``xs`` with their steps ``past``, and the target frame i + k + delta - 1, its vector ``y`` and label.

    Every frame goes to the targets that it precedes, so a long series is as many groups as targets;
    frames are numbered without gaps, and a target whose past is not whole gives no sample.
    """
    offsets = F.explode(F.sequence(F.lit(delta), F.lit(delta + k - 1)))
    sent = frames.select(*keys, F.col(t).alias("p"), F.col(vec).alias("x"), offsets.alias("o")).select(*keys, (F.col("p") + F.col("o")).alias("target"), "p", "x")
    past = sent.groupBy(*keys, "target").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("past")).where(F.size("past") == k)
    out = past.join(frames.select(*keys, F.col(t).alias("target"), F.col(vec).alias("y"), "label"), [*keys, "target"])
    return out.select(*keys, (F.col("target") - (k + delta - 1)).alias("i"), F.transform("past", lambda s: s["p"]).alias("past"), F.transform("past", lambda s: s["x"]).alias("xs"), "target", "y", "label")


def channel_groups(long: DataFrame, size: int, ch: str = "ch") -> DataFrame:
    """Adds the number of the group of ``size`` channels; the last may be short."""
    return long.withColumn("group", F.floor(F.col(ch) / size).cast("int"))


def window_to_timestep(windows: DataFrame, keys: list[str], length: int, total: str = "T", w: str = "w", s: str = "s") -> DataFrame:
    """Each time step's mean over the windows that cover it; 0 where none does."""
    covered = windows.select(*keys, F.explode(F.sequence(F.col(w), F.least(F.col(w) + length - 1, F.col(total) - 1))).alias("t"), s)
    mean = covered.groupBy(*keys, "t").agg(F.avg(s).alias(s))
    # a series' steps are made block by block, not as one array
    blocks = windows.groupBy(*keys).agg(F.max(total).cast("long").alias("T")).select(*keys, F.explode(steps(F.col("T"))).alias("b"))
    whole = blocks.repartition(*keys, "b").select(*keys, F.explode(F.sequence(F.col("b.a"), F.col("b.b") - 1)).alias("t"))
    return whole.join(mean, [*keys, "t"], "left").select(*keys, "t", F.coalesce(s, F.lit(0.0)).alias(s))


def aggregate_trace(long: DataFrame, keys: list[str]) -> DataFrame:
    """Values less their channel's median, mean over channels, divided by the population deviation (0 if there is none)."""
    centred = long.withColumn("v", F.col("v") - F.median("v").over(Window.partitionBy(*keys, "ch")))
    trace = centred.groupBy(*keys, "t").agg(F.avg("v").alias("s"))
    sd = F.stddev_pop("s").over(Window.partitionBy(*keys))
    return trace.withColumn("s", F.when(sd > 1e-12, F.col("s") / sd).otherwise(0.0))


def concat_layers(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Token vectors of two layers side by side; a token that only one layer has is an error."""
    both = a.join(b.select(*keys, F.col("vec").alias("other")), keys, "full")
    missing = F.col("vec").isNull() | F.col("other").isNull()
    fine = F.when(missing, F.raise_error(F.lit("the layers do not hold the same tokens")).cast("array<double>")).otherwise(F.concat("vec", "other"))
    return both.withColumn("vec", fine).drop("other")
