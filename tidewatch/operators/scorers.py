"""Distributional and classical anomaly scorers: fitted on train, one model a key."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.models import apply_models
from tidewatch.operators.neighbours import nearest
from tidewatch.sources.shared import written

#: Rows of partial sums that are merged at a time.
MERGED = 64


def shifted(m: tuple, d: np.ndarray) -> tuple:
    """Moments of vectors that all move by ``d``: n, sum y, sum y y', sum |y|^2 y, sum |y|^4."""
    n, s, q, v, q4 = m
    dd, tr, ds = d @ d, np.trace(q), d @ s
    v2 = v + 2 * q @ d + dd * s + d * (tr + 2 * ds + n * dd)
    q4 = q4 + 4 * d @ q @ d + n * dd * dd + 4 * (d @ v) + 2 * dd * tr + 4 * dd * ds
    return n, s + n * d, q + np.outer(d, s) + np.outer(s, d) + n * np.outer(d, d), v2, q4


def merged(parts: list[tuple[np.ndarray, tuple]]) -> tuple[np.ndarray, tuple]:
    """Moments about one pilot, the mean of all, from moments about several pilots."""
    n = sum(m[0] for _, m in parts)
    mean = sum(m[1] + m[0] * c for c, m in parts) / n
    moved = [shifted(m, c - mean) for c, m in parts]
    return mean, tuple(sum(x[i] for x in moved) for i in range(5))


def moments_of(x: np.ndarray) -> tuple[np.ndarray, tuple]:
    c = x.mean(axis=0)
    y = x - c
    r = (y * y).sum(axis=1)
    return c, (len(x), y.sum(axis=0), y.T @ y, y.T @ r, r @ r)


def moments(train: DataFrame, keys: list[str], f: str, finish: object, schema: str) -> DataFrame:
    """``finish(mean, moments)`` of each key's vectors as a row of ``schema``, from one pass over them.

    A task keeps, for each key, count, sums, products, and the third and fourth order terms that the
    shrinkage needs, about a mean of its own; moments of several tasks are merged a few at a time,
    so that neither vectors nor all tasks' sums of a key meet in one place.
    """
    kinds = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)
    packed = "part long, n long, c array<double>, s array<double>, q array<double>, v array<double>, q4 double"

    def row(k: tuple, part: int, c: np.ndarray, m: tuple) -> tuple:
        return (*k, part, m[0], c, m[1], m[2].ravel(), m[3], m[4])

    columns = [*keys, *[x.split()[0] for x in packed.split(", ")]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict = {}
        for b in batches:
            for k, rows in b.groupby(keys, dropna=False).indices.items():
                k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))  # a column of NaN alone is none of strings
                new = moments_of(np.stack(b[f].to_numpy()[rows]))
                held[k] = merged([held[k], new]) if k in held else new
        yield pd.DataFrame([row(k, TaskContext.get().partitionId(), c, m) for k, (c, m) in held.items()], columns=columns)

    def together(pdf: pd.DataFrame) -> tuple[np.ndarray, tuple]:
        return merged([(r.c, (r.n, r.s, r.q.reshape(len(r.s), -1), r.v, r.q4)) for r in pdf.itertuples()])

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([row(tuple(pdf[k].iloc[0] for k in keys), 0, *together(pdf))], columns=columns)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([finish(*together(pdf))], columns=[x.split()[0] for x in schema.split(", ")])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    parts = train.select(*keys, f).mapInPandas(partial, f"{kinds}, {packed}")
    parts = parts.withColumn("part", F.floor(F.col("part") / MERGED)).groupBy(*keys, "part").applyInPandas(some, f"{kinds}, {packed}")
    return parts.groupBy(*keys).applyInPandas(last, f"{kinds}, {schema}")


def ledoit_wolf_fit(train: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """``keys, mu, prec, shrinkage, n``: mean, precision of the shrunk covariance, and the shrinkage, from one scan."""

    def solve(mean: np.ndarray, m: tuple) -> tuple:
        return mean, *shrink(m[2].ravel(), m[4], m[0]), m[0]

    return moments(train, keys, f, solve, "mu array<double>, prec array<array<double>>, shrinkage double, n long")


def shrink(q: np.ndarray, q4: float, n: int) -> tuple[list, float]:
    """Precision rows and shrinkage from the centred sums of products and of squared squared norms."""
    p = round(len(q) ** 0.5)
    s = q.reshape(p, p) / n
    m, size = np.trace(s) / p, (s * s).sum()
    delta = (size - p * m * m) / p
    beta = min(max((q4 / n - size) / (p * n), 0.0), delta)
    rho = 0.0 if p == 1 or beta <= 0 or delta <= 0 else beta / delta
    return list(np.linalg.pinv((1 - rho) * s + rho * m * np.eye(p))), float(rho)


def mahalanobis_score(df: DataFrame, model: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """Adds s: the squared distance to the key's model's mean, never below 0."""

    def score(rows: pd.DataFrame, m: pd.Series) -> pd.DataFrame:
        x = np.stack(rows[f].to_numpy()) - np.asarray(m["mu"])
        return rows.assign(s=np.maximum(((x @ np.stack(m["prec"])) * x).sum(axis=1), 0))

    return apply_models(df, model.select(*keys, "mu", "prec"), keys, F.size("mu") * (F.size("mu") + 1), score, df.withColumn("s", F.lit(0.0)).schema)


def patch_aggregate(distances: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Mean, maximum, interpolated 95th percentile and mean of the k largest of each window's patch distances."""
    r = distances.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("s"))))
    return r.groupBy(*keys).agg(F.avg("s").alias("mean"), F.max("s").alias("max"), F.percentile("s", F.lit(0.95)).alias("p95"), F.avg(F.when(F.col("rk") <= k, F.col("s"))).alias("topk"))


def random_projection(df: DataFrame, size: int, out: int, f: str = "f", seed: int = 42) -> DataFrame:
    """Vectors times a fixed Gaussian matrix of unit columns (unchanged where they are no longer than ``out``)."""
    if size <= out:
        return df
    m = np.random.RandomState(seed).randn(size, out)
    m /= np.linalg.norm(m, axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{f: list(np.stack(b[f].to_numpy()) @ m) if len(b) else []})

    return df.mapInPandas(run, df.schema)


def knn_score(test: DataFrame, train: DataFrame, keys: list[str], k: int = 5, id: str = "t", f: str = "f") -> DataFrame:
    """Mean Euclidean distance to the k nearest train vectors of the key."""
    return nearest(test, train, keys, k, id, f).groupBy(*keys, id).agg(F.avg("d").alias("s"))


def zscore_meanabs(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over channels of |z| with train statistics: ``keys, split, t, label, s``."""
    from tidewatch.operators.prep import standardize

    z = standardize(long, [*keys, "ch"])
    return z.groupBy(*keys, "split", "t").agg(F.max("label").alias("label"), F.avg(F.abs("v")).alias("s"))


def pca_recon(df: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """Mean squared error of standardised vectors after projection on train's first components, as ``s`` in place of the vector.

    Components: at least 2, at most half the width, 20, and the rows less one.
    """

    def components(mean: np.ndarray, m: tuple) -> tuple:
        cov = m[2] / m[0]
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd == 0] = 1
        k = max(2, min(len(mean) // 2, 20, int(m[0]) - 1))
        return mean, sd, list(np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1][:, :k])

    model = moments(df.where("split = 'train'"), keys, f, components, "mu array<double>, sd array<double>, v array<array<double>>")

    def score(rows: pd.DataFrame, m: pd.Series) -> pd.DataFrame:
        z, v = (np.stack(rows[f].to_numpy()) - m["mu"]) / m["sd"], np.stack(m["v"])
        return rows.drop(columns=f).assign(s=((z - z @ v @ v.T) ** 2).mean(axis=1))

    return apply_models(df, model, keys, F.size("mu") * 22, score, df.drop(f).withColumn("s", F.lit(0.0)).schema)


def standard(df: DataFrame, train: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """Vectors by train's means and population deviations; a deviation of 0 counts as 1."""

    def scale(mean: np.ndarray, m: tuple) -> tuple:
        sd = np.sqrt(np.maximum(np.diag(m[2]) / m[0], 0))
        return mean, np.where(sd > 0, sd, 1)

    def run(rows: pd.DataFrame, m: pd.Series) -> pd.DataFrame:
        return rows.assign(**{f: list((np.stack(rows[f].to_numpy()) - m["mu"]) / m["sd"])})

    return apply_models(df, moments(train, keys, f, scale, "mu array<double>, sd array<double>"), keys, 2 * F.size("mu"), run, df.schema)


def lof_score(test: DataFrame, train: DataFrame, keys: list[str], k: int = 20, id: str = "t", f: str = "f", contamination: float | None = 0.05) -> DataFrame:
    """Local outlier factor of test rows against train, above the offset: ``keys, id, s``.

    Vectors are standardised by train; k is held to the train rows less one, and to 2 at least.  The
    offset is the interpolated quantile of 1 - ``contamination`` of train's own factors, or 1.5
    without one.  Neighbours of train and test rows come from one search.
    """
    both = train.select(*keys, id, f, F.lit(True).alias("itself")).unionByName(test.select(*keys, id, f, F.lit(False).alias("itself")))
    both = written(standard(both, train, keys, f))
    near = nearest(both, both.where("itself"), keys, k, id, f, "itself")
    n = train.groupBy(*keys).agg(F.greatest(F.lit(2), F.least(F.lit(k), F.count("*") - 1)).alias("k"))
    rank = F.row_number().over(Window.partitionBy(*keys, id, "itself").orderBy("d", "other"))
    near = written(near.join(n, keys).withColumn("rk", rank).where(F.col("rk") <= F.col("k")).drop("rk", "k"))
    kd = near.where("itself").groupBy(*keys, F.col(id).alias("other")).agg(F.max("d").alias("kd"))
    dense = written(near.join(kd, [*keys, "other"]).groupBy(*keys, id, "itself").agg((1 / (F.avg(F.greatest("kd", "d")) + 1e-10)).alias("lrd")))
    of_other = dense.where("itself").select(*keys, F.col(id).alias("other"), F.col("lrd").alias("o_lrd"))
    mean = near.join(of_other, [*keys, "other"]).groupBy(*keys, id, "itself").agg(F.avg("o_lrd").alias("o"))
    lof = mean.join(dense, [*keys, id, "itself"]).select(*keys, id, "itself", (F.col("o") / F.col("lrd")).alias("s"))
    if contamination is None:
        return lof.where("not itself").select(*keys, id, (F.col("s") - 1.5).alias("s"))
    offset = lof.where("itself").groupBy(*keys).agg(F.percentile("s", F.lit(1 - contamination)).alias("offset"))
    return lof.where("not itself").join(offset, keys).select(*keys, id, (F.col("s") - F.col("offset")).alias("s"))


def train_cap_sample(df: DataFrame, keys: list[str], cap: int, id: str = "t", seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each key, by a seeded hash of their ids."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(order, id))).where(F.col("rk") <= cap).drop("rk")


def average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """A tree as flat arrays, a place a node: feature (-1 for a leaf), cut, place of the lower child (the upper is next), and path length."""
    feature, cut, child, path = [], [], [], []
    waiting = [(x, 0)]
    for rows, depth in waiting:  # grows while it is walked, so that a node's place is its number here
        varied = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        path.append(depth + average_path(len(rows)))
        if depth >= limit or len(rows) <= 1 or not len(varied):
            feature.append(-1), cut.append(0.0), child.append(0)
            continue
        j = int(rng.choice(varied))
        at = float(rng.uniform(rows[:, j].min(), rows[:, j].max()))
        feature.append(j), cut.append(at), child.append(len(waiting))
        low = rows[:, j] < at
        waiting += [(rows[low], depth + 1), (rows[~low], depth + 1)]
    return np.array(feature, np.int32), np.array(cut), np.array(child, np.int32), np.array(path)


def mean_depth(tree: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, path: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over the trees that start at places ``tree``; all rows go down all trees a level at a time."""
    out = np.zeros(len(x))
    for root in tree:
        at = np.full(len(x), root)
        rows = np.arange(len(x))
        while len(rows):
            f = feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            here = at[rows]
            at[rows] = root + child[here] + (x[rows, f] >= cut[here])
        out += path[at]
    return out / len(tree)


def isolation_forest(
    df: DataFrame, keys: list[str], trees: int = 100, sample: int = 256, seed: int = 42, id: str = "t", f: str = "f", contamination: float | None = 0.05, cap: int = 50000
) -> DataFrame:
    """``s`` in place of the vector: 2 ** -(mean depth / c(sample)) less the offset.

    Each tree grows from its own hashed sample of train rows, of which a key gives ``cap`` at most (by
    hash, a documented bound of the fit).  The offset is the interpolated quantile of
    1 - ``contamination`` of the scores of the rows fitted on, or 0.5 without one.
    """
    train = train_cap_sample(df.where("split = 'train'").select(*keys, F.col(id).alias("id"), F.col(f).alias("f")), keys, cap, "id", seed)
    train = written(train)
    # only rows that can be in a tree's sample are sent: hashes below the share that holds it, widened by eight deviations
    share = F.least(F.lit(1.0), (sample + 8 * sample**0.5 + 32) / F.col("size"))
    hashed = F.xxhash64("tree", "id", F.lit(seed))
    spread = train.join(train.groupBy(*keys).agg(F.count("*").alias("size")), keys).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    spread = spread.withColumn("h", hashed).where((F.col("h") / 2.0**64 + 0.5) <= share)
    rank = F.row_number().over(Window.partitionBy(*keys, "tree").orderBy("h", "id"))
    some = spread.withColumn("rk", rank).where(F.col("rk") <= sample).drop("size", "h")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("rk")["f"].to_numpy())
        t = grow(x, np.random.default_rng([seed, int(pdf["tree"].iloc[0])]), int(np.ceil(np.log2(max(2, len(x))))))
        return pdf[keys].head(1).assign(tree=pdf["tree"].iloc[0], n=len(x), feature=[t[0]], cut=[t[1]], child=[t[2]], path=[t[3]])

    planted = some.groupBy(*keys, "tree").applyInPandas(plant, f"{kinds}, tree int, n int, feature array<int>, cut array<double>, child array<int>, path array<double>")
    one = F.struct("tree", "feature", "cut", "child", "path")
    forest = written(planted.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("forest"), F.max("n").alias("n")))

    def raw(x: np.ndarray, m: pd.Series) -> np.ndarray:
        parts = [np.concatenate([np.asarray(t[c]) for t in m["forest"]]) for c in ("feature", "cut", "child", "path")]
        size = [len(t["feature"]) for t in m["forest"]]
        depth = mean_depth(np.cumsum(size) - size, *parts, x)
        return 2 ** (-depth / max(average_path(m["n"]), 1e-9))

    def score(rows: pd.DataFrame, m: pd.Series) -> pd.DataFrame:
        return rows.drop(columns=f).assign(s=raw(np.stack(rows[f].to_numpy()), m))

    def fitted(rows: pd.DataFrame, m: pd.Series) -> pd.DataFrame:
        return rows[keys].assign(s=raw(np.stack(rows["f"].to_numpy()), m))

    numbers = F.size(F.flatten("forest.feature")) * 4
    out = apply_models(df, forest, keys, numbers, score, df.drop(f).withColumn("s", F.lit(0.0)).schema)
    if contamination is None:
        return out.withColumn("s", F.col("s") - 0.5)
    own = apply_models(train, forest, keys, numbers, fitted, f"{kinds}, s double")
    offset = own.groupBy(*keys).agg(F.percentile("s", F.lit(1 - contamination)).alias("offset"))
    return out.join(offset, keys).withColumn("s", F.col("s") - F.col("offset")).drop("offset")


def reconstruction_mse(windows: DataFrame, reconstruction: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared error of each window against its reconstruction, over cells of (step, channel)."""
    on = [*keys, "t", "ch"]
    both = windows.join(reconstruction.select(*on, F.col("v").alias("r")), on)
    return both.groupBy(*keys).agg(F.avg(F.pow(F.col("v") - F.col("r"), 2)).alias("s"))


def reconstruction_blend(windows: DataFrame, decoders: list[DataFrame], keys: list[str], shares: list[float] | None = None) -> DataFrame:
    """The decoders' errors of each window, weighted by ``shares`` (equal ones if none are given)."""
    shares = shares or [1 / len(decoders)] * len(decoders)
    parts = [reconstruction_mse(windows, d, keys).withColumn("s", F.col("s") * w) for d, w in zip(decoders, shares, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("s").alias("s"))
