"""Exact nearest neighbours: train rows lie in balls around pivots, and a query visits the balls that can hold an answer.

By the triangle inequality no row of a ball is nearer to a query than the distance to its pivot less
the ball's radius.  A query first meets the balls of its nearest pivots, enough of them to hold k
rows; its k-th distance there then rules out most of the others.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.models import apply_models
from tidewatch.sources.shared import written

#: Train rows of a ball, about, while a key has no more than MOST_BALLS of them.
BALL_ROWS, MOST_BALLS = 1000, 1024
#: Rows of either side that one task compares; larger balls are met in parts.
PART = 4096


def gaps(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all rows, a component at a time."""
    out = np.zeros((len(q), len(x)))
    for i in range(q.shape[1]):
        out += (q[:, i, None] - x[None, :, i]) ** 2
    return np.sqrt(out, out)


def first_balls(d: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Which balls each query meets first: by nearness of their pivots, until they hold over k rows."""
    order = np.argsort(d, axis=1, kind="stable")
    held = np.cumsum(count[order], axis=1) - count[order]  # rows in nearer balls
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, order, held <= k, 1)
    return out


def k_least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of each row's k least distances, ties to the smaller id; infinite ones never."""
    if d.shape[1] > k:
        near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    else:
        near = np.ones(d.shape, bool)
    i, j = np.nonzero(near & np.isfinite(d))
    order = np.lexsort((ids[j], d[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def nearest(queries: DataFrame, train: DataFrame, keys: list[str], k: int, id: str = "t", f: str = "f", itself: str | None = None, seen: dict | None = None) -> DataFrame:
    """``keys, id, itself, other, d``: the k nearest train rows of each query of the key, ties to the smaller id.

    ``itself`` is a column of the queries that says whether the row is also a train row, which then
    is no answer to itself.  Fewer train rows than k give fewer answers, and rows with a null key none.  ``seen``, if given, gets the
    number of rows that were sent to meet others.
    """
    kinds = ", ".join(f"{c} {train.schema[c].dataType.simpleString()}" for c in keys)
    q = written(queries.select(*keys, F.col(id).cast("long").alias("id"), F.col(f).alias("f"), (F.col(itself) if itself else F.lit(False)).alias("itself")))
    x = train.select(*keys, F.col(id).cast("long").alias("id"), F.col(f).alias("f"))
    part = (F.xxhash64("id", F.lit(17)) / 2.0**64 + 0.5).alias("h")
    some = x.select("*", part).join(x.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    some = some.where(F.col("h") < F.least(F.lit(MOST_BALLS), F.ceil(F.col("n") / BALL_ROWS)) / F.col("n")).select(*keys, "f")
    one = x.groupBy(*keys).agg(F.min_by("f", F.xxhash64("id", F.lit(17))).alias("f"))  # a key has a pivot in any case
    pivots = written(some.union(one).groupBy(*keys).agg(F.sort_array(F.collect_set("f")).alias("pivots")))
    width = F.size("pivots") * F.size(F.col("pivots")[0])

    def place(rows: pd.DataFrame, model: pd.Series) -> pd.DataFrame:
        v, p = np.stack(rows["f"].to_numpy()), np.stack(model["pivots"])
        ball, r = np.empty(len(v), np.int64), np.empty(len(v))
        for at in range(0, len(v), PART):
            d = gaps(v[at : at + PART], p)
            ball[at : at + PART] = d.argmin(axis=1)
            r[at : at + PART] = d.min(axis=1)
        return rows.assign(ball=ball, r=r)

    placed = written(apply_models(x, pivots, keys, width, place, f"{kinds}, id long, f array<double>, ball long, r double"))
    balls = placed.groupBy(*keys, "ball").agg(F.max("r").alias("radius"), F.count("*").alias("n"))
    told = balls.groupBy(*keys).agg(F.collect_list(F.struct("ball", "radius", "n")).alias("balls"))
    model = written(pivots.join(told, keys))

    def visits(first: bool):
        def run(rows: pd.DataFrame, model: pd.Series) -> pd.DataFrame:
            p = np.stack(model["pivots"])
            radius, count = np.full(len(p), -np.inf), np.zeros(len(p), np.int64)
            for b in model["balls"]:
                radius[b["ball"]], count[b["ball"]] = b["radius"], b["n"]
            out = []
            for at in range(0, len(rows), PART):
                some = rows.iloc[at : at + PART]
                d = gaps(np.stack(some["f"].to_numpy()), p)
                go = first_balls(d, count, k)
                if not first:
                    reach = some["reach"].to_numpy()[:, None]
                    go = ~go & (d - radius <= reach + 1e-9 * (1 + np.where(np.isfinite(reach), reach, 0)))
                i, ball = np.nonzero(go & (count > 0))
                out.append(some.iloc[i].assign(ball=ball))
            return pd.concat(out)[[*keys, "id", "f", "itself", "ball"]]

        return run

    sent = f"{kinds}, id long, f array<double>, itself boolean, ball long"

    def meet(asked: DataFrame) -> DataFrame:
        asked = written(asked)
        sizes = asked.groupBy(*keys, "ball").agg(F.ceil(F.count("*") / PART).alias("gs")).join(balls.select(*keys, "ball", F.ceil(F.col("n") / PART).alias("bs")), [*keys, "ball"])
        split = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = asked.join(sizes, [*keys, "ball"]).withColumn("g", F.pmod(F.xxhash64("id"), F.col("gs"))).withColumn("b", split("bs"))
        right = placed.join(sizes, [*keys, "ball"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("bs"))).withColumn("g", split("gs"))
        if seen is not None:
            seen["rows"] = seen.get("rows", 0) + left.count() + right.count()
        by = [*keys, "ball", "g", "b"]

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            names = [*keys, "id", "itself", "other", "d"]
            if a.empty or b.empty:
                return pd.DataFrame(columns=names)
            v, ids = np.stack(b["x_f"].to_numpy()), b["x_id"].to_numpy()
            out = []
            for at in range(0, len(a), 512):
                some = a.iloc[at : at + 512]
                d = gaps(np.stack(some["f"].to_numpy()), v)
                d[some["itself"].to_numpy()[:, None] & (some["id"].to_numpy()[:, None] == ids)] = np.inf
                i, j = k_least(d, ids, k)
                out.append(some.iloc[i][[*keys, "id", "itself"]].assign(other=ids[j], d=d[i, j]))
            return pd.concat(out)[names]

        right = right.select(*[F.col(c).alias(f"x_{c}") for c in [*by, "id", "f"]])
        near = left.select(*by, "id", "f", "itself").groupBy(*by).cogroup(right.groupBy(*[f"x_{c}" for c in by])).applyInPandas(compare, f"{kinds}, id long, itself boolean, other long, d double")
        return least(near)

    def least(near: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys, "id", "itself").orderBy("d", "other"))
        return near.withColumn("rk", rank).where(F.col("rk") <= k).drop("rk")

    numbers = width + 2 * F.size("balls")
    first = written(meet(apply_models(q, model, keys, numbers, visits(True), sent)))
    far = first.groupBy(*keys, "id", "itself").agg(F.when(F.count("*") == k, F.max("d")).otherwise(float("inf")).alias("reach"))
    again = q.join(far, [*keys, "id", "itself"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    return least(first.union(meet(apply_models(again, model, keys, numbers, visits(False), sent)))).withColumnRenamed("id", id)
