"""A regularised logistic model of which entities gain, checked by leaving one data set out."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewatch.sources.shared import written

#: Fewer complete records than this give no model.
LEAST_RECORDS = 5
#: Newton steps at most, and the largest change of a coefficient that ends them.
STEPS, CLOSE = 100, 1e-10
OUT = "scope string, dataset string, n_train long, n_test long, accuracy double, low double, high double, note string, coefficients array<double>"


class Folds:
    """The models: number 0 of all records, and one for each data set, of all others; ``w`` holds their coefficients, the intercept last."""

    def __init__(self, sets: pd.DataFrame, features: int):
        n, s, q = sets["n"].to_numpy(float), np.stack(sets["s"].to_numpy()), np.stack(sets["q"].to_numpy())
        self.names = {name: i + 1 for i, name in enumerate(sets["dataset"])}
        n = np.concatenate([[n.sum()], n.sum() - n])[:, None]
        s, q = np.vstack([s.sum(axis=0), s.sum(axis=0) - s]), np.vstack([q.sum(axis=0), q.sum(axis=0) - q])
        n = np.maximum(n, 1)
        self.mean = s / n
        self.sd = np.sqrt(np.maximum(q / n - self.mean**2, 0))
        self.sd[self.sd <= 1e-12 * np.maximum(1, np.abs(self.mean))] = 1
        self.w = np.zeros((len(n), features + 1))

    def scaled(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.column_stack([(x - self.mean[k]) / self.sd[k], np.ones(len(x))])


def newton_sums(ok: DataFrame, folds: Folds, live: list[int]) -> pd.DataFrame:
    """``fold, g``: gradient and Hessian of the losses of each live fold's train records, all folds in one job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, own = np.stack(b["x"].to_numpy()), b["y"].to_numpy(), b["dataset"].map(folds.names).to_numpy()
            for k in live:
                z = folds.scaled(x[own != k], k)
                p = 1 / (1 + np.exp(-(z @ folds.w[k])))
                held[k] = held.get(k, 0) + np.concatenate([z.T @ (p - y[own != k]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
        yield pd.DataFrame({"fold": list(held), "g": list(held.values())}, columns=["fold", "g"])

    parts = ok.mapInPandas(run, "fold int, g array<double>").select("fold", F.posexplode("g").alias("i", "x"))
    return parts.groupBy("fold", "i").agg(F.sum("x").alias("x")).orderBy("fold", "i").toPandas()


def right_answers(ok: DataFrame, folds: Folds, live: list[int]) -> dict[int, int]:
    """How many records each live model judges rightly: 0 all of them, the others those of their own data set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(live, 0)
        for b in batches:
            x, y, own = np.stack(b["x"].to_numpy()), b["y"].to_numpy(), b["dataset"].map(folds.names).to_numpy()
            for k in live:
                test = own == k if k else np.ones(len(x), bool)
                held[k] += int(((folds.scaled(x[test], k) @ folds.w[k] > 0) == (y[test] > 0)).sum())
        yield pd.DataFrame({"fold": list(held), "n": list(held.values())})

    return {r["fold"]: r["n"] for r in ok.mapInPandas(run, "fold int, n long").groupBy("fold").agg(F.sum("n").alias("n")).collect()}


def gain_logit(records: DataFrame, dataset: str, features: list[str], delta: str = "delta", c: float = 1.0) -> DataFrame:
    """Accuracy of "delta is above 0" from standardised features: in sample, for each data set left out, and pooled.

    Rows ``scope`` in_sample (with the coefficients), fold, and pooled (accuracy over all held-out
    records with its normal 95 % interval).  Records with a null or not finite feature, no delta or no
    data set take no part.  Folds whose train records number under five are left out; those of one
    class have no accuracy but a note; under five records in all give one row with a note.

    All models take their Newton steps together: a step is one job over the records, whatever the
    number of data sets; sums of a few numbers a data set and feature pair come to the driver.
    """
    fine = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf")) for f in [*features, delta]]
    ok = records.where(F.col(dataset).isNotNull())
    for f in fine:
        ok = ok.where(f)
    ok = written(ok.select(F.col(dataset).cast("string").alias("dataset"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), (F.col(delta) > 0).cast("double").alias("y")))
    moment = lambda power: F.array(*[F.sum(F.pow(F.col("x")[i], power)) for i in range(len(features))])
    sets = ok.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), moment(1.0).alias("s"), moment(2.0).alias("q")).orderBy("dataset").toPandas()
    spark, blank = records.sparkSession, dict.fromkeys(("dataset", "n_train", "n_test", "accuracy", "low", "high", "note", "coefficients"))
    n, pos = int(sets["n"].sum()), float(sets["pos"].sum())
    live, rows = [], []
    if n < LEAST_RECORDS or pos in (0, n):
        rows.append(blank | {"scope": "in_sample", "n_train": n, "note": "too few records" if n < LEAST_RECORDS else "one class"})
    else:
        live.append(0)
    if n >= LEAST_RECORDS:
        for i, r in sets.iterrows():
            if n - r["n"] < LEAST_RECORDS:
                continue
            if pos - r["pos"] in (0, n - r["n"]):
                rows.append(blank | {"scope": "fold", "dataset": r["dataset"], "n_train": int(n - r["n"]), "n_test": int(r["n"]), "note": "one class to train on"})
            else:
                live.append(i + 1)
    if live:
        folds = Folds(sets, len(features))
        free = np.diag([1.0 / c] * len(features) + [0.0])
        size, moving = len(features) + 1, list(live)
        for _ in range(STEPS):
            sums = newton_sums(ok, folds, moving)
            still = []
            for k, part in sums.groupby("fold"):
                g = part["x"].to_numpy()
                step = np.linalg.solve(g[size:].reshape(size, size) + free, g[:size] + free @ folds.w[k])
                folds.w[k] -= step
                if np.abs(step).max() > CLOSE:
                    still.append(int(k))
            moving = still
            if not moving:
                break
        right = right_answers(ok, folds, live)
        own = {0: n} | {i + 1: int(r["n"]) for i, r in sets.iterrows()}
        for k in live:
            if k == 0:
                rows.append(blank | {"scope": "in_sample", "n_train": n, "n_test": n, "accuracy": right[0] / n, "coefficients": folds.w[0, :-1].tolist()})
            else:
                rows.append(blank | {"scope": "fold", "dataset": sets["dataset"][k - 1], "n_train": n - own[k], "n_test": own[k], "accuracy": right[k] / own[k]})
        held = sum(own[k] for k in live if k)
        if held:
            share = sum(right[k] for k in live if k) / held
            half = 1.96 * (share * (1 - share) / held) ** 0.5
            rows.append(blank | {"scope": "pooled", "n_test": held, "accuracy": share, "low": max(0.0, share - half), "high": min(1.0, share + half)})
    return spark.createDataFrame([Row(**{k: r[k] for k in ("scope", *blank)}) for r in rows], OUT)
