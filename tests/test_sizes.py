"""Short series take plain windows and one shuffle, long ones go in blocks, and both give the same."""

import numpy as np
import pytest

from tidewatch.operators import conformal, metrics, prep, ranges, sweeps

K = ["entity"]


def pairs(spark, lengths):
    rng = np.random.default_rng(2)
    rows = [(e, t, int(rng.random() < 0.3), float(rng.integers(0, 9)), float(rng.normal())) for e, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "entity string, t long, label int, a double, b double")


def told(df):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


OPERATORS = {
    "grid": lambda p: sweeps.grid_scores(p, K, [3, 7], [0.0, 0.5]),
    "config": lambda p: sweeps.apply_config(p.selectExpr("*", "0 as ds"), K, "ds", {0: ("zscore", 0.3, 5, "median")}),
    "ensemble": lambda p: sweeps.ensemble_auto(p.selectExpr("entity", "t", "label", "stack(2, 'a', a, 'b', b) as (view, s)"), K),
    "metrics": lambda p: metrics.all_metrics(p.withColumnRenamed("b", "s"), K),
    "far": lambda p: conformal.far_eval(prep.half_split(p.where("entity is not null").withColumnRenamed("a", "s"), K), K, [0.05, 0.2], 0.4),
    "curve": lambda p: metrics.curve(p.withColumnRenamed("a", "s"), K),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_short_and_long_series_give_the_same(spark, monkeypatch, name):
    table = pairs(spark, {"a": 30, "b": 5, None: 25, "c": 90})
    with monkeypatch.context() as m:
        m.setattr(conformal, "counted", None)
        m.setattr(metrics, "points", None)  # series that fit a task never lie in ranges of scores
        short = told(OPERATORS[name](table))
    monkeypatch.setattr(ranges, "BLOCK", 28)  # a and c are long
    assert told(OPERATORS[name](table)) == short and short


def test_tasks_of_short_series_do_not_grow_with_the_rows(spark, monkeypatch):
    table = pairs(spark, {"a": 30, "b": 5, None: 25, "c": 90})
    want = told(metrics.all_metrics(table.withColumnRenamed("b", "s"), K))
    seen = []
    monkeypatch.setattr(ranges, "TASK", 15)  # ten tasks, where the session has four
    ranges.by_size(table, K, lambda rows: seen.append(rows.rdd.getNumPartitions()) or rows, None)
    assert seen == [10]
    got = metrics.all_metrics(table.withColumnRenamed("b", "s"), K)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # the curve and the runs, each once
    assert told(got) == want and want


def test_metrics_of_short_series_against_plain_numpy(spark):
    rng = np.random.default_rng(8)
    lengths = {"one": 1, "two": 2, "even": 40, "odd": 67, "flat": 30, "zeros": 30, "normal": 25, "far": 30}
    series = {e: (np.round(rng.normal(size=n), 1), (rng.random(n) < 0.4).astype(int)) for e, n in lengths.items()}
    series["flat"][0][:] = 0.1
    series["zeros"][0][:] = np.where(np.arange(30) % 2, -0.0, 0.0)
    series["normal"][1][:] = 0
    series["far"][0][[3, 9]] = np.inf
    df = spark.createDataFrame([(e, t, float(a), int(b)) for e, (s, y) in series.items() for t, (a, b) in enumerate(zip(s, y, strict=True))], "entity string, t long, s double, label int")
    got = {r["entity"]: r for r in metrics.all_metrics(df, K).collect()}
    alone = {r["entity"]: r["f1_pa_oracle"] for r in metrics.f1_pa_oracle(df, K).collect()}
    assert set(got) == set(alone) == set(series)
    f1 = lambda pred, y: 2 * (pred & (y == 1)).sum() / max(1, pred.sum() + y.sum())
    for e, (s, y) in series.items():
        best = []
        for level in metrics.LEVELS:
            h = (len(s) - 1) * (level / 100)
            low, high = np.sort(s)[[int(np.floor(h)), int(np.ceil(h))]]
            pred = s >= (low if low == high else low + (h - np.floor(h)) * (high - low))
            for run in np.split(np.arange(len(s)), np.flatnonzero(np.diff(y)) + 1):
                if y[run[0]] and pred[run].any():
                    pred[run] = True
            best.append(f1(pred, y))
        assert got[e]["f1_pa_oracle"] == alone[e] == pytest.approx(max(best)), e
        assert got[e]["best_f1"] == pytest.approx(max(f1(s >= x, y) for x in set(s.tolist()))), e
        assert np.isnan(got[e]["auc_pr"]) == (not y.any()), e
