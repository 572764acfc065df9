"""One long series in many blocks: frames, running sums, curves and smoothing against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, post, ranges, windows

K = ["entity"]


@pytest.fixture
def long(spark, monkeypatch):
    """One entity of 1000 steps and a short one, in blocks of 20 steps."""
    monkeypatch.setattr(ranges, "BLOCK", 20)
    rng = np.random.default_rng(4)
    s, y = np.round(rng.normal(size=1000), 1), (rng.random(1000) < 0.3).astype(int)
    s[y == 1] += 0.5
    rows = [("a", i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))] + [("b", i, float(i), i % 2) for i in range(3)]
    return s, y, spark.createDataFrame(rows, "entity string, t long, s double, label int").repartition(7)


def of_a(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.where("entity = 'a'").orderBy(cols[0] if len(cols) > 1 else "t").select(*cols).collect()]


@pytest.mark.parametrize("window", [3, 45])
def test_smoothing_over_block_bounds(long, window):
    s, _, df = long
    pad = np.pad(s, window // 2, mode="edge")
    near = np.lib.stride_tricks.sliding_window_view(pad, window)
    assert of_a(post.smooth_mean(df, K, window), "s") == pytest.approx(near.mean(axis=1))
    assert of_a(post.smooth_median(df, K, window), "s") == pytest.approx(np.median(near, axis=1))
    assert {r["s"] for r in post.smooth_mean(df, K, window).where("entity = 'b'").collect()} == {1.0}
    gaps = df.withColumn("t", F.col("t") * 3 - 40)  # steps need not be dense, nor start at 0
    assert of_a(post.smooth_mean(gaps, K, window), "s") == pytest.approx(near.mean(axis=1))


@pytest.mark.parametrize(("length", "stride"), [(5, 1), (50, 7)])
def test_windows_over_block_bounds(long, length, stride):
    s, y, df = long
    view = np.lib.stride_tricks.sliding_window_view(s, length)[::stride]
    got = windows.mean_pool(df, K, length, stride, ["s"])
    assert of_a(got, "w", "s", "label") == [(i, pytest.approx(x), z) for i, (x, z) in enumerate(zip(view.mean(axis=1), np.lib.stride_tricks.sliding_window_view(y, length)[::stride].max(axis=1), strict=True))]
    flat = windows.flatten(df, K, length, stride, ["s", "label"]).where("entity = 'a'").orderBy("w").collect()
    assert len(flat) == len(view) and all(r["f"][::2] == v.tolist() for r, v in zip(flat, view, strict=True))
    back = windows.window_to_timestep(got.select(*K, (F.col("w") * stride).alias("w"), "s", F.lit(1000).cast("long").alias("T")).where("entity = 'a'"), K, length)
    total, times = np.zeros(1000), np.zeros(1000)
    for i, m in enumerate(view.mean(axis=1)):
        total[i * stride : i * stride + length] += m
        times[i * stride : i * stride + length] += 1
    assert of_a(back, "s") == pytest.approx(np.divide(total, times, out=np.zeros(1000), where=times > 0))


def test_a_window_with_a_missing_step_is_not_whole(long):
    _, _, df = long
    got = [r["w"] for r in windows.window_labels(df.where("t <> 100"), K, 10, 1).where("entity = 'a'").collect()]
    assert sorted(got) == [*range(91), *range(101, 991)]


def test_wide_windows_are_refused(long):
    with pytest.raises(ValueError, match="over 5000"):
        windows.flatten(long[2], K, 2501, 1, ["s", "label"])
    assert windows.flatten(long[2], K, 2501, 1, ["s", "label"], pca=True).count() == 0


def test_curve_in_ranges(spark, long):
    s, y, df = long
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that ranges stay apart
    try:
        one = metrics.points(df, K)
        assert one.where("entity = 'a'").select("block").distinct().count() > 1
        c = {r["thr"]: r for r in metrics.curve_of(one, K).where("entity = 'a'").collect()}
        got = metrics.all_metrics(df, K).where("entity = 'a'").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(c) == set(s.tolist())
    f1 = {}
    for thr, r in c.items():
        hit = s >= thr
        assert (r["tp"], r["fp"], r["p"], r["total"]) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), y.sum(), 1000)
        f1[thr] = 2 * r["tp"] / (r["tp"] + r["fp"] + r["p"])
    pos, neg = s[y == 1], s[y == 0]
    assert got["auc_roc"] == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
    best = max(f1.values())
    assert got["best_f1"] == pytest.approx(best) and got["best_threshold"] == min(t for t, f in f1.items() if f == best)
    levels = np.percentile(s, metrics.LEVELS)
    q = {r["thr"] for r in metrics.percentiles(metrics.curve(df, K), K, metrics.LEVELS).where("entity = 'a'").collect()}
    assert sorted(q) == pytest.approx(sorted(set(levels.tolist())))


def test_segments_over_block_bounds(long):
    _, y, df = long
    edge = np.flatnonzero(np.diff(np.concatenate([[0], y, [0]])))
    assert of_a(metrics.anomaly_segments(df, K).orderBy("start"), "start", "end") == [(a, b - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def test_running_sums_with_null_keys(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(50)] + [("x", i, 2) for i in range(50)], "k string, t long, v int")
    got = ranges.running(df, ["k"], F.floor(F.col("t") / 7), [F.col("t")], {"total": F.col("v")}).collect()
    assert all(r["total"] == (r["t"] + 1) * r["v"] for r in got) and len(got) == 100


def test_order_statistics_and_p_values_in_ranges(spark, long):
    from tidewatch.operators import conformal

    s, _, df = long
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cal, test = df.where("t < 400"), df.where("t >= 400")
        for alpha in (0.001, 0.1, 0.5, 0.999):
            at = min(max(int(np.ceil(401 * (1 - alpha))), 1), 400)
            got = {r["entity"]: r for r in conformal.conformal_threshold(cal, K, alpha).collect()}
            assert (got["a"]["n_cal"], got["a"]["thr"]) == (400, np.sort(s[:400])[at - 1]) and got["b"]["n_cal"] == 3
        p = of_a(conformal.conformal_p(cal, test, K), "p_value")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert p == pytest.approx([(1 + (s[:400] >= x).sum()) / 401 for x in s[400:]])
