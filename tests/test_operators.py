"""Hand-computed values on tiny tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, post, scorers, stats

K = ["entity"]


def scores(spark, s, labels=None):
    labels = labels or [0] * len(s)
    return spark.createDataFrame([("a", i, float(x), y) for i, (x, y) in enumerate(zip(s, labels, strict=True))], "entity string, t long, s double, label int")


def column(df, c="s"):
    return [r[c] for r in df.orderBy("t").collect()]


def test_smooth_mean_repeats_edges(spark):
    assert column(post.smooth_mean(scores(spark, [0, 3, 6, 9]), K, 3)) == pytest.approx([1, 3, 6, 8])


def test_smooth_of_short_series_is_global(spark):
    assert column(post.smooth_median(scores(spark, [1, 5, 9]), K, 3)) == [5, 5, 5]


def test_even_window_is_refused(spark):
    with pytest.raises(ValueError, match="odd"):
        post.smooth_mean(scores(spark, [1, 2]), K, 2)


def test_perfect_ranking(spark):
    row = metrics.all_metrics(scores(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1]), K).first()
    assert (row["auc_roc"], row["auc_pr"], row["best_f1"], row["best_threshold"]) == (1.0, 1.0, 1.0, 0.8)


def test_one_class_has_no_auc(spark):
    assert metrics.auc_roc(scores(spark, [1, 2], [0, 0]), K).first()["auc_roc"] is None


def test_point_adjustment_fills_a_hit_run(spark):
    df = scores(spark, [0, 9, 0, 0, 0], [1, 1, 1, 0, 1])
    assert column(metrics.point_adjust(df, K, F.lit(5.0)), "pred") == [1, 1, 1, 0, 0]


def test_mahalanobis_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 3))
    df = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "entity string, t long, f array<double>")
    model = scorers.ledoit_wolf_fit(df, K)
    row = model.first()
    c = x - x.mean(axis=0)
    s, p, n = c.T @ c / 60, 3, 60
    m = np.trace(s) / p
    delta = ((s * s).sum() - p * m * m) / p
    beta = min(((np.square(c).sum(axis=1) ** 2).sum() / n - (s * s).sum()) / (p * n), delta)
    assert row["shrinkage"] == pytest.approx(beta / delta)
    prec = np.linalg.pinv((1 - beta / delta) * s + beta / delta * m * np.eye(p))
    assert column(scorers.mahalanobis_score(df, model, K)) == pytest.approx(np.einsum("ij,jk,ik->i", c, prec, c))


def test_wilcoxon_exact_value():
    assert stats.wilcoxon_p(0, 5, 0, True) == pytest.approx(2 / 32)


def test_chi2_tail():
    assert stats.chi2_tail(2 * np.log(2), 2) == pytest.approx(0.5)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
