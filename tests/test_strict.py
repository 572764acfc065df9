"""What is refused, and cases at the edge of definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import conformal, fusion, post, scorers, stats, tokens, windows
from tidewatch.sources import series_io

K = ["entity"]


@pytest.fixture(scope="module")
def views(spark):
    rows = [("a", v, t, float(t + i), 0) for i, v in enumerate(("x", "y")) for t in range(4)]
    return spark.createDataFrame(rows, "entity string, view string, t long, s double, label int")


def test_weights_fit_views(views):
    assert fusion.fuse(views, K, {"x": 1, "y": 3}).where("t = 0").first()["s"] == pytest.approx(0.75)
    for bad in ({"x": 1}, {"x": 1, "y": 1, "z": 1}, {"x": 1, "z": 1}):
        with pytest.raises(ValueError, match="do not fit"):
            fusion.fuse(views, K, bad)
    for bad in ({"x": -1, "y": 2}, {"x": 0, "y": 0}):
        with pytest.raises(ValueError, match="weights"):
            fusion.fuse(views, K, bad)
    assert fusion.fuse(views.where("false"), K, {"x": 1}).count() == 0


def test_layers_hold_the_same_tokens(spark):
    a = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0])], "w long, patch int, vec array<double>")
    assert sorted(r["vec"] for r in windows.concat_layers(a, a, ["w", "patch"]).collect()) == [[1.0, 1.0], [2.0, 2.0]]
    for x, y in ((a, a.where("patch = 0")), (a.where("patch = 0"), a)):
        with pytest.raises(Exception, match="same tokens"):
            windows.concat_layers(x, y, ["w", "patch"]).collect()


def test_calibration_refuses_test_rows(spark):
    df = spark.createDataFrame([("a", i, float(i), 0, "train" if i < 10 else "test") for i in range(12)], "entity string, t long, s double, label int, split string")
    assert sorted(r["t"] for r in conformal.train_tail(df.where("split = 'train'"), K, 0.3).collect()) == [7, 8, 9]
    with pytest.raises(Exception, match="train rows only"):
        conformal.train_tail(df, K, 0.3).collect()


def test_wilcoxon_of_no_differences(spark):
    df = spark.createDataFrame([("g", "a", 0.0), ("g", "b", 0.0), ("h", "a", 1.0)], "g string, entity string, d double")
    got = {r["g"]: (r["w"], r["n"], r["p"]) for r in stats.wilcoxon(df, ["g"]).collect()}
    assert got == {"g": (0.0, 0, 1.0), "h": (0.0, 1, 1.0)}


def test_extreme_differences(spark):
    df = spark.createDataFrame([("g", str(i), float(i % 4)) for i in range(8)] + [("g", "z", None)], "g string, entity string, d double")
    got = [tuple(r) for r in stats.extreme_differences(df, ["g"], "entity", 3).orderBy("side", "rank").collect()]
    assert got == [("g", "bottom", 1, "0", 0.0), ("g", "bottom", 2, "4", 0.0), ("g", "bottom", 3, "1", 1.0), ("g", "top", 1, "3", 3.0), ("g", "top", 2, "7", 3.0), ("g", "top", 3, "2", 2.0)]


def test_block_means_and_p(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)] + [("b", i, 1.0) for i in range(9)] + [("c", i, float(i)) for i in range(5)], "entity string, t long, s double")
    got = {r["entity"]: r for r in stats.kruskal_blocks(df, K, 3).collect()}
    a = got["a"]
    assert (a["h"], a["mean_min"], a["mean_max"], a["mean_std"]) == pytest.approx((7.2, 1, 7, 6**0.5)) and a["p"] == pytest.approx(0.0273, abs=1e-4)
    assert (got["b"]["h"], got["b"]["p"]) == (None, None) and got["c"]["blocks"] == 1 and got["c"]["p"] is None


def test_comparison_with_sources(spark):
    kind = "method string, ds int, auc double"
    main = spark.createDataFrame([("m", 0, 0.5), ("m", 0, 0.7), ("n", 0, None)], kind)
    other = spark.createDataFrame([("m", 0, 0.9), ("n", 0, 0.6), ("n", 1, 0.2)], kind)
    got = [(r["method"], r["ds"], round(r["value"], 9), r["source"], r["note"], r["best"]) for r in stats.comparison_sources([("main", main), ("other", other)], "method", "ds", "auc").orderBy("method", "ds").collect()]
    assert got == [("m", 0, 0.6, "main", "1 more", True), ("n", 0, 0.6, "other", "", True), ("n", 1, 0.2, "other", "", True)]


def test_means_are_compared_as_computed_once(spark):
    """Sums of doubles differ from one computation to the next where executors fetch blocks in any order; here a random last part stands for it."""
    kind = "method string, ds int, auc double"
    last = F.udf(lambda x: x + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    main = spark.createDataFrame([(m, d, 0.5 + i / 10) for i, m in enumerate("mno") for d in range(9)], kind).withColumn("auc", last("auc"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = stats.comparison_sources([("main", main), ("other", main.where("method = 'm'"))], "method", "ds", "auc").where("best").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r["method"], r["ds"]) for r in got) == [("o", d) for d in range(9)]


def test_validation_of_channels_labels_and_files(spark):
    rows = [("a", "train" if t < 3 else "test", t, c, 1.0, 0) for t in range(5) for c in range(2)] + [("b", "train", 0, 0, 1.0, 0), ("c", "test", 0, 0, None, 7)]
    df = spark.createDataFrame(rows, "entity string, split string, t long, ch int, v double, label int")
    labels = spark.createDataFrame([("a", 3), ("b", 0), ("d", 4)], "entity string, n long")
    got = {(r["entity"], r["problem"]) for r in series_io.validate_series(df, K, 2, labels, 4).collect()}
    assert got == {("a", "label length"), ("b", "channels"), ("c", "channels"), ("c", "missing values"), ("c", "labels"), ("c", "no train rows"), ("c", "no labels"), ("d", "no series"), (None, "files")}
    assert series_io.validate_series(df.where("entity = 'a'"), K, 2, files=1).count() == 0
    assert [r["problem"] for r in series_io.validate_series(df.where("false"), K).collect()] == ["empty"]


def test_ledger_by_size_and_view(spark, views, tmp_path):
    df = views.withColumn("label", (F.col("t") == 2).cast("int")).unionByName(views.withColumn("entity", F.lit("b"))).withColumn("win", F.explode(F.array(F.lit(5), F.lit(9))))
    series_io.write_scores(df, str(tmp_path / "led"))
    got = series_io.read_scores(spark, str(tmp_path / "led"), ["x"], [9, 11], K)
    assert {(r["entity"], r["view"], r["win"]) for r in got.collect()} == {("a", "x", 9)}
    for bad in ({"views": ["q"]}, {"sizes": [4]}):
        with pytest.raises(ValueError, match="no scores"):
            series_io.read_scores(spark, str(tmp_path / "led"), **bad)


def test_two_decoders(spark):
    kind = "entity string, t long, ch int, v double"
    x, a, b = (spark.createDataFrame([("e", 0, 0, v), ("e", 0, 1, v)], kind) for v in (1.0, 2.0, 4.0))
    assert scorers.reconstruction_blend(x, [a, b], K).first()["s"] == pytest.approx(0.5 * 1 + 0.5 * 9)
    assert scorers.reconstruction_blend(x, [a, b], K, [0.25, 0.75]).first()["s"] == pytest.approx(7)


def test_sequences_and_moved_patches(spark):
    frames = spark.createDataFrame([("a", t, [float(t)], t % 2) for t in range(7)] + [("b", 0, [0.0], 0)], "entity string, t long, vec array<double>, label int")
    got = [(r["i"], r["past"], r["xs"], r["target"], r["y"], r["label"]) for r in windows.token_sequences(frames, K, 3, 2).orderBy("i").collect()]
    assert got == [(i, [i, i + 1, i + 2], [[float(i)], [i + 1.0], [i + 2.0]], i + 4, [i + 4.0], i % 2) for i in range(3)]
    grid = spark.createDataFrame([(w, p) for w in range(2) for p in range(4)], "w long, patch int")
    moved = {tuple(r) for r in tokens.moved_patches(grid, tokens.pi_shift(spark, 2, 2, 10, 20, True)).collect()}
    assert moved == {(0, 3, 0), (1, 3, 0)}


def test_normalising_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 3.0), ("a", 0, 5.0)], "entity string, t long, s double")
    assert sorted((r["entity"] or "", r["t"], r["s"]) for r in post.norm_minmax(df, K).collect()) == [("", 0, 0.0), ("", 1, 1.0), ("a", 0, 0.0)]
