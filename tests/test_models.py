"""Fitted operators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models, neighbours, regime, scorers, stats, tokens
from tidewatch.sources import series_io

K = ["entity"]
VECTORS = "entity string, split string, t long, f array<double>"


def logistic(x, y, c=1.0):
    """Newton steps of the penalised sum of losses; the intercept is free."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    free = np.diag([1.0 / c] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + free, z.T @ (p - y) + free @ w)
    return w


def test_gain_logit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) * [3, 0.1]
    d = x[:, 0] + 20 * x[:, 1] + rng.normal(size=60)
    name = np.array(["a", "b", "c"])[np.arange(60) % 3]
    rows = [(n, float(a), float(b), float(y)) for n, (a, b), y in zip(name, x, d, strict=True)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), ("b", float("nan"), 1.0, 1.0)], "ds string, u double, v double, delta double")
    got = {(r["scope"], r["dataset"]): r for r in regime.gain_logit(df, "ds", ["u", "v"]).collect()}

    def check(train, test):
        mu, sd = x[train].mean(axis=0), x[train].std(axis=0)
        w = logistic((x[train] - mu) / sd, (d[train] > 0).astype(float))
        return w, int(((((x[test] - mu) / sd) @ w[:-1] + w[-1] > 0) == (d[test] > 0)).sum())

    all_rows = np.ones(60, bool)
    w, hits = check(all_rows, all_rows)
    assert got["in_sample", None]["coefficients"] == pytest.approx(w[:-1], abs=1e-4)
    assert got["in_sample", None]["accuracy"] == pytest.approx(hits / 60)
    folds = [check(name != n, name == n)[1] for n in "abc"]
    assert [got["fold", n]["accuracy"] for n in "abc"] == pytest.approx([h / 20 for h in folds])
    assert got["pooled", None]["accuracy"] == pytest.approx(sum(folds) / 60)


def test_gain_logit_degenerate(spark):
    few = spark.createDataFrame([("a", 1.0, 1.0)] * 3, "ds string, u double, delta double")
    assert [r["note"] for r in regime.gain_logit(few, "ds", ["u"]).collect()] == ["too few records"]
    one = spark.createDataFrame([("a", float(i), 1.0) for i in range(6)] + [("b", float(i), -1.0) for i in range(6)], "ds string, u double, delta double")
    assert [r["note"] for r in regime.gain_logit(one, "ds", ["u"]).where("scope = 'fold'").collect()] == ["one class to train on"] * 2


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    train, test = rng.normal(size=(90, 4)) @ np.diag([1, 2, 0.5, 3]), np.vstack([rng.normal(size=(12, 4)), [[9, 9, 9, 9.0]]])
    rows = [("a", "train", i, v.tolist()) for i, v in enumerate(train)] + [("a", "test", 90 + i, v.tolist()) for i, v in enumerate(test)]
    return train, test, spark.createDataFrame(rows, VECTORS).repartition(3)


def by_t(df):
    return {r["t"]: r["s"] for r in df.collect()}


def test_pca(points, way):
    train, test, df = points
    z = lambda x: (x - train.mean(axis=0)) / train.std(axis=0)
    _, _, v = np.linalg.svd(z(train), full_matrices=False)
    want = ((z(test) - z(test) @ v[:2].T @ v[:2]) ** 2).mean(axis=1)
    got = by_t(scorers.pca_recon(df, K))
    assert [got[90 + i] for i in range(len(test))] == pytest.approx(want)


@pytest.fixture(params=["broadcast", "blocks"])
def way(request, monkeypatch):
    """Models that go to every executor, and models that meet blocks of rows."""
    if request.param == "blocks":
        monkeypatch.setattr(models, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(models, "ROWS", 20)


@pytest.mark.parametrize("contamination", [0.05, None])
def test_lof(points, contamination, way):
    train, test, df = points
    k = 5
    z = lambda x: (x - train.mean(axis=0)) / train.std(axis=0)
    gap = lambda a, b: np.sqrt(((z(a)[:, None] - z(b)[None]) ** 2).sum(axis=2))
    own = gap(train, train) + np.diag([np.inf] * len(train))
    kd = np.sort(own, axis=1)[:, k - 1]

    def density(d):
        near = np.argsort(d, axis=1)[:, :k]
        return near, 1 / (np.maximum(kd[near], np.take_along_axis(d, near, 1)).mean(axis=1) + 1e-10)

    near_own, dense = density(own)
    near, mine = density(gap(test, train))
    offset = 1.5 if contamination is None else np.quantile(dense[near_own].mean(axis=1) / dense, 0.95)
    got = by_t(scorers.lof_score(df.where("split = 'test'"), df.where("split = 'train'"), K, k, contamination=contamination))
    assert [got[90 + i] for i in range(len(test))] == pytest.approx(dense[near].mean(axis=1) / mine - offset)


def test_lof_of_few_rows_holds_k_to_the_rows_less_one(spark):
    rows = [("a", "train", i, [float(i), 0.0]) for i in range(4)] + [("a", "test", 9, [1.5, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = by_t(scorers.lof_score(df.where("split = 'test'"), df.where("split = 'train'"), K, 20, contamination=None))
    step = 1 / np.std([0, 1, 2, 3])  # k = 3
    kd = np.array([3, 2, 2, 3]) * step
    lrd = lambda others, d: 1 / (np.maximum(kd[others], np.array(d) * step).mean() + 1e-10)
    dense = np.array([lrd([1, 2, 3], [1, 2, 3]), lrd([0, 2, 3], [1, 1, 2]), lrd([0, 1, 3], [2, 1, 1]), lrd([0, 1, 2], [3, 2, 1])])
    assert got[9] == pytest.approx(dense[[1, 2, 0]].mean() / lrd([1, 2, 0], [0.5, 0.5, 1.5]) - 1.5)


def test_knn_of_many_balls(points, monkeypatch, way):
    monkeypatch.setattr(neighbours, "BALL_ROWS", 8)
    monkeypatch.setattr(neighbours, "PART", 5)
    train, test, df = points
    want = np.sort(np.sqrt(((test[:, None] - train[None]) ** 2).sum(axis=2)), axis=1)[:, :5].mean(axis=1)
    got = by_t(scorers.knn_score(df.where("split = 'test'"), df.where("split = 'train'"), K))
    assert [got[90 + i] for i in range(len(test))] == pytest.approx(want)


def test_neighbours_send_few_rows_and_miss_none(spark):
    """20,000 rows against themselves, with ties, repeats and a key of three rows."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(20000, 3)) + 8 * rng.integers(0, 5, (20000, 1)), 2)
    x[100:160] = x[7]
    rows = [("a", i, v) for i, v in enumerate(x.tolist())] + [("b", i, [float(i), 0.0, 0.0]) for i in range(3)] + [(None, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "entity string, t long, f array<double>").withColumn("me", F.lit(True))
    seen = {}
    got = neighbours.nearest(df, df, K, 4, itself="me", seen=seen).collect()
    assert sorted((r["t"], r["other"], r["d"]) for r in got if r["entity"] == "b") == [(i, j, abs(float(i - j))) for i in range(3) for j in range(3) if i != j]
    assert None not in {r["entity"] for r in got}
    near = {}
    for r in got:
        if r["entity"] == "a":
            near.setdefault(r["t"], []).append((r["d"], r["other"]))
    assert seen["rows"] < 0.5 * 20000**2 / 2000 and all(len(v) == 4 for v in near.values()) and len(near) == 20000
    for i in [0, 7, 120, *rng.integers(0, 20000, 300).tolist()]:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [a for a, _ in sorted(near[i])] == pytest.approx(np.sort(d)[:4]) and all(a == pytest.approx(d[j]) for a, j in near[i])
    assert sorted(near[7]) == [(0, j) for j in (100, 101, 102, 103)] and sorted(near[120]) == [(0, j) for j in (7, 100, 101, 102)]


def test_moments_of_many_tasks_are_those_of_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) + [1e6, 0, -3]
    df = spark.createDataFrame([("a" if i % 5 else None, v.tolist()) for i, v in enumerate(x)], "entity string, f array<double>").repartition(200)
    got = {r["entity"]: r for r in scorers.ledoit_wolf_fit(df, K).collect()}
    for k, some in (("a", x[np.arange(500) % 5 > 0]), (None, x[::5])):
        c = some - some.mean(axis=0)
        prec, shrinkage = scorers.shrink((c.T @ c).ravel(), ((c * c).sum(axis=1) ** 2).sum(), len(c))
        assert got[k]["n"] == len(some) and got[k]["shrinkage"] == pytest.approx(shrinkage, rel=1e-6)
        assert np.array(got[k]["prec"]) == pytest.approx(np.array(prec), rel=1e-6, abs=1e-9)


def test_mahalanobis_by_blocks(points, way):
    train, test, df = points
    model = scorers.ledoit_wolf_fit(df.where("split = 'train'"), K)
    m = model.first()
    d = np.vstack([train, test]) - m["mu"]
    got = by_t(scorers.mahalanobis_score(df, model, K))
    assert [got[i] for i in range(len(d))] == pytest.approx(np.einsum("ij,jk,ik->i", d, np.array(m["prec"]), d))


def walk(t, x, at=0):
    """The path length of one row, node by node."""
    feature, cut, child, path = t
    while feature[at] >= 0:
        at = child[at] + (x[feature[at]] >= cut[at])
    return path[at]


def test_forest_of_flat_trees(points, way):
    train, test, df = points
    one = scorers.grow(train, np.random.default_rng(3), 6)
    two = scorers.grow(train[:20], np.random.default_rng(4), 5)
    assert (one[0] < 0).sum() == (one[0] >= 0).sum() + 1  # every node but leaves has two children
    flat = [np.concatenate(p) for p in zip(one, two, strict=True)]
    want = [(walk(one, v) + walk(two, v)) / 2 for v in test]
    assert scorers.mean_depth(np.array([0, len(one[0])]), *flat, test) == pytest.approx(want)
    raw = by_t(scorers.isolation_forest(df, K, trees=50, contamination=None))
    assert max(raw, key=raw.get) == 90 + len(test) - 1 and all(-0.5 < s < 0.5 for s in raw.values())
    got = by_t(scorers.isolation_forest(df, K, trees=50))
    offset = np.quantile([raw[i] + 0.5 for i in range(90)], 0.95)
    assert [got[i] for i in range(103)] == pytest.approx([raw[i] + 0.5 - offset for i in range(103)])
    assert got == pytest.approx(by_t(scorers.isolation_forest(df.repartition(5), K, trees=50)))


def test_forest_fits_on_a_capped_sample(spark):
    rows = [("a", "train", i, [float(np.sin(i)), i % 7.0]) for i in range(4000)]
    df = spark.createDataFrame(rows, VECTORS)
    got = by_t(scorers.isolation_forest(df, K, trees=4, sample=64, contamination=None))
    # 2 ** -(mean depth / c(64)) lies about a half where trees hold 64 rows
    assert abs(np.mean(list(got.values()))) < 0.08
    few = by_t(scorers.isolation_forest(df, K, trees=4, sample=64, contamination=None, cap=100))
    assert len(few) == 4000 and few != got


def test_transport_plan_has_uniform_marginals_and_the_gibbs_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 4, 3)) * 0.3
    df = spark.createDataFrame([(w, i, x[w, i].tolist()) for w in range(2) for i in range(4)], "w long, patch int, vec array<double>")
    p = np.zeros((4, 4))
    for r in tokens.ot_plan(df, 0.1, 500, 1e-10).collect():
        p[r["i"], r["j"]] = r["p"]
    assert p.sum(axis=0) == pytest.approx([0.25] * 4) and p.sum(axis=1) == pytest.approx([0.25] * 4)
    cost = ((x[0][:, None] - x[1][None]) ** 2).sum(axis=2) / 2
    left = np.log(p) + cost / 0.1  # a sum of a row term and a column term
    assert left - left[:1] - left[:, :1] + left[0, 0] == pytest.approx(np.zeros((4, 4)), abs=1e-6)


def test_bootstrap_interval(spark):
    x = np.random.default_rng(1).normal(3, 2, 200)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, v double")
    row = stats.bootstrap_ci(df, ["g"], "v").first()
    half = 1.96 * x.std() / 200**0.5
    assert (row["low"], row["high"]) == pytest.approx((x.mean() - half, x.mean() + half), abs=0.1)


def test_bootstrap_of_many_leaves(spark):
    """A million values, mostly repeated: the interval is that of the normal limit, and the draws of all leaves are a whole resample."""
    x = np.round(np.random.default_rng(1).gamma(2, 3, 1_000_000), 2)
    value, count = np.unique(x, return_counts=True)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(value, count, strict=True)], "v double, c int").select(F.lit("a").alias("g"), "v", F.explode(F.sequence(F.lit(1), "c")))
    row = stats.bootstrap_ci(df, ["g"], "v", resamples=400).first()
    half = 1.96 * x.std() / 1000
    assert row["mean"] == pytest.approx(x.mean(), abs=half / 4) and (row["high"] - row["low"]) / 2 == pytest.approx(half, rel=0.15)
    assert row == stats.bootstrap_ci(df.repartition(7), ["g"], "v", resamples=400).first()
    shares = np.array([stats.leaf_draws(42, 5, 10_000, leaf, 50) for leaf in range(3)])
    assert (shares.sum(axis=0) == 10_000).all() and shares[2].mean() == pytest.approx(10_000 - 8192, rel=0.05)


def test_bootstrap_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("a", None)], "g string, v double")
    got = {r["g"]: r for r in stats.bootstrap_ci(df, ["g"], "v").collect()}
    assert (got["a"]["low"], got["a"]["high"]) == (1.0, 3.0) and got["a"]["mean"] == pytest.approx(2, abs=0.03) and got["b"]["low"] == got["b"]["high"] == 5


def test_spectral_entropy_and_periodicity():
    t = np.arange(200)
    assert stats.spectral_entropy(np.ones(50)) == 0 and stats.spectral_entropy(np.random.default_rng(0).normal(size=400)) > 0.85
    assert stats.periodicity(np.sin(2 * np.pi * t / 20)) > 0.85
    x = np.random.default_rng(4).normal(size=40)
    c = x - x.mean()
    assert stats.periodicity(x) == pytest.approx(max(abs((c[: 40 - k] * c[k:]).sum() / (c @ c)) for k in range(1, 20)))


def test_file_trees(spark, tmp_path):
    for name, text in {"train/m1.txt": "1,2\n3,x\n", "test/m1.txt": "5,6\r\n7,8", "test_label/m1.txt": "0\n1\n"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    rows = {tuple(r) for r in series_io.read_entity_csv(spark, str(tmp_path / "tree")).withColumn("x", F.to_json("x")).collect()}
    assert rows == {("m1", "train", 0, "[1.0,2.0]", 0), ("m1", "train", 1, "[3.0,null]", 0), ("m1", "test", 0, "[5.0,6.0]", 0), ("m1", "test", 1, "[7.0,8.0]", 1)}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "s.csv").write_text("timestamp_(min),a\n0,4\n1,\n")
    got = series_io.read_feature_csv(spark, str(tmp_path / "f")).orderBy("t").collect()
    assert [(r["entity"], r["t"], r["x"], r["label"]) for r in got] == [("s", 0, [4.0], 0), ("s", 1, [None], 0)]


def test_per_patch_maha_reads_the_whole_vector(spark, tmp_path):
    from tidewatch.plans import registry

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[399, 40] = 50  # an anomaly in a late component of a test window
    df = spark.createDataFrame([(i, v.tolist(), 9 if i == 399 else 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["t"], r["patch"]): r["s"] for r in registry.QUERIES["per_patch_maha"](spark, str(tmp_path)).collect()}
    assert len(got) == 400
    assert max(got, key=got.get) == (99, 3)
    v = x[3::4].astype(float)
    train = v[np.arange(100) < 49.5]
    c = train - train.mean(axis=0)
    prec, _ = scorers.shrink((c.T @ c).ravel(), ((c * c).sum(axis=1) ** 2).sum(), len(c))
    d = v - train.mean(axis=0)
    assert [got[w, 3] for w in range(100)] == pytest.approx(((d @ np.array(prec)) * d).sum(axis=1), rel=1e-6)
