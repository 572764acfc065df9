"""Ball k-means and vector codes against plain k-means, and joins on hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import pq
from tidewatch.llm.spread import join_spread

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def nearest(x, book):
    d = ((x[:, None] - book[None]) ** 2).sum(-1)
    return d.argmin(axis=1), d.min(axis=1)


def plain(vecs, rounds=6, entries=16, parts=8):
    """Codes, errors and codebooks of vectors in order of their ids."""
    x = np.floor(np.asarray(vecs, np.float64) * 4096).astype(np.int64).reshape(len(vecs), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for n in range(rounds + 1):
        got = [nearest(x[:, p], book[p]) for p in range(parts)]
        if n < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    mine = x[got[p][0] == e, p]
                    if len(mine):
                        book[p, e] = mine.sum(axis=0) // len(mine)
    return np.stack([c for c, _ in got], axis=1), sum(d for _, d in got), book


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_ball_assignment(kind):
    rng = np.random.default_rng(2)
    for spread in (1, 4, 50):
        centres = rng.integers(-60, 60, (16, 4))
        centres[5] = centres[3]  # equal entries
        x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-spread, spread + 1, (3000, 4))).astype(kind)
        looks = np.zeros(3, np.int64)
        for start in (np.zeros(3000, np.int64), rng.integers(0, 16, 3000)):
            code, d = pq.ball_assign(x, start, centres.astype(kind), looks)
            want, least = nearest(x.astype(np.int64), centres)
            assert (code == want).all() and (d == least).all()
        looks[:] = 0
        again, _ = pq.ball_assign(x, code, centres.astype(kind), looks)
        assert (again == want).all()
        if spread == 1:
            assert looks[1] > 0.5 * looks[0] and looks[2] < 3 * looks[0]  # of 15 other entries a part


def test_codes_equal_plain_k_means(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 16))
    vecs = (centres[rng.integers(0, 9, 700)] + rng.normal(scale=0.2, size=(700, 16))).astype(np.float32)
    vecs[20:40] = vecs[3]  # repeats, among them entries' starts
    vecs[4] = vecs[3]
    bad = [(1000, None), (-5, [float("nan")] * 16), (-6, [1.0] * 15 + [None]), (-7, [float("inf")] * 16), (None, []), (1001, [1.0] * 8), (1002, [1.0] * 9)]
    rows = [(i, v.tolist(), None if i % 3 else i % 5, "c", 1) for i, v in enumerate(vecs)] + [(i, v, 1, "c", 1) for i, v in bad]
    codes, book = pq.fit_codes(spark, spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(3)))
    got = {r["id"]: (list(r["code"]), r["error"]) for r in codes.collect()}
    want, error, plain_book = plain(vecs)
    assert got == {i: (want[i].tolist(), int(error[i])) for i in range(700)} and np.array_equal(book, plain_book)
    first = np.floor(vecs[0].astype(float) * 4096)
    assert ((pq.decoded(bytes(got[0][0]), book) - first) ** 2).sum() == got[0][1]


def test_few_rows_null_ids_and_empty(spark):
    empty, book = pq.fit_codes(spark, spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and book.size == 0
    rows = [(None, [0.5] * 8, None, "", 1), (2, [0.25] * 8, 1, "", 1), (2, [0.25] * 8, 1, "", 1)]
    codes, book = pq.fit_codes(spark, spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["id"] or 0, bytes(r["code"]).hex(), r["error"]) for r in codes.collect()) == [(0, "02" * 8, 0), (2, "00" * 8, 0), (2, "00" * 8, 0)]
    assert book[0].tolist() == [[1024], [1024], [2048]]


def test_numbers_beyond_64_bits_are_an_error(spark):
    codes = spark.createDataFrame([(1, [1e30] * 8, 1, "", 1), (2, [1.0] * 8, 1, "", 1)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        pq.fit_codes(spark, codes)[0].collect()


def test_join_of_hot_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"), F.lit("a").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = join_spread(spark, left, right, ["k"])
    assert out.columns == ["k", "v", "n"]
    assert out.count() == 5000 and out.where("k is null and n = 1667").count() == 1667 and out.where("k = 7 and n = 1667").count() > 1600
