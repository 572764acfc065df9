"""Online guards: the state machine by hand, streams against the batch guard, late, repeated and missing rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import guard, replay

START = datetime.datetime(2024, 1, 1)
ROWS = "entity string, ts timestamp, t long, s double"


def history(spark, n=60, entities=("a", "b", None)):
    rng = np.random.default_rng(5)
    cal = spark.createDataFrame([(e, float(x)) for e in entities for x in rng.normal(size=40)], "entity string, s double")
    rows = [(e, START + datetime.timedelta(hours=t), t, float(x)) for e in entities for t, x in enumerate(rng.normal(size=n) + np.linspace(0, 4, n))]
    return cal, rows


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("mode", ["fixed", "rolling", "aci"])
def test_guard_state_survives_batches(mode):
    rng = np.random.default_rng(1)
    cal, xs = rng.normal(size=50).tolist(), rng.normal(size=80)
    whole = guard.Guard(cal, mode, window=20)
    want = [whole.see(t, x) for t, x in enumerate(xs)]
    buffer, status, got = [], None, []
    for at in range(0, 80, 7):
        g = guard.Guard(cal, mode, window=20, buffer=buffer, status=status)
        got += [g.see(t, xs[t]) for t in range(at, min(at + 7, 80))]
        buffer, status = list(g.buffer), g.status()
    assert got == want
    assert whole.see(3, 0.0) is None  # a late row is dropped


@pytest.mark.parametrize("files", [1, 4])
@pytest.mark.parametrize("mode", ["rolling", "aci"])
def test_late_and_repeated_rows_find_their_place(spark, mode, files):
    cal, rows = history(spark)
    rng = np.random.default_rng(9)
    sent = []
    for e, ts, t, s in rows:
        sent.append((e, ts, t, s, ts + datetime.timedelta(hours=int(rng.integers(0, 6)))))
        if t % 5 == 0:
            sent.append((e, ts, t, s, ts + datetime.timedelta(hours=8)))
    end = START + datetime.timedelta(days=9)
    sent.append((None, end, None, None, end))
    slices = [START + datetime.timedelta(hours=h) for h in (15, 30, 45)] + [end]
    folder = replay.write_arrivals(spark.createDataFrame(sent, ROWS + ", arrival timestamp"), "arrival", slices, "entity")
    stream = replay.read_arrivals(spark, folder, files).withWatermark("ts", "24 hours")
    out = replay.run_append(guard.guard_stream(stream, cal, mode=mode, event_time="ts", window=20))
    batch = guard.guard_batch(spark.createDataFrame(rows, ROWS), cal, mode=mode, window=20)
    assert told(out) == told(batch) and out.count() == 180


def test_an_entity_that_begins_with_alarms_has_an_empty_buffer(spark):
    """Alarms are not remembered in mode rolling, so the first micro-batches leave nothing to keep."""
    cal = spark.createDataFrame([("a", float(x)) for x in range(20)], "entity string, s double")
    rows = [("a", START + datetime.timedelta(hours=t), t, 100.0 if t < 8 else 1.0) for t in range(30)]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], ROWS + ", arrival timestamp")
    folder = replay.write_arrivals(df, "arrival", [START + datetime.timedelta(hours=h) for h in (4, 12)], "entity")
    out = replay.run_append(guard.guard_stream(replay.read_arrivals(spark, folder, 1), cal, mode="rolling", window=20))
    assert told(out) == told(guard.guard_batch(spark.createDataFrame(rows, ROWS), cal, mode="rolling", window=20)) and out.count() == 30


def test_rows_behind_the_watermark_are_dropped(spark):
    cal, rows = history(spark, entities=("a",))
    sent = [(*r, START + datetime.timedelta(days=20) if r[2] in (3, 17) else r[1]) for r in rows]
    more = [(None, START + datetime.timedelta(days=d), None, None, START + datetime.timedelta(days=d)) for d in (10, 11, 40)]
    slices = [START + datetime.timedelta(days=d) for d in (9, 10.5, 15, 30)]
    folder = replay.write_arrivals(spark.createDataFrame(sent + more, ROWS + ", arrival timestamp"), "arrival", slices, "entity")
    out = replay.run_append(guard.guard_stream(replay.read_arrivals(spark, folder, 1).withWatermark("ts", "1 hour"), cal, mode="rolling", event_time="ts", window=20))
    kept = [r for r in rows if r[2] not in (3, 17)]
    assert told(out) == told(guard.guard_batch(spark.createDataFrame(kept, ROWS), cal, mode="rolling", window=20))


def test_without_event_time_each_batch_is_sorted(spark):
    cal, rows = history(spark, entities=("a", "b"))
    df = spark.createDataFrame([(*r, r[1]) for r in rows] * 2, ROWS + ", arrival timestamp")
    folder = replay.write_arrivals(df, "arrival", [START + datetime.timedelta(hours=20)], "entity")
    out = replay.run_append(guard.guard_stream(replay.read_arrivals(spark, folder), cal, mode="aci", window=20))
    assert told(out) == told(guard.guard_batch(spark.createDataFrame(rows, ROWS), cal, mode="aci", window=20))


def test_running_statistics(spark):
    cal, rows = history(spark, entities=("a", "b"))
    folder = replay.write_arrivals(spark.createDataFrame([(*r, r[1]) for r in rows], ROWS + ", arrival timestamp"), "arrival", [START + datetime.timedelta(hours=20)], "entity")
    got = {r["entity"]: r for r in replay.run_update(guard.guard_stream(replay.read_arrivals(spark, folder), cal, mode="aci", stats=True, window=20), ["entity"], "n_predictions").collect()}
    for e in ("a", "b"):
        g = guard.Guard([r["s"] for r in cal.where(F.col("entity") == e).collect()], "aci", window=20)
        flags = [g.see(r[2], r[3])[4] for r in rows if r[0] == e]
        assert tuple(got[e])[1:] == g.stats() and got[e]["n_alarms"] == sum(flags) and got[e]["far"] == sum(flags) / 60


@pytest.mark.parametrize("stats", [False, True])
def test_python_is_called_for_groups_of_entities(spark, tmp_path, monkeypatch, stats):
    """300 entities, one of them null, others numbers that no double holds: far fewer calls, and the batch guard's rows."""

    class Counting(guard.GuardState):
        log = str(tmp_path / "calls")

        def handleExpiredTimer(self, **args):
            with open(self.log, "a") as f:
                f.write(".")
            yield from guard.GuardState.handleExpiredTimer(self, **args)

    monkeypatch.setattr(guard, "GuardState", Counting)
    rng = np.random.default_rng(7)
    names = [None, *range(2**60 + 1, 2**60 + 300)]
    kind = "entity long, ts timestamp, t long, s double"
    cal = spark.createDataFrame([(e, float(x)) for e in names for x in rng.normal(size=20)], "entity long, s double")
    rows = [(e, START + datetime.timedelta(hours=t), 2**60 + t, float(x)) for e in names for t, x in enumerate(rng.normal(size=24))]
    end = START + datetime.timedelta(days=9)
    sent = spark.createDataFrame([*((*r, r[1]) for r in rows), (None, end, None, None, end)], kind + ", arrival timestamp")
    folder = replay.write_arrivals(sent, "arrival", [START + datetime.timedelta(hours=12), end], "entity")
    out = guard.guard_stream(replay.read_arrivals(spark, folder).withWatermark("ts", "6 hours"), cal, mode="aci", event_time="ts", stats=stats, window=15)
    got = replay.run_update(out, ["entity"], "n_predictions") if stats else replay.run_append(out)
    assert 0 < len((tmp_path / "calls").read_text()) < 300
    want = guard.guard_batch(spark.createDataFrame(rows, kind), cal, mode="aci", window=15)
    if stats:
        last = want.groupBy("entity").agg(F.max("n_seen").alias("n_predictions"), F.max("n_alarms").alias("n_alarms"), F.max_by("drift", "t").alias("drift"))
        assert told(got.select(*last.columns)) == told(last) and got.count() == 300
    else:
        assert told(got) == told(want) and got.count() == 300 * 24


@pytest.mark.parametrize("stats", [False, True])
def test_a_group_reads_few_rows_of_state(spark, tmp_path, monkeypatch, stats):
    """Calibration scores and guards of a group of entities are a row of state each, not one an entity."""

    class Counting(guard.GuardState):
        log = str(tmp_path / "rows")

        def handleExpiredTimer(self, **args):
            with open(self.log, "a") as f:
                f.write(f"{len(list(self.cal.get()))}\n")
            yield from guard.GuardState.handleExpiredTimer(self, **args)

    monkeypatch.setattr(guard, "GuardState", Counting)
    rng = np.random.default_rng(11)
    names = [None, *(f"e{k}" for k in range(99))]
    cal = spark.createDataFrame([(e, float(x)) for k, e in enumerate(names) for x in rng.normal(size=5 + k % 7)], "entity string, s double")
    rows = [(e, START + datetime.timedelta(hours=t), t, float(x)) for k, e in enumerate(names) for t, x in enumerate(rng.normal(size=k % 24) * (1 + k % 3))]
    end = START + datetime.timedelta(days=9)
    sent = spark.createDataFrame([*((*r, r[1]) for r in rows), (None, end, None, None, end)], ROWS + ", arrival timestamp")
    folder = replay.write_arrivals(sent, "arrival", [START + datetime.timedelta(hours=h) for h in (8, 16)] + [end], "entity")
    out = guard.guard_stream(replay.read_arrivals(spark, folder).withWatermark("ts", "2 hours"), cal, mode="aci", event_time="ts", stats=stats, groups=4, window=15)
    got = replay.run_update(out, ["entity"], "n_predictions") if stats else replay.run_append(out)
    want = guard.guard_batch(spark.createDataFrame(rows, ROWS), cal, mode="aci", window=15)
    if stats:
        last = want.groupBy("entity").agg(F.max("n_seen").alias("n_predictions"), F.max("n_alarms").alias("n_alarms"), F.max_by("drift", "t").alias("drift"))
        got, want = got.select(*last.columns), last
    assert told(got) == told(want) and got.count()
    assert set((tmp_path / "rows").read_text().split()) == {"1"}


def test_calibration_scores_of_more_than_one_arrow_batch(spark):
    rng = np.random.default_rng(8)
    cal = spark.createDataFrame([("a", float(x)) for x in rng.normal(size=12_000)], "entity string, s double")
    rows = [("a", START + datetime.timedelta(hours=t), t, float(x)) for t, x in enumerate(rng.normal(size=30))]
    folder = replay.write_arrivals(spark.createDataFrame([(*r, r[1]) for r in rows], ROWS + ", arrival timestamp"), "arrival", [], "entity")
    out = replay.run_append(guard.guard_stream(replay.read_arrivals(spark, folder), cal, mode="fixed"))
    assert told(out) == told(guard.guard_batch(spark.createDataFrame(rows, ROWS), cal, mode="fixed")) and out.count() == 30


def test_scores_of_a_stream_of_vectors(spark):
    rng = np.random.default_rng(3)
    prec = np.cov(rng.normal(size=(5, 40)))
    model = spark.createDataFrame([("a", [0.5] * 5, prec.tolist())], "entity string, mu array<double>, prec array<array<double>>")
    x = rng.normal(size=(30, 5))
    rows = spark.createDataFrame([("a", i, v.tolist(), i) for i, v in enumerate(x)], "entity string, t long, f array<double>, arrival int")
    out = replay.run_append(guard.stream_score(replay.read_arrivals(spark, replay.write_arrivals(rows, "arrival", [10, 20], "t"), 2), model).select("t", "s"))
    want = np.einsum("ij,jk,ik->i", x - 0.5, prec, x - 0.5)
    assert [r["s"] for r in out.orderBy("t").collect()] == pytest.approx(want)


def test_errors(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            guard.Guard([1.0, 2.0, 3.0], "rolling").see(0, bad)
        with pytest.raises(ValueError, match="finite"):
            guard.Guard([1.0, bad], "rolling")
    cal, rows = history(spark, 3, ("a",))
    with pytest.raises(Exception, match="without t"):
        guard.guard_batch(spark.createDataFrame([*rows, ("a", START, None, 1.0)], ROWS), cal).collect()
    with pytest.raises(Exception, match="no calibration scores of b"):
        guard.guard_batch(spark.createDataFrame([*rows, ("b", START, 1, 1.0)], ROWS), cal).collect()


def test_adaptive_guard_by_hand():
    """An early alarm takes the level to (almost) 0; it then gains 0.022 with each quiet score."""
    seen = [100.0] + [10.0] * 9 + [50.0]

    def thresholds(**options):
        g = guard.Guard(list(range(20)), "aci", alpha=0.1, window=20, gamma=0.22, **options)
        return [g.see(t, x)[3:6] for t, x in enumerate(seen)]

    got = thresholds()
    assert [f for _, f, _ in got] == [True] + [False] * 10
    # calibration scores of rank ceil(21 (1 - level)), 20 at most; from ten scores on the buffer's of rank ceil(11 (1 - 0.176)) = 10
    assert np.allclose([x for x, _, _ in got], [18, 19, 19, 19, 19, 19, 18, 18, 17, 17, 100])
    # in drift the calibration scores decide again, at the level of 0.198 by then
    drift = thresholds(drift_sigma=1.0)
    assert [d for _, _, d in drift] == [False] * 9 + [True] * 2 and np.isclose(drift[-1][0], 16) and drift[-1][1]
    assert np.isclose(guard.Guard(list(range(20)), "aci", alpha=0.4, n_tests=4).see(0, 1.0)[3], 18)
