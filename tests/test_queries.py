"""Registered queries against their SQL on small tables that hold odd values."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewatch.plans import registry


def both(spark, folder, name):
    """Rows of the query and of its SQL as text, so that 0.0 and -0.0 differ."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr(r) for r in cursor.fetchall())
    return sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, str(folder)).select(*columns).collect()), want


def test_token_sequences_have_no_negative_zeros(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(40, 64)).astype(np.float32)
    vectors[8:12, 5] = -1e-7  # this mean is below zero and rounds to zero
    table = {"vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(40)], pa.int32())}
    for name in ("embeddings", "events", "lineitem"):
        t = table if name == "embeddings" else EMPTY[name]
        pq.write_table(pa.table(t), tmp_path / f"{name}.parquet")
    got, want = both(spark, tmp_path, "token_sequences")
    assert got == want and len(got) == 5


@pytest.mark.parametrize("name", ["far_at_alpha_v2", "fixed_quantile_eval"])
def test_equal_scores_are_equal_whatever_their_mean_was_summed_from(spark, tmp_path, name):
    """Users whose deviations from the mean are all the same but for the last bits: none lies above the threshold."""
    pairs = [(0.1, 0.7), (0.7, 0.1), (10.1, 30.4), (30.4, 10.1), (5.55, 7.77), (7.77, 5.55), (0.3, 99.9), (99.9, 0.3)]
    rows = [(u, t, (a if t < 10 else b)) for u, (a, b) in enumerate(pairs) for t in range(20)]
    n = len(rows)
    ts = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=t) for _, t, _ in rows]
    events = {"event_id": pa.array(range(n), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array([r[0] for r in rows], pa.int64()), "event_type": pa.array(["error" if r[1] >= 12 else "view" for r in rows]), "value": pa.array([r[2] for r in rows], pa.float64())}
    for table, empty in EMPTY.items():
        pq.write_table(pa.table(events if table == "events" else empty), tmp_path / f"{table}.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and got
    assert {r["far"] for r in registry.QUERIES[name](spark, str(tmp_path)).where("view = 'dev'").collect()} == {0.0}


@pytest.mark.parametrize("name", ["all_metrics", "auc_pr", "f1_pa_oracle", "comparison_sources"])
def test_users_without_errors(spark, tmp_path, name):
    """Large tables hold users without an error, with errors only, and with a single event."""
    rng = np.random.default_rng(6)
    kinds = {u: ("error" if u == 2 else None, "view" if u in (1, 5) else None, 1 if u > 5 else 30) for u in range(8)}
    rows = [(u, t, only or none or ("error" if rng.random() < 0.4 else "click"), float(rng.integers(1, 60)) / 4) for u, (only, none, n) in kinds.items() for t in range(n)]
    ts = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=t) for _, t, _, _ in rows]
    events = {"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array([r[0] for r in rows], pa.int64()), "event_type": pa.array([r[2] for r in rows]), "value": pa.array([r[3] for r in rows], pa.float64())}
    for table, empty in EMPTY.items():
        pq.write_table(pa.table(events if table == "events" else empty), tmp_path / f"{table}.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and len(got) == (10 if name == "comparison_sources" else 24)


#: Tables that the fixtures' SQL names, without rows.
EMPTY = {
    "events": {"event_id": pa.array([], pa.int64()), "ts": pa.array([], pa.timestamp("us")), "user_id": pa.array([], pa.int64()), "event_type": pa.array([], pa.string()), "value": pa.array([], pa.float64())},
    "lineitem": {"l_returnflag": pa.array([], pa.string()), "l_shipdate": pa.array([], pa.date32()), "l_quantity": pa.array([], pa.float64()), "l_discount": pa.array([], pa.float64()), "l_extendedprice": pa.array([], pa.float64())},
}
