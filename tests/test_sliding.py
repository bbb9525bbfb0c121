"""Sliding time ranges against direct sums, over batches, blocks, ties and NULLs."""

import random
import time

import duckdb
import numpy as np
import pytest

from tidemark.operators.flow import regime_windows
from tidemark.operators.series import Series
from tidemark.operators.sliding import around, extremes, summaries, time_ranges
from tidemark.plans import ORACLE_SQL, QUERIES
from tests.test_zero_prices import same


def plain(rows, ms):
    out = {}
    for key, t, i, price, change in rows:
        seen = sorted((r for r in rows if r[0] == key and t is not None and r[1] is not None and t - ms < r[1] <= t), key=lambda r: (r[1], r[2]))
        p, r = [x[3] for x in seen if x[3] is not None], [x[4] for x in seen if x[4] is not None]
        pairs = [(x[1] / 1000, x[3]) for x in seen if x[3] is not None]
        slope = np.polyfit(*np.array(pairs).T, 1)[0] if len({a for a, _ in pairs}) > 1 else None
        out[i] = (len(seen) or None, seen[0][3] if seen else None, max(p, default=None), min(p, default=None), sum(r) if r else None, len(r) if seen else None, sum(x > 0 for x in r) if seen else None, sum(x < 0 for x in r) if seen else None, np.var(r, ddof=1) if len(r) > 1 else None, slope)
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_against_direct_sums(spark, batch):
    rng = random.Random(6)
    maybe = lambda v: None if rng.random() < 0.1 else v
    rows = [(rng.choice(["a", "a", "b", None]), maybe(rng.randrange(-3000, 9000)), i, maybe(rng.gauss(50, 9)), maybe(rng.choice([0.0, rng.gauss(0, 2)]))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long, p double, r double").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = time_ranges(df, ["k"], "t", "p", "r", [700, 2000], ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.i for r in got) == list(range(400))
    for ms in (700, 2000):
        want = plain(rows, ms)
        for r in got:
            assert all((a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-7, atol=1e-7)) for a, b in zip(r[f"r{ms}"], want[r.i])), (r, want[r.i])


def test_large_ids_and_empty_tables_stay_whole(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, 1, 2.0, None, [1]), (None, 2, 3.0, 1.0, None)], "id long, t long, p double, r double, l array<int>")
    got = regime_windows(df.selectExpr("'k' as k", "*"), Series(("k",), ("t",)), "p", "r", [1000])
    assert {r.id for r in got.collect()} == {big, None} and {r.n_1s for r in got.collect()} == {1, 2}
    assert regime_windows(df.limit(0).selectExpr("'k' as k", "*"), Series(("k",), ("t",)), "p", "r", [1000]).count() == 0


def test_extremes():
    rng = np.random.default_rng(2)
    x = np.where(rng.random(300) < 0.1, np.nan, rng.normal(size=300))
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(0, 120, 500))
    want = [np.nanmax(x[a:b]) if b > a and not np.isnan(x[a:b]).all() else np.nan for a, b in zip(lo, hi)]
    assert np.array_equal(extremes(x, lo, hi), want, equal_nan=True)


def test_cost_does_not_grow_with_the_range():
    rng = np.random.default_rng(1)
    n = 200_000
    t, p, r = np.arange(n) * 10.0, rng.normal(50, 1, n), rng.normal(0, 1, n)

    def took(ms):
        began = time.process_time()
        summaries(t, p, r, 0, n, ms)
        return time.process_time() - began

    took(100)
    assert took(1_000_000) < 6 * max(took(100), 0.02)


def test_first_values_in_blocks_of_time(spark):
    from tidemark.operators.flow import past_values
    from tidemark.operators.series import Series

    rows = [("a" if i % 3 else "b", (i * 7919) % 5000 // 3 * 3, i, None if i % 17 == 4 else float(i % 23)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, i long, x double").repartition(5)
    out = past_values(df, Series(("k",), ("t", "i")), "x", {"p": 60, "q": 900})
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: (r.p, r.q) for r in out.collect()}
    first = lambda k, t, ms: min((r for r in rows if r[0] == k and t - ms <= r[1] <= t), key=lambda r: (r[1], r[2]))[3]
    assert len(got) == 900 and all(got[i] == (first(k, t, 60), first(k, t, 900)) for k, t, i, _ in rows)
    assert out.columns == ["k", "t", "i", "x", "p", "q"]


@pytest.mark.parametrize("name", ["L12_instability", "L13_event_labels"])
def test_labels_over_six_hours_take_blocks_not_frames(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i % 90 <> 3 THEN TIMESTAMP '2024-01-01' + INTERVAL (i // 3 * 7) MINUTE END AS ts, CAST(i % 5 AS BIGINT) AS user_id, CASE WHEN i % 4 > 0 THEN 'e' || i % 4 END AS event_type,
        CASE WHEN i % 11 = 2 THEN NULL WHEN i % 37 = 5 THEN 'NaN'::DOUBLE WHEN i % 53 = 7 THEN 'Infinity'::DOUBLE ELSE hash(i) % 40 / 2 - 1 END AS value, CASE WHEN i % 17 > 0 THEN '{{"k": ' || hash(i) % 90 || '}}' END AS props FROM range(1500) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    got, want = df.collect(), con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(got) == len(want) == 1500
    for a, b in zip(sorted(map(tuple, got), key=lambda r: r[0]), sorted(want, key=lambda r: r[0])):
        assert all(map(same, a, b)), (a, b)


def test_ranges_of_an_empty_table(spark):
    none = spark.createDataFrame([], "k string, t long, x double")
    assert around(none, ["k"], "t", 10, ["x"], "x", "x").collect() == []
