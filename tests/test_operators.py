"""Traps on small frames: gaps, ties, duplicates, zero denominators, warm-up, run boundaries, look-ahead."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import any_to_ms, in_session, iso
from tidemark.functions.semantics import finite, log_bps, safe_div, to_number
from tidemark.operators import asof as A
from tidemark.operators import buckets as B
from tidemark.operators import clean as C
from tidemark.operators import flow as X
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import sequential as Q
from tidemark.operators import splits as V
from tidemark.operators.series import Series

S = Series(("k",), ("t",))


def frame(spark, rows, schema="k string, t long, x double"):
    return spark.createDataFrame(rows, schema)


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_semantics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 2.0), (3.0, None), (4.0, -2.0)], "a double, b double")
    got = one(df, finite(F.col("a")), safe_div(F.col("a"), F.col("b")), safe_div(F.col("a"), F.col("b"), 0), log_bps(F.col("a"), F.col("b")))
    assert got[0] == (1.0, None, 0.0, None) and got[1][0] is None and got[2][0] is None and got[3] == (3.0, None, None, None) and got[4][1] == -2.0
    assert one(spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "s string"), to_number(F.col("s"), 0.0)) == [(1.5,), (0.0,), (0.0,), (0.0,)]


def test_epoch_units_and_clock(spark):
    df = spark.createDataFrame([(1700000000,), (1700000000000,), (1700000000000000,), (5,)], "x long")
    assert one(df, any_to_ms(F.col("x"))) == [(1700000000000,)] * 3 + [(None,)]
    assert one(spark.createDataFrame([(1709251199999,)], "x long"), iso(F.col("x"))) == [("2024-02-29T23:59:59Z",)]
    # 09:30 in New York on either side of the change to daylight saving, 2024-03-10
    ms = [1709908200000, 1710163800000, 1709904600000, 1710077400000]  # Fri 14:30Z, Mon 13:30Z, Fri 13:30Z, Sun 13:30Z
    assert [r[0] for r in one(spark.createDataFrame([(m,) for m in ms], "x long"), in_session(F.col("x")))] == [True, True, False, False]


def test_gap_series_and_duplicates(spark):
    rows = [("a", 0, 1.0), ("a", 100, 2.0), ("a", 100, 3.0), ("a", 4200, 4.0)]
    ticks = spark.createDataFrame([(k, t, x, i) for i, (k, t, x) in enumerate(rows)], "k string, t long, price double, seq long")
    dense = B.gap_filled(B.last_per_bucket(ticks, ["k"], 1000, "t", ["price"], "seq"), ["k"], 1000).orderBy("bucket")
    got = one(dense, "bucket", "price", "observed", "return_bps")
    assert [g[:3] for g in got] == [(0, 3.0, 1), (1000, 3.0, 0), (2000, 3.0, 0), (3000, 3.0, 0), (4000, 4.0, 1)]
    assert [g[3] for g in got[:4]] == [0.0] * 4 and abs(got[4][3] - 1e4 * math.log(4 / 3)) < 1e-9
    assert one(C.dedupe(ticks, ["k", "t"], ["seq"]).filter("t = 100"), "price") == [(3.0,)]
    assert one(C.dedupe(ticks, ["k", "t"], ["seq"], "first").filter("t = 100"), "price") == [(2.0,)]


def test_flat_series_and_warm_up(spark):
    df = frame(spark, [("a", i, 5.0) for i in range(6)]).withColumn("ch", S.diff(F.col("x")))
    out = df.select("t", S.zscore(F.col("x"), 3).alias("z"), I.rsi_mean(S, F.col("ch"), 3).alias("m"), I.rsi_sum(S, F.col("ch"), 3).alias("s")).orderBy("t").collect()
    assert [r.z for r in out] == [None, None, 0, 0, 0, 0] and out[-1].m == 50.0 and out[-1].s == 100.0
    gaps = frame(spark, [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("a", 3, 5.0)])
    assert [r[0] for r in one(gaps.orderBy("t"), S.mean(F.col("x"), 2))] == [None, None, None, 4.0]


def test_window_edges(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 60_000, 2.0), ("a", 60_001, 4.0)])
    got = one(df, "t", F.sum("x").over(S.past_ms(60_000)), F.sum("x").over(S.past_ms(60_000, True)), F.sum("x").over(S.future_ms(60_000)))
    assert got == [(0, 1.0, 1.0, 2.0), (60_000, 2.0, 3.0, 4.0), (60_001, 6.0, 6.0, None)]


def test_asof_ties_duplicates_and_gates(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 5, 3)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 8, 1, 0.1), ("a", 12, 2, 0.2), ("a", 20, 3, 0.3), ("a", 20, 4, 0.4), ("c", 1, 5, 0.5)], "k string, t long, seq long, v double")
    go = lambda d, **o: {r.id: (r.ctx_v, r.ctx_age) for r in A.asof(left, right, ["k"], "t", ["v"], d, right_seq="seq", **o).collect()}
    assert go("backward") == {1: (0.1, 2), 2: (0.4, 0), 3: (None, None)}
    assert go("forward") == {1: (0.2, 2), 2: (0.4, 0), 3: (None, None)}
    assert go("nearest") == {1: (0.1, 2), 2: (0.4, 0), 3: (None, None)}  # equal distance: backward
    assert go("backward", max_age=1)[1] == (None, None)
    gated = A.with_context(left, right, ["k"], "t", ["v"], 5, right_seq="seq", gate=F.col("ctx_v") > 0.2)
    assert {r.id: (r.ctx_v, r.ctx_age, r.ctx_available) for r in gated.collect()} == {1: (0.0, -1, 0), 2: (0.4, 0, 1), 3: (0.0, -1, 0)}


def test_two_runs_do_not_touch(spark):
    df = spark.createDataFrame([("r1", 0, 1.0), ("r1", 1, 2.0), ("r2", 2, 30.0), ("r2", 3, 40.0)], "k string, t long, x double")
    assert [r[0] for r in one(df.orderBy("t"), S.lag("x"))] == [None, 1.0, None, 30.0]
    assert [r[0] for r in one(df.orderBy("t"), F.max("x").over(S.next_n(5)))] == [2.0, None, 40.0, None]


def test_touch_ties(spark):
    df = frame(spark, [("a", 0, 100.0), ("a", 1, 101.0), ("a", 2, 99.0)])
    path = L.return_path(S, F.col("x"), 2)
    assert one(df.orderBy("t"), L.first_touch(path, 50.0, 50.0))[0] == (1,)
    bars = spark.createDataFrame([([101.0], [99.0], 100.0)], "h array<double>, l array<double>, p double")
    got = bars.select(*[v.alias(k) for k, v in L.barrier_class(F.col("h"), F.col("l"), F.col("p"), 50.0, 50.0).items()]).first()
    assert (got["class"], got.ambiguous, got.unresolved, got.or_null, got.stop_first) == (0, 1, 0, None, -1)


def test_negative_start_of_max_dip(spark):
    df = frame(spark, [("a", 0, -5.0), ("a", 1, 2.0), ("a", 2, -1.0)])
    assert M.expectancy(df, ["k"], ["t"], "x").first().max_dip == -1.0  # the peak starts at the first value


def test_calibration_edges_and_tied_scores(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.3, 0), (1.0, 1)], "p double, y int")
    assert sorted(r.bin for r in M.reliability(df, [], "p", "y").collect()) == [0, 1, 3, 9]
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "p double, y int")
    assert M.rank_auc(tied, [], "p", "y").first().auc == 0.5
    assert M.average_precision(tied, [], "p", "y").first().average_precision == 0.5


def test_future_rows_change_no_feature(spark):
    rows = [("a", i * 1000, 10.0 + (i * 7) % 5) for i in range(40)]
    features = lambda df: X.micro_bundle(df.withColumns({"b": F.col("x"), "s": F.lit(1.0), "z": S.zscore(F.col("x"), 5), "q": S.quantile(F.col("x"), 6, 0.9), "r": S.percent_rank(F.col("x"), 8, 2)}), S, "x", "b", "s", [3000])
    short = {r.t: r for r in features(frame(spark, rows[:30])).collect()}
    long = {r.t: r for r in features(frame(spark, rows).repartition(5)).collect()}
    assert all(long[t] == r for t, r in short.items())


def test_sequential_guards(spark):
    df = spark.createDataFrame([("a", i * 10, -1.0 if i == 0 else 1.0) for i in range(8)], "k string, t long, n double")
    got = {r.t: (r.taken, r.reason) for r in Q.guarded(df, ["k"], "t", "n", 15, 20).collect()}
    assert [got[i * 10][0] for i in range(8)] == [1, 1, 0, 0, 1, 1, 1, 1] and got[20][1] == "cooldown"
    kept = Q.non_overlapping(df.withColumn("s", F.col("t")), ["k"], "t", "s", 25)
    assert sorted(r.t for r in kept.collect()) == [0, 30, 60]


def test_ladder(spark):
    cfg = Q.Ladder(0, rungs=2, spacing_bps=100, take_profit_bps=150, stop_bps=500, fee_bps=0)
    run = Q.LadderRun(cfg)
    for t, p in enumerate([100.0, 98.9, 100.6, 100.6]):
        run.tick(t, p)
    r = run.result()
    assert r["fills"] == 1 and r["profits"] == 1 and abs(r["net_bps"] - (100.6 / 99 - 1) * 1e4) < 1e-9


def test_splits():
    assert V.expanding_folds(100, 2, 0.5, 3, 2) == [(0, 47, 52, 75), (1, 72, 77, 100)]
    assert V.sliding(10, 4, 3) == [(0, 0, 4), (1, 3, 7), (2, 6, 10)]
    assert C.block_sample(10, 4, 3) == [(0, 4), (4, 8), (8, 10)]


def test_upsert_keeps_first_and_updates_latest(spark):
    old = spark.createDataFrame([("a", 1, 1.0, None)], "k string, t long, x double, last_y double")
    new = spark.createDataFrame([("a", 2, 9.0, 5.0), ("b", 3, 2.0, None)], "k string, t long, x double, last_y double")
    got = {r.k: (r.x, r.last_y) for r in J.upsert(old, new, ["k"], ["last_y"], "t").collect()}
    assert got == {"a": (1.0, 5.0), "b": (2.0, None)}


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], "Mid_Price int, ts_ms int")
    assert C.resolve_column(df, ["mid_price"]) == "Mid_Price" and C.resolve_column(df, ["price"]) == "Mid_Price"
    with pytest.raises(ValueError):
        C.resolve_column(df, ["nothing"])


def test_table_shorter_than_a_window(spark):
    assert V.sliding(3, 5, 1) == []
    rows = spark.range(3).withColumnRenamed("id", "i")
    assert V.in_windows(rows, "i", []).columns == ["i", "window"]
    assert V.in_windows(rows, "i", []).count() == 0
    assert V.in_windows(rows, "i", [(0, 0, 2), (1, 1, 3)]).count() == 4


def test_sliding_windows_by_arithmetic(spark):
    rows = spark.range(-3, 60).withColumnRenamed("id", "i")
    for n, size, step in ((57, 20, 5), (57, 5, 5), (57, 3, 7), (19, 20, 5)):
        want = V.in_windows(rows, "i", [(k, 2 + a, 2 + b) for k, a, b in V.sliding(n, size, step)])
        count = max(0, (n - size) // step + 1)
        got = V.in_sliding(rows, "i", count, size, step, 2)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (n, size, step)
    assert V.in_sliding(rows, "i", 10**9, 20, 5).filter("i = 40").count() == 4  # windows are not listed


def test_exact_means_tie(spark):
    x = [0.1, 0.7, 1e6, 0.3, 1e-3, 12.34, 0.2]
    df = spark.createDataFrame([(k, v) for k in range(6) for v in (x if k % 2 else sorted(x))[k:] + (x if k % 2 else sorted(x))[:k]], "k int, x double")
    got = {r.m for r in df.groupBy("k").agg(M.exact_mean(F.col("x")).alias("m")).collect()}
    assert len(got) == 1 and abs(got.pop() - sum(x) / 7) < 1e-9
    odd = spark.createDataFrame([(1, float("inf")), (1, 2.0), (2, None), (3, 1e30), (3, 3e30)], "k int, x double")
    assert {r.k: r.m for r in odd.groupBy("k").agg(M.exact_mean(F.col("x")).alias("m")).collect()} == {1: float("inf"), 2: None, 3: 2e30}


def test_copies_of_a_user_are_nearest_at_distance_0(spark, tmp_path):
    from tidemark.plans import QUERIES

    rows = [(u, 0.1 * (u + 1) * (i * i % 11) + i % 3, i) for u in range(8) for i in range(25)]
    copies = [(u + 8 * r, v, (i * (2 * r + 3)) % 25) for r in range(4) for u, v, i in rows]
    df = spark.createDataFrame([(n, u, "view", v, '{"k": 1}', i) for n, (u, v, i) in enumerate(sorted(copies, key=lambda x: x[2]))], "event_id long, user_id long, event_type string, value double, props string, i int")
    df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).drop("i").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.nearest, r.distance) for r in QUERIES["D21_behaviour_archive"](spark, str(tmp_path)).collect()}
    twins = lambda u: sorted(x for x in got if x % 1000000 % 8 == u % 1000000 % 8 and x != u)
    assert len(got) > 32 and all(v == (twins(u)[0], 0.0) for u, v in got.items())
