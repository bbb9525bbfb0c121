"""Rolling quantiles and ranks against sorting every window."""

import random

import duckdb
import numpy as np
import pytest

from tidemark.operators.ranks import burst_threshold, rolling_order


def windows(values, n, before):
    for i in range(len(values)):
        part = values[max(0, i - n) : i] if before else values[max(0, i - n + 1) : i + 1]
        yield [v for v in part if v is not None]


@pytest.mark.parametrize(("batch", "n", "least", "before"), [("4", 7, None, False), ("1000", 7, 2, True), ("5", 1, 1, False), ("3", 50, 3, True)])
def test_against_sorted_windows(spark, batch, n, least, before):
    rng = random.Random(n)
    rows = [(k, i, 2**60 + i, None if rng.random() < 0.15 else float(rng.choice([1, 2, 2, 3, rng.gauss(0, 5)]))) for k in ("a", "b", None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i int, id long, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.i): r for r in rolling_order(df, ["k"], ["i"], n, {"q": ("x", 0.3)}, {"r": "x"}, least, before).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("a", "b", None):
        x = [r[3] for r in rows if r[0] == key]
        current = [None, *x][: len(x)] if before else x
        for i, part in enumerate(windows(x, n, before)):
            r = got[key, i]
            enough = len(part) >= (least or n)
            assert r.id == 2**60 + i and (np.isclose(r.q, np.quantile(part, 0.3)) if enough else r.q is None)
            v = current[i]
            want = (sum(a < v for a in part) + (sum(a == v for a in part) + 1) / 2) / len(part) if enough and v is not None else None
            assert r.r is None if want is None else np.isclose(r.r, want)


def test_burst_threshold(spark):
    x = [-1.0, 5.0, None, 2.0, 9.0, 1.0, -3.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = sorted(burst_threshold(df, ["k"], ["i"], "x", 3, 0.9).collect(), key=lambda r: r.i)
    for i, part in enumerate(windows(x, 3, True)):
        up = [v for v in part if v > 0]
        want = max([*([np.quantile(up, 0.9)] if up else []), *([np.median(part)] if part else [])], default=None)
        assert (got[i].threshold is None) == (want is None) and (want is None or np.isclose(got[i].threshold, want))
        assert got[i].burst == (want is not None and x[i] is not None and x[i] > want)
    # quantile_cont gives 7.4399999999999995 here, 7.2 + 0.8 * 0.3 gives 7.44
    near = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.2, 7.2, 7.5, 7.44])], "k string, i int, x double")
    sql = "SELECT quantile_cont(v, 0.9) FROM (VALUES (0.2::DOUBLE), (7.2), (7.5)) t(v)"
    last = burst_threshold(near, ["k"], ["i"], "x", 3, 0.9).filter("i = 3").first()
    assert last.threshold == duckdb.sql(sql).fetchall()[0][0] < 7.44 and last.burst
    assert burst_threshold(df.limit(0), ["k"], ["i"], "x", 3, 0.9).count() == 0
