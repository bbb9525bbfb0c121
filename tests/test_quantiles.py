"""Exact quantiles without one aggregate of all values, and the tertiles made of them."""

import math

import duckdb
import numpy as np
import pytest

from tests.test_zero_prices import key, same
from tidemark.functions.semantics import fused
from tidemark.operators import metrics as M
from tidemark.plans import ORACLE_SQL, QUERIES

ROWS = """SELECT CASE WHEN i % 7 < 3 THEN 'a' WHEN i % 7 < 5 THEN 'b' WHEN i % 7 = 5 THEN NULL ELSE 'c' || i END AS g,
    CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 4 AND i % 5 = 0 THEN 'NaN'::DOUBLE WHEN i % 97 = 1 THEN '-Infinity'::DOUBLE WHEN i % 3 = 0 THEN i % 20 ELSE hash(i) % 1000003 / 7 END AS v FROM range({n}) r(i)"""


@pytest.mark.parametrize("margin", [0.002, 0.2, 0.9])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_are_exact(spark, tmp_path, keys, margin):
    con, qs = duckdb.connect(), [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    con.execute(f"COPY ({ROWS.format(n=4000)}) TO '{tmp_path}/v.parquet' (FORMAT parquet)")
    out = M.exact_quantiles(spark.read.parquet(f"{tmp_path}/v.parquet"), keys, "v", qs, margin=margin)
    got = [(*(r[k] for k in keys), *r["_q"]) for r in out.collect()]
    by = ", ".join(keys)
    want = con.execute(f"SELECT {by + ', ' if keys else ''}{', '.join(f'quantile_cont(v, {q!r})' for q in qs)} FROM '{tmp_path}/v.parquet' WHERE v IS NOT NULL {'GROUP BY ' + by if keys else ''}").fetchall()
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(map(same, a, b)), (a, b)


def test_no_values_no_quantiles(spark):
    none = spark.createDataFrame([(1, None)], "i int, v double")
    assert [r["_q"] for r in M.exact_quantiles(none, [], "v", [0.5]).collect()] == [[None]]
    assert [r.bucket for r in M.tertile(none, [], "v").collect()] == ["unknown"]


def test_tertiles_gather_no_values_in_an_aggregate(spark):
    rows = spark.range(100).selectExpr("id", "id * 1.5D AS v")
    plan = M.tertile(rows, [], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


@pytest.mark.parametrize("name", ["L21_downside_ordinal", "A50_tertile_regime"])
def test_flat_prices(spark, tmp_path, name):
    """A volatility of 0 gives infinities and NaN, which the tertiles count as values."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 11) MINUTE AS ts, CAST(i % 3 AS BIGINT) AS user_id, ['view', 'click'][1 + i // 3 % 2] AS event_type,
        CASE WHEN i % 3 = 0 AND i % 120 < 90 THEN 7.0 ELSE 1 + hash(i) % 1009 / 10 END AS value, '{{"k": ' || i * 37 % 100 || '}}' AS props FROM range(900) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    got, cur = df.collect(), con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})")
    want = cur.fetchall()
    assert len(got) == len(want) == 900
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert all(map(same, a, b)), (a, b)


def test_equal_neighbours_are_their_own_quantile(spark, tmp_path):
    """Copies of a table make neighbours equal; 54.57 * (1 - s) + 54.57 * s can give 54.57000000000001, and rows of 54.57 change sides."""
    con, path = duckdb.connect(), tmp_path / "events.parquet"
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 60) MINUTE AS ts, CAST(i % 3 AS BIGINT) AS user_id, ['view', 'click', 'error'][1 + i // 60 % 3] AS event_type,
        round(exp(hash(i // 60) % 1000003 / 200000), 2) AS value, '{{"k": 1}}' AS props FROM range(3600 * 5) r(i)) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    for name in ("A50_tertile_regime", "W29_burst_threshold"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect()), key=key) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=key)


def test_interpolation_rounds_once():
    rng = np.random.default_rng(1)
    a, b, s = np.round(rng.exponential(50, 20_000), 2), np.round(rng.normal(0, 50, 20_000), 2), rng.random(20_000)
    assert fused(a, 1 - s, b * s).tolist() == [math.fma(x, y, z) for x, y, z in zip(a, 1 - s, b * s)]
    assert (fused(a, 1 - s, a * s) == [math.fma(x, y, z) for x, y, z in zip(a, 1 - s, a * s)]).all()
