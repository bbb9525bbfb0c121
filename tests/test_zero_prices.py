"""Queries on events with values of 0 against their SQL, whose divisions give infinities and NaN there."""

import math

import duckdb
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

NAMES = [
    "J13_realised_outcome",
    "L12_instability",
    "L4_path_range_frame",
    "L5_first_touch",
    "L6_net_aware_touch",
    "L7_touch_summary",
    "P15_clip_log_sign",
    "S_math",
    "P16_sentinel_returns",
    "W1_lag_returns",
    "J12_forward_max_gap",
    "L13_event_labels",
    "SRC6_trade_normalisation",
    "W24_changes",
    "W26_micro_bundle",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zero"))
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 11) MINUTE AS ts, CAST(i % 3 AS BIGINT) AS user_id, ['view', 'purchase', 'click', 'signup'][1 + i // 3 % 4] AS event_type,
        [0.0, 0.0, 5.5, 0.0, 20.0, 90.25, 1.0][1 + i * i % 7] * (i % 4) AS value, '{{"k": ' || i * 37 % 100 || '}}' AS props FROM range(600) r(i)) TO '{path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return path, con


def key(row):
    return tuple((x is None, str(x) if isinstance(x, str) else 0.0 if x is None or x != x else x) for x in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or math.isfinite(a) and math.isfinite(b) and abs(a - b) <= 2e-6 * max(1, abs(b))
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_zero(spark, tables, name):
    path, con = tables
    df = QUERIES[name](spark, path)
    got = df.collect()
    cur = con.execute(ORACLE_SQL[name])
    at = [[x[0] for x in cur.description].index(x) for x in df.columns]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.parametrize("name", ["L4_path_range_frame", "L6_net_aware_touch", "L7_touch_summary", "J12_forward_max_gap"])
def test_missing_prices_and_users(spark, tables, tmp_path, name):
    con = tables[1].cursor()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 13 <> 1 THEN value END AS value, CASE WHEN event_id % 50 < 44 THEN user_id END AS user_id) FROM '{tables[0]}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    df = QUERIES[name](spark, str(tmp_path))
    got = df.collect()
    want = con.execute(f"WITH events AS (FROM '{tmp_path}/events.parquet') SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert all(map(same, a, b)), (a, b)
