"""The queries' decimals are those of DuckDB's round, also where x * 10^6 meets a half or the size of a double."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import ORACLE_SQL, QUERIES
from tidemark.plans.registry import rounded


def test_rounded(spark):
    x = [8.0046875, -8.0046875, 0.5, 2.5, -0.0000005, 1.0000005, 8206.4657715, 123456789.0000005, 1e300, -1e305, float("inf"), float("-inf"), None]
    for digits in (0, 5, 6, 9):
        got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", rounded(F.col("x"), digits).alias("y")).orderBy("i").collect()]
        assert got == [duckdb.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0] for v in x]
    assert str(spark.range(1).select(rounded(F.lit(float("nan")), 6).alias("y")).first().y) == "nan"


@pytest.mark.parametrize("name", ["P16_sentinel_returns"])
def test_halves(spark, tmp_path, name):
    con, path = duckdb.connect(), tmp_path / "events.parquet"
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, CAST(1 AS BIGINT) AS user_id, 'view' AS event_type, [6.4, 57.63, 0.0][1 + i % 3]::DOUBLE AS value, '{{"k": 1}}' AS props FROM range(30) r(i)) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]}) ORDER BY event_id").fetchall()
    assert (1, 8.004687) in want and sorted(map(tuple, df.collect())) == want
