"""The query registry. A query names its output columns by kind, for both engines alike:

l: whole numbers (long), d: doubles, rounded to 6 decimals, s: strings, b: booleans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import ntz_to_ms
from tidemark.operators.series import Series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS t FROM events)"
USER = Series(("user_id",), ("t", "event_id"))
TYPE = Series(("event_type",), ("t", "event_id"))
BY_USER, BY_TYPE = "PARTITION BY user_id ORDER BY t, event_id", "PARTITION BY event_type ORDER BY t, event_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, k and t (epoch ms)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), ntz_to_ms(F.col("ts")).alias("t"))


def early(df: DataFrame, share: float = 0.6, by: str = "event_id") -> Column:
    """Rows in the first `share` of the range of `by`: the training part, whatever the table's size."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    return F.col(by) < F.lit(None if low is None else low + share * (high - low)).cast("double")


def early_sql(source: str = "ev", share: float = 0.6, by: str = "event_id") -> str:
    """SQL of early."""
    return f"{by} < (SELECT min({by}) + {share}::DOUBLE * (max({by}) - min({by})) FROM {source})"


def rounded(x: Column, digits: int) -> Column:
    """x to some decimals as DuckDB rounds doubles: x * 10^digits to a whole number, halves away from 0; x itself where that is not finite."""
    scale = F.lit(10.0**digits)
    near = F.round(x * scale) / scale
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), x).otherwise(near)


def query(name: str, sql: str | None = None, l: str = "", d: str = "", s: str = "", b: str = "", digits: int = 6):  # noqa: E741
    """Register fn(spark, sf_dir) -> DataFrame; sql is wrapped so that both give the same columns."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            cols = [F.col(x).cast("long").alias(x) for x in l.split()] + [(rounded(F.col(x).cast("double"), digits) + 0.0).alias(x) for x in d.split()]
            return df.select(*cols, *[F.col(x).cast("string").alias(x) for x in s.split()], *[F.col(x).cast("boolean").alias(x) for x in b.split()])

        QUERIES[name] = run
        if sql is not None:
            cols = [f"CAST({x} AS BIGINT) AS {x}" for x in l.split()] + [f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {x}" for x in d.split()]
            cols += [f"CAST({x} AS VARCHAR) AS {x}" for x in s.split()] + [f"CAST({x} AS BOOLEAN) AS {x}" for x in b.split()]
            ORACLE_SQL[name] = f"SELECT {', '.join(cols)} FROM (\n{sql.strip()}\n) AS _q"
        return fn

    return register


def lbps(a: str, b: str) -> str:
    """SQL of log_bps."""
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN 1e4 * ln(({a}) / ({b})) END"


def roll(agg: str, x: str, n: int, by: str = BY_USER, least: int | None = None) -> str:
    """SQL of a full-window rolling aggregate; agg holds {x}."""
    w = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least or n} THEN {agg.format(x=x)} {w} END"


def ema_sql(name: str, source: str, alpha: str, x: str, key: str = "user_id") -> str:
    """A recursive CTE (key, i, y): the exponential mean of x over rows numbered i = 1, 2 ... by key."""
    return f"""{name} AS (SELECT {key}, i, CAST({x} AS DOUBLE) AS y FROM {source} WHERE i = 1
UNION ALL SELECT _r.{key}, _r.i, {alpha} * _r.{x} + (1 - {alpha}) * {name}.y FROM {name} JOIN {source} _r ON _r.{key} = {name}.{key} AND _r.i = {name}.i + 1)"""


def ridge_sql(source: str, features: list[str], target: str, where: str, penalty: float, n: str = "") -> str:
    """CTEs ending in ridge{n}(w0, w1 ..., b0): Cramer's rule on centred sums, for two or three features."""
    k = range(len(features))
    means = ", ".join([f"avg(CAST({f} AS DOUBLE)) AS m{i}" for i, f in enumerate(features)] + [f"avg({target}) AS my"])
    sums = [f"sum((CAST({features[i]} AS DOUBLE) - m{i}) * (CAST({features[j]} AS DOUBLE) - m{j})){f' + {penalty}' if i == j else ''} AS g{i}{j}" for i in k for j in k]
    sums += [f"sum((CAST({f} AS DOUBLE) - m{i}) * ({target} - my)) AS t{i}" for i, f in enumerate(features)]

    def det(a: list[list[str]]) -> str:
        if len(a) == 2:
            return f"({a[0][0]} * {a[1][1]} - {a[0][1]} * {a[1][0]})"
        minors = [det([[x for j, x in enumerate(row) if j != i] for row in a[1:]]) for i in range(len(a))]
        return "(" + " ".join(f"{'+' if i % 2 == 0 else '-'} {a[0][i]} * {minor}" for i, minor in enumerate(minors)) + ")"

    gram = [[f"g{i}{j}" for j in k] for i in k]
    weights = ", ".join(f"{det([[f't{i}' if j == x else gram[i][j] for j in k] for i in k])} / {det(gram)} AS w{x}" for x in k)
    return f"""rows_{n} AS (SELECT * FROM {source} WHERE {where}), means{n} AS (SELECT {means} FROM rows_{n}),
sums{n} AS (SELECT {", ".join(sums)}, {", ".join(f"any_value(m{i}) AS m{i}" for i in k)}, any_value(my) AS my FROM rows_{n}, means{n}),
solved{n} AS (SELECT *, {weights} FROM sums{n}), ridge{n} AS (SELECT *, my - {" - ".join(f"w{i} * m{i}" for i in k)} AS b0 FROM solved{n})"""
