"""Buckets, bars, roll-ups, spines, flow (A1-A8, A34, A42, A44, U7) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY, HOUR
from tidemark.functions.semantics import log_bps, pct_change
from tidemark.operators import buckets as B
from tidemark.operators import labels as L
from tidemark.operators.series import Series
from tidemark.operators.splits import chronological
from tidemark.plans.registry import EV, events, lbps, query

BARS = f"""{EV}, bars AS (SELECT event_type, t // {HOUR} * {HOUR} AS bucket, arg_min(value, (t, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (t, event_id)) AS close, sum(k) AS volume, count(*) AS trades, min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY ALL)"""
DENSE = f"""{EV}, b AS (SELECT event_type, t // {HOUR} * {HOUR} AS bucket, arg_max(value, (t, event_id)) AS price FROM ev GROUP BY ALL),
sp AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 1, {HOUR})) AS bucket FROM b GROUP BY event_type),
dense AS (SELECT sp.event_type, sp.bucket, CASE WHEN b.price IS NULL THEN 0 ELSE 1 END AS observed, last_value(b.price IGNORE NULLS) OVER (PARTITION BY sp.event_type ORDER BY sp.bucket) AS price
 FROM sp LEFT JOIN b ON b.event_type = sp.event_type AND b.bucket = sp.bucket),
ret AS (SELECT *, coalesce({lbps('price', 'lag(price) OVER (PARTITION BY event_type ORDER BY bucket)')}, 0.0) AS return_bps FROM dense)"""
S = Series(("event_type",), ("bucket",))


def hourly(spark, sf_dir):
    return B.ohlcv(events(spark, sf_dir), ["event_type"], HOUR, "t", "value", "k", "event_id")


def dense(spark, sf_dir):
    last = B.last_per_bucket(events(spark, sf_dir), ["event_type"], HOUR, "t", ["value"], "event_id").withColumnRenamed("value", "price")
    return B.gap_filled(last, ["event_type"], HOUR)


@query("A2_ohlcv_bars", f"WITH {BARS} SELECT * FROM bars", l="bucket trades first_t last_t volume", d="open high low close", s="event_type")
def _(spark, d):
    return hourly(spark, d)


@query("A1_gap_filled_buckets", f"WITH {DENSE} SELECT * FROM ret", l="bucket observed", d="price return_bps", s="event_type")
def _(spark, d):
    return dense(spark, d)


@query("A3_snapshot_candles", f"WITH {EV} SELECT user_id, t // {DAY} * {DAY} AS bucket, arg_min(value, (t, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (t, event_id)) AS close, count(*) AS trades FROM ev GROUP BY ALL", l="user_id bucket trades", d="open high low close")
def _(spark, d):
    return B.ohlcv(events(spark, d), ["user_id"], DAY, "t", "value", "k", "event_id")


ROLL = f"""WITH {BARS}, up AS (SELECT event_type, bucket // (4 * {HOUR}) * (4 * {HOUR}) AS up, arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low, arg_max(close, bucket) AS close, sum(volume) AS volume, count(*) AS n,
 list_sort(list(bucket)) AS bs FROM bars GROUP BY ALL)
SELECT *, up + 4 * {HOUR} AS close_t FROM up WHERE n = 4"""


@query("A4_complete_roll_up", ROLL, l="up n close_t volume", d="open high low close", s="event_type")
def _(spark, d):
    return B.roll_up(hourly(spark, d), ["event_type"], HOUR, 4 * HOUR)


@query("A44_contiguous_roll_up", ROLL + f" AND bs = range(up, up + 4 * {HOUR}, {HOUR})", l="up n close_t volume", d="open high low close", s="event_type")
def _(spark, d):
    return B.roll_up(hourly(spark, d), ["event_type"], HOUR, 4 * HOUR, contiguous=True)


@query("A42_completed_intervals", f"WITH {BARS}, up AS (SELECT event_type, bucket // (4 * {HOUR}) AS up FROM bars GROUP BY ALL HAVING count(*) = 4) SELECT event_type, count(*) AS completed FROM up GROUP BY ALL", l="completed", s="event_type")
def _(spark, d):
    return B.roll_up(hourly(spark, d), ["event_type"], HOUR, 4 * HOUR).groupBy("event_type").agg(F.count("*").alias("completed"))


FLOW = f"""WITH {EV}, tr AS (SELECT *, t // {DAY} * {DAY} AS bucket, event_type IN ('purchase', 'signup') AS buy FROM ev),
r AS (SELECT *, {lbps('value', 'lag(value) OVER (PARTITION BY user_id, bucket ORDER BY t, event_id)')} AS ret FROM tr),
g AS (SELECT user_id, bucket, count(*) AS trades, count(*) FILTER (buy) AS buys, coalesce(sum(k) FILTER (buy), 0) AS buy_volume, coalesce(sum(k) FILTER (NOT buy), 0) AS sell_volume,
 coalesce(sum(value * k) FILTER (buy), 0) AS buy_quote, coalesce(sum(value * k) FILTER (NOT buy), 0) AS sell_quote, sum(value * k) AS quote, max(value) AS high, min(value) AS low, avg(k) AS mean_size, quantile_cont(k, 0.5) AS median_size, max(k) AS max_size,
 coalesce(stddev_pop(ret), 0.0) AS realized_bps FROM r GROUP BY ALL)
SELECT *, buy_volume - sell_volume AS signed_volume, CASE WHEN buy_volume + sell_volume = 0 THEN 0 ELSE (buy_volume - sell_volume) / (buy_volume + sell_volume)::DOUBLE END AS imbalance,
 CASE WHEN buy_volume + sell_volume > 0 THEN quote / (buy_volume + sell_volume) END AS vwap, {lbps('high', 'low')} AS range_bps FROM g"""


@query("A5_trade_flow", FLOW, l="user_id bucket trades buys", d="buy_volume sell_volume buy_quote sell_quote mean_size median_size max_size signed_volume imbalance vwap range_bps")
def _(spark, d):
    e = events(spark, d).withColumn("k", F.col("k").cast("double"))
    return B.trade_flow(e, ["user_id"], DAY, "t", "value", "k", F.col("event_type").isin("purchase", "signup"), "event_id")


@query("A6_realized_volatility", FLOW, l="user_id bucket trades", d="realized_bps")
def _(spark, d):
    e = events(spark, d).withColumn("k", F.col("k").cast("double"))
    return B.trade_flow(e, ["user_id"], DAY, "t", "value", "k", F.col("event_type").isin("purchase", "signup"), "event_id")


@query("A7_large_trades", f"""WITH {EV}, q AS (SELECT *, t // {HOUR} * {HOUR} AS bucket, value * k AS q FROM ev), m AS (SELECT event_type, bucket, max(q) AS top FROM q GROUP BY ALL),
th AS (SELECT event_type, bucket, CASE WHEN count(top) OVER w >= 2 THEN quantile_cont(top, 0.95) OVER w END AS threshold FROM m WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT q.event_type, q.bucket, max(threshold) AS threshold, count(*) FILTER (q >= threshold) AS large_trades, coalesce(sum(q) FILTER (q >= threshold), 0) AS large_quote FROM q JOIN th USING (event_type, bucket) GROUP BY ALL""", l="bucket large_trades", d="threshold large_quote", s="event_type")  # fmt: skip
def _(spark, d):
    return B.large_trades(events(spark, d), ["event_type"], HOUR, "t", F.col("value") * F.col("k"), 24)


@query("A8_metric_summary", f"""WITH {EV} SELECT event_type, t // {HOUR} * {HOUR} AS bucket, avg(value) AS value_mean, min(value) AS value_min, max(value) AS value_max, arg_max(value, (t, event_id)) AS value_last, arg_max(value, (t, event_id)) - arg_min(value, (t, event_id)) AS value_change,
 avg(k) AS k_mean, arg_max(k, (t, event_id)) - arg_min(k, (t, event_id)) AS k_change FROM ev GROUP BY ALL""", l="bucket", d="value_mean value_min value_max value_last value_change k_mean k_change", s="event_type")  # fmt: skip
def _(spark, d):
    return B.metric_summary(events(spark, d), ["event_type"], HOUR, "t", ["value", "k"], "event_id")


@query("A34_daily_quote_volume", f"WITH {EV} SELECT event_type, t // {DAY} AS day, sum(CASE WHEN value > 5 THEN value * k END) AS quote FROM ev GROUP BY ALL", l="day", d="quote", s="event_type")
def _(spark, d):
    return events(spark, d).groupBy("event_type", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum(F.when(F.col("value") > 5, F.col("value") * F.col("k"))).alias("quote"))


@query("U7_bucket_spine", f"WITH {DENSE} SELECT event_type, count(*) AS n, sum(1 - observed) AS filled FROM dense GROUP BY ALL", l="n filled", s="event_type")
def _(spark, d):
    return dense(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(1 - F.col("observed")).alias("filled"))


FLAG = f"""WITH {DENSE}, x AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n,
 CASE WHEN count(return_bps) OVER w = 24 THEN avg(return_bps) OVER w END AS mean_24, CASE WHEN count(return_bps) OVER w = 24 THEN stddev_pop(return_bps) OVER w END AS std_24,
 CASE WHEN count(price) OVER f = 3 THEN greatest(0.0, {lbps('max(price) OVER f', 'price')}) END AS mfe_3, CASE WHEN count(price) OVER f = 3 THEN least(0.0, {lbps('min(price) OVER f', 'price')}) END AS mae_3
 FROM ret WINDOW o AS (PARTITION BY event_type ORDER BY bucket), w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'holdout' END AS split FROM x"""


@query("flagship_feature_label_table", FLAG, l="bucket observed", d="price return_bps mean_24 std_24 mfe_3 mae_3", s="event_type split")
def flagship(spark, d):
    """Buckets, gap fill, returns, rolling statistics, future excursions and a chronological split."""
    x = dense(spark, d)
    mfe, mae = L.excursions(S, F.col("price"), F.col("price"), F.col("price"), 3)
    x = x.withColumns({"i": F.row_number().over(S.spec) - 1, "mean_24": S.mean(F.col("return_bps"), 24), "std_24": S.std(F.col("return_bps"), 24), "mfe_3": mfe, "mae_3": mae, "n": F.count("*").over(S.all())})
    return x.withColumn("split", chronological(F.col("i"), F.col("n")))


@query("W1_lag_returns", f"WITH {DENSE} SELECT event_type, bucket, price - lag(price, 3) OVER o AS diff_3, {lbps('price', 'lag(price, 3) OVER o')} AS return_3, price / lag(price) OVER o - 1 AS change FROM ret WINDOW o AS (PARTITION BY event_type ORDER BY bucket)", l="bucket", d="diff_3 return_3 change", s="event_type")
def _(spark, d):
    p = F.col("price")
    return dense(spark, d).withColumns({"diff_3": S.diff(p, 3), "return_3": log_bps(p, S.lag(p, 3)), "change": pct_change(p, S.lag(p))})
