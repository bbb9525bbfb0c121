"""Streaming operators over the events table, in the batch form that the streams must equal (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY, HOUR
from tidemark.functions.semantics import safe_div
from tidemark.plans.registry import EV, events, query
from tidemark.streaming import book as K
from tidemark.streaming import candles as C

c = F.col


def trades(spark, d):
    e = events(spark, d)
    return e.select("event_id", "user_id", c("event_id").alias("trade_id"), F.timestamp_millis("t").alias("ts"), "t", c("value").alias("price"), c("k").cast("double").alias("size"), F.when(c("event_type").isin("purchase", "signup"), "buy").otherwise("sell").alias("side"))


TR = f"{EV}, tr AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN k ELSE 0 END AS b, CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE k END AS s FROM ev)"


@query("T1_trade_buckets", f"WITH {TR} SELECT t // {HOUR} * {HOUR} AS start_ms, count(*) AS trades, sum(value * k) AS quote, sum(b) AS buy_volume, sum(s) AS sell_volume FROM tr GROUP BY ALL", l="start_ms trades", d="quote buy_volume sell_volume")
def _(spark, d):
    return C.trade_buckets(trades(spark, d), width="1 hour").withColumn("start_ms", F.unix_millis("start"))


@query("T3_candles", f"WITH {EV} SELECT t // {HOUR} * {HOUR} AS start_ms, arg_min(value, (t, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (t, event_id)) AS close, sum(k) AS volume, count(*) AS trades FROM ev GROUP BY ALL", l="start_ms trades", d="open high low close volume")
def _(spark, d):
    return C.candles(trades(spark, d), width="1 hour").withColumn("start_ms", F.unix_millis("start"))


@query("T13_sliding_windows", f"WITH {EV} SELECT (t // {HOUR} - o) * {HOUR} AS start_ms, count(*) AS n, avg(value) AS mean FROM ev, (SELECT unnest(range(0, 3)) AS o) GROUP BY ALL", l="start_ms n", d="mean")
def _(spark, d):
    return C.sliding(trades(spark, d), "ts", "3 hours", "1 hour", "1 day").withColumn("start_ms", F.unix_millis("start"))


@query("T13b_sessions", f"WITH {EV}, m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {6 * HOUR} THEN 0 ELSE 1 END AS nw FROM ev), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(t) AS start_ms, max(t) + {6 * HOUR} AS end_ms, count(*) AS n FROM g GROUP BY user_id, s", l="user_id start_ms end_ms n")
def _(spark, d):
    x = C.sessions(trades(spark, d), "ts", "6 hours", "1 day", ("user_id",))
    return x.withColumns({"start_ms": F.unix_millis("start"), "end_ms": F.unix_millis("end")})


@query("T10_matured_labels", f"WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), q AS (SELECT * FROM ev WHERE event_type = 'view') SELECT p.user_id, p.t AS decision_ms, q.t AS price_ms, q.value AS price FROM p JOIN q ON p.user_id = q.user_id AND q.t > p.t AND q.t <= p.t + {DAY}", l="user_id decision_ms price_ms", d="price")
def _(spark, d):
    e = events(spark, d)
    a = e.filter("event_type = 'purchase'").select("user_id", F.timestamp_millis("t").alias("decision_ts"))
    b = e.filter("event_type = 'view'").select("user_id", F.timestamp_millis("t").alias("price_ts"), c("value").alias("price"))
    out = C.matured(a, b, "user_id", "1 DAY", "2 days")
    return out.withColumns({"decision_ms": F.unix_millis("decision_ts"), "price_ms": F.unix_millis("price_ts")})


@query("T12_staleness", f"WITH {EV} SELECT user_id, 1706572800000 - max(t) AS age_ms, 1706572800000 - max(t) > {DAY} AS stale FROM ev GROUP BY user_id", l="user_id age_ms", b="stale")
def _(spark, d):
    return C.staleness(events(spark, d), ["user_id"], "t", 1706572800000, DAY)


def messages(spark, d):
    """A book message per event: every 40th is a snapshot, some updates are missing, some are old."""
    e = events(spark, d)
    level = lambda s: F.array(*[F.struct((100 + s * (c("k") % 7 + i + 1) * 0.05).alias("p"), F.when((c("event_id") + i) % 5 == 0, 0.0).otherwise(c("value") + i).alias("q")) for i in range(3)])
    final = c("event_id") * 2 + F.when(c("k") == 13, 50).otherwise(0)
    return e.select(c("event_type").alias("symbol"), c("event_id").alias("seq"), "t", F.when(c("event_id") % 40 < 5, "snapshot").otherwise("delta").alias("kind"), (final - 60).alias("first"), final.alias("final"), level(-1).alias("bids"), level(1).alias("asks"))


@query("T5_order_book_state", l="seq t", d="best_bid best_ask mid_price spread_percent bid_depth_10bps order_book_imbalance_25bps", s="symbol status")
def _(spark, d):
    return K.book_metrics(K.book_rows(messages(spark, d)))


@query("T6_book_metrics", f"WITH {EV}, b AS (SELECT event_id, value AS bq, k AS aq, 100 - k / 1000.0 AS bb, 100.05 + k / 1000.0 AS ba FROM ev) SELECT event_id, bb AS best_bid, ba AS best_ask, (bb + ba) / 2 AS mid_price, (ba - bb) / ((bb + ba) / 2) AS spread_percent, CASE WHEN bq + aq = 0 THEN 0 ELSE (bq - aq) / (bq + aq) END AS imbalance FROM b", l="event_id", d="best_bid best_ask mid_price spread_percent imbalance")
def _(spark, d):
    side = lambda p, q: F.array(F.struct(p.alias("p"), q.cast("double").alias("q")))
    rows = events(spark, d).select("event_id", side(100 - c("k") / 1000.0, c("value")).alias("bids"), side(100.05 + c("k") / 1000.0, c("k")).alias("asks"))
    m = K.book_metrics(rows)
    return m.withColumn("imbalance", safe_div(c("large_bid_wall_size") - c("large_ask_wall_size"), c("large_bid_wall_size") + c("large_ask_wall_size"), 0))


@query("T7_book_validation", f"WITH {EV} SELECT event_id FROM ev WHERE k % 3 <> 0", l="event_id")
def _(spark, d):
    rows = events(spark, d).select("event_id", F.lit(100.0).alias("best_bid"), F.when(c("k") % 3 == 0, 99.0).otherwise(101.0).alias("best_ask"))
    return K.valid_books(rows)
