"""Joins, as-of joins, sets, reshapes, cleaning projections (J*, U*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY, HOUR
from tidemark.functions.semantics import all_of, finite, log_ratio, normal_side, pct_change, side_sign, simple_bps, to_number
from tidemark.operators import asof as A
from tidemark.operators import clean as C
from tidemark.operators import flow as X
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators.series import Series
from tidemark.plans.bars import BARS, hourly
from tidemark.plans.features import barq, ev
from tidemark.plans.registry import BY_USER, EV, USER, events, query, table

c = F.col


def val():
    return F.col("value")

SIDES = f"{EV}, l AS (SELECT user_id, event_id, t, value FROM ev WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS rid, t AS rt, value AS rv FROM ev WHERE event_type = 'view')"


def sides(spark, d):
    e = events(spark, d)
    right = e.filter("event_type = 'view'").select("user_id", c("event_id").alias("rid"), "t", c("value").alias("rv"))
    return e.filter("event_type = 'purchase'").select("user_id", "event_id", "t", "value"), right


BACK = "SELECT l.*, rid, rv, rt, t - rt AS age FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt"


@query("J9_asof_backward", f"WITH {SIDES} {BACK}", l="event_id rid age", d="rv")
def _(spark, d):
    a, b = sides(spark, d)
    return A.asof(a, b, ["user_id"], "t", ["rid", "rv"], prefix="").select("event_id", "rid", "rv", "age")


@query("J7_asof_with_gate", f"WITH {SIDES}, m AS ({BACK}) SELECT event_id, CASE WHEN age <= {DAY} THEN rv ELSE 0.0 END AS rv, CASE WHEN age <= {DAY} THEN age ELSE -1 END AS age, CASE WHEN age <= {DAY} THEN 1 ELSE 0 END AS available FROM m", l="event_id age available", d="rv")
def _(spark, d):
    a, b = sides(spark, d)
    return A.with_context(a, b, ["user_id"], "t", ["rv"], DAY, prefix="c_").withColumnsRenamed({"c_rv": "rv", "c_age": "age", "c_available": "available"})


NEAR = """bk AS (SELECT l.event_id, l.t, r.rid AS bi, r.rt AS bt, r.rv AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt), fw AS (SELECT l.event_id, r.rid AS fi, r.rt AS ft, r.rv AS fv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.rt),
nr AS (SELECT event_id, t, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fi ELSE bi END AS rid, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft - t ELSE t - bt END AS age, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fv ELSE bv END AS rv FROM bk JOIN fw USING (event_id))"""


@query("J8_asof_nearest", f"WITH {SIDES}, {NEAR} SELECT event_id, CASE WHEN age <= {2 * DAY} THEN rid END AS rid, CASE WHEN age <= {2 * DAY} THEN age END AS age, CASE WHEN age <= {2 * DAY} THEN rv END AS rv FROM nr", l="event_id rid age", d="rv")
def _(spark, d):
    a, b = sides(spark, d)
    return A.asof(a, b, ["user_id"], "t", ["rid", "rv"], "nearest", prefix="", max_age=2 * DAY)


@query("J10_stale_priors", f"WITH {SIDES}, m AS ({BACK}) SELECT event_id, CASE WHEN age <= {DAY} THEN least(rv / 100, 1.0) ELSE 1 / 3 END AS p FROM m", l="event_id", d="p")
def _(spark, d):
    a, b = sides(spark, d)
    out = A.asof(a, b, ["user_id"], "t", ["rv"], max_age=DAY)
    return out.withColumn("p", F.when(c("ctx_t").isNotNull(), F.least(c("ctx_rv") / 100, F.lit(1.0))).otherwise(1 / 3)).select("event_id", "p")


@query("J11_layered_contexts", f"WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), a AS (SELECT user_id, t, value FROM ev WHERE event_type = 'view'), b AS (SELECT user_id, t, value FROM ev WHERE event_type = 'error'), x AS (SELECT l.event_id, l.user_id, l.t, CASE WHEN l.t - a.t <= {DAY} THEN a.value ELSE 0.0 END AS near_value FROM l ASOF LEFT JOIN a ON l.user_id = a.user_id AND l.t >= a.t) SELECT x.event_id, near_value, CASE WHEN x.t - b.t <= {5 * DAY} THEN b.value ELSE 0.0 END AS far_value FROM x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.t >= b.t", l="event_id", d="near_value far_value")
def _(spark, d):
    e = events(spark, d)
    pick = lambda k: e.filter(c("event_type") == k).select("user_id", "t", "value")
    return A.layered(e.filter("event_type = 'purchase'"), {"near": (pick("view"), ["value"], DAY), "far": (pick("error"), ["value"], 5 * DAY)}, ["user_id"], "t")


FWD = f"WITH {EV}, q AS (SELECT *, t + {DAY} AS want FROM ev), m AS (SELECT q.user_id, q.event_id, q.t, q.value, CASE WHEN e.t - q.want <= {DAY} THEN e.value END AS exit_value, CASE WHEN e.t - q.want <= {DAY} THEN e.t END AS exit_t FROM q ASOF LEFT JOIN ev e ON q.user_id = e.user_id AND q.want <= e.t)"


@query("J12_forward_max_gap", FWD + " SELECT *, (exit_value / value - 1) * 1e4 AS forward_bps FROM m", l="event_id exit_t", d="exit_value forward_bps")
def _(spark, d):
    return A.forward_return(events(spark, d), ["user_id"], "t", "value", DAY, DAY)


@query("J13_realised_outcome", FWD + f", w AS (SELECT event_id, max(value) OVER f AS hi, min(value) OVER f AS lo FROM ev WINDOW f AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING)) SELECT event_id, (exit_value / value - 1) * 1e4 - 4.0 AS net_bps, (hi / value - 1) * 1e4 AS best_bps, (lo / value - 1) * 1e4 AS worst_bps FROM m JOIN w USING (event_id)", l="event_id", d="net_bps best_bps worst_bps")
def _(spark, d):
    w = Series(("user_id",), ("t",)).future_ms(DAY)
    e = events(spark, d).withColumns({"hi": F.max("value").over(w), "lo": F.min("value").over(w)})
    e = A.forward_return(e, ["user_id"], "t", "value", DAY, DAY)
    return e.withColumns({"net_bps": c("forward_bps") - 4.0, "best_bps": simple_bps(c("hi"), val()), "worst_bps": simple_bps(c("lo"), val())})


J14 = f"""WITH {EV}, p AS (SELECT event_id, user_id, t + {HOUR} AS want FROM ev WHERE event_type = 'purchase'),
b AS (SELECT p.event_id, e.t AS before_t, e.value AS before FROM p ASOF LEFT JOIN (SELECT user_id, t, arg_max(value, event_id) AS value FROM ev GROUP BY ALL) e ON p.user_id = e.user_id AND p.want >= e.t),
a AS (SELECT p.event_id, e.t AS after_t, e.value AS after FROM p ASOF LEFT JOIN (SELECT user_id, t, arg_max(value, event_id) AS value FROM ev GROUP BY ALL) e ON p.user_id = e.user_id AND p.want <= e.t)
SELECT * FROM b JOIN a USING (event_id)"""


@query("J14_point_lookup", J14, l="event_id before_t after_t", d="before after")
def _(spark, d):
    """The row at or before, and the one at or after, a point in time."""
    e = events(spark, d)
    points = e.filter("event_type = 'purchase'").select("event_id", "user_id", (c("t") + HOUR).alias("want"))
    out = A.asof(points, e, ["user_id"], "want", ["value"], "backward", "b_", right_time="t", right_seq="event_id")
    out = A.asof(out, e, ["user_id"], "want", ["value"], "forward", "a_", right_time="t", right_seq="event_id")
    return out.select("event_id", c("b_t").alias("before_t"), c("b_value").alias("before"), c("a_t").alias("after_t"), c("a_value").alias("after"))


@query("J15_distance_diagnostics", f"WITH {SIDES}, {NEAR} SELECT quantile_cont(age, 0.5) AS median, quantile_cont(age, 0.95) AS p95, count(*) FILTER (age <= {HOUR}) AS in_hour, count(*) FILTER (age <= {DAY}) AS in_day, count(*) AS n FROM nr", l="in_hour in_day n", d="median p95", digits=3)
def _(spark, d):
    a, b = sides(spark, d)
    x = A.asof(a, b, ["user_id"], "t", ["rid"], "nearest")
    return x.agg(F.percentile("ctx_age", 0.5).alias("median"), F.percentile("ctx_age", 0.95).alias("p95"), F.count_if(c("ctx_age") <= HOUR).alias("in_hour"), F.count_if(c("ctx_age") <= DAY).alias("in_day"), F.count("*").alias("n"))


@query("J16_previous_next_event", f"WITH {SIDES}, p AS (SELECT l.event_id, l.user_id, l.t, l.t - r.rt AS since FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt), n AS (SELECT l.event_id, r.rt - l.t AS until FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.rt) SELECT event_id, since, until, coalesce(since <= {DAY}, FALSE) OR coalesce(until <= {DAY}, FALSE) AS near_event FROM p JOIN n USING (event_id)", l="event_id since until", b="near_event")
def _(spark, d):
    a, b = sides(spark, d)
    x = A.asof(a, b, ["user_id"], "t", ["rid"], "backward", "p_")
    x = A.asof(x, b, ["user_id"], "t", ["rid"], "forward", "n_")
    near = F.coalesce(c("p_age") <= DAY, F.lit(False)) | F.coalesce(c("n_age") <= DAY, F.lit(False))
    return x.select("event_id", c("p_age").alias("since"), c("n_age").alias("until"), near.alias("near_event"))


barq("J17_exact_grid", f"SELECT *, CASE WHEN count(close) OVER w = 3 THEN last_value(close) OVER w END AS grid_value, (CASE WHEN count(close) OVER w = 3 THEN last_value(close) OVER w END / close - 1) * 1e4 AS grid_bps FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 1 FOLLOWING AND {3 * HOUR} FOLLOWING)", lambda b: X.exact_grid(b, Series(("event_type",), ("bucket",)), "close", HOUR, 3), d="grid_value grid_bps")


@query("J18_align_venues", f"WITH {EV}, a AS (SELECT *, (t + {HOUR // 2}) // {HOUR} * {HOUR} AS aligned FROM ev) SELECT aligned, arg_max(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'click' THEN (t, event_id) END) AS click, arg_max(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'view' THEN (t, event_id) END) AS view FROM a GROUP BY aligned".replace("AS click", "AS v_click").replace("AS view", "AS v_view"), l="aligned", d="v_click v_view")
def _(spark, d):
    return X.align_venues(events(spark, d), "t", "event_type", "value", ["click", "view"], HOUR, "event_id").withColumnsRenamed({"click": "v_click", "view": "v_view"})


def models(spark, d):
    b = hourly(spark, d)
    return [b.filter(c("event_type") == k).select("bucket", c("close").alias(f"m_{k}")) for k in ("click", "error", "view")]


M3 = ", ".join(f"m_{k} AS (SELECT bucket, close AS m_{k} FROM bars WHERE event_type = '{k}')" for k in ("click", "error", "view"))


@query("J1_inner_join_models", f"WITH {BARS}, {M3} SELECT * FROM m_click JOIN m_error USING (bucket) JOIN m_view USING (bucket)", l="bucket", d="m_click m_error m_view")
def _(spark, d):
    return J.inner_all(models(spark, d), ["bucket"])


@query("J2_left_join_flag", f"WITH {BARS}, {M3} SELECT m_click.bucket, m_click, m_error, CASE WHEN m_error.bucket IS NULL THEN 0 ELSE 1 END AS joined FROM m_click LEFT JOIN m_error ON m_click.bucket = m_error.bucket", l="bucket joined", d="m_click m_error")
def _(spark, d):
    a, b, _ = models(spark, d)
    return J.left_with_flag(a, b, ["bucket"], "joined")


@query("J4_composite_left_joins", "SELECT l_orderkey, l_linenumber, l_extendedprice, o_totalprice, c_acctbal, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey", l="l_orderkey l_linenumber", d="l_extendedprice o_totalprice c_acctbal", s="n_name")
def _(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    orders, customer = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    x = line.join(orders, line["l_orderkey"] == orders["o_orderkey"], "left").join(customer, c("o_custkey") == c("c_custkey"), "left")
    return x.join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"), "left")


@query("J5_replay_comparison", f"WITH {BARS}, alt AS (SELECT event_type, t // {HOUR} * {HOUR} AS bucket, avg(value) AS mean FROM ev GROUP BY ALL) SELECT a.event_type, a.bucket, a.close AS recorded, b.mean AS replayed, a.close - b.mean AS difference FROM bars a JOIN alt b USING (event_type, bucket)", l="bucket", d="recorded replayed difference", s="event_type")
def _(spark, d):
    e = events(spark, d)
    alt = e.groupBy("event_type", (F.floor(c("t") / HOUR) * HOUR).alias("bucket")).agg(F.avg("value").alias("replayed"))
    return hourly(spark, d).withColumnRenamed("close", "recorded").join(alt, ["event_type", "bucket"]).withColumn("difference", c("recorded") - c("replayed"))


@query("J6_map_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", l="s_suppkey", s="n_name r_name")
def _(spark, d):
    x = J.map_lookup(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(spark, d, "nation"), "n_nationkey")
    return J.map_lookup(x.withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), "r_regionkey")


ev("J19_anti_join_seen", "SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev s WHERE s.event_type = 'error' AND s.user_id = ev.user_id AND s.k = ev.k)", lambda e: J.unseen(e, e.filter("event_type = 'error'").select(c("user_id"), c("k")).distinct(), ["user_id", "k"]), l="user_id event_id")
barq("J20_scored_by_all", "SELECT * FROM bars WHERE bucket IN (SELECT bucket FROM bars GROUP BY bucket HAVING count(DISTINCT event_type) = 5)", lambda b: J.scored_by_all(b, "bucket", "event_type", 5), d="close")


@query("J21_key_overlap", f"WITH {EV} SELECT count(DISTINCT a.user_id) AS left_keys, count(DISTINCT b.user_id) AS right_keys, count(DISTINCT CASE WHEN a.user_id = b.user_id THEN a.user_id END) AS shared FROM (SELECT DISTINCT user_id FROM ev WHERE k < 3) a FULL JOIN (SELECT DISTINCT user_id FROM ev WHERE k > 96) b ON a.user_id = b.user_id", l="left_keys right_keys shared")
def _(spark, d):
    e = events(spark, d)
    return J.overlap(e.filter("k < 3"), e.filter("k > 96"), "user_id")


J22 = f"""WITH {EV}, p AS (SELECT user_id, max(t) AS passed FROM ev GROUP BY ALL), m AS (SELECT e.*, passed, arg_max(value, t) OVER (PARTITION BY e.user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING) AS ex FROM ev e JOIN p USING (user_id))
SELECT event_id, coalesce(CASE WHEN k % 4 = 0 THEN -1.0 END, CASE WHEN passed >= t + {DAY} THEN ex END) AS outcome FROM m"""


@query("J22_matured_fill", J22, l="event_id", d="outcome")
def _(spark, d):
    e = events(spark, d)
    return J.fill_matured(e.withColumn("outcome", F.when(c("k") % 4 == 0, -1.0)), e, ["user_id"], "t", "value", DAY, "outcome")


@query("J23_matched_pairs", f"WITH {EV}, g AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS left_value, max(CASE WHEN event_type = 'view' THEN value END) AS right_value FROM ev GROUP BY user_id) SELECT *, right_value - left_value AS delta FROM g WHERE left_value IS NOT NULL AND right_value IS NOT NULL", l="user_id", d="left_value right_value delta")
def _(spark, d):
    return J.matched_pairs(events(spark, d), ["user_id"], "event_type", "click", "view", "value")


@query("J24_span_overlap", f"WITH {EV}, g AS (SELECT min(t) FILTER (event_type = 'click') AS a0, max(t) FILTER (event_type = 'click') AS a1, min(t) FILTER (event_type = 'view') AS b0, max(t) FILTER (event_type = 'view') AS b1 FROM ev) SELECT greatest(a0, b0) AS s0, least(a1, b1) AS e0, greatest(0, (least(a1, b1) - greatest(a0, b0)) // {HOUR} + 1) AS expected_rows FROM g", l="s0 e0 expected_rows")
def _(spark, d):
    return J.span_overlap(events(spark, d), "event_type", "t", "click", "view", HOUR).withColumnsRenamed({"start": "s0", "end": "e0"})


@query("J3_spine_join", f"WITH {BARS}, sp AS (SELECT unnest(range(min(bucket), max(bucket) + 1, {HOUR})) AS bucket FROM bars) SELECT sp.bucket, count(b.bucket) AS venues, coalesce(sum(b.trades), 0) AS trades FROM sp LEFT JOIN bars b ON sp.bucket = b.bucket GROUP BY sp.bucket", l="bucket venues trades")
def _(spark, d):
    b = hourly(spark, d)
    span = b.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).select(F.explode(F.sequence("a", "z", F.lit(HOUR).cast("long"))).alias("bucket"))
    return span.join(b, "bucket", "left").groupBy("bucket").agg(F.count("event_type").alias("venues"), F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"))


@query("U1_union_all", f"WITH {EV} SELECT event_id, value, NULL AS k FROM ev WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, k FROM ev WHERE event_type = 'view'", l="event_id k", d="value")
def _(spark, d):
    e = events(spark, d)
    return J.union_all([e.filter("event_type = 'click'").select("event_id", "value"), e.filter("event_type = 'view'").select("event_id", "k")])


@query("U2_shifted_union", f"WITH {EV}, s AS (SELECT event_type, min(t) AS a, max(t) - min(t) + 60000 AS n FROM ev GROUP BY ALL), o AS (SELECT event_type, a, coalesce(sum(n) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s) SELECT event_id, t - a + off AS shifted_t FROM ev JOIN o USING (event_type)", l="event_id shifted_t")
def _(spark, d):
    return J.shifted_union(events(spark, d), "event_type", "t", 60_000)


@query("U4_key_difference", f"WITH {EV} SELECT user_id, k FROM ev WHERE event_type = 'click' EXCEPT SELECT user_id, k FROM ev WHERE event_type = 'view'", l="user_id k")
def _(spark, d):
    e = events(spark, d)
    return e.filter("event_type = 'click'").select("user_id", "k").subtract(e.filter("event_type = 'view'").select("user_id", "k"))


@query("U4b_key_intersection", f"WITH {EV} SELECT user_id, k FROM ev WHERE event_type = 'click' INTERSECT SELECT user_id, k FROM ev WHERE event_type = 'view'", l="user_id k")
def _(spark, d):
    e = events(spark, d)
    return e.filter("event_type = 'click'").select("user_id", "k").intersect(e.filter("event_type = 'view'").select("user_id", "k"))


@query("U5_widen", f"WITH {BARS} SELECT bucket, sum(close) FILTER (event_type = 'click') AS click, sum(close) FILTER (event_type = 'view') AS w_view FROM bars GROUP BY bucket", l="bucket", d="click w_view")
def _(spark, d):
    return J.widen(hourly(spark, d), "bucket", "event_type", "close", ["click", "view"]).withColumnRenamed("view", "w_view")


@query("U6_describe_transposed", f"WITH {EV}, l AS (SELECT 'value' AS feature, value AS x FROM ev UNION ALL SELECT 'k', k FROM ev) SELECT feature, count(x) / count(*) AS finite_share, min(x) AS least, max(x) AS most, avg(x) AS mean, stddev_pop(x) AS std, avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END) AS negative_share, skewness(x) AS skew FROM l GROUP BY feature", d="finite_share least most mean std negative_share skew", s="feature")
def _(spark, d):
    return M.feature_audit(events(spark, d), ["value", "k"])


@query("U8_upsert", f"WITH {EV}, o AS (SELECT user_id, event_id, t, value, k FROM ev WHERE event_type = 'click'), n AS (SELECT user_id, event_id, t, value, k FROM ev WHERE event_type = 'view'), b AS (SELECT *, 0 AS s FROM o UNION ALL SELECT *, 1 FROM n) SELECT user_id, arg_min(event_id, (s, t)) AS event_id, arg_min(value, (s, t)) AS value, arg_max(k, (s, t)) AS k FROM b GROUP BY user_id", l="user_id event_id k", d="value")
def _(spark, d):
    e = events(spark, d).select("user_id", "event_id", "t", "value", "k", "event_type")
    return J.upsert(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), ["user_id"], ["k"], "t")


@query("U3_same_row_columns", f"WITH {EV} SELECT event_id, value + k AS a, value - k AS b FROM ev", l="event_id", d="a b")
def _(spark, d):
    return events(spark, d).withColumns({"a": val() + c("k"), "b": val() - c("k")})


# ---- projections, filters, cleaning -----------------------------------------------------------------
@query("P1_resolve_columns", "SELECT event_id, value AS price, epoch_us(ts) // 1000 AS at FROM events".replace("AS at", "AS tm"), l="event_id tm", d="price")
def _(spark, d):
    e = events(spark, d)
    return e.select("event_id", c(C.resolve_column(e, ["price", "VALUE"])).alias("price"), c(C.resolve_column(e, ["timestamp", "t"])).alias("tm"))


ev("P2_numeric_coercion", "SELECT event_id, CASE WHEN k % 5 = 0 THEN -1.0 ELSE value END AS x, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS y FROM ev", lambda e: e.withColumn("raw", F.when(c("k") % 5 == 0, F.lit("n/a")).otherwise(val().cast("string"))).withColumns({"x": to_number(c("raw"), -1.0), "y": to_number(c("raw"))}), l="event_id", d="x y")
ev("P3_snapshot_validity", "SELECT * FROM ev WHERE value > 0 AND k > 0", lambda e: C.valid_rows(e, ["value", "k"]), l="event_id")
ev("P4_valid_rows", ", m AS (SELECT *, CASE WHEN k % 7 <> 0 THEN value END AS x FROM ev) SELECT * FROM m WHERE x IS NOT NULL", lambda e: C.valid_rows(e.withColumn("x", F.when(c("k") % 7 != 0, val())), present=["x", "value"]), l="event_id")
ev("P5_side_normalisation", "SELECT event_id, CASE k % 5 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'long' WHEN 3 THEN 'short' ELSE 'flat' END AS side, CASE WHEN k % 5 IN (1, 3) THEN -1.0 ELSE 1.0 END AS sgn FROM ev", lambda e: e.withColumn("raw", F.element_at(F.array(*map(F.lit, ["BUY ", "sell", "1", "-1", "Flat"])), (c("k") % 5 + 1).cast("int"))).withColumns({"side": normal_side(c("raw")), "sgn": side_sign(c("raw"))}), l="event_id", d="sgn", s="side")
ev("P6_fallback_coalesce", "SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN value END, CASE WHEN k % 3 = 0 THEN 1.0 * k END, 0.0) AS x FROM ev", lambda e: e.withColumn("x", F.coalesce(F.when(c("k") % 2 == 0, val()), F.when(c("k") % 3 == 0, 1.0 * c("k")), F.lit(0.0))), l="event_id", d="x")
ev("P7_readiness_flags", f", m AS (SELECT *, row_number() OVER ({BY_USER}) AS i FROM ev) SELECT event_id, i < 10 AS not_warm, value < 1 AS bad_price, NOT (i < 10 OR value < 1) AS feature_ready FROM m", lambda e: C.readiness(e.withColumn("i", F.row_number().over(USER.spec)), {"not_warm": c("i") < 10, "bad_price": val() < 1}), l="event_id", b="not_warm bad_price feature_ready")
ev("P11_coverage", "SELECT count(*) AS n_rows, count(*) FILTER (k % 7 = 0) AS removed_features, count(*) FILTER (k % 7 <> 0 AND value < 1) AS removed_target, count(*) FILTER (k % 7 <> 0 AND value >= 1 AND k <= 50) AS removed_regime, count(*) FILTER (k % 7 <> 0 AND value >= 1 AND k > 50) AS kept FROM ev", lambda e: C.coverage(e.withColumns({"x": F.when(c("k") % 7 != 0, val()), "y": F.when(val() >= 1, val())}), ["x"], "y", c("k") > 50), l="n_rows removed_features removed_target removed_regime kept")
ev("P12_freshness_filter", f", m AS (SELECT *, t - lag(t) OVER ({BY_USER}) AS age FROM ev) SELECT * FROM m WHERE age <= {HOUR} AND k <> 0", lambda e: e.withColumn("age", USER.diff(c("t"))).filter(all_of(c("age") <= HOUR, c("k") != 0)), l="event_id age")
ev("P13_development_cutoff", "SELECT * FROM ev WHERE t < 1705276800000", lambda e: e.filter(c("t") < 1705276800000), l="event_id")
ev("P14_missing_flags", "SELECT event_id, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS x_missing FROM ev", lambda e: C.missing_flags(e.withColumn("x", F.when(c("k") % 7 != 0, val())), ["x"]), l="event_id x_missing")
ev("P15_clip_log_sign", "SELECT event_id, least(greatest(value, 10), 40) AS cl, ln(1 + value) AS lp, sign(k - 50) AS sg, CASE WHEN k > 0 THEN least(greatest(ln(value) - ln(CASE WHEN k > 0 THEN k END), -1), 1) END AS lr FROM ev", lambda e: e.withColumns({"cl": F.least(F.greatest(val(), F.lit(10.0)), F.lit(40.0)), "lp": F.log1p(val()), "sg": F.signum(c("k") - 50), "lr": log_ratio(val(), c("k").cast("double"), 1.0)}), l="event_id", d="cl lp sg lr")
ev("P16_sentinel_returns", f", m AS (SELECT *, value / lag(value) OVER ({BY_USER}) - 1 AS r FROM ev) SELECT event_id, CASE WHEN r <= -0.999 THEN 0.0 ELSE r END AS r FROM m", lambda e: e.withColumn("r", C.clean_return(pct_change(val(), USER.lag(val())))), l="event_id", d="r")
ev("P18_one_hot", "SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END AS event_type_{k}" for k in ("click", "view", "error")) + " FROM ev", lambda e: C.one_hot(e, "event_type", ["click", "view", "error"]), l="event_id event_type_click event_type_view event_type_error")


@query("P17_columns_by_tokens", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem", l="l_orderkey l_linenumber", d="l_extendedprice l_discount")
def _(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", *C.columns_by_tokens(x, ["price", "discount"]))


ev("P_finite", "SELECT event_id, value AS x FROM ev", lambda e: e.withColumn("x", finite(val())), l="event_id", d="x")
