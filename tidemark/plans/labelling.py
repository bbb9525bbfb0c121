"""Label queries (L*), splits (V*), sampling (O*). They look ahead by definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY, HOUR
from tidemark.functions.semantics import ieee_div, simple_bps
from tidemark.operators import clean as C
from tidemark.operators import labels as L
from tidemark.operators import touches as B
from tidemark.operators import metrics as M
from tidemark.operators import splits as V
from tidemark.operators.series import Series
from tidemark.plans.bars import BARS, hourly
from tidemark.plans.features import BAR, BY_BAR, barq, ev
from tidemark.plans.registry import BY_USER, EV, USER, early, early_sql, ema_sql, events, lbps, query, ridge_sql, roll

c = F.col


def val():
    return F.col("value")

NEXT = lambda n: f"({BY_USER} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"

ev("L1_future_return", f"SELECT *, {lbps(f'lead(value, 3) OVER ({BY_USER})', 'value')} AS future_3, lead(t, 3) OVER ({BY_USER}) AS label_end FROM ev", lambda e: e.withColumns({"future_3": L.future_return(USER, val(), 3), "label_end": USER.lead(c("t"), 3)}), l="event_id label_end", d="future_3")
ev("L2_excursions", f"SELECT *, CASE WHEN count(value) OVER w = 5 THEN greatest({lbps('max(value) OVER w', 'value')}, 0.0) END AS mfe, CASE WHEN count(value) OVER w = 5 THEN least({lbps('min(value) OVER w', 'value')}, 0.0) END AS mae FROM ev WINDOW w AS {NEXT(5)}", lambda e: e.withColumns(dict(zip(("mfe", "mae"), L.excursions(USER, val(), val(), val(), 5)))), l="event_id", d="mfe mae")
PATH = f", p AS (SELECT *, list(value) OVER {NEXT(5)} AS f FROM ev), q AS (SELECT *, CASE WHEN len(f) = 5 THEN list_transform(f, lambda x: (x / value - 1) * 1e4) END AS path FROM p)"
J = lambda x: f"array_to_string(list_transform({x}, lambda z: CAST(CAST(round(z) AS BIGINT) AS VARCHAR)), ',')"  # noqa: E731, E741


def path(e, n=5):
    return e.withColumn("path", L.return_path(USER, val(), n))


def touched(e, up, down, n=5):
    return B.touch_steps(e, ["user_id"], ["t", "event_id"], "value", "value", "value", n, up, down, zero=True).withColumn("touch", B.touched_first())


def text(x):
    return F.array_join(F.transform(x, lambda z: F.round(z + 0.0001).cast("long").cast("string")), ",")


JT = lambda x: f"array_to_string(list_transform({x}, lambda z: CAST(CAST(round(z + 0.0001) AS BIGINT) AS VARCHAR)), ',')"  # noqa: E731, E741
ev("L3_return_path_envelopes", PATH + f" SELECT *, {JT('path')} AS p, {JT('list_transform(range(1, 6), lambda i: greatest(0.0, list_max(path[1:i])))')} AS hi, {JT('list_transform(range(1, 6), lambda i: least(0.0, list_min(path[1:i])))')} AS lo FROM q WHERE path IS NOT NULL", lambda e: path(e).filter("path is not null").withColumns({"p": text(c("path")), "hi": text(L.envelope(c("path"), "high")), "lo": text(L.envelope(c("path"), "low"))}), l="event_id", s="p hi lo")
ev("L4_path_range_frame", f"SELECT *, (max(value) OVER w / value - 1) * 1e4 AS up_bps, (min(value) OVER w / value - 1) * 1e4 AS down_bps, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {DAY} FOLLOWING)",
   lambda e: e.withColumns({"up_bps": simple_bps(F.max("value").over(Series(("user_id",), ("t",)).future_ms(DAY)), val()), "down_bps": simple_bps(F.min("value").over(Series(("user_id",), ("t",)).future_ms(DAY)), val()), "n": F.count("*").over(Series(("user_id",), ("t",)).future_ms(DAY))}), l="event_id n", d="up_bps down_bps")
TOUCH = ", a AS (SELECT *, coalesce(list_position(list_transform(path, lambda r: r >= {up}), TRUE), 0) AS ia, coalesce(list_position(list_transform(path, lambda r: r <= -{dn}), TRUE), 0) AS ib FROM {src})"
HIT = "CASE WHEN path IS NULL THEN NULL WHEN ia > 0 AND (ib = 0 OR ia < ib) THEN 1 WHEN ib > 0 AND (ia = 0 OR ib < ia) THEN -1 ELSE 0 END"
ev("L5_first_touch", PATH + TOUCH.format(up=8000, dn=6000, src="q") + f" SELECT *, {HIT} AS touch FROM a", lambda e: touched(e, 8000.0, 6000.0), l="event_id touch")
ev("L6_net_aware_touch", PATH + ", q2 AS (SELECT *, k * 100.0 + 50 AS need FROM q)" + TOUCH.format(up="need", dn="need", src="q2") + f" SELECT *, {HIT} AS touch FROM a", lambda e: touched(e, c("k") * 100.0 + 50, c("k") * 100.0 + 50), l="event_id touch")


@query("L7_touch_summary", f"WITH {EV} " + PATH + TOUCH.format(up=8000, dn=6000, src="q") + f", h AS (SELECT *, {HIT} AS touch FROM a) SELECT event_type, count(*) FILTER (touch = 1) AS tp_first, count(*) FILTER (touch = -1) AS down_first, count(*) FILTER (touch = 0) AS neither, count(touch) / count(*) AS coverage, avg(CASE WHEN touch = 1 THEN 1.0 WHEN touch = -1 THEN 0.0 END) AS tp_share FROM h GROUP BY ALL", l="tp_first down_first neither", d="coverage tp_share", s="event_type")
def _(spark, d):
    return L.touch_summary(touched(events(spark, d), 8000.0, 6000.0), ["event_type"], "touch")


F1 = lbps(f"lead(value) OVER ({BY_USER})", "value")
ev("L8_direction_classes", f", m AS (SELECT *, {F1} AS f FROM ev) SELECT *, CASE WHEN f IS NULL THEN NULL WHEN f > 5000 THEN 1 WHEN f < -5000 THEN -1 ELSE 0 END AS strict, CASE WHEN f IS NULL THEN NULL WHEN f >= 100.0 * k THEN 1 WHEN f <= -100.0 * k THEN -1 ELSE 0 END AS inclusive FROM m", lambda e: e.withColumn("f", L.future_return(USER, val(), 1)).withColumns({"strict": L.direction(c("f"), 5000.0), "inclusive": L.direction(c("f"), 100.0 * c("k"), True)}), l="event_id strict inclusive")
RET = f"r AS (SELECT *, {lbps('value', f'lag(value) OVER ({BY_USER})')} AS ret FROM ev)"
ev("L9_volatility_threshold", f", {RET} SELECT *, greatest(coalesce(({roll('stddev_pop({x})', 'ret', 10, least=2)}) * pow(3, 0.5) * 0.5, -1.0), 1000.0) AS band FROM r", lambda e: e.withColumn("ret", USER.returns(val())).withColumn("band", L.volatility_threshold(USER, c("ret"), 10, 3, 0.5, 1000.0)), l="event_id", d="band")
AHEAD = f", f AS (SELECT *, list(high) OVER n AS hs, list(low) OVER n AS ls FROM bars WINDOW n AS ({BY_BAR} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)), g AS (SELECT *, coalesce(list_position(list_transform(hs, lambda x: (x / close - 1) * 1e4 >= 9000), TRUE), 0) AS ia, coalesce(list_position(list_transform(ls, lambda x: (x / close - 1) * 1e4 <= -7000), TRUE), 0) AS ib FROM f WHERE len(hs) = 6)"


def barriers(b, long=True, tp=9000.0, sl=7000.0):
    return B.barrier_classes(b, ["event_type"], ["bucket"], 6, tp, sl, long).withColumnRenamed("class", "cls")


CLS = "CASE WHEN ia > 0 AND (ib = 0 OR ia < ib) THEN 1 WHEN ib > 0 AND (ia = 0 OR ib < ia) THEN -1 ELSE 0 END"
barq("L10_barrier_class", AHEAD + f" SELECT *, {CLS} AS cls FROM g", barriers, l="bucket cls", d="close")
barq("L17_barrier_flags", AHEAD + f" SELECT *, CASE WHEN ia > 0 AND ia = ib THEN 1 ELSE 0 END AS ambiguous, CASE WHEN ia = 0 AND ib = 0 THEN 1 ELSE 0 END AS unresolved, CASE WHEN ia > 0 AND ia = ib THEN NULL ELSE {CLS} END AS or_null, CASE WHEN ia > 0 AND ia = ib THEN -1 ELSE {CLS} END AS stop_first FROM g", barriers, l="bucket ambiguous unresolved or_null stop_first", d="close")
SHORT = AHEAD.replace(">= 9000", ">= 7000").replace("<= -7000", "<= -9000")
barq("L19_offer_replay", AHEAD + f", u AS (SELECT event_type, 'long' AS side, CASE WHEN ia > 0 AND ia = ib THEN -1 ELSE {CLS} END AS r FROM g), h2 AS (SELECT *, coalesce(list_position(list_transform(hs, lambda x: (x / close - 1) * 1e4 >= 7000), TRUE), 0) AS ja, coalesce(list_position(list_transform(ls, lambda x: (x / close - 1) * 1e4 <= -9000), TRUE), 0) AS jb FROM f WHERE len(hs) = 6), w AS (SELECT * FROM u UNION ALL SELECT event_type, 'short', CASE WHEN ja > 0 AND ja = jb THEN -1 WHEN jb > 0 AND (ja = 0 OR jb < ja) THEN 1 WHEN ja > 0 AND (jb = 0 OR ja < jb) THEN -1 ELSE 0 END FROM h2) SELECT event_type, side, count(*) FILTER (r = 1) AS wins, count(*) FILTER (r = -1) AS losses, count(*) AS n FROM w GROUP BY ALL",
     lambda b: barriers(b).select("event_type", F.lit("long").alias("side"), c("stop_first").alias("r")).unionByName(barriers(b, False).select("event_type", F.lit("short").alias("side"), c("stop_first").alias("r"))).groupBy("event_type", "side").agg(F.count_if(c("r") == 1).alias("wins"), F.count_if(c("r") == -1).alias("losses"), F.count("*").alias("n")), l="wins losses n", d="", s="event_type side")
barq("L11_structure_regime", f", m AS (SELECT *, max(high) OVER a AS h1, min(low) OVER a AS l1, max(high) OVER b AS h2, min(low) OVER b AS l2, count(high) OVER n AS rows_ahead FROM bars WINDOW a AS ({BY_BAR} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), b AS ({BY_BAR} ROWS BETWEEN 7 FOLLOWING AND 12 FOLLOWING), n AS ({BY_BAR} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)) SELECT *, CASE WHEN h2 > h1 AND l2 > l1 THEN 'up' WHEN h2 < h1 AND l2 < l1 THEN 'down' ELSE 'range' END AS regime FROM m WHERE rows_ahead = 12",
     lambda b: b.withColumns(L.halves(BAR, c("high"), c("low"), 6, 12)).filter("rows_ahead = 12").withColumn("regime", L.structure_regime(c("first_high"), c("first_low"), c("second_high"), c("second_low"))), d="", s="event_type regime")
F12 = f"(PARTITION BY event_type ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {6 * HOUR} FOLLOWING)"
ev("L13_event_labels", f", m AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo, arg_max(t, (value, -t)) OVER w AS th, arg_min(t, (value, t)) OVER w AS tl, max(k) OVER w AS mk, min(k) OVER w AS nk, count(*) OVER w AS rows_ahead FROM ev WINDOW w AS {F12}) SELECT *, (hi / value - 1) * 1e4 AS up_bps, (lo / value - 1) * 1e4 AS down_bps, (hi / value - 1) * 1e4 / ((th - t) / 1000.0) AS up_velocity, (lo / value - 1) * 1e4 / ((tl - t) / 1000.0) AS down_velocity, CASE WHEN mk > 2 * k THEN 1 WHEN mk IS NOT NULL THEN 0 END AS spread_shock, CASE WHEN nk < 0.5 * k THEN 1 WHEN nk IS NOT NULL THEN 0 END AS depth_drop FROM m",
   lambda e: L.event_labels(e, ["event_type"], "value", "k", "k", 6 * HOUR, "t"), l="event_id spread_shock depth_drop rows_ahead", d="up_bps down_bps up_velocity down_velocity")
ev("L12_instability", f", m AS (SELECT *, max(value) OVER w / min(value) OVER w AS rg, min(value) OVER w / value AS adverse, max(value) OVER w / value AS rise, count(*) OVER w AS n, quantile_cont(value, 0.5) OVER p AS med FROM ev WINDOW w AS {F12}, p AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)) SELECT *, n > 0 AND (rg > 20 OR adverse < 0.1 OR rise > 10 OR value > 3 * med) AS unstable FROM m",
   lambda e: L.instability(e, ["event_type"], "t", "value", 6 * HOUR), l="event_id n", b="unstable")
GAP = f", m AS (SELECT *, t - lag(t) OVER ({BY_USER}) AS gap FROM ev) SELECT *, coalesce(count(gap) OVER w = 3 AND min(gap) OVER w > 0 AND max(gap) OVER w <= {2 * DAY}, FALSE) AS future_ok"
ev("L22_gapless_future", GAP + f" FROM m WINDOW w AS {NEXT(3)}", lambda e: L.gapless_future(e, USER, "t", 3, 2 * DAY), l="event_id", b="future_ok")
ev("L14_next_flow", GAP + f", CASE WHEN count(gap) OVER w = 3 AND max(gap) OVER w <= {2 * DAY} AND min(gap) OVER w > 0 THEN sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END) OVER w END AS flow_3 FROM m WINDOW w AS {NEXT(3)}", lambda e: L.gapless_future(e, USER, "t", 3, 2 * DAY).withColumn("flow_3", F.when(c("future_ok"), F.sum(F.when(c("event_type").isin("purchase", "signup"), val()).otherwise(-val())).over(USER.next_n(3)))), l="event_id", d="flow_3", b="future_ok")
L15 = f", {RET}, x AS (SELECT *, {roll('stddev_pop({x})', 'ret', 10)} AS vol, CASE WHEN count(value) OVER w = 4 THEN greatest({lbps('max(value) OVER w', 'value')}, 0.0) END AS mfe, CASE WHEN count(value) OVER w = 4 THEN least({lbps('min(value) OVER w', 'value')}, 0.0) END AS mae FROM r WINDOW w AS {NEXT(4)}) SELECT *, "
L15 += ", ".join(f"CASE WHEN vol * 2.0 > 0 THEN CASE WHEN mfe >= {k} * (vol * 2.0) THEN 1 WHEN mfe < {k} * (vol * 2.0) THEN 0 END END AS up_{str(k).replace('.', '_')}_h4, CASE WHEN vol * 2.0 > 0 THEN CASE WHEN mae <= -{k} * (vol * 2.0) THEN 1 WHEN mae > -{k} * (vol * 2.0) THEN 0 END END AS down_{str(k).replace('.', '_')}_h4" for k in (0.5, 1.0, 1.5, 2.0)) + " FROM x"


def with_vol(e):
    e = e.withColumn("ret", USER.returns(val())).withColumn("vol", USER.std(c("ret"), 10))
    return e.withColumns(dict(zip(("mfe", "mae"), L.excursions(USER, val(), val(), val(), 4))))


ev("L15_volatility_events", L15, lambda e: with_vol(e).withColumns(L.volatility_events(c("mfe"), c("mae"), c("vol"), 4)), l="event_id " + " ".join(f"{a}_{k}_h4" for a in ("up", "down") for k in ("0_5", "1_0", "1_5", "2_0")))
ev("L16_interval_hazard", PATH + ", s AS (SELECT *, CASE WHEN path IS NOT NULL THEN coalesce(list_position(list_transform(path, lambda r: r <= -100.0 * k), TRUE), 0) END AS step FROM q) SELECT *, CASE WHEN step IS NOT NULL THEN CASE WHEN step = 1 THEN 1 ELSE 0 END END AS hazard_1, CASE WHEN step IS NOT NULL THEN CASE WHEN step = 2 THEN 1 ELSE 0 END END AS hazard_2, CASE WHEN step IS NOT NULL THEN CASE WHEN step IN (3, 4) THEN 1 ELSE 0 END END AS hazard_4 FROM s", lambda e: path(e).withColumn("step", L.touch_step(c("path"), 100.0 * c("k"))).withColumns(L.hazard(c("step"))), l="event_id step hazard_1 hazard_2 hazard_4")
ev("L18_expansion", f", {RET} SELECT *, CASE WHEN count(ret) OVER w = 5 THEN CASE WHEN stddev_pop(ret) OVER w > {roll('stddev_pop({x})', 'ret', 10)} THEN 1 WHEN {roll('stddev_pop({x})', 'ret', 10)} IS NOT NULL THEN 0 END END AS vol_expansion, CASE WHEN count(ret) OVER w = 5 THEN {lbps('max(value) OVER w', 'min(value) OVER w')} END AS future_range FROM r WINDOW w AS {NEXT(5)}", lambda e: e.withColumn("ret", USER.returns(val())).withColumns(L.expansion(USER, c("ret"), val(), val(), 5, 10)), l="event_id vol_expansion", d="future_range")


L20 = f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER ({BY_USER}) AS i FROM ev), {ema_sql("f", "o", "(2.0 / 7.0)", "value")}, {ema_sql("s", "o", "(2.0 / 19.0)", "value")},
g AS (SELECT o.*, f.y - s.y AS gap, (value + (f.y - value) * (1 - 2.0 / 7.0) ** 3) - (value + (s.y - value) * (1 - 2.0 / 19.0) ** 3) AS roll_forward FROM o JOIN f USING (user_id, i) JOIN s USING (user_id, i)),
h AS (SELECT *, lead(gap, 3) OVER ({BY_USER}) AS later FROM g)
SELECT *, later - roll_forward AS residual, CAST(sign(later) <> sign(gap) AS INT) AS crossed FROM h"""


@query("L20_indicator_event", L20, l="user_id event_id crossed", d="gap roll_forward residual")
def _(spark, d):
    """EMA spread against its roll-forward under a constant price: a closed form, h steps ahead."""
    from tidemark.operators.indicators import ema_paths, span_alpha

    a, z, h = span_alpha(6), span_alpha(18), 3
    e = ema_paths(events(spark, d), ["user_id"], ["t", "event_id"], "value", {"fast": a, "slow": z})
    gap = c("fast") - c("slow")
    ahead = (val() + (c("fast") - val()) * (1 - a) ** h) - (val() + (c("slow") - val()) * (1 - z) ** h)
    e = e.withColumns({"gap": gap, "roll_forward": ahead})
    return e.withColumns({"residual": USER.lead(c("gap"), h) - c("roll_forward"), "crossed": (F.signum(USER.lead(c("gap"), h)) != F.signum("gap")).cast("int")})


L21 = f", {RET}, x AS (SELECT *, CASE WHEN count(value) OVER w = 4 THEN least({lbps('min(value) OVER w', 'value')}, 0.0) END / ({roll('stddev_pop({x})', 'ret', 10)}) AS u FROM r WINDOW w AS {NEXT(4)}), tr AS (SELECT quantile_cont(u, 1 / 3) AS a, quantile_cont(u, 2 / 3) AS b FROM x WHERE {early_sql('x')}) SELECT x.*, CASE WHEN u IS NULL THEN 'unknown' WHEN u <= a THEN 'low' WHEN u > b THEN 'high' ELSE 'mid' END AS bucket FROM x, tr"
ev("L21_downside_ordinal", L21, lambda e: M.tertile(with_vol(e).withColumn("u", ieee_div(c("mae"), c("vol"))), [], "u", early(e)), l="event_id", d="u", s="bucket")

# ---- splits and sampling ----------------------------------------------------------------------------
POS = "p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM ev)"


def placed(spark, d):
    e = events(spark, d)
    return C.position(e, "event_id", step=1 << 16), e.count()


def splitq(name, sql, col):
    @query(name, f"WITH {EV}, {POS} {sql}", l="event_id i", s="split")
    def _(spark, d):
        e, n = placed(spark, d)
        return e.withColumn("split", col(c("i"), F.lit(n)))


splitq("V1_chronological_split", "SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'holdout' END AS split FROM p", V.chronological)
splitq("V2_purge_embargo", "SELECT *, CASE WHEN i < floor(n * 0.6) - 60 THEN 'train' WHEN i < floor(n * 0.6) + 40 THEN 'purge_embargo' WHEN i < floor(n * 0.8) - 60 THEN 'validation' WHEN i < floor(n * 0.8) + 40 THEN 'purge_embargo' ELSE 'untouched_holdout' END AS split FROM p", lambda i, n: V.purged(i, n, 60, 40))
splitq("V7_calibration_split", "SELECT *, CASE WHEN i < floor(n * 0.75) - 20 THEN 'fit' WHEN i < floor(n * 0.75) + 0 THEN 'gap' ELSE 'calibrate' END AS split FROM p", lambda i, n: F.when(i < F.floor(n * 0.75) - 20, "fit").when(i < F.floor(n * 0.75), "gap").otherwise("calibrate"))


@query("V3_expanding_folds", f"WITH {EV}, {POS}, b AS (SELECT unnest(range(0, 4)) AS w, max(n) AS n FROM p), f AS (SELECT w, floor(n * 0.5) + w * ((n - floor(n * 0.5)) // 4) + 40 AS s, CASE WHEN w = 3 THEN n ELSE floor(n * 0.5) + (w + 1) * ((n - floor(n * 0.5)) // 4) END AS e FROM b) SELECT w AS window, count(*) AS rows_in, min(i) AS first_i, max(i) AS last_i FROM p JOIN f ON i >= s AND i < e GROUP BY w".replace("AS window", "AS win"), l="win rows_in first_i last_i")
def _(spark, d):
    e, n = placed(spark, d)
    folds = V.expanding_folds(n, 4, 0.5, 60, 40)
    return V.in_windows(e, "i", [(k, s, t) for k, _, s, t in folds]).groupBy(c("window").alias("win")).agg(F.count("*").alias("rows_in"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query("V4_sliding_windows", f"WITH {EV}, {POS}, f AS (SELECT unnest(range(0, (max(n) - 2000) // 500 + 1)) AS w FROM p) SELECT w AS win, count(*) AS rows_in, sum(value) AS total FROM p JOIN f ON i >= w * 500 AND i < w * 500 + 2000 GROUP BY w", l="win rows_in", d="total", digits=3)
def _(spark, d):
    e, n = placed(spark, d)
    return V.in_sliding(e, "i", max(0, (n - 2000) // 500 + 1), 2000, 500).groupBy(c("window").alias("win")).agg(F.count("*").alias("rows_in"), F.sum("value").alias("total"))


@query("V5_sliding_time_windows", f"WITH {EV}, b AS (SELECT min(t) AS a, max(t) AS z FROM ev), f AS (SELECT w, a + w * {3 * DAY} + {10 * DAY} AS s FROM b, (SELECT unnest(range(0, 400)) AS w) WHERE a + {10 * DAY} + w * {3 * DAY} + {3 * DAY} <= z + 1) SELECT w AS win, count(*) AS rows_in, avg(value) AS mean FROM ev JOIN f ON t >= s AND t < s + {3 * DAY} GROUP BY w", l="win rows_in", d="mean")
def _(spark, d):
    e = events(spark, d)
    a, z = e.agg(F.min("t"), F.max("t")).first()
    windows = 0 if a is None else max(0, (z + 1 - a - 13 * DAY) // (3 * DAY) + 1)
    return V.in_sliding(e, "t", windows, 3 * DAY, 3 * DAY, 0 if a is None else a + 10 * DAY).groupBy(c("window").alias("win")).agg(F.count("*").alias("rows_in"), F.avg("value").alias("mean"))


V6 = f"""WITH {EV}, r AS (SELECT min(event_id) AS a, max(event_id) AS z FROM ev), x AS (SELECT ev.*, least(3, floor((event_id - a) * 4.0 / (z - a))) AS bl FROM ev, r),
sy AS (SELECT DISTINCT event_type AS s FROM ev), bs AS (SELECT unnest(range(0, 4)) AS b),
sc AS (SELECT 'symbol:' || s || ':' AS scenario, 'symbol' AS kind, s, NULL AS b FROM sy UNION ALL SELECT 'block::' || b, 'block', NULL, b FROM bs UNION ALL SELECT 'both:' || s || ':' || b, 'both', s, b FROM sy, bs)
SELECT scenario, CASE WHEN CASE kind WHEN 'symbol' THEN event_type = s WHEN 'block' THEN bl = b ELSE event_type = s AND bl = b END THEN 'test' WHEN kind = 'both' AND (event_type = s) <> (bl = b) THEN 'dropped' ELSE 'train' END AS role, count(*) AS n FROM x, sc GROUP BY ALL"""


@query("V6_leave_out", V6, l="n", s="scenario role")
def _(spark, d):
    """Every symbol, and four time blocks over the whole table."""
    e = events(spark, d)
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    symbols = sorted(r[0] for r in e.select("event_type").distinct().collect())
    block = F.least(F.lit(3), F.floor((c("event_id") - low) * 4.0 / (high - low)))
    return V.leave_out(e, "event_type", block, symbols, range(4)).groupBy("scenario", "role").agg(F.count("*").alias("n"))


V8_FOLD = "(n // 2) + {k} * ((n - n // 2) // 3)"
V8 = f"""WITH {EV}, {POS}, q AS (SELECT *, CAST(k AS DOUBLE) AS k_d, lag(value) OVER ({BY_USER}) AS lag1, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS mean5 FROM p WINDOW w AS ({BY_USER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ok AS (SELECT * FROM q WHERE lag1 IS NOT NULL AND mean5 IS NOT NULL),
{", ".join(ridge_sql("ok", ["k_d", "lag1", "mean5"], "value", f"i < {V8_FOLD.format(k=k)} - 60", 1.0, str(k)) for k in range(3))}
{" UNION ALL ".join(f"SELECT event_id, {k} AS fold, value, b0 + w0 * k_d + w1 * lag1 + w2 * mean5 AS oof FROM ok, ridge{k} WHERE i >= {V8_FOLD.format(k=k)} + 40 AND i < {'n' if k == 2 else V8_FOLD.format(k=k + 1)}" for k in range(3))}"""


@query("V8_out_of_fold", V8, digits=5, l="event_id fold", d="oof value")
def _(spark, d):
    from tidemark.operators.diagnostics import out_of_fold

    e, n = placed(spark, d)
    e = e.withColumns({"k_d": c("k").cast("double"), "lag1": USER.lag(val()), "mean5": USER.mean(val(), 5)}).na.drop()
    return out_of_fold(e, "i", V.expanding_folds(n, 3, 0.5, 60, 40), ["k_d", "lag1", "mean5"], "value")


@query("O6_block_sample", f"WITH {EV}, {POS}, k AS (SELECT unnest(range(0, 4)) AS w, max(n) AS n FROM p), b AS (SELECT w, max(floor(w * (n - 300) / 3) - 300 * w) OVER (ORDER BY w) + 300 * w AS s FROM k) SELECT w AS win, count(*) AS rows_in, min(i) AS first_i, max(i) AS last_i FROM p JOIN b ON i >= s AND i < s + 300 GROUP BY w", l="win rows_in first_i last_i")
def _(spark, d):
    e, n = placed(spark, d)
    blocks = [(k, a, b) for k, (a, b) in enumerate(C.block_sample(n, 300, 4))]
    return V.in_windows(e, "i", blocks).groupBy(c("window").alias("win")).agg(F.count("*").alias("rows_in"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


ev("O1_stable_sort", "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k, t, event_id) AS place FROM ev", lambda e: e.withColumn("place", F.row_number().over(Series(("event_type",), ("k", "t", "event_id")).spec)), l="event_id place")
ev("O2_dedupe_keep_last", "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY t DESC, event_id DESC) = 1", lambda e: C.dedupe(e, ["user_id", "k"], ["t", "event_id"]), l="user_id k event_id t", d="value", s="event_type")
ev("O2b_dedupe_keep_first", "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY t, event_id) = 1", lambda e: C.dedupe(e, ["user_id", "k"], ["t", "event_id"], keep="first"), l="user_id k event_id t", d="value", s="event_type")
ev("O3_head_per_group", "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id) <= 3", lambda e: C.head_per_group(e, ["user_id"], [F.desc("t"), "event_id"], 3), l="user_id event_id")
ev("O4_top_fraction", ", m AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT * FROM m WHERE r <= greatest(1, floor(n * 0.05))", lambda e: M.top_fraction(e, ["event_type"], "value", "event_id", 0.05), l="event_id", d="value", s="event_type")
ev("O5_best_per_group", "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1", lambda e: M.best_row(e, ["user_id"], [val(), c("event_id")]), l="user_id event_id", d="value")
