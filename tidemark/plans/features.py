"""Causal window features (W*), calendar and scalar functions (section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as K
from tidemark.functions.calendar import DAY, HOUR
from tidemark.functions.semantics import clip, flag, log_bps, log_ratio, safe_div, sigmoid, softmax
from tidemark.operators import flow as X
from tidemark.operators import indicators as I
from tidemark.operators import ranks as RK
from tidemark.operators import sequences as Q
from tidemark.operators.series import Series
from tidemark.plans.bars import BARS, hourly
from tidemark.plans.registry import BY_TYPE, BY_USER, EV, TYPE, USER, ema_sql, events, lbps, query, roll

c = F.col


def val():
    return F.col("value")

BAR = Series(("event_type",), ("bucket",))
BY_BAR = "PARTITION BY event_type ORDER BY bucket"


def type_all():
    return Series(("event_type",), ()).all()


def ev(name: str, sql: str, cols, l: str = "user_id event_id", d: str = "", s: str = "", b: str = ""):  # noqa: E741
    """A query that adds columns to events."""

    @query(name, f"WITH {EV} {sql}", l=l, d=d, s=s, b=b)
    def _(spark, sf_dir):
        return cols(events(spark, sf_dir))


def barq(name: str, sql: str, cols, d: str, l: str = "bucket", s: str = "event_type"):  # noqa: E741
    @query(name, f"WITH {BARS} {sql}", l=l, d=d, s=s)
    def _(spark, sf_dir):
        return cols(hourly(spark, sf_dir))


R = f"r AS (SELECT *, {lbps('value', f'lag(value) OVER ({BY_USER})')} AS ret FROM ev)"


def with_ret(e):
    return e.withColumn("ret", USER.returns(val()))


ev("W2_moving_average_distance", f"SELECT *, {lbps('value', roll('avg({x})', 'value', 10))} AS ma_distance FROM ev", lambda e: e.withColumn("ma_distance", I.ma_distance(USER, val(), 10)), d="ma_distance")
ev("W3_range_features", f", m AS (SELECT *, {roll('max({x})', 'value', 10)} AS hi, {roll('min({x})', 'value', 10)} AS lo FROM ev) SELECT *, {lbps('hi', 'lo')} AS range_10, {lbps('value', 'hi')} AS to_high_10, {lbps('value', 'lo')} AS to_low_10 FROM m", lambda e: e.withColumns(I.range_features(USER, val(), val(), val(), 10)), d="range_10 to_high_10 to_low_10")
ev("W4_rolling_volatility", f", {R} SELECT *, {roll('stddev_pop({x})', 'ret', 10)} AS vol0, {roll('stddev_samp({x})', 'ret', 10)} AS vol1, sqrt(10.0) * {roll('stddev_pop({x})', 'ret', 10)} AS realized FROM r", lambda e: with_ret(e).withColumns({"vol0": USER.std(c("ret"), 10), "vol1": USER.std(c("ret"), 10, 1), "realized": 10**0.5 * USER.std(c("ret"), 10)}), d="vol0 vol1 realized")
barq("W4b_parkinson", f", x AS (SELECT *, pow({lbps('high', 'low')}, 2) AS h2 FROM bars) SELECT *, sqrt(({roll('avg({x})', 'h2', 6, BY_BAR)}) / (4 * 0.6931471805599453)) AS parkinson FROM x", lambda b: b.withColumn("parkinson", I.parkinson(BAR, c("high"), c("low"), 6)), d="parkinson")
ev("W5_zscore", f", m AS (SELECT *, {roll('avg({x})', 'value', 10)} AS m, {roll('stddev_pop({x})', 'value', 10)} AS sd FROM ev) SELECT *, CASE WHEN m IS NULL THEN NULL WHEN sd = 0 THEN 0 ELSE (value - m) / sd END AS z FROM m", lambda e: e.withColumn("z", USER.zscore(val(), 10)), d="z")
ev("W6_shifted_zscore", f"SELECT *, CASE WHEN count(value) OVER w = 10 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM ev WINDOW w AS ({BY_USER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", lambda e: e.withColumn("z", USER.shifted_zscore(val(), 10)), d="z")
SIGNED = "f AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END AS flow FROM ev)"


def signed(e):
    return e.withColumn("flow", F.when(c("event_type").isin("purchase", "signup"), val()).otherwise(-val()))


ev("W7_flow_persistence", f", {SIGNED}, g AS (SELECT *, flow - lag(flow) OVER ({BY_USER}) AS df, CASE WHEN flow > 0 THEN 1.0 ELSE 0.0 END AS up FROM f) SELECT *, {roll('sum({x})', 'flow', 8)} AS flow_8, {roll('avg({x})', 'up', 8)} AS persistence, {roll('avg({x})', 'df', 8)} AS acceleration, sum(flow) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS delta FROM g",
   lambda e: signed(e).withColumn("df", USER.diff(c("flow"))).withColumns({"flow_8": USER.sum(c("flow"), 8), "persistence": USER.mean(flag(c("flow") > 0), 8), "acceleration": USER.mean(c("df"), 8), "delta": F.sum("flow").over(USER.so_far())}), d="flow_8 persistence acceleration delta")
ev("W8_rolling_quantiles", f"SELECT *, {roll('quantile_cont({x}, 0.5)', 'value', 12)} AS median, {roll('quantile_cont({x}, 0.9)', 'value', 12)} AS q90 FROM ev", lambda e: RK.rolling_order(e, ["user_id"], ["t", "event_id"], 12, {"median": ("value", 0.5), "q90": ("value", 0.9)}), d="median q90")
ev("W9_rolling_percent_rank", f", m AS (SELECT *, list(value) OVER ({BY_USER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vs FROM ev) SELECT *, CASE WHEN len(vs) >= 5 THEN (len(list_filter(vs, lambda x: x < value)) + (len(list_filter(vs, lambda x: x = value)) + 1) / 2.0) / len(vs) END AS pct FROM m", lambda e: RK.rolling_order(e, ["user_id"], ["t", "event_id"], 20, ranks={"pct": "value"}, least=5), d="pct")
ev("W10_percent_rank_fullsample", "SELECT *, (rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type) AS pct FROM ev",
   lambda e: e.withColumn("pct", (F.rank().over(Series(("event_type",), ("value",)).spec) + (F.count("*").over(Series(("event_type", "value"), ()).all()) - 1) / 2.0) / F.count("*").over(type_all())), d="pct")
ev("W11_rank_bins", "SELECT *, row_number() OVER w AS rn, rank() OVER (PARTITION BY event_type ORDER BY value) AS rk, least(floor((row_number() OVER w - 1) * 4 / count(*) OVER (PARTITION BY event_type)), 3) AS bin FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)",
   lambda e: e.withColumns({"rn": F.row_number().over(Series(("event_type",), ("value", "event_id")).spec), "rk": F.rank().over(Series(("event_type",), ("value",)).spec)}).withColumn("bin", F.least(F.floor((c("rn") - 1) * 4 / F.count("*").over(type_all())), F.lit(3))), l="user_id event_id rn rk bin")
PATH = f"{R}, q AS (SELECT *, sum(coalesce(ret, 0.0)) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS cumulative FROM r)"
ev("W12_cumulative_drawdown", f", {PATH} SELECT *, cumulative - max(cumulative) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS drawdown, cumulative - min(cumulative) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS runup FROM q", lambda e: I.path_stats(with_ret(e), USER, c("ret")), d="cumulative drawdown runup")
ev("W13_compounded_equity", f", {R} SELECT *, exp(sum(ln(1 + least(greatest(coalesce(ret, 0.0) / 1e6, -0.99), 10.0))) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING)) AS equity FROM r", lambda e: I.path_stats(with_ret(e), USER, c("ret") / 100), d="equity")
ev("W14_forward_fill", f", m AS (SELECT *, CASE WHEN k % 3 = 0 THEN value END AS x FROM ev) SELECT *, last_value(x IGNORE NULLS) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS filled FROM m", lambda e: e.withColumn("x", F.when(c("k") % 3 == 0, val())).withColumn("filled", USER.forward_fill(c("x"))), d="filled")
ev("W14b_backfill_fullsample", f", m AS (SELECT *, CASE WHEN k % 3 = 0 THEN value END AS x FROM ev) SELECT *, first_value(x IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM m", lambda e: e.withColumn("x", F.when(c("k") % 3 == 0, val())).withColumn("filled", USER.backfill(c("x"))), d="filled")


def recursion(alpha: str, column: str, source: str = "ev") -> str:
    return f"""RECURSIVE {EV}, src AS ({source}), o AS (SELECT *, row_number() OVER ({BY_USER}) AS i FROM src),
e AS (SELECT user_id, event_id, i, {column} AS y FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, {alpha} * o.{column} + (1 - {alpha}) * e.y FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)"""


@query("W15_ema", f"WITH {recursion('(2.0 / 11.0)', 'value', 'SELECT * FROM ev')} SELECT user_id, event_id, y AS ema FROM e", l="user_id event_id", d="ema")
def _(spark, d):
    return I.ema_paths(events(spark, d), ["user_id"], ["t", "event_id"], "value", {"ema": I.span_alpha(10)})


O = f"RECURSIVE {EV}, o AS (SELECT *, row_number() OVER ({BY_USER}) AS i, lag(value) OVER ({BY_USER}) AS before, avg(value) OVER ({BY_USER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m10 FROM ev)"
MACD = f"""WITH {O}, {ema_sql("f", "o", "(2.0 / 13.0)", "value")}, {ema_sql("s", "o", "(2.0 / 27.0)", "value")},
md AS (SELECT o.*, f.y - s.y AS macd FROM o JOIN f USING (user_id, i) JOIN s USING (user_id, i)), {ema_sql("g", "md", "(2.0 / 10.0)", "macd")}
SELECT md.*, g.y AS macd_signal, macd - g.y AS macd_hist FROM md JOIN g USING (user_id, i)"""


@query("W15b_macd", MACD, l="user_id event_id", d="macd macd_signal macd_hist")
def _(spark, d):
    return I.macd(events(spark, d), ["user_id"], ["t", "event_id"], "value")


W16 = f"""WITH {O}, x AS (SELECT user_id, i - 9 AS i, CASE WHEN i = 10 THEN m10 ELSE value END AS v FROM o WHERE i >= 10), {ema_sql("y", "x", "(2.0 / 11.0)", "v")}
SELECT o.*, y.y AS ema FROM o LEFT JOIN y ON y.user_id = o.user_id AND y.i = o.i - 9"""


@query("W16_sma_seeded_ema", W16, l="user_id event_id", d="ema")
def _(spark, d):
    return I.sma_seeded_ema(events(spark, d), ["user_id"], ["t", "event_id"], "value", 10, "ema")


CH = f"h AS (SELECT *, value - lag(value) OVER ({BY_USER}) AS ch FROM ev), u AS (SELECT *, greatest(ch, 0.0) AS up, greatest(-ch, 0.0) AS dn FROM h WHERE TRUE), u2 AS (SELECT * REPLACE (CASE WHEN ch IS NULL THEN 0.0 ELSE up END AS up, CASE WHEN ch IS NULL THEN 0.0 ELSE dn END AS dn) FROM u)"
ev("W17_rsi_mean_and_sum", f", {CH}, m AS (SELECT *, {roll('avg({x})', 'up', 10)} AS a, {roll('avg({x})', 'dn', 10)} AS b FROM u2) SELECT *, CASE WHEN a IS NULL THEN NULL WHEN a = 0 AND b = 0 THEN 50 WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END AS rsi_mean, CASE WHEN a IS NULL THEN NULL WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END AS rsi_sum FROM m",
   lambda e: e.withColumn("ch", USER.diff(val())).withColumns({"rsi_mean": I.rsi_mean(USER, c("ch"), 10), "rsi_sum": I.rsi_sum(USER, c("ch"), 10)}), d="rsi_mean rsi_sum")


W17C = f"""WITH {O}, x AS (SELECT user_id, i - 1 AS i, greatest(value - before, 0.0) AS up, greatest(before - value, 0.0) AS dn FROM o WHERE i >= 2),
{ema_sql("a", "x", "0.1", "up")}, {ema_sql("b", "x", "0.1", "dn")}, r AS (SELECT a.user_id, a.i + 1 AS i, a.y AS a, b.y AS b FROM a JOIN b USING (user_id, i) WHERE a.i >= 10)
SELECT o.*, CASE WHEN a = 0 AND b = 0 THEN 50.0 WHEN b = 0 THEN 100.0 ELSE 100 - 100 / (1 + a / b) END AS rsi_wilder FROM o LEFT JOIN r USING (user_id, i)"""


@query("W17c_rsi_wilder", W17C, l="user_id event_id", d="rsi_wilder")
def _(spark, d):
    return I.wilder_rsi(events(spark, d), ["user_id"], ["t", "event_id"], "value", 10)


barq("W18_average_true_range", f", x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({BY_BAR})), abs(low - lag(close) OVER ({BY_BAR}))) AS tr FROM bars) SELECT *, {roll('avg({x})', 'tr', 14, BY_BAR)} AS atr, 100 * {roll('avg({x})', 'tr', 14, BY_BAR)} / close AS atr_percent FROM x",
     lambda b: b.withColumn("tr", I.true_range(BAR, c("high"), c("low"), c("close"))).withColumn("atr", BAR.mean(c("tr"), 14)).withColumn("atr_percent", 100 * safe_div(c("atr"), c("close"))), d="tr atr atr_percent")
N = 12
OSC = f""", x AS (SELECT *, (high + low + close) / 3 AS tp, close - lag(close) OVER ({BY_BAR}) AS dc, (high + low + close) / 3 - lag((high + low + close) / 3) OVER ({BY_BAR}) AS dt FROM bars),
y AS (SELECT *, {roll('avg({x})', 'close', N, BY_BAR)} AS mid, {roll('stddev_pop({x})', 'close', N, BY_BAR)} AS sd, {roll('max({x})', 'high', N, BY_BAR)} AS hi, {roll('min({x})', 'low', N, BY_BAR)} AS lo, {roll('avg({x})', 'tp', N, BY_BAR)} AS mt,
 list(tp) OVER w AS tps, CASE WHEN count(*) OVER w = {N} THEN sum(CASE WHEN dt > 0 THEN tp * volume ELSE 0 END) OVER w END AS mu, CASE WHEN count(*) OVER w = {N} THEN sum(CASE WHEN dt < 0 THEN tp * volume ELSE 0 END) OVER w END AS md,
 sum(CASE WHEN dc > 0 THEN volume WHEN dc < 0 THEN -volume ELSE 0 END) OVER ({BY_BAR} ROWS UNBOUNDED PRECEDING) AS obv, CASE WHEN count(*) OVER w = {N} THEN sum(tp * volume) OVER w / sum(volume) OVER w END AS vw, lag(close, {N}) OVER ({BY_BAR}) AS old
 FROM x WINDOW w AS ({BY_BAR} ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))
SELECT *, 4 * sd / mid AS bollinger_width, CASE WHEN sd = 0 THEN 0 ELSE (close - (mid - 2 * sd)) / (4 * sd) END AS bollinger_b, (close - lo) / (hi - lo) AS donchian, 100 * (close - lo) / (hi - lo) AS stochastic, -100 * (hi - close) / (hi - lo) AS williams,
 (tp - mt) / (0.015 * (list_sum(list_transform(tps, lambda q: abs(q - mt))) / {N})) AS cci, CASE WHEN mu = 0 AND md = 0 THEN 50 WHEN md = 0 THEN 100 ELSE 100 - 100 / (1 + mu / md) END AS mfi, {lbps('close', 'vw')} AS vwap_distance, {lbps('close', 'old')} AS roc FROM y"""
barq("W19_oscillators", OSC, lambda b: I.oscillators(b, BAR, N), d="bollinger_width bollinger_b donchian stochastic williams cci mfi obv vwap_distance roc")
barq("W20_candle_anatomy", """SELECT *, high - low AS range, close - open AS body, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, CASE WHEN high = low THEN 0 ELSE abs(close - open) / (high - low) END AS body_share, CASE WHEN high = low THEN 0 ELSE (close - low) / (high - low) END AS close_position,
 CASE WHEN high = low THEN 0 ELSE ((high - greatest(open, close)) - (least(open, close) - low)) / (high - low) END AS wick_asymmetry FROM bars""", lambda b: b.withColumns(I.candle_anatomy(c("open"), c("high"), c("low"), c("close"))), d="range body upper_wick lower_wick body_share close_position wick_asymmetry")  # fmt: skip
barq("W21_signed_runs", f", x AS (SELECT *, CAST(coalesce(sign(close - open), 0) AS INT) AS sg FROM bars), y AS (SELECT *, CASE WHEN coalesce(lag(sg) OVER ({BY_BAR}), 99) <> sg THEN 1 ELSE 0 END AS nw FROM x), z AS (SELECT *, sum(nw) OVER ({BY_BAR} ROWS UNBOUNDED PRECEDING) AS g FROM y) SELECT *, sg * row_number() OVER (PARTITION BY event_type, g ORDER BY bucket) AS run FROM z", lambda b: I.signed_run(b, BAR, c("close") - c("open")), d="close", l="bucket run")
RNG = "PARTITION BY event_type ORDER BY t RANGE BETWEEN"
TS = Series(("event_type",), ("t",))
MIN15, MIN60 = 900_000, 3_600_000
ev("W22_past_value", f"SELECT *, first_value(value) OVER ({RNG} {HOUR} PRECEDING AND CURRENT ROW) AS past FROM ev", lambda e: X.past_values(e, TYPE, "value", {"past": HOUR}), d="past")
W23 = f""", rr AS (SELECT *, {lbps('value', f'lag(value) OVER ({BY_TYPE})')} AS ret FROM ev) SELECT *, {lbps('value', 'first_value(value) OVER w')} AS return_3600s, stddev_samp(ret) OVER w AS vol_3600s, {lbps('max(value) OVER w', 'min(value) OVER w')} AS range_3600s, sum(ret) OVER w AS sum_3600s,
 avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) OVER w AS up_3600s, count(*) OVER w AS n_3600s FROM rr WINDOW w AS ({RNG} {HOUR - 1} PRECEDING AND CURRENT ROW)"""
ev("W23_time_range_bundle", W23, lambda e: X.regime_windows(e.withColumn("ret", log_bps(val(), F.lag("value").over(Series(("event_type",), ("t", "event_id")).spec))), TS, "value", "ret", [HOUR, 6 * HOUR]), l="event_id n_3600s", d="return_3600s vol_3600s range_3600s sum_3600s up_3600s")
ev("W24_changes", f", m AS (SELECT *, first_value(value) OVER ({RNG} {MIN15} PRECEDING AND CURRENT ROW) AS a, first_value(value) OVER ({RNG} {MIN60} PRECEDING AND CURRENT ROW) AS b FROM ev) SELECT *, value - a AS value_change_900s, (value - a) / abs(a) AS value_relative_900s, (value - a) / 900.0 - (value - b) / 3600.0 AS value_acceleration FROM m", lambda e: X.changes(e, TYPE, ["value"], [MIN15, MIN60]), d="value_change_900s value_relative_900s value_acceleration")
ev("W25_freshness", f", m AS (SELECT *, t - lag(t) OVER ({BY_TYPE}) AS gap_ms FROM ev) SELECT *, coalesce(gap_ms > {HOUR}, FALSE) AS large_gap FROM m", lambda e: X.freshness(e, Series(("event_type",), ("t", "event_id")), HOUR), l="event_id gap_ms", b="large_gap")
W26 = f""", m AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END AS buy, CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE value END AS sell FROM ev)
SELECT *, sum(buy - sell) OVER w AS flow_86400s, coalesce(sum(buy - sell) OVER p, 0.0) AS flow_before_86400s, sum(buy - sell) OVER w / sum(buy + sell) OVER w AS pressure_86400s, coalesce(sum(buy + sell) OVER w / sum(buy + sell) OVER p, CASE WHEN sum(buy + sell) OVER p IS NOT NULL THEN 0 END) AS burst_86400s,
 {lbps('value', 'first_value(value) OVER w')} / 86400.0 AS velocity_86400s, count(*) OVER w AS rows_86400s, {lbps('value', 'min(value) OVER w')} AS bounce_86400s, {lbps('value', 'min(value) OVER p')} AS break_86400s
FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW), p AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {2 * DAY - 1} PRECEDING AND {DAY} PRECEDING)"""


def buy_sell(e):
    is_buy = c("event_type").isin("purchase", "signup")
    return e.withColumns({"buy": F.when(is_buy, val()).otherwise(0.0), "sell": F.when(is_buy, 0.0).otherwise(val())})


ev("W26_micro_bundle", W26, lambda e: X.micro_bundle(buy_sell(e), Series(("user_id",), ("t",)), "value", "buy", "sell", [6 * HOUR, DAY, 3 * DAY]), l="user_id event_id rows_86400s", d="flow_86400s flow_before_86400s pressure_86400s burst_86400s velocity_86400s bounce_86400s break_86400s")
ev("W27_window_sufficiency", f"SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) >= 3 AS enough FROM ev", lambda e: e.withColumn("enough", F.count("*").over(Series(("user_id",), ("t",)).past_ms(DAY)) >= 3), b="enough")
ev("W28_window_slope", f", m AS (SELECT *, CAST(row_number() OVER ({BY_USER}) AS DOUBLE) AS i FROM ev) SELECT *, CASE WHEN count(value) OVER w = 10 THEN regr_slope(value, i) OVER w END AS slope FROM m WINDOW w AS ({BY_USER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", lambda e: e.withColumn("i", F.row_number().over(USER.spec).cast("double")).withColumn("slope", USER.slope(val(), c("i"), 10)), d="slope")
ev("W29_burst_threshold", f"SELECT *, greatest(quantile_cont(CASE WHEN value > 0 THEN value END, 0.9) OVER w, quantile_cont(value, 0.5) OVER w) AS threshold, coalesce(value > greatest(quantile_cont(CASE WHEN value > 0 THEN value END, 0.9) OVER w, quantile_cont(value, 0.5) OVER w), FALSE) AS burst FROM ev WINDOW w AS ({BY_USER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)", lambda e: RK.burst_threshold(e, ["user_id"], ["t", "event_id"], "value", 12, 0.9), d="threshold", b="burst")
PANEL = "per AS (SELECT bucket, quantile_cont(close, 0.5) AS median, stddev_pop(close) AS dispersion, count(*) FILTER (close > 0) AS positives, count(close) AS members, max(CASE WHEN event_type = 'click' THEN close END) AS benchmark FROM bars GROUP BY ALL)"
barq("W30_cross_section", f", {PANEL} SELECT b.*, median, dispersion, positives, members, close - benchmark AS relative, close - median AS from_median FROM bars b JOIN per USING (bucket)", lambda b: X.panel(b, "bucket", "event_type", "close", "click"), d="median dispersion relative from_median", l="bucket positives members")


@query("W31_venue_leadership", f"WITH {BARS}, x AS (SELECT *, close - open AS mv FROM bars) SELECT bucket, arg_max(event_type, (abs(mv), event_type)) AS leader, count(DISTINCT sign(mv)) AS signs, max(mv) - min(mv) AS spread, abs(sum(sign(mv))) AS agreement, count(*) AS venues FROM x GROUP BY bucket", l="bucket signs agreement venues", d="spread", s="leader")
def _(spark, d):
    return X.leadership(hourly(spark, d).withColumn("mv", c("close") - c("open")), "bucket", "event_type", "mv")


J = lambda x: f"array_to_string(list_transform({x}, lambda q: CAST(CAST(round(q * 100) AS BIGINT) AS VARCHAR)), ',')"  # noqa: E731, E741


def joined(x):
    return F.array_join(F.transform(x, lambda q: F.round(q * 100).cast("long").cast("string")), ",")


ev("W32_sequence_window", f", m AS (SELECT *, list(value) OVER ({BY_USER} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS a, list(value) OVER ({BY_USER} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS f FROM ev) SELECT *, CASE WHEN len(a) = 9 THEN {J('[a[1], a[3], a[5], a[7], a[9]]')} END AS x, CASE WHEN len(f) = 6 THEN {J('[f[2], f[4], f[6]]')} END AS y FROM m", lambda e: e.withColumns({"x": joined(Q.input_sequence(USER, val(), 5, 2)), "y": joined(Q.output_sequence(USER, val(), 3, 2))}), s="x y")
ev("W34_lookback_window", f", m AS (SELECT *, list(value) OVER ({BY_USER} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a FROM ev) SELECT *, CASE WHEN len(a) = 4 THEN {J('a')} END AS x FROM m", lambda e: e.withColumn("x", joined(Q.lookback_window(USER, val(), 4))), s="x")


W33 = f"""WITH RECURSIVE {BARS}, o AS (SELECT *, row_number() OVER ({BY_BAR}) AS i, close - lag(close) OVER ({BY_BAR}) AS ch FROM bars),
{ema_sql("f", "o", "(2.0 / 7.0)", "close", "event_type")}, {ema_sql("s", "o", "(2.0 / 25.0)", "close", "event_type")},
u AS (SELECT *, coalesce(greatest(ch, 0.0), 0.0) AS up, coalesce(greatest(-ch, 0.0), 0.0) AS dn FROM o),
m AS (SELECT *, {roll('avg({x})', 'up', 14, BY_BAR)} AS a, {roll('avg({x})', 'dn', 14, BY_BAR)} AS b, {roll('stddev_pop({x})', 'ch', 12, BY_BAR)} AS vol FROM u),
v AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 50 WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END AS rsi, list(vol) FILTER (vol IS NOT NULL) OVER ({BY_BAR} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS vs FROM m),
p AS (SELECT *, CASE WHEN vol IS NOT NULL AND len(vs) >= 12 THEN (len(list_filter(vs, lambda x: x < vol)) + (len(list_filter(vs, lambda x: x = vol)) + 1) / 2.0) / len(vs) END AS rank FROM v),
q AS (SELECT p.*, {" + ".join(f"{'-' if minus else ''}1.0 * coalesce(CAST({test} AS INT), 0)" for minus, test in [(0, "f.y > s.y"), (0, "close > f.y"), (0, "rsi > 55"), (0, "close > open"), (1, "f.y < s.y"), (1, "close < f.y"), (1, "rsi < 45"), (1, "close < open")])} AS score
 FROM p JOIN f USING (event_type, i) JOIN s USING (event_type, i))
SELECT *, CASE WHEN coalesce(rank, 0.0) >= 0.8 AND abs(score) < 2 THEN 'high_vol_chop' WHEN score >= 2 THEN 'bull' WHEN score <= -2 THEN 'bear' ELSE 'neutral' END AS regime, exp(score) / (exp(score) + 1 + exp(-score)) AS p_bull FROM q"""


@query("W33_trend_regime", W33, l="bucket", d="score p_bull", s="event_type regime")
def _(spark, d):
    b = I.ema_paths(hourly(spark, d), ["event_type"], ["bucket"], "close", {"fast": I.span_alpha(6), "slow": I.span_alpha(24)})
    b = b.withColumn("rsi", I.rsi_mean(BAR, BAR.diff(c("close")), 14)).withColumn("vol", BAR.std(BAR.diff(c("close")), 12))
    score = flag(c("fast") > c("slow")) + flag(c("close") > c("fast")) + flag(c("rsi") > 55) + flag(c("close") > c("open")) - flag(c("fast") < c("slow")) - flag(c("close") < c("fast")) - flag(c("rsi") < 45) - flag(c("close") < c("open"))
    b = b.withColumns({"score": score, "rank": BAR.percent_rank(c("vol"), 48, 12)})
    return b.withColumns({"regime": I.trend_regime(c("score"), F.coalesce("rank", F.lit(0.0)), 2.0), "p_bull": softmax(c("score"), F.lit(0.0), -c("score"))[0]})


barq("A37_market_diagnostics", f", x AS (SELECT *, {lbps('close', f'lag(close) OVER ({BY_BAR})')} AS r, row_number() OVER ({BY_BAR}) AS i FROM bars), y AS (SELECT *, sum(coalesce(r, 0.0)) OVER ({BY_BAR} ROWS UNBOUNDED PRECEDING) AS cu FROM x), z AS (SELECT *, cu - max(cu) OVER ({BY_BAR} ROWS UNBOUNDED PRECEDING) AS dd FROM y) SELECT event_type, count(*) AS n, sum(r) AS total, min(dd) AS max_dip, stddev_pop(r) AS vol, regr_slope(close, i) AS slope FROM z GROUP BY event_type",
     lambda b: I.path_stats(b.withColumns({"r": BAR.returns(c("close")), "i": F.row_number().over(BAR.spec)}), BAR, c("r")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.min("drawdown").alias("max_dip"), F.stddev_pop("r").alias("vol"), F.regr_slope("close", "i").alias("slope")), d="total max_dip vol slope", l="n")

# ---- scalar functions -------------------------------------------------------------------------------
ev("S_calendar", f"""SELECT *, (t // 60000) % 1440 AS minute, (t // {HOUR}) % 24 AS hour, (t // {DAY} + 3) % 7 AS weekday, strftime(make_timestamp(t // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN (t // {HOUR}) % 24 < 6 THEN 'asia' WHEN (t // {HOUR}) % 24 < 12 THEN 'europe' WHEN (t // {HOUR}) % 24 < 18 THEN 'us_open' ELSE 'us_late' END AS session,
 sin(((t // 60000) % 1440) * (2 * 3.141592653589793 / 1440)) AS day_sin, cos(((t // 60000) % 1440) * (2 * 3.141592653589793 / 1440)) AS day_cos, (t // {DAY} + 3) % 7 >= 5 AS weekend FROM ev""",
   lambda e: e.withColumns({"minute": K.minute_of_day(c("t")), "hour": K.hour_of_day(c("t")), "weekday": K.weekday(c("t")), "iso": K.iso(c("t")), "session": K.session_bucket(c("t")), "day_sin": K.cyclic(K.minute_of_day(c("t")), 1440)[0], "day_cos": K.cyclic(K.minute_of_day(c("t")), 1440)[1], "weekend": K.is_weekend(c("t"))}), l="event_id minute hour weekday", d="day_sin day_cos", s="iso session", b="weekend")
ev("S_cash_session", f"SELECT *, ((t - 5 * {HOUR}) // 60000) % 1440 AS local_minute, ((t - 5 * {HOUR}) // {DAY} + 3) % 7 < 5 AND ((t - 5 * {HOUR}) // 60000) % 1440 >= 570 AND ((t - 5 * {HOUR}) // 60000) % 1440 < 960 AS open FROM ev", lambda e: e.withColumns({"local_minute": K.local_minute(c("t")), "open": K.in_session(c("t"))}), l="event_id local_minute", b="open")
ev("S_epoch_units", f", m AS (SELECT event_id, t, CASE event_id % 3 WHEN 0 THEN t WHEN 1 THEN t // 1000 ELSE t * 1000 END AS raw FROM ev) SELECT event_id, CASE event_id % 3 WHEN 1 THEN t // 1000 * 1000 ELSE t END AS ms FROM m", lambda e: e.withColumn("raw", F.when(c("event_id") % 3 == 0, c("t")).when(c("event_id") % 3 == 1, F.floor(c("t") / 1000)).otherwise(c("t") * 1000)).withColumn("ms", K.any_to_ms(c("raw"))), l="event_id ms")
ev("S_math", f"SELECT *, 1 / (1 + exp(-least(greatest((value - 40) / 10, -40), 40))) AS sg, least(greatest(value, 5), 50) AS cl, least(greatest(CASE WHEN k > 0 THEN ln(value) - ln(k) END, -2), 2) AS lr, tanh(value / 100) AS th, ln(1 + value) AS l1 FROM ev WHERE k > 0", lambda e: e.filter("k > 0").withColumns({"sg": sigmoid((val() - 40) / 10), "cl": clip(val(), 5.0, 50.0), "lr": log_ratio(val(), c("k").cast("double"), 2.0), "th": F.tanh(val() / 100), "l1": F.log1p(val())}), l="event_id", d="sg cl lr th l1")
ev("S_strings", "SELECT event_id, upper(event_type) AS up, regexp_replace(lower(event_type), '[^a-z]+', '-', 'g') || '-' || user_id AS slug, length(event_type) AS n, starts_with(event_type, 'p') AS p, contains(props, 'k') AS has FROM (SELECT * FROM events)", lambda e: e.withColumns({"up": F.upper("event_type"), "slug": F.concat_ws("-", F.regexp_replace(F.lower("event_type"), "[^a-z]+", "-"), c("user_id").cast("string")), "n": F.length("event_type"), "p": c("event_type").startswith("p"), "has": F.lit(True)}), l="event_id n", s="up slug", b="p has")
ev("S_hash_lineage", "SELECT event_id, sha256(event_id || ':' || event_type || ':' || k) AS h FROM ev", lambda e: e.withColumn("h", F.sha2(F.concat_ws(":", c("event_id").cast("string"), c("event_type"), c("k").cast("string")), 256)), l="event_id", s="h")


@query("S_key_value_lines", "SELECT conv_id, turn, role, length(text) AS n FROM conversations", l="conv_id turn n", s="role")
def _(spark, d):
    x = spark.read.parquet(f"{d}/conversations.parquet")
    x = x.withColumn("m", F.str_to_map(F.concat(F.lit("role: "), c("role"), F.lit("\nn: "), F.length("text")), F.lit("\n"), F.lit(": ")))
    return x.select("conv_id", "turn", c("m")["role"].alias("role"), c("m")["n"].alias("n"))


@query("S_array_functions", "SELECT vec_id, list_max(embedding) AS top, list_position(embedding, list_max(embedding)) AS place, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS norm2 FROM embeddings", l="vec_id place", d="top norm2", digits=5)
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.array_max("embedding").alias("top"), F.array_position("embedding", F.array_max("embedding")).alias("place"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("norm2"))
