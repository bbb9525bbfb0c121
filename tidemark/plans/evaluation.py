"""Evaluation, policy, diagnostics, sequential and simulation queries (A9-A51, P8-P21, D*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY, HOUR
from tidemark.operators import diagnostics as G
from tidemark.operators import metrics as M
from tidemark.operators import sequential as Q
from tidemark.plans.bars import BARS, hourly
from tidemark.plans.features import BAR, barq, ev
from tidemark.plans.labelling import placed
from tidemark.plans.registry import BY_TYPE, BY_USER, EV, USER, early, early_sql, events, query, ridge_sql, table

c = F.col


def val():
    return F.col("value")

PRED = f"""{EV}, pr AS (SELECT * FROM (SELECT *, lag(value) OVER ({BY_USER}) - 35.0 AS pred, value - 35.0 AS actual FROM ev) WHERE pred IS NOT NULL)"""


def next_3():
    return BAR.next_n(3)


def place_order():
    """A leaderboard holds one row per candidate, so one task ranks it."""
    return Window.orderBy((c("n") >= 50).desc(), c("mean").desc(), c("worst").desc(), "user_id")


def preds(spark, d):
    """Prediction and outcome pairs: the value before, against the value, both around 35."""
    return events(spark, d).withColumns({"pred": USER.lag(val()) - 35.0, "actual": val() - 35.0}).filter("pred is not null")


def pq(name, sql, fn, l="", d="", s="", b="", digits=6):  # noqa: E741
    @query(name, f"WITH {PRED} {sql}", l=l, d=d, s=s, b=b, digits=digits)
    def _(spark, sf_dir):
        return fn(preds(spark, sf_dir))


MULT = "CASE WHEN abs(pred) > 10 THEN CAST(sign(pred) AS INT) ELSE 0 END"
pq("P8_policy_mask", "SELECT event_id, CASE WHEN pred > 10 THEN 1 ELSE 0 END AS direct_gt, CASE WHEN pred < -10 THEN 1 ELSE 0 END AS inverse_lt, CASE WHEN abs(pred) > 10 THEN CAST(sign(pred) AS INT) ELSE 0 END AS abs_gt FROM pr", lambda p: p.withColumns({k: M.policy_multiplier(c("pred"), k, 10.0) for k in ("direct_gt", "inverse_lt", "abs_gt")}), l="event_id direct_gt inverse_lt abs_gt")
pq("P9_policy_scores", f", m AS (SELECT *, {MULT} AS multiplier FROM pr), n AS (SELECT *, CASE WHEN multiplier <> 0 THEN 1 ELSE 0 END AS selected, multiplier * actual AS gross FROM m) SELECT *, selected * 4.0 AS cost, gross - selected * 4.0 AS net FROM n", lambda p: M.score_policy(p, "pred", "actual", "abs_gt", 10.0, 4.0), l="event_id selected multiplier", d="gross cost net")
pq("P10_regime_filter", ", q AS (SELECT quantile_cont(actual, 0.5) AS med FROM pr) SELECT event_id, CASE WHEN k / 100.0 >= 0.67 THEN 'high_vol' WHEN k / 100.0 <= 0.33 THEN 'low_vol' WHEN actual > med THEN 'trending' ELSE 'ranging' END AS regime FROM pr, q", lambda p: p.crossJoin(p.agg(F.percentile("actual", 0.5).alias("med"))).withColumn("regime", M.regime_filter(c("k") / 100.0, c("actual"), c("med"))), l="event_id", s="regime")
P3 = "p3 AS (SELECT *, k / 100.0 AS pb, 1 - k / 100.0 - least(k, 100 - k) / 200.0 AS ps, least(k, 100 - k) / 200.0 AS pn FROM pr)"


def three(p):
    k = c("k").cast("double")
    return p.withColumns({"pb": k / 100.0, "pn": F.least(k, 100 - k) / 200.0}).withColumn("ps", 1 - k / 100.0 - c("pn"))


pq("P19_three_class_decode", f", {P3} SELECT event_id, CASE WHEN greatest(pb, ps) >= 0.5 AND greatest(pb, ps) - pn >= 0.2 THEN CASE WHEN pb > ps THEN 'buy' ELSE 'sell' END ELSE 'neutral' END AS side FROM p3 WHERE abs(pb - ps) > 1e-9 AND abs(greatest(pb, ps) - pn - 0.2) > 1e-9", lambda p: three(p).filter((F.abs(c("pb") - c("ps")) > 1e-9) & (F.abs(F.greatest("pb", "ps") - c("pn") - 0.2) > 1e-9)).withColumn("side", M.decode_three(c("pb"), c("pn"), c("ps"), 0.5, 0.2)), l="event_id", s="side")
pq("P20_disagreement", "SELECT event_id, sign(pred) <> sign(k - 50) AND k <> 50 AS disagree FROM pr", lambda p: p.withColumn("disagree", (F.signum("pred") != F.signum((c("k") - 50).cast("double"))) & (c("k") != 50)), l="event_id", b="disagree")
pq("P21_gates", "SELECT event_id, CASE WHEN least(pred, k - 50, 20.0 - abs(pred)) > 0 THEN 1 ELSE 0 END AS all_positive, CASE WHEN least(pred, k - 50, 20.0 - abs(pred)) > 5 THEN 1 ELSE 0 END AS min_above, CASE WHEN pred > 5 AND k - 50 > 0 THEN 1 ELSE 0 END AS primary_secondary FROM pr", lambda p: p.withColumns(M.gates([c("pred"), (c("k") - 50).cast("double"), 20.0 - F.abs("pred")], 5.0)), l="event_id all_positive min_above primary_secondary")
NET = f"nt AS (SELECT *, sign(pred) * actual - 4.0 AS net, t // {DAY} AS day FROM pr)"


def net(p):
    return p.withColumns({"net": F.signum("pred") * c("actual") - 4.0, "day": F.floor(c("t") / DAY)})


pq("A9_grouped_report", f", {NET} SELECT event_type, day, count(net) AS n, sum(net) AS total, avg(net) AS mean, quantile_cont(net, 0.5) AS median, max(net) AS best, min(net) AS worst, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS positive_share FROM nt GROUP BY ALL", lambda p: M.grouped_report(net(p), ["event_type", "day"], "net"), l="day n", d="total mean median best worst positive_share", s="event_type", digits=9)
pq("A10_macro_average", f", {NET}, g AS (SELECT user_id, sum(net) AS s, count(net) AS n FROM nt GROUP BY ALL) SELECT sum(s) / sum(n) AS row_weighted, avg(s / n) AS equal_group, count(*) AS groups_n FROM g", lambda p: M.macro_average(net(p), "user_id", "net").withColumnRenamed("groups", "groups_n"), l="groups_n", d="row_weighted equal_group")
pq("A11_best_and_worst_rows", f", {NET} SELECT user_id, arg_max(event_id, (net, event_id)) AS best_id, arg_min(event_id, (net, event_id)) AS worst_id FROM nt GROUP BY ALL", lambda p: M.best_row(net(p), ["user_id"], [c("net"), c("event_id")]).select("user_id", c("event_id").alias("best_id")).join(M.best_row(net(p), ["user_id"], [c("net"), c("event_id")], worst=True).select("user_id", c("event_id").alias("worst_id")), "user_id"), l="user_id best_id worst_id")
ev("A12_distinct_mode_counts", ", g AS (SELECT user_id, k, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT user_id, arg_max(k, (n, k)) AS mode_k FROM g GROUP BY ALL) SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT k) AS ks, count(*) AS n, any_value(mode_k) AS mode_k FROM ev JOIN m USING (user_id) GROUP BY user_id", lambda e: M.distinct_and_mode(e, ["user_id"], {"kinds": "event_type", "ks": "k"}, "k"), l="user_id kinds ks n mode_k")
BLOCKS = "g AS (SELECT event_type, {block} AS b, sum(net) AS x FROM nt GROUP BY ALL), h AS (SELECT event_type, count(*) AS blocks, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction, max(x) AS best, min(x) AS worst, quantile_cont(x, 0.5) AS median, CASE WHEN sum(greatest(x, 0)) = 0 THEN 0 ELSE max(greatest(x, 0)) / sum(greatest(x, 0)) END AS max_positive_share FROM g GROUP BY ALL) SELECT *, CASE WHEN positive_fraction >= 0.5 AND median > 0 AND max_positive_share <= 0.5 THEN 1 ELSE 0 END AS passed FROM h"
pq("A14_day_blocks", f", {NET}, " + BLOCKS.format(block="day"), lambda p: M.window_blocks(net(p), ["event_type"], c("day"), "net"), l="blocks passed", d="positive_fraction best worst median max_positive_share", s="event_type")
pq("A13_weighted_blocks", f", {NET}, " + BLOCKS.format(block=f"(t - 1704067200000) // {3 * DAY}"), lambda p: M.window_blocks(net(p), ["event_type"], F.floor((c("t") - 1704067200000) / (3 * DAY)), "net"), l="blocks passed", d="positive_fraction best worst median max_positive_share", s="event_type")
pq("A48_contract_survivors", f", {NET}, " + BLOCKS.format(block="day").replace("SELECT event_type,", "SELECT user_id AS event_type,", 1) + " WHERE positive_fraction >= 0.4", lambda p: M.window_blocks(net(p).withColumn("event_type", c("user_id").cast("string")), ["event_type"], c("day"), "net").filter("positive_fraction >= 0.4"), l="blocks passed", d="positive_fraction worst", s="event_type")
ev("A15_quantile_battery", "SELECT event_type, " + ", ".join(f"quantile_cont(value, {q}) AS p{round(q * 100):02d}" for q in (0.1, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM ev GROUP BY ALL", lambda e: M.quantile_battery(e, ["event_type"], "value"), l="", d="p10 p50 p75 p90 p95 p99", s="event_type")
barq("A16_opportunity_report", ", m AS (SELECT event_type, (max(high) OVER w / close - 1) * 1e4 AS up, (lead(close, 3) OVER (PARTITION BY event_type ORDER BY bucket) / close - 1) * 1e4 AS fin, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) SELECT event_type, avg(up) AS mean_up, avg(fin) AS mean_end, avg(CASE WHEN up > 5000 THEN 1.0 ELSE 0.0 END) AS opportunity, count(*) AS n FROM m WHERE n = 3 GROUP BY ALL",
     lambda b: b.withColumns({"up": (F.max("high").over(next_3()) / c("close") - 1) * 1e4, "fin": (F.lead("close", 3).over(BAR.spec) / c("close") - 1) * 1e4, "n": F.count("*").over(next_3())}).filter("n = 3").groupBy("event_type").agg(F.avg("up").alias("mean_up"), F.avg("fin").alias("mean_end"), F.avg((c("up") > 5000).cast("double")).alias("opportunity"), F.count("*").alias("n")), l="n", d="mean_up mean_end opportunity")
pq("A17_expectancy", f", {NET}, q AS (SELECT *, sum(net) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS cu FROM nt), r AS (SELECT *, cu - max(cu) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS dip FROM q) SELECT user_id, count(net) AS n, avg(net) AS mean, sum(net) AS total, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(dip) AS max_dip, avg(CASE WHEN net > 0 THEN net END) / avg(CASE WHEN net < 0 THEN -net END) AS payoff FROM r GROUP BY ALL", lambda p: M.expectancy(net(p), ["user_id"], ["t", "event_id"], "net"), l="user_id n", d="mean total win_rate max_dip payoff")
GRID = "g(threshold, cost) AS (SELECT a, b FROM (VALUES (0.0), (5.0), (10.0), (20.0)) x(a), (VALUES (0.0), (4.0)) y(b))"
pq("A31_threshold_cost_sweep", f", {GRID} SELECT event_type, threshold, cost, count(*) AS n, avg(sign(pred) * actual - cost) AS mean_net, sum(sign(pred) * actual - cost) AS total_net, avg(CASE WHEN sign(pred) * actual - cost > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM pr, g WHERE abs(pred) > threshold GROUP BY ALL", lambda p: M.threshold_sweep(p, ["event_type"], "pred", "actual", [0.0, 5.0, 10.0, 20.0], [0.0, 4.0]), l="n", d="threshold cost mean_net total_net win_rate", s="event_type")
pq("A18_strategy_metrics", ", g(threshold) AS (VALUES (1.0), (0.0), (2.0), (3.0), (5.0)) SELECT threshold, count(*) AS n, avg(sign(pred) * actual - 0.0) AS mean_net, avg(CASE WHEN sign(pred) * actual > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM pr, g WHERE abs(pred) > threshold GROUP BY ALL", lambda p: M.threshold_sweep(p, [], "pred", "actual", [1.0, 0.0, 2.0, 3.0, 5.0]), l="n", d="threshold mean_net win_rate")
pq("A19_association", "SELECT event_type, corr(pred, actual) AS corr_xy, covar_pop(pred, actual) AS cov, regr_slope(actual, pred) AS slope, regr_intercept(actual, pred) AS intercept, regr_r2(actual, pred) AS r2 FROM pr GROUP BY ALL", lambda p: M.association(p, ["event_type"], "pred", "actual").withColumnRenamed("corr", "corr_xy"), d="corr_xy cov slope intercept r2", s="event_type", digits=5)
A20 = f""", f AS (SELECT event_type, regr_slope(actual, pred) AS a, regr_intercept(actual, pred) AS b FROM pr WHERE {early_sql("pr")} GROUP BY ALL)
SELECT event_type, avg(abs(actual - (a * pred + b))) AS mae, 1 - sum((actual - (a * pred + b)) ** 2) / (var_pop(actual) * count(*)) AS r2
FROM pr JOIN f USING (event_type) WHERE NOT ({early_sql("pr")}) GROUP BY ALL"""


def fitted_line(p):
    """Slope and intercept of the early rows, judged on the later ones."""
    train = early(p)
    line = M.association(p.filter(train), ["event_type"], "pred", "actual").select("event_type", "slope", "intercept")
    rest = p.filter(~train).join(line, "event_type").withColumn("e", c("actual") - (c("slope") * c("pred") + c("intercept")))
    return rest.groupBy("event_type").agg(F.avg(F.abs("e")).alias("mae"), (1 - F.sum(c("e") * c("e")) / (F.var_pop("actual") * F.count("*"))).alias("r2"))


pq("A20_univariate_ols", A20, fitted_line, d="mae r2", s="event_type", digits=5)
CONF = "count(*) FILTER (actual > 0 AND pred > 0) AS tp, count(*) FILTER (actual <= 0 AND pred > 0) AS fp, count(*) FILTER (actual <= 0 AND pred <= 0) AS tn, count(*) FILTER (actual > 0 AND pred <= 0) AS fn"
pq("A21_confusion", f", m AS (SELECT event_type, {CONF} FROM pr GROUP BY ALL) SELECT *, tp / (tp + fp) AS prec, tp / (tp + fn) AS rec, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM m", lambda p: M.confusion(p, ["event_type"], c("actual") > 0, c("pred") > 0).withColumnsRenamed({"precision": "prec", "recall": "rec"}), l="tp fp tn fn", d="prec rec balanced_accuracy", s="event_type")
pq("A22_error_metrics", "SELECT event_type, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) ** 2)) AS rmse, avg(pred - actual) AS bias, avg(abs(0 - actual)) AS baseline_mae, 1 - avg(abs(pred - actual)) / avg(abs(0 - actual)) AS skill FROM pr GROUP BY ALL", lambda p: M.errors(p, ["event_type"], "pred", "actual", F.lit(0.0)), d="mae rmse bias baseline_mae skill", s="event_type")
PY = "py AS (SELECT *, k / 100.0 AS p, CASE WHEN actual > 0 THEN 1 ELSE 0 END AS y FROM pr)"


def prob(p):
    return p.withColumns({"p": c("k") / 100.0, "y": (c("actual") > 0).cast("int")})


pq("A22b_probability_scores", f", {PY}, z AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM py) SELECT event_type, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss FROM z GROUP BY ALL", lambda p: M.probability_scores(prob(p), ["event_type"], "p", "y"), d="brier log_loss", s="event_type")
REL = f"{PY}, rel AS (SELECT event_type, least(k * 10 // 100, 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM py GROUP BY ALL)"
pq("A23_reliability_table", f", {REL} SELECT * FROM rel", lambda p: M.reliability(prob(p).withColumn("p", c("k") / 100.0 + 1e-12), ["event_type"], "p", "y"), l="bin n", d="mean_p rate", s="event_type")
pq("A23b_calibration_error", f", {REL} SELECT event_type, sum(abs(mean_p - rate) * n) / sum(n) AS ece, max(abs(mean_p - rate)) AS mce FROM rel GROUP BY ALL", lambda p: M.calibration_error(prob(p).withColumn("p", c("k") / 100.0 + 1e-12), ["event_type"], "p", "y"), d="ece mce", s="event_type")
pq("A24_rank_auc", f", {PY}, r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS rk FROM py) SELECT event_type, sum(y) AS positives, sum(1 - y) AS negatives, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY ALL", lambda p: M.rank_auc(prob(p), ["event_type"], "k", "y"), l="positives negatives", d="auc", s="event_type")
pq("A24b_average_precision", f", {PY}, g AS (SELECT event_type, k, sum(y) AS p, count(*) AS n FROM py GROUP BY ALL), h AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (PARTITION BY event_type ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) SELECT event_type, sum(n) AS n, sum(tp / al * p) / sum(p) AS average_precision, sum(tp / al * p) / sum(p) / (sum(p) / sum(n)) AS lift FROM h GROUP BY ALL", lambda p: M.average_precision(prob(p), ["event_type"], "k", "y"), l="n", d="average_precision lift", s="event_type")


@query("A24c_label_auc", "WITH x AS (SELECT quality AS y, n_chars AS sc FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0 AS rk FROM x) SELECT sum(y) AS positives, sum(1 - y) AS negatives, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r", l="positives negatives", d="auc")
def _(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.rank_auc(x, [], "n_chars", "quality")


@query("A25_feature_audit", f"WITH {BARS}, l AS (SELECT 'open' AS feature, open AS x FROM bars UNION ALL SELECT 'close', close FROM bars UNION ALL SELECT 'volume', volume FROM bars) SELECT feature, count(x) / count(*) AS finite_share, min(x) AS least, max(x) AS most, avg(x) AS mean, stddev_pop(x) AS std, avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END) AS negative_share FROM l GROUP BY feature", d="finite_share least most mean std negative_share", s="feature", digits=5)
def _(spark, d):
    return M.feature_audit(hourly(spark, d), ["open", "close", "volume"])


ev("A26_data_quality", f", m AS (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS s, t - lag(t) OVER ({BY_TYPE}) AS g FROM ev) SELECT event_type, count(*) AS n, count(*) FILTER (g = 0) AS duplicates, count(*) FILTER (s < 0) AS disorder, count(*) FILTER (g > {HOUR}) AS gaps, max(g) AS largest_gap, quantile_cont(CASE WHEN g > 0 THEN g END, 0.5) AS median_gap FROM m GROUP BY ALL", lambda e: M.data_quality(e, ["event_type"], "t", "event_id", HOUR), l="n duplicates disorder gaps largest_gap", d="median_gap", s="event_type")
ev("A27_cadence_coverage", f", m AS (SELECT *, t - lag(t) OVER ({BY_USER}) AS g FROM ev) SELECT user_id, quantile_cont(CASE WHEN g > 0 THEN g END, 0.5) AS cadence, count(*) * quantile_cont(CASE WHEN g > 0 THEN g END, 0.5) / (max(t) - min(t)) AS coverage FROM m GROUP BY user_id", lambda e: e.withColumn("g", USER.diff(c("t"))).groupBy("user_id").agg(F.percentile(F.when(c("g") > 0, c("g")), 0.5).alias("cadence"), (F.count("*") * F.percentile(F.when(c("g") > 0, c("g")), 0.5) / (F.max("t") - F.min("t"))).alias("coverage")), l="user_id", d="cadence coverage")
barq("A28_contiguous_suffix", f", m AS (SELECT *, CASE WHEN bucket - lag(bucket) OVER w = {HOUR} THEN 0 ELSE 1 END AS br FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY bucket)), i AS (SELECT *, sum(br) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS isl FROM m), g AS (SELECT event_type, isl, count(*) AS suffix, min(bucket) AS from_t, max(bucket) AS to_t FROM i GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY isl DESC) = 1", lambda b: M.contiguous_suffix(b, ["event_type"], "bucket", HOUR), l="suffix from_t to_t", d="")
GAPS = "l AS (SELECT 'value' AS feature, event_type, value AS x FROM ev UNION ALL SELECT 'k', event_type, k FROM ev), {a}, {b} SELECT a.*, n_b, mean_b, std_b, p10_b, p50_b, p90_b, mean_a - mean_b AS mean_gap, (mean_a - mean_b) / abs(mean_b) AS relative_gap FROM a JOIN b USING (feature)"
SIDE = "{t} AS (SELECT feature, count(x) AS n_{t}, avg(x) AS mean_{t}, stddev_pop(x) AS std_{t}, quantile_cont(x, 0.1) AS p10_{t}, quantile_cont(x, 0.5) AS p50_{t}, quantile_cont(x, 0.9) AS p90_{t} FROM l WHERE event_type = '{k}' GROUP BY feature)"
ev("A29_distribution_gap", ", " + GAPS.format(a=SIDE.format(t="a", k="click"), b=SIDE.format(t="b", k="view")), lambda e: M.distribution_gap(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["value", "k"]), l="n_a n_b", d="mean_a std_a p10_a p50_a p90_a mean_b std_b p10_b p50_b p90_b mean_gap relative_gap", s="feature")


@query("A30_bootstrap_interval", d="low middle high")
def _(spark, d):
    return M.interval(M.bootstrap_means(net(preds(spark, d)), "net", c("day"), 200))


pq("A32_leaderboard", f", {NET}, g AS (SELECT user_id, count(*) AS n, avg(net) AS mean, min(net) AS worst FROM nt GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY n >= 50 DESC, mean DESC, worst DESC, user_id) AS place FROM g", lambda p: net(p).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.min("net").alias("worst")).withColumn("place", F.row_number().over(place_order())), l="user_id n place", d="mean worst")
ev("A33_group_transform", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, d.kinds FROM ev JOIN (SELECT user_id, count(DISTINCT k) AS kinds FROM ev GROUP BY user_id) d USING (user_id)", lambda e: M.group_transform(e, ["user_id"], [F.count("*").alias("n"), F.countDistinct("k").alias("kinds")]), l="event_id n kinds")
ev("A35_lineage_strings", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS lineage FROM ev GROUP BY user_id", lambda e: M.joined_values(e, ["user_id"], "event_type", "lineage"), l="user_id", s="lineage")
FIT = f", {NET}, b AS (SELECT user_id, day, sum(net) AS x FROM nt GROUP BY ALL), g AS (SELECT user_id, quantile_cont(x, 0.5) AS med, min(x) AS worst, count(*) AS n FROM b GROUP BY ALL), f AS (SELECT *, med + 0.75 * worst - 0.1 * abs(n - 20) AS fitness FROM g)"


def fitness(p):
    b = net(p).groupBy("user_id", "day").agg(F.sum("net").alias("x"))
    g = b.groupBy("user_id").agg(F.percentile("x", 0.5).alias("med"), F.min("x").alias("worst"), F.count("*").alias("n"))
    return g.withColumn("fitness", c("med") + 0.75 * c("worst") - 0.1 * F.abs(c("n") - 20))


pq("A36_fitness_survivors", FIT + ", o AS (SELECT *, row_number() OVER (ORDER BY fitness DESC, user_id) AS rk, count(*) OVER () AS m FROM f WHERE n >= 15) SELECT * FROM o WHERE rk <= greatest(5, ceil(m * 0.2))", lambda p: M.survivors(fitness(p), c("n") >= 15, "fitness", "user_id", 0.2, 5).withColumnRenamed("rank", "rk"), l="user_id n rk", d="fitness")
pq("A38_loss_attribution", f", {NET} SELECT CASE WHEN net >= 0 THEN 'win' WHEN actual > 20 THEN 'spike' WHEN net > -6 THEN 'cost' ELSE 'wrong_side' END AS reason, count(*) AS n, sum(net) AS total FROM nt GROUP BY ALL", lambda p: net(p).groupBy(F.when(c("net") >= 0, "win").when(c("actual") > 20, "spike").when(c("net") > -6, "cost").otherwise("wrong_side").alias("reason")).agg(F.count("*").alias("n"), F.sum("net").alias("total")), l="n", d="total", s="reason")
pq("A39_adjusted_skewness", "SELECT event_type, skewness(pred) AS skew FROM pr GROUP BY ALL", lambda p: p.groupBy("event_type").agg(M.adjusted_skewness("pred").alias("skew")), d="skew", s="event_type")
pq("A40_direction_baselines", "SELECT event_type, avg(CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END) AS always_long, avg(CASE WHEN actual < 0 THEN 1.0 ELSE 0.0 END) AS always_short, greatest(avg(CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN actual < 0 THEN 1.0 ELSE 0.0 END)) AS majority, avg(CASE WHEN sign(actual) = sign(pred) THEN 1.0 ELSE 0.0 END) AS momentum FROM pr GROUP BY ALL", lambda p: M.direction_baselines(p, ["event_type"], "pred", "actual"), d="always_long always_short majority momentum", s="event_type")
ev("A41_fixed_buckets", ", m AS (SELECT CASE WHEN k % 7 <> 0 THEN value END AS x FROM ev) SELECT CASE WHEN x IS NULL THEN 'missing' WHEN x < 10 THEN '<10' WHEN x < 50 THEN '[10,50)' WHEN x < 100 THEN '[50,100)' ELSE '>=100' END AS bucket, count(*) AS n FROM m GROUP BY ALL", lambda e: e.groupBy(M.fixed_buckets(F.when(c("k") % 7 != 0, val()), [10.0, 50.0, 100.0]).alias("bucket")).agg(F.count("*").alias("n")), l="n", s="bucket")
pq("A43_composite_score", FIT + " SELECT user_id, med + 0.5 * worst - CASE WHEN n < 18 THEN 10 ELSE 0 END AS score, array_to_string(list_filter([CASE WHEN n < 18 THEN 'few_days' END, CASE WHEN worst < -200 THEN 'deep_loss' END, CASE WHEN med < 0 THEN 'negative_median' END], lambda x: x IS NOT NULL), ';') AS reasons FROM f", lambda p: fitness(p).withColumns({"score": c("med") + 0.5 * c("worst") - F.when(c("n") < 18, 10).otherwise(0), "reasons": M.reasons({"few_days": c("n") < 18, "deep_loss": c("worst") < -200, "negative_median": c("med") < 0})}), l="user_id", d="score", s="reasons")
ev("A45_series_eligibility", f", g AS (SELECT user_id, count(*) AS n, count(DISTINCT t // {DAY}) AS days, count(*) FILTER (event_type = 'purchase') AS p FROM ev GROUP BY ALL) SELECT user_id, array_to_string(list_filter([CASE WHEN n < 60 THEN 'rows' END, CASE WHEN days < 25 THEN 'days' END, CASE WHEN p < 10 THEN 'outcomes' END], lambda x: x IS NOT NULL), ';') AS reasons FROM g", lambda e: e.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.floor(c("t") / DAY)).alias("days"), F.count_if(c("event_type") == "purchase").alias("p")).withColumn("reasons", M.reasons({"rows": c("n") < 60, "days": c("days") < 25, "outcomes": c("p") < 10})), l="user_id", s="reasons")
A46 = f""", s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, avg(k) AS mk, stddev_pop(k) AS sk FROM ev WHERE {early_sql(share=0.5)}),
z AS (SELECT 'value' AS feature, (value - m) / sd AS z FROM ev, s WHERE NOT ({early_sql(share=0.5)}) UNION ALL SELECT 'k', (k - mk) / sk FROM ev, s WHERE NOT ({early_sql(share=0.5)}))
SELECT feature, avg(z) AS z_mean, stddev_pop(z) AS z_std, avg(CASE WHEN abs(z) > 3 THEN 1.0 ELSE 0.0 END) AS over_3, avg(CASE WHEN abs(z) > 5 THEN 1.0 ELSE 0.0 END) AS over_5 FROM z GROUP BY feature"""


def feature_drift(e):
    train = early(e, 0.5)
    return M.drift(e.filter(~train), G.fit_scaler(e.filter(train), ["value", "k"]), ["value", "k"])


ev("A46_feature_drift", A46, feature_drift, l="", d="z_mean z_std over_3 over_5", s="feature")
ev("A47_column_profile", ", g AS (SELECT event_type, k, count(*) AS n FROM ev GROUP BY ALL) SELECT event_type, arg_max(k, (n, k)) AS mode_k, max(n) AS mode_n, count(*) AS distinct_k FROM g GROUP BY event_type", lambda e: e.groupBy("event_type", "k").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.max_by("k", F.struct("n", "k")).alias("mode_k"), F.max("n").alias("mode_n"), F.count("*").alias("distinct_k")), l="mode_k mode_n distinct_k", s="event_type")
pq("A49_lexicographic_selection", f", {GRID}, sw AS (SELECT event_type, threshold, count(*) AS n, avg(sign(pred) * actual) AS mean FROM pr, (SELECT DISTINCT threshold FROM g) WHERE abs(pred) > threshold GROUP BY ALL) SELECT event_type, arg_max(threshold, (n >= 300, mean, -threshold)) AS threshold, max(n >= 300) AS enough FROM sw GROUP BY event_type", lambda p: M.best_row(M.threshold_sweep(p, ["event_type"], "pred", "actual", [0.0, 5.0, 10.0, 20.0]).withColumn("enough", c("n") >= 300), ["event_type"], [c("enough"), c("mean_net"), -c("threshold")]), d="threshold", s="event_type", b="enough")
ev("A50_tertile_regime", ", q AS (SELECT event_type, quantile_cont(value, 1 / 3) AS a, quantile_cont(value, 2 / 3) AS b FROM ev GROUP BY ALL) SELECT event_id, CASE WHEN value <= a THEN 'low' WHEN value > b THEN 'high' ELSE 'mid' END AS bucket FROM ev JOIN q USING (event_type)", lambda e: M.tertile(e, ["event_type"], "value"), l="event_id", s="bucket")
ev("A51_label_availability", f", m AS (SELECT event_id, lead(value, 1) OVER w AS a, lead(value, 5) OVER w AS b, lead(value, 10) OVER w AS c3 FROM ev WINDOW w AS ({BY_USER})) SELECT event_id, CASE WHEN a IS NULL AND b IS NULL AND c3 IS NULL THEN 'none' WHEN a IS NOT NULL AND b IS NOT NULL AND c3 IS NOT NULL THEN 'all' ELSE 'partial' END AS state FROM m", lambda e: e.withColumns({"a": USER.lead(val(), 1), "b": USER.lead(val(), 5), "c3": USER.lead(val(), 10)}).withColumn("state", M.availability(["a", "b", "c3"])), l="event_id", s="state")
ev("S_quantile_bins", ", q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c3 FROM ev) SELECT event_id, CAST(value > a AS INT) + CAST(value > b AS INT) + CAST(value > c3 AS INT) AS bin FROM ev, q", lambda e: M.quantile_bins(e, "value", 4), l="event_id bin")

# ---- sequential, costs, diagnostics, models ---------------------------------------------------------
D1 = f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER ({BY_USER}) AS i FROM ev), s AS (SELECT user_id, t, event_id FROM o WHERE i = 1 UNION ALL
SELECT s.user_id, n.t, n.event_id FROM s, LATERAL (SELECT t, event_id FROM ev e WHERE e.user_id = s.user_id AND e.t >= s.t + {2 * DAY} ORDER BY t, event_id LIMIT 1) n) SELECT * FROM s"""


@query("D1_non_overlapping_selection", D1, l="user_id t event_id")
def _(spark, d):
    return Q.non_overlapping(events(spark, d), ["user_id"], "t", "event_id", 2 * DAY)


@query("D5_position_simulation", f"WITH {D1[len('WITH '):].replace('SELECT * FROM s', '')} SELECT s.user_id, count(*) AS trades, sum(ev.value - 35.0) AS pnl FROM s JOIN ev ON ev.event_id = s.event_id GROUP BY s.user_id", l="user_id trades", d="pnl")
def _(spark, d):
    e = events(spark, d)
    taken = Q.non_overlapping(e, ["user_id"], "t", "event_id", 2 * DAY).select("event_id")
    return e.join(taken, "event_id").groupBy("user_id").agg(F.count("*").alias("trades"), F.sum(val() - 35.0).alias("pnl"))


@query("D2_cooldown_after_loss", l="event_id taken", s="reason")
def _(spark, d):
    return Q.guarded(net(preds(spark, d)).select("user_id", "event_id", "t", "net"), ["user_id"], "t", "net", HOUR, DAY, seq="event_id")


@query("D4_drawdown_guard", l="event_id taken", s="reason")
def _(spark, d):
    return Q.guarded(net(preds(spark, d)).select("user_id", "event_id", "t", "net"), ["user_id"], "t", "net", HOUR, 0, 150.0, seq="event_id")


ev("D3_density_limit", f", m AS (SELECT *, CASE WHEN value > 40 THEN 1 ELSE 0 END AS sig FROM ev) SELECT event_id, CASE WHEN sig = 1 AND coalesce(sum(sig) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), 0) < 4 THEN 1 ELSE 0 END AS kept FROM m", lambda e: Q.density_limited(e, ["user_id"], ["t", "event_id"], val() > 40, 10, 4), l="event_id kept")


@query("D6_ladder_sweep", l="config_id fills profits stops timeouts rebalances halted open", d="net_bps max_drawdown_bps", s="event_type")
def _(spark, d):
    grid = [Q.Ladder(i, rungs=r, spacing_bps=s, take_profit_bps=p, stop_bps=9000.0, timeout_ms=12 * HOUR, rebalance_ms=6 * HOUR) for i, (r, s, p) in enumerate((r, s, p) for r in (2, 4) for s in (500.0, 1500.0) for p in (800.0, 3000.0))]
    return Q.ladder_sweep(events(spark, d), ["event_type"], "t", "event_id", "value", grid)


ev("D8_dynamic_costs", "SELECT event_id, 1.5 + value / 100 + CASE WHEN k < 20 THEN 1.0 ELSE 0.0 END + CASE WHEN abs((k - 50) / 50.0) > 0.6 THEN 0.5 ELSE 0.0 END + CASE WHEN event_type <> 'error' THEN 0.0 ELSE 2.0 END AS cost FROM ev", lambda e: e.withColumn("cost", Q.dynamic_cost(1.5, val() / 100, c("k").cast("double"), (c("k") - 50) / 50.0, c("event_type") != "error", 20.0)), l="event_id", d="cost")
F4 = ["value", "k", "m5", "l1"]


def four(e):
    return e.withColumns({"m5": USER.mean(val(), 5), "l1": USER.lag(val())}).withColumn("k", c("k").cast("double"))


M4 = f", m AS (SELECT *, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS m5, lag(value) OVER ({BY_USER}) AS l1 FROM ev WINDOW w AS ({BY_USER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM m" for i, a in enumerate(sorted(F4)) for b in sorted(F4)[i + 1 :])
ev("D9_feature_correlations", f"{M4} {PAIRS}", lambda e: G.correlations(four(e), F4).withColumnRenamed("corr", "r"), l="", d="r", s="a b")


D9B = f"""WITH RECURSIVE {EV} {M4}, pairs AS ({PAIRS}), near AS (SELECT a, b FROM pairs WHERE abs(r) >= 0.4 UNION ALL SELECT b, a FROM pairs WHERE abs(r) >= 0.4),
reach(feature, other) AS (SELECT f, f FROM (SELECT unnest({F4}) AS f) UNION SELECT reach.feature, near.b FROM reach JOIN near ON near.a = reach.other)
SELECT feature, min(other) AS representative FROM reach GROUP BY feature"""


@query("D9b_redundancy_clusters", D9B, s="feature representative")
def _(spark, d):
    found = G.redundancy_clusters(G.correlations(four(events(spark, d)), F4), F4, 0.4)
    return spark.createDataFrame(sorted(found.items()), "feature string, representative string")


@query("D10_block_stability", f"WITH {EV}, p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM ev), g AS (SELECT least(i * 6 // n, 5) AS b, avg(value) AS m, corr(value, k) AS r FROM p GROUP BY ALL) SELECT count(*) AS blocks, stddev_pop(m) / abs(avg(m)) AS mean_cv, abs(sum(sign(r))) / count(r) AS sign_stability FROM g", l="blocks", d="mean_cv sign_stability")
def _(spark, d):
    e, n = placed(spark, d)
    return G.block_stability(e, "i", n, "value", "k")


ev("D11_keep_decision", "SELECT event_id, CASE WHEN k % 11 = 0 THEN 'invalid' WHEN value > 100 THEN 'redundant' WHEN value < 2 THEN 'unstable' ELSE 'keep' END AS decision FROM ev", lambda e: e.withColumn("decision", G.decision(c("k") % 11 == 0, val() > 100, val() < 2)), l="event_id", s="decision")
ev("D12_weighted_ensemble", f"{M4} SELECT event_id, (coalesce(value * 0.5, 0) + coalesce(m5 * 0.3, 0) + coalesce(l1 * 0.2, 0)) / (0.5 + CASE WHEN m5 IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN l1 IS NOT NULL THEN 0.2 ELSE 0 END) AS blend FROM m", lambda e: four(e).withColumn("blend", G.ensemble({"value": 0.5, "m5": 0.3, "l1": 0.2})), l="event_id", d="blend")
ev("D13_train_scaler", f", s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM ev WHERE {early_sql()}) SELECT event_id, (value - m) / sd AS value_z FROM ev, s", lambda e: G.scale(e, ["value"], early(e)), l="event_id", d="value_z")
D14 = f""", s AS (SELECT event_type, avg(value) AS m, quantile_cont(value, 0.5) AS md FROM ev WHERE {early_sql()} GROUP BY ALL), x AS (SELECT *, lag(value) OVER ({BY_TYPE}) AS b FROM ev)
SELECT event_type, avg(abs(value)) AS zero, avg(abs(value - m)) AS train_mean, avg(abs(value - md)) AS train_median, avg(abs(value - b)) AS persistence FROM x JOIN s USING (event_type) WHERE NOT ({early_sql()}) GROUP BY event_type"""
ev("D14_baselines", D14, lambda e: G.baselines(e, ["event_type"], ["t", "event_id"], "value", early(e)), l="", d="zero train_mean train_median persistence", s="event_type")
D15 = f"""{M4}, ok AS (SELECT * FROM m WHERE m5 IS NOT NULL AND l1 IS NOT NULL), {ridge_sql("ok", ["k", "l1"], "value", early_sql("ok"), 1.0)}
SELECT event_id, value, b0 + w0 * k + w1 * l1 AS fitted FROM ok, ridge"""


@query("D15_ridge_predictions", f"WITH {EV} {D15}", l="event_id", d="fitted value", digits=5)
def _(spark, d):
    e = four(events(spark, d)).na.drop()
    w, b = G.ridge(e.filter(early(e)), ["k", "l1"], "value", 1.0)
    return e.withColumn("fitted", G.linear_prediction(["k", "l1"], w, b))


@query("D16_tree_and_logistic_models", l="event_id", d="p_logistic p_gbt", digits=4)
def _(spark, d):
    e = prob(preds(spark, d)).select("event_id", c("k").cast("double").alias("k"), "pred", c("y").cast("double").alias("y"))
    train = e.filter(early(e)).orderBy("event_id")
    out = e
    for name, kind, options in (("p_logistic", "logistic", {"maxIter": 20}), ("p_gbt", "gbt", {"maxIter": 5, "maxDepth": 3, "seed": 1})):
        from pyspark.ml.functions import vector_to_array

        scored = G.ml_model(kind, ["k", "pred"], "y", **options).fit(train).transform(out)
        out = scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return out


barq("D18_run_lengths", ", m AS (SELECT *, close > open AS st FROM bars), n AS (SELECT *, CASE WHEN lag(st) OVER w = st THEN 0 ELSE 1 END AS nw FROM m WINDOW w AS (PARTITION BY event_type ORDER BY bucket)), r AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS g FROM n), z AS (SELECT event_type, g, any_value(st) AS st, count(*) AS n FROM r GROUP BY event_type, g) SELECT CASE WHEN st THEN 'true' ELSE 'false' END AS state, count(*) AS runs, avg(n) AS mean_length, max(n) AS max_length FROM z GROUP BY ALL", lambda b: G.run_lengths(b, ["event_type"], ["bucket"], c("close") > c("open")), l="runs max_length", d="mean_length", s="state")
pq("D19_paper_backtest", ", m AS (SELECT *, CASE WHEN pred > 10 THEN 1 WHEN pred < -10 THEN -1 ELSE 0 END AS side FROM pr) SELECT event_id, side, CASE WHEN side <> 0 THEN side * actual - 4.0 ELSE 0.0 END AS net FROM m", lambda p: Q.backtest(p, "pred", "actual", 10.0, 4.0), l="event_id side", d="net")
pq("D20_abstention_sweep", ", g(threshold) AS (VALUES (0.0), (10.0), (25.0)) SELECT threshold, count(*) AS n, avg(sign(pred) * actual) AS mean_net FROM pr, g WHERE abs(pred) > threshold GROUP BY ALL", lambda p: M.threshold_sweep(p, [], "pred", "actual", [0.0, 10.0, 25.0]), l="n", d="threshold mean_net")


@query("D21_behaviour_archive", f"""WITH {EV}, o AS (SELECT user_id, avg(value) AS a, stddev_pop(value) AS b, count(*) AS n FROM ev GROUP BY ALL),
g AS (SELECT * FROM o UNION ALL SELECT user_id + 1000000, a, b, n FROM o WHERE user_id % 10 = 3), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(n) AS mn, stddev_pop(n) AS sn FROM g),
z AS (SELECT user_id, (a - ma) / sa AS x, (b - mb) / sb AS y, (n - mn) / sn AS w FROM g, s), p AS (SELECT l.user_id, r.user_id AS other, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.w - r.w) ** 2) / sqrt(3.0) AS d FROM z l, z r WHERE l.user_id <> r.user_id)
SELECT user_id, arg_min(other, (d, other)) AS nearest, min(d) AS distance FROM p GROUP BY user_id""", l="user_id nearest", d="distance")  # fmt: skip
def _(spark, d):
    """Users by their behaviour, some of them twice, and one unusable candidate for each, which must not matter."""
    centred = events(spark, d).withColumn("a", M.exact_mean(val(), Window.partitionBy("user_id")))
    g = centred.groupBy("user_id").agg(F.first("a").alias("a"), F.sqrt(M.exact_mean(F.pow(val() - c("a"), 2.0))).alias("b"), F.count("*").cast("double").alias("n"))
    unusable = g.select((c("user_id") + 2000000).alias("user_id"), "a", F.when(c("user_id") % 2 == 0, float("nan")).alias("b"), "n")
    return G.nearest_candidate(g.unionByName(g.filter("user_id % 10 = 3").withColumn("user_id", c("user_id") + 1000000)).unionByName(unusable), "user_id", ["a", "b", "n"])
