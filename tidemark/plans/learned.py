"""Queries of fitted models, of the weight grid and of contract and regime reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY
from tidemark.operators import diagnostics as G
from tidemark.operators import grid as W
from tidemark.operators import learning as L
from tidemark.operators import metrics as M
from tidemark.operators import sequences as Q
from tidemark.plans.bars import BARS, hourly
from tidemark.plans.evaluation import M4, PRED, four, preds
from tidemark.plans.registry import EV, early, early_sql, events, query, table

c = F.col

SOFT = "sign({x}) * greatest(abs({x}) - 0.1 * 0.7, 0.0)"
ELASTIC = f"""WITH RECURSIVE {EV} {M4}, ok AS (SELECT * FROM m WHERE m5 IS NOT NULL AND l1 IS NOT NULL),
s AS (SELECT avg(k) AS m0, avg(l1) AS m1, avg(value) AS my, var_pop(k) AS g00, covar_pop(k, l1) AS g01, var_pop(l1) AS g11, covar_pop(k, value) / stddev_pop(value) AS t0, covar_pop(l1, value) / stddev_pop(value) AS t1, stddev_pop(value) AS sy FROM ok WHERE {early_sql("ok")}),
cd AS (SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 UNION ALL
  SELECT i + 1, n0, {SOFT.format(x="(t1 - g01 * n0)")} / (g11 + 0.1 * 0.3) FROM (SELECT i, w1, {SOFT.format(x="(t0 - g01 * w1)")} / (g00 + 0.1 * 0.3) AS n0 FROM cd, s WHERE i < 200) AS x, s),
w AS (SELECT w0 * sy AS w0, w1 * sy AS w1, my - w0 * sy * m0 - w1 * sy * m1 AS b FROM cd, s WHERE i = 200)
SELECT event_id, w0 * k + w1 * l1 + b AS fitted, w0, w1 FROM ok, w"""


@query("D15_elastic_net", ELASTIC, l="event_id", d="fitted w0 w1")
def _(spark, d):
    e = four(events(spark, d)).na.drop()
    w, b = L.elastic_net(e.filter(early(e)), ["k", "l1"], "value", alpha=0.1, l1_ratio=0.7)
    return e.select("event_id", (c("k") * w[0] + c("l1") * w[1] + b).alias("fitted"), F.lit(w[0]).alias("w0"), F.lit(w[1]).alias("w1"))


EDGES = {"k": [float(x) for x in range(10, 100, 10)], "l1": [5.0, 10.0, 20.0, 35.0, 50.0, 80.0]}
ROUNDS = 4


def stumps_sql() -> str:
    edges = ", ".join(f"('{f}', {t}::DOUBLE)" for f, ts in EDGES.items() for t in ts)
    out = f"""WITH {EV} {M4}, p AS (SELECT *, {early_sql("m")} AS tr FROM m), cells AS (SELECT event_id, 'k' AS f, k::DOUBLE AS x FROM p UNION ALL SELECT event_id, 'l1', l1 FROM p),
edges(f, edge) AS (VALUES {edges}), r0 AS (SELECT event_id, tr, value - (SELECT avg(value) FROM p WHERE tr) AS rest FROM p)"""
    for n in range(1, ROUNDS + 1):
        out += f""",
s{n} AS (SELECT f, edge, avg(rest) FILTER (tr AND lft) AS ml, avg(rest) FILTER (tr AND NOT lft) AS mr, count(*) FILTER (tr AND lft) AS nl, count(*) FILTER (tr AND NOT lft) AS nr,
  coalesce(sum(rest) FILTER (NOT tr AND lft), 0) AS vl, coalesce(sum(rest) FILTER (NOT tr AND NOT lft), 0) AS vr, count(*) FILTER (NOT tr AND lft) AS cl, count(*) FILTER (NOT tr AND NOT lft) AS cr
  FROM (SELECT *, coalesce(x <= edge, FALSE) AS lft FROM r{n - 1} JOIN cells USING (event_id) JOIN edges USING (f)) AS z{n} GROUP BY f, edge),
b{n} AS (SELECT f, edge, ml, mr FROM s{n} WHERE nl >= 5 AND nr >= 5 ORDER BY 2 * 0.3 * (ml * vl + mr * vr) - 0.09 * (ml * ml * cl + mr * mr * cr) DESC LIMIT 1),
r{n} AS (SELECT event_id, tr, rest - 0.3 * CASE WHEN x <= edge THEN ml ELSE mr END AS rest FROM r{n - 1} JOIN cells USING (event_id) JOIN b{n} USING (f))"""
    return out + f" SELECT event_id, value - rest AS fitted FROM p JOIN r{ROUNDS} USING (event_id)"


@query("D15_boosted_stumps", stumps_sql(), l="event_id", d="fitted")
def _(spark, d):
    e = four(events(spark, d))
    train = early(e)
    model = L.boosted_stumps(e, ["k", "l1"], "value", train, ~train, rounds=ROUNDS, rate=0.3, edges=EDGES)
    return e.select("event_id", model.prediction().alias("fitted"))


SCORED = f"{EV}, sc AS (SELECT event_id, k / 100.0 AS score, CASE WHEN value > 25 + k % 7 THEN 1 ELSE 0 END AS y FROM ev)"


def scored(spark, d):
    return events(spark, d).select("event_id", (c("k") / 100.0).alias("score"), (c("value") > 25 + c("k") % 7).cast("int").alias("y"))


@query(
    "D16_isotonic",
    f"""WITH {SCORED}, g AS (SELECT score, sum(y) AS total, count(*) AS n FROM sc WHERE {early_sql()} GROUP BY score),
x AS (SELECT score, coalesce(sum(total) OVER u, 0) AS t0, coalesce(sum(n) OVER u, 0) AS n0, sum(total) OVER v AS t1, sum(n) OVER v AS n1 FROM g WINDOW u AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT a.score AS lo, b.score AS hi, (b.t1 - a.t0) / (b.n1 - a.n0) AS mean FROM x a JOIN x b ON a.score <= b.score),
mins AS (SELECT i.score, s.lo, min(s.mean) AS low FROM x i JOIN spans s ON s.lo <= i.score AND s.hi >= i.score GROUP BY i.score, s.lo),
curve AS (SELECT score, max(low) AS value FROM mins GROUP BY score),
ends AS (SELECT arg_min(value, score) AS first_value, arg_max(value, score) AS last_value FROM curve),
near AS (SELECT sc.event_id, sc.score, a.score AS x0, a.value AS y0, b.score AS x1, b.value AS y1 FROM sc ASOF LEFT JOIN curve a ON sc.score >= a.score ASOF LEFT JOIN curve b ON sc.score <= b.score)
SELECT event_id, CASE WHEN x0 IS NULL THEN first_value WHEN x1 IS NULL THEN last_value WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (score - x0) / (x1 - x0) END AS calibrated FROM near, ends""",
    l="event_id",
    d="calibrated",
)
def _(spark, d):
    e = scored(spark, d)
    return L.with_isotonic(e, "score", L.isotonic(e.filter(early(e)), "score", "y"), "calibrated")


def platt_sql(steps: int = 8) -> str:
    out = f"WITH {SCORED}, tr AS (SELECT score AS x, y FROM sc WHERE {early_sql()}), n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
    for n in range(1, steps + 1):
        out += f""",
q{n} AS (SELECT a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM tr, n{n - 1}),
h{n} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((p - y) * x) + any_value(a) AS ga, sum(p - y) AS gb, sum(p * (1 - p) * x * x) + 1 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb FROM q{n}),
n{n} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM h{n})"""
    return out + f" SELECT event_id, 1 / (1 + exp(-(a * score + b))) AS calibrated, a AS slope, b AS intercept FROM sc, n{steps}"


@query("D16_platt", platt_sql(), l="event_id", d="calibrated slope intercept")
def _(spark, d):
    e = scored(spark, d)
    a, b = L.platt(e.filter(early(e)), "score", "y")
    return e.select("event_id", L.platt_prediction("score", a, b).alias("calibrated"), F.lit(a).alias("slope"), F.lit(b).alias("intercept"))


THRESHOLDS, GATED, STEPS = (0.0, 15.0), ("none", "all_positive", "same_sign", "primary"), 4


def grid(spark, d):
    p = preds(spark, d).select("event_id", "t", "pred", (c("k") - 50.0).alias("p2"), (20.0 - F.abs("pred")).alias("p3"), "actual", F.lit(4.0).alias("flat"), (c("k") / 10.0).alias("wide"))
    return W.score_grid(p, "t", ["pred", "p2", "p3"], "actual", ["flat", "wide"], DAY, STEPS, THRESHOLDS, GATED, ["event_id"])


VECTORS = ", ".join(f"('{';'.join(f'{x:g}' for x in w)}', {w[0]}::DOUBLE, {w[1]}::DOUBLE, {w[2]}::DOUBLE)" for w in W.simplex(3, STEPS))
GRID = f"""WITH {PRED}, p AS (SELECT *, k - 50.0 AS p2, 20.0 - abs(pred) AS p3 FROM pr), ws(weights, w1, w2, w3) AS (VALUES {VECTORS}), th(threshold) AS (VALUES (0.0), (15.0)), ga(gate) AS (VALUES ('none'), ('all_positive'), ('same_sign'), ('primary')),
m AS (SELECT event_id, t, k, actual, weights, threshold, gate, w1 * pred + w2 * p2 + w3 * p3 AS blend,
  CASE gate WHEN 'none' THEN TRUE WHEN 'all_positive' THEN least(pred, p2, p3) > 0 WHEN 'same_sign' THEN least(pred, p2, p3) > 0 OR greatest(pred, p2, p3) < 0 ELSE pred > 0 END AS ok FROM p, ws, th, ga),
tr AS (SELECT weights, threshold, gate, event_id, t, sign(blend) * actual AS gross, sign(blend) * actual - 4.0 AS net0, sign(blend) * actual - k / 10.0 AS net1 FROM m WHERE ok AND abs(blend) > threshold),
paths AS (SELECT *, sum(net0) OVER w AS path FROM tr WINDOW w AS (PARTITION BY weights, threshold, gate ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
falls AS (SELECT weights, threshold, gate, greatest(max(path) OVER (PARTITION BY weights, threshold, gate ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) - path AS fall FROM paths),
dips AS (SELECT weights, threshold, gate, max(fall) AS dip FROM falls GROUP BY ALL),
blocks AS (SELECT weights, threshold, gate, t // {DAY} AS block, count(*) AS n, sum(gross) AS gross, sum(net0) AS net0, sum(net1) AS net1, sum(CASE WHEN net0 > 0 THEN 1 ELSE 0 END) AS wins FROM tr GROUP BY ALL),
grid AS (SELECT weights, threshold, gate, sum(n) AS traded, sum(gross) AS gross, sum(net0) AS net0, sum(net1) AS net1, sum(wins) / sum(n) AS win_rate, any_value(dip) AS dip, avg(CASE WHEN net0 > 0 THEN 1.0 ELSE 0.0 END) AS good_blocks, min(net0) AS worst_block FROM blocks JOIN dips USING (weights, threshold, gate) GROUP BY weights, threshold, gate)"""


@query("D12_weight_grid", f"{GRID} SELECT * FROM grid", l="traded", d="threshold gross net0 net1 win_rate dip good_blocks worst_block", s="weights gate", digits=4)
def _(spark, d):
    return grid(spark, d).withColumnRenamed("rows", "traded")


@query("D12_ranked_grid", f"{GRID}, s AS (SELECT *, round(net0 * good_blocks - dip, 6) AS score FROM grid) SELECT weights, threshold, gate, row_number() OVER (ORDER BY CASE WHEN traded < 300 THEN 1 ELSE 0 END, score DESC, weights, threshold, gate) AS rank, score FROM s", l="rank", d="threshold score", s="weights gate", digits=4)
def _(spark, d):
    return W.ranked_grid(grid(spark, d), least_rows=300)


@query("D15_softmax", l="event_id", d="p0 p1 p2", digits=4)
def _(spark, d):
    """Direction classes (down, flat, up) of the value against the one before."""
    e = four(events(spark, d)).na.drop()
    e = e.select("event_id", (c("k") / 100.0).alias("a"), (c("l1") / 50.0).alias("b"), F.when(c("value") > c("l1") + 10, 2).when(c("value") < c("l1") - 10, 0).otherwise(1).alias("y"))
    p = L.softmax_prediction(["a", "b"], L.softmax_weights(e.filter(early(e)), ["a", "b"], "y", 3))
    return e.select("event_id", *[x.alias(f"p{i}") for i, x in enumerate(p)])


SURVIVORS = f"""WITH {PRED}, th(threshold) AS (VALUES (0.0), (15.0), (30.0)), w AS (SELECT user_id % 40 AS contract, t // {DAY} AS day, threshold, count(*) AS n, sum(sign(pred) * actual - 4.0) AS total FROM pr, th WHERE abs(pred) > threshold GROUP BY ALL),
b AS (SELECT contract, day, arg_min(threshold, (-round(total, 6), threshold)) AS threshold, arg_min(n, (-round(total, 6), threshold)) AS n, max(total) AS total FROM w GROUP BY contract, day),
g AS (SELECT contract, count(DISTINCT day) AS windows, count(DISTINCT CASE WHEN total > 0 THEN day END) AS positive_windows, min(total) AS worst, sum(total) AS total, sum(n) AS traded, count(*) FILTER (threshold = 0) AS zero_best, count(*) FILTER (threshold >= 15) AS high_best, count(*) FILTER (threshold >= 15 AND n < 4) AS sparse_high, count(*) FILTER (n >= 4) AS full_windows FROM b GROUP BY contract)
SELECT *, CASE WHEN zero_best > 0 AND high_best = 0 THEN 'zero_only' WHEN full_windows = 0 THEN 'too_few_rows' WHEN positive_windows / windows < 0.5 THEN 'unstable' WHEN zero_best > high_best THEN 'zero_dominates' ELSE 'candidate' END AS status FROM g"""


@query("A48b_contract_status", SURVIVORS, l="contract windows positive_windows traded zero_best high_best sparse_high full_windows", d="worst total", s="status")
def _(spark, d):
    p = preds(spark, d).select((c("user_id") % 40).alias("contract"), F.floor(c("t") / DAY).alias("day"), "pred", (F.signum("pred") * c("actual") - 4.0).alias("net"))
    each = p.withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(15.0), F.lit(30.0)))).filter(F.abs("pred") > c("threshold"))
    each = each.groupBy("contract", "day", "threshold").agg(F.count("*").alias("n"), F.sum("net").alias("total"))
    best = M.best_row(each, ["contract", "day"], [F.round("total", 6), -c("threshold")])
    return M.contract_survivors(best, ["contract"], "day", "threshold", "n", "total", least_rows=4, high=15.0).withColumnRenamed("rows", "traded")


REGIMES = f"""WITH {BARS}, m AS (SELECT *, CASE WHEN close > open * 1.5 THEN 'up' WHEN close < open * 0.67 THEN 'down' ELSE 'chop' END AS state, high - low AS width FROM bars),
n AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS nw FROM m WINDOW w AS (PARTITION BY event_type ORDER BY bucket)), r AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS g FROM n),
z AS (SELECT event_type, g, any_value(state) AS state, count(*) AS l FROM r GROUP BY event_type, g), d AS (SELECT state, count(*) AS runs, avg(l) AS mean_length, quantile_cont(l, 0.1) AS length10, quantile_cont(l, 0.5) AS length50, quantile_cont(l, 0.9) AS length90 FROM z GROUP BY state)
SELECT state, count(*) / (SELECT count(*) FROM m) AS share, avg(width) AS mean, quantile_cont(width, 0.05) AS q05, quantile_cont(width, 0.33) AS q33, quantile_cont(width, 0.67) AS q67, quantile_cont(width, 0.95) AS q95, any_value(runs) AS runs, any_value(mean_length) AS mean_length, any_value(length10) AS length10, any_value(length50) AS length50, any_value(length90) AS length90 FROM m JOIN d USING (state) GROUP BY state"""


@query("D18b_regime_quantiles", REGIMES, l="runs", d="share mean q05 q33 q67 q95 mean_length length10 length50 length90", s="state")
def _(spark, d):
    state = F.when(c("close") > c("open") * 1.5, "up").when(c("close") < c("open") * 0.67, "down").otherwise("chop")
    return G.regime_calibration(hourly(spark, d).withColumn("width", c("high") - c("low")), ["event_type"], ["bucket"], state, "width")


INTERP = "SELECT vec_id, p, CASE WHEN p <= 0 THEN embedding[1] WHEN p >= len(embedding) - 1 THEN embedding[len(embedding)] ELSE embedding[floor(p)::INT + 1] + (embedding[floor(p)::INT + 2] - embedding[floor(p)::INT + 1])::DOUBLE * (p - floor(p)) END AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, unnest([-1.0, 0.0, 2.25, 7.5, 1000.0]::DOUBLE[]) AS p FROM embeddings)"


@query("S_interp", INTERP, l="vec_id", d="p value", digits=5)
def _(spark, d):
    """Vectors as waveforms, sampled between their points."""
    e = table(spark, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("y")).filter("size(y) > 0")
    places = F.array(*[F.lit(x) for x in (-1.0, 0.0, 2.25, 7.5, 1000.0)])
    xs = F.transform(F.sequence(F.lit(0), F.size("y") - 1), lambda i: i.cast("double"))
    return e.select("vec_id", F.explode(F.arrays_zip(places.alias("p"), Q.interp(places, xs, c("y")).alias("value"))).alias("r")).select("vec_id", "r.p", "r.value")
