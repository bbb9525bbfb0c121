"""Candidate fitness, loss attribution, column profiles, isotonic and spectral sequences (A36, A38, A47, arrays)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import sequences as Q
from tidemark.plans.evaluation import NET, PRED, PY, net, preds, prob
from tidemark.plans.registry import EV, USER, events, query, table

c = F.col
FOLD = "least(3, floor((event_id - (SELECT min(event_id) FROM pr)) * 4.0 / ((SELECT max(event_id) FROM pr) - (SELECT min(event_id) FROM pr))))"
A36 = f"""WITH {PRED}, {PY}, z AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q, {FOLD} AS fold FROM py),
f AS (SELECT event_type, fold, avg((p - y) * (p - y)) AS brier, avg(y) AS rate, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss, avg(p) AS mp, avg(CASE WHEN y = 1 THEN p END) AS hit FROM z GROUP BY ALL),
g AS (SELECT *, 1 - brier / (rate * (1 - rate)) AS skill, -(rate * ln(rate) + (1 - rate) * ln(1 - rate)) - loss AS gain, abs(mp - rate) AS gap, hit / mp - 1 AS lift FROM f),
s AS (SELECT event_type, quantile_cont(skill, 0.5) AS med, min(skill) AS worst, quantile_cont(lift, 0.5) AS lift, quantile_cont(gain, 0.5) AS gain, avg(CASE WHEN skill > 0 THEN 1.0 ELSE 0.0 END) AS stable, quantile_cont(gap, 0.5) AS gap FROM g GROUP BY ALL)
SELECT event_type, med, worst, med + 0.75 * worst + 0.25 * lift + 0.10 * gain + 0.05 * stable - 2 * abs(least(0, worst)) - least(0.02, 12 / 10000.0) - least(0.05, greatest(0.0, gap - 0.05)) AS fitness FROM s"""


@query("A36b_candidate_fitness", A36, d="med worst fitness", s="event_type")
def _(spark, d):
    p = prob(preds(spark, d))
    low, high = p.agg(F.min("event_id"), F.max("event_id")).first()
    fold = F.least(F.lit(3), F.floor((c("event_id") - low) * 4.0 / (high - low)))
    half = lambda x: F.percentile(x, 0.5)
    per = M.fold_skill(p, ["event_type"], fold, "p", "y").groupBy("event_type").agg(half("skill").alias("med"), F.min("skill").alias("worst"), half("lift").alias("lift"), half("log_loss_gain").alias("gain"), F.avg((c("skill") > 0).cast("double")).alias("stable"), half("gap").alias("gap"))
    return per.withColumn("fitness", M.candidate_fitness(c("med"), c("worst"), c("lift"), c("gain"), c("stable"), c("gap"), F.lit(12)))


REASON = "CASE WHEN net < -40 THEN 'stop_loss' WHEN k % 3 = 0 THEN 'timeout' WHEN k % 3 = 1 THEN 'final_liquidation' ELSE 'take_profit' END"
A38 = f"""WITH {PRED}, {NET}, r AS (SELECT *, {REASON} AS reason FROM nt), g AS (SELECT user_id, reason, sum(net) AS x FROM r GROUP BY ALL),
s AS (SELECT user_id, arg_min(reason, (x, reason)) AS worst_reason, coalesce(sum(x) FILTER (reason = 'stop_loss'), 0.0) AS stop_net, coalesce(sum(x) FILTER (reason = 'timeout'), 0.0) AS timeout_net, coalesce(sum(x) FILTER (reason = 'final_liquidation'), 0.0) AS final_net FROM g GROUP BY user_id)
SELECT *, CASE WHEN stop_net <= timeout_net AND stop_net <= final_net AND stop_net < 0 THEN 'stop_loss' WHEN timeout_net <= stop_net AND timeout_net <= final_net AND timeout_net < 0 THEN 'timeout' WHEN final_net < 0 THEN 'final_liquidation' ELSE 'mixed_or_no_loss' END AS dominant FROM s"""


@query("A38b_dominant_loss", A38, l="user_id", d="stop_net timeout_net final_net", s="worst_reason dominant")
def _(spark, d):
    reason = F.when(c("net") < -40, "stop_loss").when(c("k") % 3 == 0, "timeout").when(c("k") % 3 == 1, "final_liquidation").otherwise("take_profit")
    return M.dominant_loss(net(preds(spark, d)).withColumn("reason", reason), ["user_id"], "reason", "net")


STATS = "SELECT '{x}' AS name, '{role}' AS role, count({x}) / count(*) AS present, count({x}) FILTER (isfinite({x})) / count(*) AS finite, min({x}) FILTER (isfinite({x})) AS least, max({x}) FILTER (isfinite({x})) AS most, avg({x}) FILTER (isfinite({x})) AS mean, stddev_pop({x}) FILTER (isfinite({x})) AS std FROM m"
A47B = f"WITH {EV}, m AS (SELECT CAST(t AS DOUBLE) AS t, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS value, CAST(k AS DOUBLE) AS k FROM ev) " + " UNION ALL ".join(STATS.format(x=x, role=r) for x, r in (("t", "timestamp"), ("value", "price"), ("k", "volume")))


@query("A47b_column_statistics", A47B, d="present finite least most mean std", s="name role", digits=3)
def _(spark, d):
    e = events(spark, d).withColumn("value", F.when(c("k") % 7 == 0, None).when(c("k") % 11 == 0, float("nan")).otherwise(c("value")))
    return M.column_statistics(e, ["t", "value", "k"])


A47C = f"""WITH {EV}, m AS (SELECT user_id, t, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) / 1000.0 AS s FROM ev), f AS (SELECT user_id, s, count(*) AS n FROM m WHERE s > 0 GROUP BY ALL), o AS (SELECT user_id, arg_max(s, (n, -s)) AS mode_s FROM f GROUP BY user_id),
p AS (SELECT user_id, quantile_cont(s, 0.5) FILTER (s > 0) AS median_s, count(*) FILTER (s = 0) AS repeated, count(*) FILTER (t < 0) AS negative FROM m GROUP BY user_id) SELECT p.*, mode_s, abs(median_s - 20000) <= 5000 AS matches FROM p LEFT JOIN o USING (user_id)"""


@query("A47c_cadence_profile", A47C, l="user_id repeated negative", d="median_s mode_s", b="matches")
def _(spark, d):
    return M.cadence_profile(events(spark, d), ["user_id"], "t", 20_000.0)


ISO = f"""WITH {EV}, w AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM ev), n AS (SELECT unnest(range(1, 6)) AS i),
m AS (SELECT event_id, i.i AS i, a.i AS a, min(list_avg(list_slice(x, a.i, b.i))) AS least FROM w, n i, n a, n b WHERE len(x) = 5 AND a.i <= i.i AND b.i >= i.i GROUP BY ALL)
SELECT event_id, i AS place, max(least) AS fitted FROM m GROUP BY event_id, i"""


@query("S_isotonic_projection", ISO, l="event_id place", d="fitted")
def _(spark, d):
    e = events(spark, d).withColumn("x", Q.input_sequence(USER, c("value"), 5)).filter("x is not null")
    return e.select("event_id", F.posexplode(Q.isotonic(c("x"))).alias("p", "fitted")).withColumn("place", c("p") + 1)


TURN = {(k, f): f"list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * {f}((i - 1) * {2 * math.pi * k / 64!r})))" for k in range(1, 5) for f in ("cos", "sin")}
FFT = "SELECT vec_id, " + " + ".join(f"({x}) ** 2" for x in TURN.values()) + " AS energy, 2.0 / 64 * (" + " + ".join(TURN[k, "cos"] for k in range(1, 5)) + ") AS first_value, 2.0 / 64 * (" + " + ".join(f"{TURN[k, f]} * {f}(9 * {2 * math.pi * k / 64!r})" for k in range(1, 5) for f in ("cos", "sin")) + ") AS tenth_value FROM embeddings"


@query("S_spectral_band", FFT, l="vec_id", d="energy first_value tenth_value", digits=5)
def _(spark, d):
    energy, wave = Q.band(c("embedding").cast("array<double>"), 64, 1, 4)
    e = table(spark, d, "embeddings").withColumns({"energy": energy, "wave": wave})
    return e.select("vec_id", "energy", F.get("wave", F.lit(0)).alias("first_value"), F.get("wave", F.lit(9)).alias("tenth_value"))
