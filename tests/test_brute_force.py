"""Queries and operators without SQL, against plain Python over the same table, and folds over many batches."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY, HOUR
from tidemark.operators import indicators as I
from tidemark.operators import sequential as Q
from tidemark.operators.folds import fold
from tidemark.plans import QUERIES
from tidemark.plans.registry import events
from tidemark.plans.streams import messages
from tidemark.streaming import book as K

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ev(spark):
    return sorted((r.user_id, r.t, r.event_id, r.value, r.event_type, r.k) for r in events(spark, SF).collect())


def nets(ev):
    """(user, t, event, net) of every row with a row before it."""
    out, before = [], {}
    for user, t, event, value, *_ in ev:
        if user in before:
            pred, actual = before[user] - 35.0, value - 35.0
            out.append((user, t, event, math.copysign(1, pred) * actual - 4.0 if pred else -4.0))
        before[user] = value
    return out


def plain_guards(rows, horizon, cooldown, drawdown):
    """Every decision looks at all earlier taken trades again."""
    out, taken = {}, defaultdict(list)
    for user, t, event, net in rows:
        known = [(at + horizon, x) for at, x in taken[user] if at + horizon <= t]
        pause = any(x < 0 and t < due + cooldown for due, x in known)
        total = peak = 0.0
        for _, x in known:
            total += x
            peak = max(peak, total)
        reason = "cooldown" if pause else "drawdown" if drawdown is not None and peak - total > drawdown else ""
        if not reason:
            taken[user].append((t, net))
        out[event] = (int(not reason), reason)
    return out


@pytest.mark.parametrize("name, cooldown, drawdown", [("D2_cooldown_after_loss", DAY, None), ("D4_drawdown_guard", 0, 150.0)])
def test_guards(spark, ev, name, cooldown, drawdown):
    got = {r.event_id: (r.taken, r.reason) for r in QUERIES[name](spark, SF).collect()}
    want = plain_guards(nets(ev), HOUR, cooldown, drawdown)
    assert got == want and {r for _, r in want.values()} >= {"", "cooldown" if drawdown is None else "drawdown"}


def plain_ladder(ticks, rungs, spacing, profit, stop, timeout, rebalance, halt, fee):
    """One list of trades, each from its fill on; totals are made from closed trades in order."""
    anchor = since = None
    trades, closed, counts = [], [], defaultdict(int)
    for t, p in ticks:
        held = [x for x in trades if x["end"] is None]
        if anchor is None or (not held and t - since >= rebalance):
            counts["rebalances"] += anchor is not None
            anchor, since, base = p, t, len(trades)
        for x in held:
            move = (p / x["entry"] - 1) * 1e4
            why = "profits" if move >= profit else "stops" if move <= -stop else "timeouts" if t - x["at"] >= timeout else None
            if why:
                x["end"] = t
                counts[why] += 1
                closed.append(move - 2 * fee)
        sums = np.cumsum([0.0, *closed])
        if (np.maximum.accumulate(sums) - sums)[-1] > halt:
            counts["halted"] = 1
            break
        for rung in range(1, rungs + 1):
            level = anchor * (1 - rung * spacing / 1e4)
            if p <= level and not any(x["rung"] == rung and x["end"] is None for x in trades[base:]):
                trades.append({"rung": rung, "entry": level, "at": t, "end": None})
                counts["fills"] += 1
    sums = np.cumsum([0.0, *closed])
    return counts, float(sums[-1]), float((sums - np.maximum.accumulate(sums)).min()), sum(x["end"] is None for x in trades)


def test_ladder(spark, ev):
    series = defaultdict(list)
    for _, t, event, value, kind, _ in ev:
        series[kind].append((t, event, value))
    grid = [(r, s, p) for r in (2, 4) for s in (500.0, 1500.0) for p in (800.0, 3000.0)]
    got = {(r.event_type, r.config_id): r for r in QUERIES["D6_ladder_sweep"](spark, SF).collect()}
    assert len(got) == len(series) * len(grid)
    for kind, ticks in series.items():
        ticks = [(t, p) for t, _, p in sorted(ticks)]
        for i, (rungs, spacing, profit) in enumerate(grid):
            counts, net, worst, still = plain_ladder(ticks, rungs, spacing, profit, 9000.0, 12 * HOUR, 6 * HOUR, 2000.0, 1.0)
            r = got[kind, i]
            assert [r[x] for x in ("fills", "profits", "stops", "timeouts", "rebalances", "halted", "open")] == [*(counts[x] for x in ("fills", "profits", "stops", "timeouts", "rebalances", "halted")), still]
            assert abs(r.net_bps - net) < 1e-5 * (1 + abs(net)) and abs(r.max_drawdown_bps - worst) < 1e-5 * (1 + abs(worst))


def test_bootstrap_interval(spark, ev):
    """Over many seeds of plain resampling the interval's ends are about those of the query."""
    blocks = defaultdict(list)
    for _, t, _, net in nets(ev):
        blocks[t // DAY].append(net)
    rng, parts = np.random.default_rng(2), [np.array(x) for x in blocks.values()]
    means = sorted(sum(parts[i].sum() for i in pick) / sum(len(parts[i]) for i in pick) for pick in rng.integers(0, len(parts), (4000, len(parts))))
    got = QUERIES["A30_bootstrap_interval"](spark, SF).first()
    width = means[3900] - means[100]
    assert abs(got.low - means[100]) < 0.25 * width and abs(got.high - means[3900]) < 0.25 * width and got.low < got.middle < got.high


def test_order_book(spark):
    """Both sides rebuilt from all messages since the last snapshot, for every message."""
    rows = sorted(messages(spark, SF).collect(), key=lambda r: (r.symbol, r.seq))
    got = {(r.symbol, r.seq): r for r in K.book_rows(messages(spark, SF)).collect()}
    last, since = {}, defaultdict(list)
    for r in rows:
        if r.kind == "snapshot":
            status, since[r.symbol], last[r.symbol] = "snapshot", [r], r.final
        elif last.get(r.symbol) is None:
            status = "waiting"
        elif r.final <= last[r.symbol]:
            status = "old_update"
        elif r.first > last[r.symbol] + 1:
            status, last[r.symbol] = "gap", None
        else:
            status, last[r.symbol] = "applied", r.final
            since[r.symbol].append(r)
        g = got[r.symbol, r.seq]
        assert g.status == status
        if status in ("snapshot", "applied"):
            for side, sign in (("bids", -1), ("asks", 1)):
                book = {}
                for m in since[r.symbol]:
                    for level in m[side]:
                        book[level.p] = level.q
                want = sorted(((p, q) for p, q in book.items() if q > 0), key=lambda x: sign * x[0])[:50]
                assert [(x.p, x.q) for x in g[side]] == want


def test_models_rank_better_than_chance(spark, ev):
    actual = {e: int(x > 0) for _, _, e, x in ((u, t, e, v - 35.0) for u, t, e, v, *_ in ev)}
    rows = QUERIES["D16_tree_and_logistic_models"](spark, SF).collect()
    assert all(0 <= r.p_logistic <= 1 and 0 <= r.p_gbt <= 1 for r in rows)
    cut = min(e for _, _, e, *_ in ev) + 0.6 * (max(e for _, _, e, *_ in ev) - min(e for _, _, e, *_ in ev))
    train = [(actual[r.event_id], r.p_gbt) for r in rows if r.event_id < cut]
    loss = lambda q: -np.mean([y * math.log(max(q(p), 1e-9)) + (1 - y) * math.log(max(1 - q(p), 1e-9)) for y, p in train])
    rate = np.mean([y for y, _ in train])
    assert loss(lambda p: p) <= loss(lambda p: rate)


def test_folds_over_many_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() if rng.random() < 0.9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        ema = {(r.k, r.t): r.y for r in I.ema_paths(df, ["k"], ["t"], "x", {"y": 0.2}, least=3).collect()}
        kept = sorted((str(r.k), r.t) for r in Q.non_overlapping(df.withColumn("s", F.col("t")), ["k"], "t", "s", 17).collect())
        ends = sorted((str(r.k), r.n) for r in fold(df, ["k"], ["t"], lambda pdf, n: (None, (n or 0) + len(pdf)), "k string, n long", lambda key, n: __import__("pandas").DataFrame([{"k": key[0], "n": n}])).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, state = {}, {}
    for k, t, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        y, n = state.get(k, (None, 0))
        if x is not None:
            y, n = (x if y is None else 0.2 * x + 0.8 * y), n + 1
        state[k] = (y, n)
        want[k, t] = y if n >= 3 else None
    assert ema.keys() == want.keys() and all((ema[i] is None) == (want[i] is None) and (want[i] is None or abs(ema[i] - want[i]) < 1e-12) for i in want)
    taken, free = [], {}
    for k, t, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if t >= free.get(k, t):
            taken.append((str(k), t))
            free[k] = t + 17
    assert kept == sorted(taken)
    assert ends == sorted((str(k), sum(r[0] == k for r in rows)) for k in ("a", "b", None))


def test_nearest_candidates_in_cells(spark):
    from tidemark.operators.diagnostics import nearest_candidate

    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (150, 2)), np.repeat(rng.normal(0, 3, (5, 2)), 4, axis=0), [[40.0, -30.0]]]
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "who long, a double, b double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for size in (1000, 12):
        got = {r.who: (r.nearest, r.distance) for r in nearest_candidate(df, "who", ["a", "b"], cell_rows=size).collect()}
        for i in range(len(x)):
            d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            assert got[i][0] == int(np.flatnonzero(d <= d.min() + 1e-12)[0]) and abs(got[i][1] - d.min() / 2**0.5) < 1e-9
    assert nearest_candidate(df.limit(1), "who", ["a", "b"]).count() == 0


def test_unusable_candidates_take_no_part(spark):
    from tidemark.operators.diagnostics import nearest_candidate

    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0), (2, 1.0, 1.0), (3, None, 5.0), (4, 9.0, 9.0), (5, nan, 1.0), (6, 1.0, inf), (None, 0.0, 0.0)]
    near = lambda rows, **o: {r.who: (r.nearest, round(r.distance, 9)) for r in nearest_candidate(spark.createDataFrame(rows, "who int, a double, b double"), "who", ["a", "b"], **o).collect()}
    got = near(rows)
    assert {k: v[0] for k, v in got.items()} == {1: 2, 2: 1, 4: 2} and got == near([r for r in rows if r[0] in (1, 2, 4)])
    twins = [(i, 5.0, 5.0) for i in range(300)] + [(500 + i, 5.0 + i, 7.0) for i in range(1, 4)] + [(900, -0.0, 1.0), (901, 0.0, 1.0)]
    got = near(twins, cell_rows=20)
    assert got[0] == (1, 0.0) and all(got[i] == (0, 0.0) for i in range(1, 300)) and got[900] == (901, 0.0) and got[901] == (900, 0.0) and got[501][0] == 502 and len(got) == 305
    assert near([(1, None, None)]) == {}
