"""Order-dependent selection, position and ladder simulation."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import safe_div
from tidemark.operators.folds import condense, fold, scan

c = F.col


def non_overlapping(df: DataFrame, keys: Sequence[str], time: str, seq: str, horizon: int, block: int | None = None) -> DataFrame:
    """Greedy: the next row at or after the last taken one + horizon (D1, D5). Rows without a time take no part.

    Of rows of one time the first by seq is taken; with a horizon of 0 or less nothing overlaps and every row is.
    Rows lie in blocks of (key, time), so one key spreads over as many tasks as it has blocks. A block does not know
    when the block before it lets go, but that is less than a horizon past its own start. So it follows the selection
    from each row of its first horizon (chains that meet are one from there on) and leaves a small table: entered at,
    left with. These tables are walked by key, and each block then selects from its true entry. `block` is the width of
    a block, 64 horizons unless given and at least one; it does not change the result.
    """
    rows = df.select(*keys, time, seq).filter(c(time).isNotNull())
    if horizon <= 0:
        return rows
    width = max(block or 64 * horizon, horizon)
    rows = rows.withColumn("_block", F.floor(c(time) / width))
    near, whole = [*keys, "_block"], lambda x: T.StructField(x, T.LongType())

    def follow(state: list, t: list[int]) -> None:
        limit, chains = state
        at = 0
        while at < len(t):
            now, met = t[at], []
            while chains and chains[0][0] <= now:
                met += chains.popleft()[1]
            if limit is not None:
                met.append(now)
                limit = limit if now < limit else None
            if met:
                chains.append((now + horizon, met))
            at = at + 1 if limit is not None else max(at + 1, bisect_left(t, chains[0][0]))
        state[0] = limit

    def table(state: list) -> list[tuple[int, int]]:
        ways = sorted((entered, free) for free, met in state[1] for entered in met)
        return [x for x, after in zip(ways, [*ways[1:], (0, None)]) if x[1] != after[1]]

    def walk(state: list, block: int, upto: int, left: int) -> tuple[int | None]:
        held = None
        if block != state[0]:
            held = state[1]
            state[0], state[2] = block, False
        if not state[2] and (state[1] is None or state[1] <= upto):
            state[1], state[2] = left, True
        return (held,)

    def take(state: list[int | None], t: int | None, free: int | None) -> tuple[int]:
        if t is None:  # the row that carries the entry sorts first
            state[0] = free
        elif state[0] is None or t >= state[0]:
            state[0] = t + horizon
            return (1,)
        return (0,)

    ways = condense(rows, near, [time], [time], [whole("_upto"), whole("_left")], lambda t: [t // width * width + horizon, deque()], follow, table)
    walked = scan(ways, keys, ["_block", "_upto"], ["_block", "_upto", "_left"], [whole("_free")], lambda: [None, None, True], walk)
    entries = walked.filter(c("_free").isNotNull()).select(*near, "_free")
    both = rows.withColumn("_free", F.lit(None).cast("long")).unionByName(entries, allowMissingColumns=True)
    taken = scan(both, near, [time, seq], [time, "_free"], [whole("_taken")], lambda: [None], take)
    return taken.filter("_taken = 1").select(*keys, time, seq)


def density_limited(df: DataFrame, keys: Sequence[str], order: Sequence[str], signal: Column, n: int, most: int) -> DataFrame:
    """Signals with fewer than `most` raw signals in the n - 1 rows before (D3)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n + 1, -1)
    df = df.withColumn("_sig", signal.cast("int"))
    return df.withColumn("kept", ((c("_sig") == 1) & (F.coalesce(F.sum("_sig").over(w), F.lit(0)) < most)).cast("int")).drop("_sig")


def guarded(df: DataFrame, keys: Sequence[str], time: str, net: str, horizon: int, cooldown: int, drawdown: float | None = None, seq: str | None = None) -> DataFrame:
    """Cooldown after a loss and a halt on realised drawdown, outcomes known only at t + horizon.

    The state is the queue of outcomes not known yet, the end of the pause, and the realised total and
    its peak. Equal times go by seq.
    """
    schema = T.StructType(list(df.schema.fields)).add("taken", T.IntegerType()).add("reason", T.StringType())

    def step(pdf: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        pending, free_at, total, peak = state or (deque(), -(1 << 62), 0.0, 0.0)
        taken, why = [], []
        for t, x in zip(pdf[time].tolist(), pdf[net].tolist()):
            while pending and pending[0][0] <= t:
                at, value = pending.popleft()
                total += value
                peak = max(peak, total)
                if value < 0:
                    free_at = max(free_at, at + cooldown)
            reason = "cooldown" if t < free_at else "drawdown" if drawdown is not None and peak - total > drawdown else ""
            taken.append(int(not reason))
            why.append(reason)
            if not reason and x is not None and x == x:
                pending.append((t + horizon, x))
        return pdf.assign(taken=taken, reason=why), (pending, free_at, total, peak)

    return fold(df, keys, [time, *([seq] if seq else [])], step, schema)


def dynamic_cost(fee: float, half_spread: Column, depth: Column, imbalance: Column, has_flow: Column, shallow: float, depth_penalty: float = 1.0, imbalance_penalty: float = 0.5, missing_penalty: float = 2.0) -> Column:
    """Fee + half spread + penalties for thin depth, adverse imbalance and missing flow, in bps."""
    return F.lit(fee) + F.coalesce(half_spread, F.lit(0.0)) + F.when(depth < shallow, depth_penalty).otherwise(0.0) + F.when(F.abs(imbalance) > 0.6, imbalance_penalty).otherwise(0.0) + F.when(has_flow, 0.0).otherwise(missing_penalty)


@dataclass(frozen=True)
class Ladder:
    """One configuration of the grid simulator; prices in bps of the anchor."""

    config_id: int
    rungs: int = 4
    spacing_bps: float = 20.0
    take_profit_bps: float = 25.0
    stop_bps: float = 120.0
    timeout_ms: int = 3_600_000
    rebalance_ms: int = 1_800_000
    cooldown_ms: int = 0
    halt_drawdown_bps: float = 2_000.0
    fee_bps: float = 1.0


class LadderRun:
    """Long grid: rungs below an anchor are filled as price falls and closed at profit, stop or timeout."""

    def __init__(self, cfg: Ladder):
        self.cfg, self.anchor, self.anchored, self.pause = cfg, None, 0, -(1 << 62)
        self.open: list[tuple[int, float, int]] = []
        self.used: set[int] = set()
        self.total = self.peak = self.worst = 0.0
        self.counts = {"fills": 0, "profits": 0, "stops": 0, "timeouts": 0, "rebalances": 0, "halted": 0}

    def tick(self, t: int, p: float) -> None:
        cfg, n = self.cfg, self.counts
        if n["halted"]:
            return
        if self.anchor is None or (not self.open and t - self.anchored >= cfg.rebalance_ms):
            n["rebalances"] += self.anchor is not None
            self.anchor, self.anchored, self.used = p, t, set()
        left = []
        for rung, entry, at in self.open:
            move = (p / entry - 1) * 1e4
            kind = "profits" if move >= cfg.take_profit_bps else "stops" if move <= -cfg.stop_bps else "timeouts" if t - at >= cfg.timeout_ms else ""
            if not kind:
                left.append((rung, entry, at))
                continue
            n[kind] += 1
            self.total += move - 2 * cfg.fee_bps
            self.peak, self.worst = max(self.peak, self.total), min(self.worst, self.total - max(self.peak, self.total))
            self.used.discard(rung)
            if kind == "stops":
                self.pause = t + cfg.cooldown_ms
        self.open = left
        if self.peak - self.total > cfg.halt_drawdown_bps:
            n["halted"] = 1
            return
        for rung in range(1, cfg.rungs + 1):
            level = self.anchor * (1 - rung * cfg.spacing_bps / 1e4)
            if t >= self.pause and rung not in self.used and p <= level:
                self.open.append((rung, level, t))
                self.used.add(rung)
                n["fills"] += 1

    def result(self) -> dict[str, float]:
        return {**self.counts, "net_bps": self.total, "max_drawdown_bps": self.worst, "open": len(self.open)}


def ladder_sweep(df: DataFrame, keys: Sequence[str], time: str, seq: str, price: str, configs: Sequence[Ladder]) -> DataFrame:
    """Every configuration on every series (D6, D7): rows are dealt by series and configuration and folded apart.

    The state is the run's open rungs and totals, so memory does not grow with the series.
    """
    by_id = {k.config_id: k for k in configs}
    rows = df.select(*keys, c(time).alias("_t"), c(seq).alias("_s"), c(price).alias("_p"))
    rows = rows.withColumn("config_id", F.explode(F.array(*[F.lit(k).cast("long") for k in by_id])))
    names = ("fills", "profits", "stops", "timeouts", "rebalances", "halted", "net_bps", "max_drawdown_bps", "open")
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def step(pdf: pd.DataFrame, run: LadderRun | None) -> tuple[None, LadderRun]:
        run = run or LadderRun(by_id[int(pdf["config_id"].iloc[0])])
        for t, p in zip(pdf["_t"].tolist(), pdf["_p"].tolist()):
            run.tick(t, p)
        return None, run

    def finish(key: tuple, run: LadderRun) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip((*keys, "config_id"), key)), **run.result()}])

    schema = f"{key_types}, config_id long, " + ", ".join(f"{n} {'double' if n.endswith('bps') else 'long'}" for n in names)
    return fold(rows, [*keys, "config_id"], ["_t", "_s"], step, schema, finish)


def backtest(df: DataFrame, pred: str, actual: str, threshold: float, cost: float) -> DataFrame:
    """Threshold signals with a round-trip cost and running equity per row."""
    side = F.when(c(pred) > threshold, 1).when(c(pred) < -threshold, -1).otherwise(0)
    df = df.withColumn("side", side)
    return df.withColumn("net", F.when(c("side") != 0, c("side") * c(actual) - cost).otherwise(0.0)).withColumn("hit", F.when(c("side") != 0, (c("net") > 0).cast("int")))


def profit_share(net: Column) -> Column:
    return safe_div(F.sum(F.greatest(net, F.lit(0.0))), F.sum(F.abs(net)))
