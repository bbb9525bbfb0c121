"""Labels over future windows (L*). Every function here looks ahead; none belongs among features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import ieee_div, log_bps, simple_bps
from tidemark.operators.series import Series
from tidemark.operators.sliding import around

c = F.col


def future_return(s: Series, price: Column, h: int) -> Column:
    return log_bps(s.lead(price, h), price)


def excursions(s: Series, high: Column, low: Column, price: Column, h: int) -> tuple[Column, Column]:
    """Best and worst move over exactly h later rows, at least 0 and at most 0."""
    w = s.next_n(h)
    full = F.count(price).over(w) == h
    mfe, mae = log_bps(F.max(high).over(w), price), log_bps(F.min(low).over(w), price)
    return F.when(full, F.greatest(mfe, F.lit(0.0))), F.when(full, F.least(mae, F.lit(0.0)))


def return_path(s: Series, price: Column, h: int) -> Column:
    """Simple returns in bps of each of the next h rows, NULL from a price of 0; NULL if fewer follow (L3, M8)."""
    later = F.collect_list(price).over(s.next_n(h))
    return F.when(F.size(later) == h, F.transform(later, lambda p: (F.try_divide(p, price) - 1) * 1e4))


def envelope(path: Column, kind: str) -> Column:
    """Running best (high) or worst (low) of a path, starting from 0."""
    pick = F.greatest if kind == "high" else F.least
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: pick(F.lit(0.0), (F.array_max if kind == "high" else F.array_min)(F.slice(path, F.lit(1), k))))


def first_touch(path: Column, up: Column | float, down: Column | float) -> Column:
    """+1 or -1 for the barrier touched first, 0 for none or both in the same row."""
    up, down = (x if isinstance(x, Column) else F.lit(x) for x in (up, down))
    a = F.array_position(F.transform(path, lambda r: r >= up), True)
    b = F.array_position(F.transform(path, lambda r: r <= -down), True)
    hit = F.when((a > 0) & ((b == 0) | (a < b)), 1).when((b > 0) & ((a == 0) | (b < a)), -1).otherwise(0)
    return F.when(path.isNotNull(), hit)


def touch_step(path: Column, down: Column) -> Column:
    """Step of the first value at or below -down; 0 if none."""
    return F.when(path.isNotNull(), F.array_position(F.transform(path, lambda r: r <= -down), True).cast("int"))


def barrier_class(highs: Column, lows: Column, price: Column, tp: float, sl: float, long: bool = True) -> dict[str, Column]:
    """Take-profit or stop first on bars (L10, L17, L19): class 0 if a bar holds both first, plus flags.

    highs and lows are arrays of later bars. stop_first counts such a bar as a stop.
    """
    up, down = (tp, sl) if long else (sl, tp)
    a = F.array_position(F.transform(highs, lambda h: simple_bps(h, price) >= up), True)
    b = F.array_position(F.transform(lows, lambda x: simple_bps(x, price) <= -down), True)
    win, loss = (a, b) if long else (b, a)
    both = (a > 0) & (a == b)
    first = F.when((win > 0) & ((loss == 0) | (win < loss)), 1).when((loss > 0) & ((win == 0) | (loss < win)), -1).otherwise(0)
    return {"class": first, "ambiguous": both.cast("int"), "unresolved": ((a == 0) & (b == 0)).cast("int"), "or_null": F.when(both, None).otherwise(first), "stop_first": F.when(both, -1).otherwise(first)}


def direction(x: Column, band: float | Column, inclusive: bool = False) -> Column:
    """+1 / 0 / -1 with a flat band; the fixed mode is strict, the volatility mode inclusive."""
    band = band if isinstance(band, Column) else F.lit(band)
    up, down = (x >= band, x <= -band) if inclusive else (x > band, x < -band)
    return F.when(x.isNull() | band.isNull(), None).when(up, 1).when(down, -1).otherwise(0)


def volatility_threshold(s: Series, step_return: Column, n: int, minutes: int = 3, k: float = 1.0, least_move: float = 1.0, least: int = 2) -> Column:
    """std of one-step returns over n rows, scaled to a horizon; at least least_move."""
    return F.greatest(s.std(step_return, n, least=least) * (minutes**0.5) * k, F.lit(least_move))


def volatility_events(mfe: Column, mae: Column, vol: Column, h: int, severities: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)) -> dict[str, Column]:
    """Up- and downside events in units of volatility scaled to the horizon."""
    unit = vol * (h**0.5)
    out = {}
    for k in severities:
        name = str(k).replace(".", "_")
        out |= {f"up_{name}_h{h}": F.when(unit > 0, (mfe >= k * unit).cast("int")), f"down_{name}_h{h}": F.when(unit > 0, (mae <= -k * unit).cast("int"))}
    return out


def hazard(step: Column, edges: tuple[int, ...] = (1, 2, 4, 8)) -> dict[str, Column]:
    """Whether the first hit lies in (previous edge, edge]."""
    out, before = {}, 0
    for h in edges:
        out[f"hazard_{h}"] = F.when(step.isNotNull(), ((step > before) & (step <= h)).cast("int"))
        before = h
    return out


def expansion(s: Series, returns: Column, high: Column, low: Column, h: int, n: int) -> dict[str, Column]:
    """Future volatility above the current one; future range above the shifted median of past ranges."""
    w = s.next_n(h)
    full = F.count(returns).over(w) == h
    return {"vol_expansion": F.when(full, (F.stddev_pop(returns).over(w) > s.std(returns, n)).cast("int")), "future_range": F.when(full, log_bps(F.max(high).over(w), F.min(low).over(w)))}


def structure_regime(first_high: Column, first_low: Column, second_high: Column, second_low: Column) -> Column:
    """Higher highs and lows, lower ones, or neither, between the halves of a window."""
    return F.when((second_high > first_high) & (second_low > first_low), "up").when((second_high < first_high) & (second_low < first_low), "down").otherwise("range")


def halves(s: Series, high: Column, low: Column, m: int, h: int) -> dict[str, Column]:
    a, b = s.spec.rowsBetween(1, m), s.spec.rowsBetween(m + 1, h)
    return {"first_high": F.max(high).over(a), "first_low": F.min(low).over(a), "second_high": F.max(high).over(b), "second_low": F.min(low).over(b), "rows_ahead": F.count(high).over(s.next_n(h))}


def event_labels(df: DataFrame, keys: Sequence[str], mid: str, spread: str, depth: str, ms: int, t: str) -> DataFrame:
    """Move, extremes with their first times, velocities, spread and depth shocks over (t, t + ms]."""
    df = around(df, keys, t, ms, list(dict.fromkeys([mid, spread, depth])), timed=mid)
    up, down = simple_bps(c(f"high_{mid}"), c(mid)), simple_bps(c(f"low_{mid}"), c(mid))
    wide, thin = c(f"high_{spread}"), c(f"low_{depth}")
    return df.withColumns({
        "up_bps": up, "down_bps": down, "up_velocity": ieee_div(up, (c("high_at") - c(t)) / 1000.0), "down_velocity": ieee_div(down, (c("low_at") - c(t)) / 1000.0),
        "spread_shock": F.when(wide > 2 * c(spread), 1).when(wide.isNotNull(), 0), "depth_drop": F.when(thin < 0.5 * c(depth), 1).when(thin.isNotNull(), 0), "rows_ahead": c("n_ahead"),
    })


def instability(df: DataFrame, keys: Sequence[str], t: str, price: str, ms: int) -> DataFrame:
    """unstable: a wide range, fall or rise over (t, t + ms], or a price far above its median over [t - ms, t]; n rows ahead."""
    df = around(df, keys, t, ms, [price], median=price)
    high, low, now = c(f"high_{price}"), c(f"low_{price}"), c(price)
    wide = (ieee_div(high, low) > 20) | (ieee_div(low, now) < 0.1) | (ieee_div(high, now) > 10) | (now > 3 * c("median"))
    return df.withColumns({"n": c("n_ahead"), "unstable": (c("n_ahead") > 0) & wide})


def gapless_future(df: DataFrame, s: Series, t: str, h: int, max_gap: int) -> DataFrame:
    """ok = the next h rows exist and each step is in (0, max_gap]."""
    df = df.withColumn("_gap", c(t) - s.lag(t))
    w = s.next_n(h)
    ok = (F.count("_gap").over(w) == h) & (F.min("_gap").over(w) > 0) & (F.max("_gap").over(w) <= max_gap)
    return df.withColumn("future_ok", F.coalesce(ok, F.lit(False))).drop("_gap")


def touch_summary(df: DataFrame, keys: list[str], touch: str) -> DataFrame:
    """Take-profit before downside, the reverse, neither, and coverage."""
    return df.groupBy(*keys).agg(F.count_if(c(touch) == 1).alias("tp_first"), F.count_if(c(touch) == -1).alias("down_first"), F.count_if(c(touch) == 0).alias("neither"), (F.count(touch) / F.count("*")).alias("coverage"), F.avg(F.when(c(touch) != 0, (c(touch) == 1).cast("double"))).alias("tp_share"))
