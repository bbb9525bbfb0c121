"""Event-time microstructure windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import floor_to
from tidemark.functions.semantics import ieee_div, log_bps, safe_div, simple_bps
from tidemark.operators.series import Series
from tidemark.operators.sliding import time_ranges

c = F.col


def past_values(df: DataFrame, s: Series, x: str, spans: dict[str, int]) -> DataFrame:
    """df with a column a span: the first value of x in [t - ms, t] (W22). Blocks of time spread a key; a row costs a search, not its range.

    Order columns after the time decide between rows of one time.
    """
    out = time_ranges(df, s.keys, s.order[0], x, x, [ms + 1 for ms in spans.values()], s.order[1:], first_only=True)
    return out.withColumns({name: c(f"r{ms + 1}.first") for name, ms in spans.items()}).drop(*[f"r{ms + 1}" for ms in spans.values()])


def regime_windows(df: DataFrame, s: Series, price: str, step_return: str, spans: Sequence[int]) -> DataFrame:
    """Return, slope, volatility, range, persistence over (t - ms, t] for each span.

    step_return is the return of each row in bps; the slope is in bps a second. Time is the first column of the
    series' order; rows without one have NULLs.
    """
    out = time_ranges(df, s.keys, s.order[0], price, step_return, spans, s.order[1:])
    for ms in spans:
        r, n = c(f"r{ms}"), f"_{ms // 1000}s"
        out = out.withColumns({
            "return" + n: log_bps(c(price), r["first"]), "vol" + n: F.sqrt(r["var"]), "range" + n: log_bps(r["high"], r["low"]), "sum" + n: r["sum"],
            "up" + n: safe_div(r["up"], r["known"]), "down" + n: safe_div(r["down"], r["known"]), "slope" + n: r["slope"], "n" + n: r["n"].cast("long"),
        })
    return out.drop(*[f"r{ms}" for ms in spans])


def changes(df: DataFrame, s: Series, columns: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """Change, relative change (by IEEE division: from 0 an infinity or NaN) and acceleration of columns over look-backs."""
    cols = {}
    for x in columns:
        past = {ms: f"_{x}_{ms}" for ms in spans}
        df = past_values(df, s, x, {name: ms for ms, name in past.items()})
        for ms in spans:
            old = c(past[ms])
            cols |= {f"{x}_change_{ms // 1000}s": c(x) - old, f"{x}_relative_{ms // 1000}s": ieee_div(c(x) - old, F.abs(old))}
        if len(spans) > 1:
            a, b = (c(x) - c(past[ms]) for ms in (spans[0], spans[1]))
            cols[f"{x}_acceleration"] = a / (spans[0] / 1000.0) - b / (spans[1] / 1000.0)
    return df.withColumns(cols).drop(*[f"_{x}_{ms}" for x in columns for ms in spans])


def freshness(df: DataFrame, s: Series, limit_ms: int = 1500) -> DataFrame:
    """Gap to the row before and whether it is large."""
    gap = c(s.order[0]) - s.lag(s.order[0])
    return df.withColumns({"gap_ms": gap, "large_gap": F.coalesce(gap > limit_ms, F.lit(False))})


def micro_bundle(df: DataFrame, s: Series, mid: str, buy: str, sell: str, spans: Sequence[int]) -> DataFrame:
    """Current (t - ms, t] and previous (t - 2 ms, t - ms] windows with velocity and bursts (W26, W27). Shares of no volume follow IEEE division."""
    cols = {}
    for ms in spans:
        now, old, n = s.past_ms(ms), s.previous_ms(ms), f"_{ms // 1000}s"
        flow, before = F.sum(c(buy) - c(sell)).over(now), F.sum(c(buy) - c(sell)).over(old)
        volume, volume_before = F.sum(c(buy) + c(sell)).over(now), F.sum(c(buy) + c(sell)).over(old)
        cols |= {
            "flow" + n: flow, "flow_before" + n: F.coalesce(before, F.lit(0.0)), "pressure" + n: ieee_div(flow, volume), "burst" + n: F.coalesce(ieee_div(volume, volume_before), F.when(volume_before.isNotNull(), 0.0)),
            "velocity" + n: log_bps(c(mid), F.first(mid).over(now)) / (ms / 1000.0), "rows" + n: F.count("*").over(now), "bounce" + n: log_bps(c(mid), F.min(mid).over(now)), "break" + n: log_bps(c(mid), F.min(mid).over(old)),
        }
    return df.withColumns(cols)


def panel(df: DataFrame, time: str, symbol: str, value: str, benchmark: str) -> DataFrame:
    """Cross-section per time: median, dispersion, positives, and value relative to a benchmark.

    Aggregated per time and joined back, so one very busy time is pre-aggregated before it is shuffled.
    """
    per = df.groupBy(time).agg(
        F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("dispersion"), F.count_if(c(value) > 0).alias("positives"), F.count(value).alias("members"),
        F.max(F.when(c(symbol) == benchmark, c(value))).alias("benchmark"),
    )
    return df.join(per, time).withColumns({"relative": c(value) - c("benchmark"), "from_median": c(value) - c("median")})


def leadership(df: DataFrame, time: str, venue: str, value: str) -> DataFrame:
    """Per time: the venue that moved most, agreement of signs, spread between venues."""
    return df.groupBy(time).agg(
        F.max_by(venue, F.struct(F.abs(c(value)), c(venue))).alias("leader"), F.countDistinct(F.signum(value)).alias("signs"), (F.max(value) - F.min(value)).alias("spread"),
        F.abs(F.sum(F.signum(value))).alias("agreement"), F.count("*").alias("venues"),
    )


def align_venues(df: DataFrame, time: str, venue: str, value: str, venues: Sequence[str], ms: int, seq: str) -> DataFrame:
    """One row per rounded time with a column per venue: a full outer join as one aggregate."""
    at = floor_to(c(time) + ms // 2, ms).alias("aligned")
    return df.groupBy(at).agg(*[F.max_by(F.when(c(venue) == v, c(value)), F.when(c(venue) == v, F.struct(time, seq))).alias(v) for v in venues])


def exact_grid(df: DataFrame, s: Series, value: str, step: int, n: int) -> DataFrame:
    """Values at t + step .. t + n step, only if every one of them is there."""
    w = s.future_ms(step * n)
    on_grid = F.count(F.when(c(value).isNotNull(), 1)).over(w)
    last = F.last(value).over(w)
    return df.withColumn("grid_value", F.when(on_grid == n, last)).withColumn("grid_bps", simple_bps(c("grid_value"), c(value)))
