"""As-of joins without inequality joins: one union, one sort, one running last/first.

Rows of both sides meet in blocks of (key, time), so a key that holds most of the rows lies in as many tasks as
it has blocks; a row whose match lies in another block finds it in a carry table of one row a (key, block).
Ties on time put the right row first for backward joins, so it is seen by a left row of the same time.
Duplicate right rows: the one last in `right_seq` order wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import DAY


def _held(u: DataFrame, keys: Sequence[str], forward: bool) -> DataFrame:
    """One row a (key, block): the right row that the blocks before it (after it, going forward) hold ready."""
    time = -F.col("_at") if forward else F.col("_at")  # going forward: the first time, and of its duplicates the last
    per = u.groupBy(*keys, "_block").agg(F.max_by("_m", F.when(F.col("_side") == 0, F.struct(time.alias("at"), F.col("_m.seq").alias("seq")))).alias("_edge"))
    w = Window.partitionBy(*keys).orderBy("_block")
    edge = F.first("_edge", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return per.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_block"]], edge.alias("_held"))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], direction: str = "backward", prefix: str = "ctx_", max_age: int | None = None, right_time: str | None = None, right_seq: str | None = None, offset: int = 0, block: int = DAY) -> DataFrame:
    """left with prefix+column of the matched right row, prefix+"t" (its time) and prefix+"age" (ms).

    direction: backward (at or before), forward (at or after) or nearest (backward wins ties). The
    match is sought at time + offset. Rows beyond max_age have NULLs. block: time span of a block; it deals
    rows to tasks and does not change the result.
    """
    rt, seq = right_time or time, right_seq or right_time or time
    match = F.struct(F.col(rt).cast("long").alias("t"), F.col(seq).alias("seq"), *[F.col(c).alias(f"c_{c}") for c in columns])
    r = right.select(*keys, F.col(rt).cast("long").alias("_at"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"), match.alias("_m"), F.lit(0).alias("_side"))
    m_type = r.schema["_m"].dataType
    l = left.select(*keys, (F.col(time) + offset).cast("long").alias("_at"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(m_type).alias("_m"), F.lit(1).alias("_side"))
    u = l.unionByName(r).withColumn("_block", F.floor(F.col("_at") / block))
    by_seq, near = F.col("_m.seq"), [*keys, "_block"]
    # Going forward, left rows come first at equal times, and the last duplicate is the first one met.
    orders = {"_b": ["_at", "_side", by_seq], "_f": ["_at", F.desc("_side"), by_seq.desc()]}
    sides = {"backward": ["_b"], "forward": ["_f"]}.get(direction, ["_b", "_f"])
    out = u
    for s in sides:
        w = Window.partitionBy(*near).orderBy(*orders[s])
        inside = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if s == "_b" else F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        out = out.withColumn(s, inside)
    out = out.filter("_side = 1")
    for s in sides:
        held = _held(u, keys, s == "_f")
        on = F.lit(True)
        for k in near:
            on = on & out[k].eqNullSafe(held[f"_k_{k}"])
        out = out.join(held, on, "left").withColumn(s, F.coalesce(s, "_held")).drop("_held", *[f"_k_{k}" for k in near])
    if direction == "nearest":
        closer = F.coalesce(F.col("_f.t") - F.col("_at") < F.col("_at") - F.col("_b.t"), F.col("_b").isNull())
        u = out.withColumn("_hit", F.when(closer, F.col("_f")).otherwise(F.col("_b")))
    else:
        u = out.withColumn("_hit", F.col(sides[0]))
    age = F.abs(F.col("_at") - F.col("_hit.t"))
    if max_age is not None:
        u = u.withColumn("_hit", F.when(age <= max_age, F.col("_hit")))
    return u.filter("_side = 1").select("_row.*", *[F.col(f"_hit.c_{c}").alias(prefix + c) for c in columns], F.col("_hit.t").alias(prefix + "t"), age.alias(prefix + "age"))


def with_context(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], max_age: int, prefix: str = "ctx_", default: float = 0.0, missing_age: int = -1, direction: str = "backward", gate: Column | None = None, **options) -> DataFrame:
    """asof() with defaults for unmatched rows, an availability flag and an optional gate on the context."""
    out = asof(left, right, keys, time, columns, direction, prefix, max_age, **options)
    ok = F.col(prefix + "t").isNotNull() if gate is None else F.col(prefix + "t").isNotNull() & F.coalesce(gate, F.lit(False))
    return out.withColumns({prefix + "available": ok.cast("int")} | {prefix + c: F.when(ok, F.col(prefix + c)).otherwise(F.lit(default)) for c in columns} | {prefix + "age": F.when(ok, F.col(prefix + "age")).otherwise(F.lit(missing_age))}).drop(prefix + "t")


def layered(left: DataFrame, layers: dict[str, tuple[DataFrame, Sequence[str], int]], keys: Sequence[str], time: str) -> DataFrame:
    """Several contexts, each with its own age limit."""
    out = left
    for name, (right, columns, max_age) in layers.items():
        out = with_context(out, right, keys, time, columns, max_age, prefix=f"{name}_")
    return out


def forward_return(rows: DataFrame, keys: Sequence[str], time: str, price: str, horizon: int, max_gap: int) -> DataFrame:
    """Price at the first row at or after t + horizon, unless it is more than max_gap late (J12); a NULL key equals no key."""
    from tidemark.functions.semantics import simple_bps

    out = asof(rows, rows.dropna(subset=list(keys)), keys, time, [price], "forward", "exit_", max_gap, offset=horizon)
    return out.withColumn("forward_bps", simple_bps(F.col(f"exit_{price}"), F.col(price)))
