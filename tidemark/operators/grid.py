"""Weight grid of an ensemble: every weight vector, threshold and gate scored in one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: Gate on the models' own predictions (rows x models) -> rows that may trade.
GATES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "none": lambda x: np.ones(len(x), dtype=bool),
    "all_positive": lambda x: (x > 0).all(axis=1),
    "same_sign": lambda x: (x > 0).all(axis=1) | (x < 0).all(axis=1),
    "primary": lambda x: x[:, 0] > 0,
}


def simplex(models: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors of whole multiples of 1 / steps that add up to 1."""
    return [tuple(w / steps for w in ws) for ws in product(range(steps, -1, -1), repeat=models) if sum(ws) == steps]


def score_grid(df: DataFrame, time: str, predictions: Sequence[str], actual: str, costs: Sequence[str], block: int, steps: int = 4, thresholds: Sequence[float] = (0.0,), gates: Sequence[str] = ("none",), tie: Sequence[str] = ()) -> DataFrame:
    """One row a (weights, threshold, gate): rows, gross, net after each cost column, wins, dip and share of good blocks.

    A row trades the sign of its blended prediction where that lies beyond the threshold and the gate lets it.
    Arrow batches become one matrix product of rows and grid; what leaves a task is a summary of each piece of a
    time block: sums, and the highest, the lowest and the deepest fall of the running net, which join in time
    order. wins, dip and blocks are by the first cost. Rows lacking a value take no part; rows of one time go by `tie`.
    """
    weights = simplex(len(predictions), steps)
    matrix, names, k = np.array(weights).T, list(gates), len(predictions)
    needed = [*predictions, actual, *costs]
    ok = F.lit(True)
    for x in (time, *needed):
        ok = ok & c(x).isNotNull() & ~F.isnan(c(x).cast("double"))
    rows = df.filter(ok).withColumn("_block", F.floor(c(time) / block).cast("long"))
    dealt = rows.repartition("_block").sortWithinPartitions("_block", time, *tie).select("_block", *[c(x).cast("double").alias(f"_{i}") for i, x in enumerate(needed)])
    sums = [f"net{i}" for i in range(len(costs))]
    fields = ["rows", "gross", *sums, "wins", "high", "low", "dip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            data = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            blocks, x, real = data[0], np.column_stack(data[1 : k + 1]), data[k + 1]
            blend, allowed = x @ matrix, [GATES[g](x) for g in names]
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            out = []
            for (t, threshold), (g, gate) in product(enumerate(thresholds), enumerate(allowed)):
                side = np.where((np.abs(blend) > threshold) & gate[:, None], np.sign(blend), 0.0)
                traded, gross = side != 0, side * real[:, None]
                nets = [np.where(traded, gross - cost[:, None], 0.0) for cost in data[k + 2 :]]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    path = np.cumsum(nets[0][a:b], axis=0)
                    high = np.maximum(np.maximum.accumulate(path, axis=0), 0.0)
                    one = [traded[a:b].sum(axis=0).astype(float), gross[a:b].sum(axis=0), *(n[a:b].sum(axis=0) for n in nets), (traded[a:b] & (nets[0][a:b] > 0)).sum(axis=0).astype(float), high[-1], np.minimum(path.min(axis=0), 0.0), (high - path).max(axis=0)]
                    where = traded[a:b].any(axis=0)
                    size = int(where.sum())
                    out.append(([np.full(size, t), np.full(size, g), np.flatnonzero(where), np.full(size, blocks[a]), np.full(size, piece + p)], [v[where] for v in one]))
            piece += len(cuts) - 1
            keys = [np.concatenate([o[0][i] for o in out]) for i in range(5)]
            values = [np.concatenate([o[1][i] for o in out]) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in keys), *map(pa.array, values)], names=["t", "g", "w", "block", "piece", *fields])

    parts = dealt.mapInArrow(run, "t long, g long, w long, block long, piece long, " + ", ".join(f"{f} double" for f in fields))
    # Pieces of a block come from one task, in order; a combination has as many as there are blocks and batches.
    joined = parts.groupBy("t", "g", "w").agg(F.array_sort(F.collect_list(F.struct("block", "piece", *fields))).alias("pieces"))
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("net", "high", "dip")])

    def follow(a: Column, x: Column) -> Column:
        top = F.greatest(a["high"], a["net"] + x["high"])
        dip = F.greatest(a["dip"], x["dip"], a["high"] - (a["net"] + x["low"]))
        return F.struct((a["net"] + x["net0"]).alias("net"), top.alias("high"), dip.alias("dip"))

    dip = joined.select("t", "g", "w", F.aggregate("pieces", zero, follow)["dip"].alias("dip"))
    per_block = parts.groupBy("t", "g", "w", "block").agg(*[F.sum(f).alias(f) for f in ("rows", "gross", *sums, "wins")])
    total = per_block.groupBy("t", "g", "w").agg(*[F.sum(f).alias(f) for f in ("rows", "gross", *sums, "wins")], F.avg((c("net0") > 0).cast("double")).alias("good_blocks"), F.min("net0").alias("worst_block"))
    label = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (c(at) + 1).cast("int"))
    spelled = [";".join(f"{x:g}" for x in w) for w in weights]
    return total.join(dip, ["t", "g", "w"]).select(
        label(spelled, "w").alias("weights"), label([float(t) for t in thresholds], "t").alias("threshold"), label(names, "g").alias("gate"), c("rows").cast("long").alias("rows"),
        "gross", *sums, (c("wins") / c("rows")).alias("win_rate"), "dip", "good_blocks", "worst_block",
    )


def ranked_grid(grid: DataFrame, least_rows: int) -> DataFrame:
    """Combinations with enough rows first, then by net of the first cost times the share of good blocks, less the dip."""
    score = c("net0") * c("good_blocks") - c("dip")
    order = Window.orderBy((c("rows") < least_rows).cast("int"), F.desc("score"), "weights", "threshold", "gate")
    return grid.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order))  # one row a combination
