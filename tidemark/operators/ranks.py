"""Rolling quantiles and ranks with an indexable skip list: a row costs the logarithm of the window.

pandas keeps a window's values in such a list and inserts and deletes one value a row. Batches of a key follow
each other with the last values of the window as their only state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import fused
from tidemark.operators.folds import fold

c = F.col


def rolling_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, quantiles: dict[str, tuple[str, float]] | None = None, ranks: dict[str, str] | None = None, least: int | None = None, before: bool = False) -> DataFrame:
    """df with quantiles (name to column and share) and average-tie ranks over the count (name to column).

    The window is the last n rows, or the n rows before the current one. NULL and NaN are no values; a window of
    fewer than `least` values (n where not given) gives NULL, and so does a row without a value for its rank.
    """
    quantiles, ranks, least = quantiles or {}, ranks or {}, least or n
    columns = list(dict.fromkeys([*(x for x, _ in quantiles.values()), *ranks.values()]))
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.DoubleType()) for x in (*quantiles, *ranks))])

    def step(pdf: pd.DataFrame, state: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        new = pdf[columns].astype("float64").reset_index(drop=True)
        held = new if state is None else pd.concat([state, new], ignore_index=True)
        seen = held.shift(1) if before else held
        out = pdf.copy()
        for name, (x, q) in quantiles.items():
            values = seen[x].rolling(n, min_periods=least)
            low, high = (values.quantile(q, interpolation=side).to_numpy()[-len(new) :] for side in ("lower", "higher"))
            place = q * (seen[x].rolling(n, min_periods=0).count().to_numpy()[-len(new) :] - 1)
            share = place - np.floor(place)
            once = fused(low, 1 - share, high * share)
            out[name] = np.where(share == 0, low, np.where(np.isnan(once), low * (1 - share) + high * share, once))
        for name, x in ranks.items():
            out[name] = seen[x].rolling(n, min_periods=least).rank(method="average", pct=True).to_numpy()[-len(new) :]
        return out, held.tail(n)

    return fold(df, keys, order, step, schema)


def burst_threshold(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int, q: float) -> DataFrame:
    """threshold: the larger of the quantile of the positive values and the median of all of the n rows before; burst: x is above it."""
    rows = df.withColumn("_positive", F.when(c(x) > 0, c(x)).cast("double"))
    rows = rolling_order(rows, keys, order, n, {"_q": ("_positive", q), "_m": (x, 0.5)}, least=1, before=True)
    limit: Column = F.greatest("_q", "_m")
    return rows.withColumn("threshold", limit).withColumn("burst", F.coalesce(c(x) > c("threshold"), F.lit(False))).drop("_positive", "_q", "_m")
