"""Sequential passes over sorted series with a small state, in constant memory.

Spark deals the rows by key and sorts them; a task reads them in Arrow batches and carries only the
state of the current key from batch to batch. A key is read by one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: step(rows of one key, state or None) -> (rows to emit or None, state)
Step = Callable[[pd.DataFrame, Any], tuple[pd.DataFrame | None, Any]]


def starts(columns: Sequence[pa.Array]) -> list[int]:
    """Rows at which any of the columns differs from the row before; NULL equals NULL."""
    size = len(columns[0])
    new = np.zeros(size, dtype=bool)
    new[0] = True
    for x in columns:
        now, before = x[1:], x[:-1]
        differs = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.not_equal(pc.is_null(now), pc.is_null(before)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fields: Sequence[T.StructField], start: Callable[[], Any], step: Callable[..., tuple]) -> DataFrame:
    """df with one value a field and row: step(state, *values of the inputs) changes the key's state, made by start(), in place.

    Like fold(), but a call a row and no frame a key: for small states, and for many short keys.
    """
    keys = list(keys)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*rows.schema.fields, *fields])
    at, read = [rows.columns.index(k) for k in keys], [rows.columns.index(x) for x in inputs]
    types = {f.name: pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = starts([batch.column(i) for i in at])
            columns, out = [batch.column(i).to_pylist() for i in read], []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                key = tuple(batch.column(i)[a].as_py() for i in at)
                if key != last or state is None:
                    last, state = key, start()
                out += [step(state, *values) for values in zip(*(x[a:b] for x in columns))]
            made = [pa.array(x, t) for x, t in zip(zip(*out), types.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *types])

    return rows.mapInArrow(run, schema)


def condense(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fields: Sequence[T.StructField], start: Callable[[Any], Any], step: Callable[..., Any], finish: Callable[[Any], list[tuple]]) -> DataFrame:
    """keys and fields only: rows finish(state) of each key, after step(state, *lists of the inputs) has read its rows in order.

    start(first row's inputs) makes the state, which step changes in place. No frame a key, as in scan().
    """
    keys = list(keys)
    rows = df.select(*dict.fromkeys([*keys, *order, *inputs])).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*(rows.schema[k] for k in keys), *fields])
    at, read = [rows.columns.index(k) for k in keys], [rows.columns.index(x) for x in inputs]
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, kinds, out = None, None, None, []

        def emit(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), [*kinds, *types])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, columns = [batch.column(i).type for i in at], [batch.column(i).to_pylist() for i in read]
            names = [batch.column(i).to_pylist() for i in at]
            edges = starts([batch.column(i) for i in at])
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                key = tuple(x[a] for x in names)
                if key != last or state is None:
                    if state is not None:
                        out += [(*last, *row) for row in finish(state)]
                    last, state = key, start(*(x[a] for x in columns))
                step(state, *(x[a:b] for x in columns))
            if out:
                yield emit(out)
                out = []
        if state is not None:
            out += [(*last, *row) for row in finish(state)]
        if out:
            yield emit(out)

    return rows.mapInArrow(run, schema)


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: Any, finish: Callable[[tuple, Any], pd.DataFrame] | None = None) -> DataFrame:
    """Run step over each key's rows in order; finish(key, state) may add rows after a key's last one."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            same = np.ones(len(pdf), dtype=bool)
            for k in keys:
                now, before = pdf[k], pdf[k].shift()
                same &= ((now == before) | (now.isna() & before.isna())).to_numpy(dtype=bool)
            same[0] = True
            edges = [0, *np.flatnonzero(~same).tolist(), len(pdf)]
            names, done = [pdf[k].to_numpy() for k in keys], []
            for a, b in zip(edges[:-1], edges[1:]):
                key = tuple(None if pd.isna(x[a]) else x[a] for x in names)
                if key != last:
                    if last is not None and finish:
                        done.append(finish(last, state))
                    last, state = key, None
                out, state = step(pdf.iloc[a:b], state)
                if out is not None and len(out):
                    done.append(out)
            if done:  # one frame a batch: many short keys do not make many small batches
                yield pd.concat(done, ignore_index=True)
        if last is not None and finish:
            yield finish(last, state)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
