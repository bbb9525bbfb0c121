"""Mixing sources to target weights by the cube method.

Every source gets a target (weights, capped at `cap` times its size, the excess shared again); a
document of a source is taken floor(target/size) times for sure and once more with the remaining
fraction as inclusion probability. The flight phase moves these probabilities inside the null space of
two constraints, word total and document total, so both stay exact until at most two documents of a
chunk are undecided. Chunks are cut by hash, run apart from one another, and pass their undecided
documents to the next, thousands of times smaller round; the last two of a source are landed on the
combination nearest to the target.

Defined results: null text has size 0, null source is a source of its own (last in order); zero-sized
documents and sources take part with 0 words; an empty table gives an empty mix. Repeated rows are
separate documents. Draws come from a generator seeded with source, chunk and round: reruns agree.
"""

from __future__ import annotations

import zlib
from fractions import Fraction
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise

CHUNK = 4096
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_BROADCAST_BYTES = 8 << 20


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> dict[str | None, float]:
    """Target of each source: shares by weight, none above cap times the source's size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, open_, out = Fraction(sum(n for _, n in order)), dict(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if unit * weight[s] > cap * n]
        if not full:
            return out | {s: float(unit * weight[s]) for s in open_}
        for s in full:
            out[s] = float(cap * open_[s])
            left -= cap * open_.pop(s)
    return out


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p along null vectors of (sizes, ones) until at most two entries lie inside (0, 1)."""
    size, p, draw = size.tolist(), p.tolist(), rng.random(len(p) + 2).tolist()
    todo = [i for i in range(len(p)) if 0 < p[i] < 1]
    held, at, step = todo[:3], 3, 0
    while len(held) > 1:
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1, -1, 0)
        elif size[held[0]] == size[held[1]]:
            u = (1, -1)
        else:
            break
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(held, u) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(held, u) if x)
        move = up if draw[step % len(draw)] * (up + down) < down else -down
        step += 1
        for i, x in zip(held, u):
            p[i] = p[i] + move * x
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        rest = [i for i in held if 0 < p[i] < 1]
        if len(rest) == len(held):  # rounding left all inside: settle the one nearest to a border
            i = min(held, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = round(p[i])
            rest.remove(i)
        held = rest + todo[at : at + 3 - len(rest)]
        at += 3 - len(rest)
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Settle the last undecided entries (two at most) on the words nearest to what they stand for."""
    p, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    want, count = float((size[left] * p[left]).sum()), float(p[left].sum())
    best = min(range(2 ** len(left)), key=lambda m: (abs(sum(int(size[i]) for k, i in enumerate(left) if m >> k & 1) - want), abs(bin(m).count("1") - count), m))
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    return p


def _round(rows: DataFrame, n: int) -> DataFrame:
    """One flight in every (source, chunk); a source in its last round is one chunk and lands."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([zlib.crc32(repr(key[0]).encode()), int(key[1]), n])
        size = pdf["size"].to_numpy()
        p = flight(size, pdf["p"].to_numpy(), rng)
        return pdf.assign(p=land(size, p) if pdf["chunks"].iloc[0] == 1 else p)

    return rows.groupBy("source", "chunk").applyInPandas(run, rows.schema)


def _hinted(table: DataFrame, facts: list[tuple]) -> DataFrame:
    """A table of one row a source, broadcast where its bytes are few; a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if sum(64 + len((f[0] or "").encode()) for f in facts) <= _BROADCAST_BYTES else table


def _key() -> Column:
    """Tells texts and sources apart; their null flags keep (text, null) from (null, text)."""
    return F.xxhash64(F.col("text").isNull(), F.col("text"), F.col("source").isNull(), F.col("source"))


def _each(n: Column) -> Column:
    """1 to n as two nested lists, so that no list grows with a large n."""
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4096)), lambda k: F.struct((k * 4096 + 1).alias("a"), F.least(k * 4096 + 4096, n).alias("b")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, key, seq, size, source_size, target, copies) of every document.

    (doc_id, key, seq) tells rows apart: key hashes text and source, seq numbers exact repetitions.
    """
    if chunk < 8:
        raise ValueError("a chunk has 8 documents at least, or rounds would not shrink")
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), _key().alias("key"), size.alias("size"))
    # Repetitions are counted before they are numbered: a row repeated at will is one row of the shuffle.
    rows = rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("c"))
    rows = rows.withColumn("part", F.explode(_each(F.col("c")))).withColumn("seq", F.explode(F.sequence("part.a", "part.b")))
    rows = materialise(rows.drop("c", "part"), "sizes")
    # One row per source: bounded by the number of sources, not by documents.
    totals = {r.source: (r.n, r.m) for r in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("m")).collect()}
    targets = source_targets([(s, n) for s, (n, _) in totals.items()], weights, cap)
    facts = []
    for s, (n, m) in totals.items():
        ratio = Fraction(targets[s]) / n if n else Fraction(0)
        facts.append((s, n, targets[s], int(ratio), float(ratio - int(ratio)), -(-m // chunk)))
    table = spark.createDataFrame(facts, "source_ string, source_size long, target double, base int, p double, chunks int")
    rows = rows.join(_hinted(table, facts), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("order", F.xxhash64("doc_id", "key", "seq", F.lit(7)))
    settled: list[DataFrame] = []
    for n in count():  # every round leaves two of a chunk at most, so it ends
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("order", F.lit(n)), F.col("chunks")))
        done = materialise(_round(rows, n), "flight")
        left = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done.filter(~left))
        counts = {r.source: r.m for r in done.filter(left).groupBy("source").agg(F.count("*").alias("m")).collect()}
        if not counts:
            break
        facts = [(s, -(-m // chunk)) for s, m in counts.items()]
        again = spark.createDataFrame(facts, "source_ string, chunks int")
        rows = done.filter(left).drop("chunks").join(_hinted(again, facts), F.col("source").eqNullSafe(F.col("source_"))).drop("source_").select(*done.columns)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "key", "seq", "size", "source_size", "target", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every document repeated as often as the mix takes it (0 to cap times).

    Texts are shuffled once at most, and only those that the mix takes. Rows that repeat each other's id,
    text and source share their copies; where their other columns differ, the first of these take more.
    """
    taken = mix(docs, **options).groupBy("doc_id", "key").agg(F.sum("copies").alias("t"), F.count("*").alias("c")).filter("t > 0")
    taken = materialise(taken.select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), "t", "c"), "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), _key().alias("key"))
    # A merge join at every size: neither side grows into a broadcast or a hash table.
    joined = rows.join(taken.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")))
    out = joined.filter("c = 1").select("row", F.col("t").alias("n"))
    if not taken.filter("c > 1").isEmpty():
        # Equal rows become one with a count before the running numbers of their variants are made.
        text = F.to_json("row", {"ignoreNullFields": "false"})
        same = joined.filter("c > 1").groupBy("id", "key", F.xxhash64(text).alias("variant")).agg(F.first("row").alias("row"), F.count("*").alias("m"), F.first("t").alias("t"), F.first("c").alias("c"))
        before = F.sum("m").over(Window.partitionBy("id", "key").orderBy("variant")) - F.col("m")
        share = lambda at: F.col("t").cast("decimal(38,0)") * at / F.col("c")
        spread = same.withColumn("before", before).select("row", (F.ceil(share(F.col("before") + F.col("m"))) - F.ceil(share(F.col("before")))).cast("long").alias("n"))
        out = out.unionByName(spread.filter("n > 0"))
    parts = out.withColumn("part", F.explode(_each(F.col("n"))))
    return parts.withColumn("copy", F.explode(F.sequence("part.a", "part.b"))).select("row.*")
