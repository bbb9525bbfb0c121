"""Exact top-k inner products by ball-tree branch and bound.

Vectors become integers floor(256 * x); the score is their inner product, exact. Vectors are dealt to
shards by hash; each shard's ball tree is built once and stored as a row. A node's inner-product upper
bound for a query is q.c + |q| r. A query first runs down to the most promising leaf, which gives a k-th
score; then the tree is searched from the root, level by level, and a node whose bound is below the k-th
score goes with its whole subtree; the leaves left are visited by falling bound while the k-th score
rises. Queries search in three waves (home shard, a quarter of the others, the rest), and the k-th score
found so far travels with the query to the next wave. Queries travel in blocks, so a task holds one
shard's tree and one block, whatever the number of either.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; a query meets only vectors of its own length; rows with the query's id are its own;
repeated (id, vector) rows count once. Ties go to the smaller id. With no other vector, no rows. A
shard holds about SHARD_BYTES of components, so longer vectors make shards of fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise

LEAF = 256
SHARD_ROWS, SHARD_BYTES = 16_384, 8 << 20
BLOCK_QUERIES = 8_192
_LOWEST = np.iinfo(np.int64).min
_EXACT = 2.0**53


class BallTree:
    """Nodes as arrays: centre, radius, children (0 for a leaf) and the range of rows, which are in leaf order."""

    PARTS = ("ids", "vectors", "centre", "radius", "child", "begin", "end")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, *built: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        if built:
            self.centre, self.radius, self.child, self.begin, self.end = built
        else:
            self._build(leaf)
        self.norm = float(np.abs(self.vectors).max(initial=0))

    def _build(self, leaf: int) -> None:
        order = np.argsort(self.ids, kind="stable")
        centre, radius, child, begin, end = [], [], [], [], []
        second: dict[int, int] = {}
        todo = [(0, len(order), -1)]
        while todo:
            a, b, parent = todo.pop()
            x = self.vectors[order[a:b]]
            middle = x.mean(axis=0)
            away = np.sqrt(((x - middle) ** 2).sum(axis=1))
            if parent >= 0 and not child[parent]:
                child[parent] = len(centre)  # the other child comes after the subtree of this one
            elif parent >= 0:
                second[parent] = len(centre)
            node = len(centre)
            centre.append(middle)
            radius.append(float(away.max(initial=0)))
            child.append(0)
            begin.append(a)
            end.append(b)
            if b - a > leaf and radius[-1] > 0:
                p = x[int(away.argmax())]
                q = x[int(((x - p) ** 2).sum(axis=1).argmax())]
                order[a:b] = order[a:b][np.argsort(x @ (q - p), kind="stable")]
                middle_row = (a + b) // 2
                todo += [(middle_row, b, node), (a, middle_row, node)]
        self.ids, self.vectors = self.ids[order], self.vectors[order]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.child = np.array([[x, second.get(i, 0)] for i, x in enumerate(child)], np.int64)
        self.begin, self.end = np.array(begin, np.int64), np.array(end, np.int64)

    def pack(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k)).tobytes() for k in self.PARTS}

    @classmethod
    def unpack(cls, row: dict[str, bytes], dim: int) -> BallTree:
        kinds = {"ids": np.int64, "child": np.int64, "begin": np.int64, "end": np.int64}
        a = {k: np.frombuffer(row[k], kinds.get(k, np.float64)) for k in cls.PARTS}
        nodes, rows = len(a["radius"]), len(a["ids"])
        return cls(a["ids"], a["vectors"].reshape(rows, dim), a["centre"].reshape(nodes, dim), a["radius"], a["child"].reshape(nodes, 2), a["begin"], a["end"])

    def bounds(self, queries: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Upper bound of the inner products of each query with the rows of its node, above any rounding."""
        length, centre = np.sqrt((queries**2).sum(axis=1)), self.centre[node]
        size = np.sqrt((centre**2).sum(axis=1)) + self.radius[node]
        return (queries * centre).sum(axis=1) + length * self.radius[node] + 1e-9 * length * size + 0.5

    def scores(self, queries: np.ndarray, a: int, b: int) -> np.ndarray:
        if self.norm * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < _EXACT:
            return (queries @ self.vectors[a:b].T).astype(np.int64)
        whole = [[sum(int(x) * int(y) for x, y in zip(q, v)) for v in self.vectors[a:b]] for q in queries]
        return np.array([[max(_LOWEST + 1, min(np.iinfo(np.int64).max, x)) for x in line] for line in whole], dtype=np.int64)

    def _visit(self, queries: np.ndarray, own: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], best: np.ndarray, name: np.ndarray, limit: np.ndarray) -> None:
        """Score the rows of a leaf for each (query, leaf) pair, at most one leaf a query."""
        who, leaf = pairs
        order = np.argsort(leaf, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else []:
            a, b, q = int(self.begin[leaf[group[0]]]), int(self.end[leaf[group[0]]]), who[group]
            s = self.scores(queries[q], a, b)
            s[self.ids[a:b][None, :] == own[q][:, None]] = _LOWEST
            some = s.max(axis=1) >= limit[q]
            q, s = q[some], s[some]
            if not len(q):
                continue
            all_s = np.concatenate([best[q], s], axis=1)
            all_i = np.concatenate([name[q], np.broadcast_to(self.ids[a:b], s.shape)], axis=1)
            top = np.lexsort((all_i, ~all_s), axis=1)[:, : best.shape[1]]  # ~x falls as x grows and never overflows
            best[q], name[q] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            limit[q] = np.maximum(limit[q], best[q, -1])

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Best scores and ids of each query among vectors that score at least its floor; and nodes bounded."""
        m = len(queries)
        best = np.full((m, k), _LOWEST, dtype=np.int64)
        name = np.full((m, k), np.iinfo(np.int64).max, dtype=np.int64)
        limit, seen = floor.copy(), 0
        # Down to one leaf by the better child each time: a first k-th score.
        first, inner = np.zeros(m, np.int64), np.arange(m if self.child[0, 0] else 0)
        while len(inner):
            two = self.child[first[inner]]
            left, right = (self.bounds(queries[inner], two[:, x]) for x in (0, 1))
            seen += 2 * len(inner)
            first[inner] = np.where(left >= right, two[:, 0], two[:, 1])
            inner = inner[self.child[first[inner], 0] > 0]
        self._visit(queries, own, (np.arange(m), first), best, name, limit)
        # From the root by levels; what cannot reach the k-th score is cut with its subtree.
        who, node = np.arange(m), np.zeros(m, np.int64)
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            bound = self.bounds(queries[who], node)
            seen += len(who)
            live = bound >= limit[who]
            who, node, bound = who[live], node[live], bound[live]
            leaf = self.child[node, 0] == 0
            rest = leaf & (node != first[who])
            leaves.append((who[rest], node[rest], bound[rest]))
            who, node = np.repeat(who[~leaf], 2), self.child[node[~leaf]].ravel()
        who, node, bound = (np.concatenate(x) for x in zip(*leaves))
        order = np.lexsort((-bound, who))
        who, node, bound = who[order], node[order], bound[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)  # 0 for the best leaf of each query, and so on
        for t in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero(turn == t)
            now = now[bound[now] >= limit[who[now]]]
            if not len(now):
                break
            self._visit(queries, own, (who[now], node[now]), best, name, limit)
        return best, name, seen


def pack(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): integer components as packed doubles; unusable rows are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            n = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
            edge = np.r_[0, np.cumsum(np.maximum(n, 0))]
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            good = np.flatnonzero((n >= 0) & (bad[edge[1:]] == bad[edge[:-1]]) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            v = [values[edge[i] : edge[i + 1]].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(n[good], pa.int32()), pa.array(v, pa.binary())], names=["id", "dim", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, dim int, v binary")


def _matrix(packed: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)


def _trees(vectors: DataFrame) -> DataFrame:
    """One row a shard: its ball tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        tree = BallTree(pdf["id"].to_numpy(), _matrix(pdf["v"], dim))
        return pd.DataFrame([{"dim": dim, "shard": pdf["shard"].iloc[0], **tree.pack()}])

    return vectors.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, " + ", ".join(f"{k} binary" for k in BallTree.PARTS))


def _search(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One task: one shard's tree and one block of queries, with their shares of the k-th score as floor."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        row = left.iloc[0]
        dim = int(row["dim"])
        best, name, _ = BallTree.unpack(row, dim).search(_matrix(right["q"], dim), right["query_id"].to_numpy(), right["floor"].to_numpy(), k)
        out = pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(), k), "vec_id": name.ravel(), "score": best.ravel()})
        return out[out["score"] > _LOWEST]

    return trees.groupBy("dim", "shard", "block").cogroup(queries.groupBy("query_dim", "to", "query_block")).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id `every` divides."""
    rows = materialise(pack(vectors, id_col, vector_col).dropDuplicates(["id", "v"]), "vectors")
    is_query = F.col("id") % every == 0
    n, m, components = rows.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows), -(-8 * components // SHARD_BYTES)), max(1, -(-m // block_queries))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    # One column per block of queries: trees are copied once a block, never vector by vector.
    trees = materialise(_trees(rows), "trees").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.filter(is_query).select(
        F.col("id").alias("query_id"), F.col("dim").alias("query_dim"), F.col("v").alias("q"), F.col("shard").alias("home"),
        F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("query_block"),
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def kept(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    # Shards at distance 0 from home, then the next quarter, then the rest.
    edges = sorted({0, 1, 1 + (shards - 1) // 4, shards})
    found = None
    for low, high in zip(edges[:-1], edges[1:]):
        sent = queries.withColumn("floor", F.lit(_LOWEST + 1))
        if found is not None:
            kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            sent = queries.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(_LOWEST + 1))).drop("kth")
        sent = sent.withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).withColumn("to", F.pmod(F.col("home") + F.col("step"), F.lit(shards)))
        wave = _search(trees, sent, k)
        wave = wave if found is None else wave.unionByName(found.drop("rank"))
        found = kept(wave) if high == shards else materialise(kept(wave), "wave")
    return found.select("query_id", "rank", "vec_id", "score")
