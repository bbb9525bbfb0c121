"""N-gram Jaccard join by MinHash banding.

Texts become sets of five-word shingles (a shorter text is one shingle). Documents with equal sets are
one representative. Band hashes of the MinHash signature are shuffled; the number of bands follows from
the target recall at the threshold. Instead of listing the pairs of a bucket, each member is linked to
the bucket's smallest one, and the components of these links are candidate clusters: any two
representatives that share a bucket are in one cluster. Each cluster's full shingle sets are then
compared exactly; a cluster above a block's size is split into blocks, and tasks take pairs of blocks.
Tasks return, per representative, its number of links and the smallest member it is joined to, never
pairs, so a group of n near copies costs n rows per block.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered.
Defined results: null or empty texts and texts without words are alone in their class (their own id)
and have no links; repeated rows are documents of their own; a class is named by its smallest id (null
only if no member has one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.decontamination import words_of
from tidemark.llm.scratch import input_bytes, materialise, parts_for
from tidemark.llm.token_output import _slices

SIZE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9995, 6
BLOCK_REPS, BLOCK_SHINGLES = 1024, 2_000_000
_BROADCAST_ROWS = 400_000
_CACHE_WORDS = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` hashes so that a pair at the threshold shares one with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        self[word] = h = xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    parts = [words_of(t) for t in texts]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    # Zero words after each text: shingles that reach into them are not used.
    flat = np.zeros(int(n.sum()) + size * (len(n) + 1), dtype=np.uint64)
    first = np.r_[0, np.cumsum(n + size)][:-1].astype(np.int64)
    get = _words.__getitem__
    for p, at in zip(parts, first.tolist()):
        flat[at : at + len(p)] = np.fromiter(map(get, p), np.uint64, len(p))
    h = np.zeros(len(flat) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = (h ^ flat[k : len(h) + k]) * _ODD
        h ^= h >> np.uint64(32)
    h = _mix(h)
    return [np.unique(h[a : a + (max(1, m - size + 1) if m else 0)]) for a, m in zip(first.tolist(), n.tolist())]


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) band hashes; no set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    rng = np.random.default_rng(20240501)
    xor, odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sets), b, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = _mix(h ^ np.minimum.reduceat((flat ^ xor[k]) * odd[k], starts))
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, rep, n, bands); rep and bands are null for texts without words."""
    from xxhash import xxh3_64_intdigest

    table = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2, 2 << 20):
                sets = shingle_sets(batch.column(2).to_pylist(), size)
                some = [s for s in sets if len(s)]
                found = iter(_bands(some, bands, rows).tolist() if some else [])
                rep = [xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                columns = [batch.column(0), batch.column(1), pa.array(rep, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "rep", "n", "bands"])

    return table.mapInArrow(run, f"doc_id {kind}, text_hash long, rep long, n long, bands array<long>")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections; columns are the shingles that occur twice at least."""
    sets = a if b is None else a + b
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    owner, column = owner[keep], rank[at[keep]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((len(a), len(sets) - (0 if b is None else len(a))), dtype=np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, total, width):
        s, e = np.searchsorted(column, [low, low + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[owner[s:e], column[s:e] - low] = 1
        out += x[: len(a)] @ (x if b is None else x[len(a) :]).T
    return out


def _forest(reps: np.ndarray, linked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest member of each one's component."""
    root = reps.copy()
    x, y = linked
    while len(x):
        old = root.copy()
        np.minimum.at(root, x, old[y])
        np.minimum.at(root, y, old[x])
        if (root == old).all():
            break
    return root


def _verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All members of one task: a few whole clusters, or two blocks (i, j) of a large one."""
    out = []
    for _, g in pdf.groupby("cluster", sort=False):
        g = g.drop_duplicates("rep")
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
        reps, copies, n = g["rep"].to_numpy(), g["copies"].to_numpy(), np.array([len(s) for s in sets], dtype=np.float64)
        left = np.flatnonzero(g["block"].to_numpy() == i)
        right = left if i == j else np.flatnonzero(g["block"].to_numpy() == j)
        links = np.zeros(len(g), dtype=np.int64)
        linked = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(left) and len(right):
            common = _overlaps([sets[k] for k in left], None if i == j else [sets[k] for k in right])
            hit = common >= threshold * (n[left][:, None] + n[right][None, :] - common) - 1e-6
            if i == j:
                np.fill_diagonal(hit, False)
            links[left] += hit @ copies[right]
            if i != j:
                links[right] += hit.T @ copies[left]
            x, y = np.nonzero(hit)
            linked = (left[x], right[y])
        out.append(pd.DataFrame({"rep": reps, "root": _forest(reps, linked), "links": links}))
    return pd.concat(out)


def near_duplicates(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block_reps: int = BLOCK_REPS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, root, class_id, n_links, alone): root tells classes apart, links are other documents with Jaccard >= threshold."""
    spark = docs.sparkSession
    bands = band_count(threshold, recall, rows)
    signed = materialise(signatures(docs, size, bands, rows), "signatures")
    real = signed.filter("rep is not null")
    same = real.groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialise(same.select("rep", "copies", "first_id", "at.doc_id", "at.text_hash", "n", "bands"), "reps")
    dealt = reps.select("rep", F.explode("bands").alias("band"))
    buckets = materialise(dealt.groupBy("band").agg(F.min("rep").alias("b"), F.count("*").alias("c")).filter("c > 1").drop("c"), "buckets")
    stars = dealt.join(buckets, "band").filter("rep != b").select(F.col("rep").alias("a"), "b").distinct()
    clusters = components(stars).withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster")
    members = materialise(reps.drop("bands", "first_id").join(clusters, "rep"), "members")
    # Clusters above a block's size: at most one for every block_reps representatives.
    weight = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("m") / block_reps), F.ceil(F.col("s") / block_shingles))
    large = materialise(weight.select("cluster", parts.cast("int").alias("parts")).filter("parts > 1"), "large")
    members = members.join(F.broadcast(large) if large.count() <= _BROADCAST_ROWS else large, "cluster", "left")
    one = F.col("parts").isNull()
    nbytes = 8 * (members.agg(F.sum("n")).first()[0] or 0)
    tasks = parts_for(spark, nbytes, 8 << 20)
    members = members.withColumn("block", F.when(one, 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int"))
    members = members.withColumn("task", F.when(one, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(F.col("cluster")))
    members = members.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "rep", "copies", "cluster", F.coalesce("parts", F.lit(1)).alias("parts"), "block", "task")
    # Only texts of clusters travel. The list is broadcast while it is small, else both sides shuffle.
    if members.count() <= _BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(members, texts["doc_id"].eqNullSafe(F.col("id_")) & (texts["text_hash"] == F.col("hash_"))).select("text", "rep", "copies", "cluster", "parts", "block", "task")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 0, 2 << 20):
                packed = [s.tobytes() for s in shingle_sets(batch.column(0).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], names=["shingles", *batch.schema.names[1:]])

    sent = chosen.mapInArrow(sets, "shingles binary, rep long, copies long, cluster long, parts int, block int, task long")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    sent = sent.withColumn("pair", F.explode(pairs)).select("shingles", "rep", "copies", "cluster", "parts", "block", "task", "pair.i", "pair.j")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        return _verify(pdf, threshold)

    verified = materialise(sent.groupBy("task", "i", "j").applyInPandas(verify, "rep long, root long, links long"), "verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(verified.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = reps.select("rep", "copies", "first_id").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    reps = materialise(reps.withColumn("root", F.coalesce("root", "rep")), "classes")
    names = reps.groupBy("root").agg(F.min("first_id").alias("class_id"))
    facts = materialise(reps.join(names, "root").select("rep", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "facts")
    out = signed.select("doc_id", "text_hash", "rep").join(facts, "rep", "left")
    alone = F.col("rep").isNull()
    return out.select("doc_id", "text_hash", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), alone.alias("alone"))


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every document."""
    return near_duplicates(docs, **options).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: one with the smallest id (ties: the smallest text hash; null ids last).

    Rows that repeat its id and text go too; if their other columns differ, any one of them stays.
    """
    found = near_duplicates(docs, **options).filter(~F.col("alone"))
    pairs = materialise(found.groupBy("doc_id", "text_hash").agg(F.first("root").alias("root"), F.count("*").alias("c")), "pairs")
    # Classes are told apart by root: names are shared by classes of null ids and of repeated ids.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "c")).alias("k")
    kept = materialise(pairs.groupBy("root").agg(first).select("k.doc_id", "k.text_hash", "k.c"), "kept")
    # Of kept pairs, those of a single row are not touched by what follows.
    gone = pairs.select("doc_id", "text_hash").exceptAll(kept.filter("c = 1").select("doc_id", "text_hash"))
    # Rows travel as structs, so no column of docs can clash with the helpers.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))

    def same(pair: DataFrame) -> Column:
        return keyed["id"].eqNullSafe(pair["id_"]) & (keyed["hash"] == pair["hash_"])

    gone = gone.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    left = keyed.join(gone, same(gone), "left_anti")
    repeated = kept.filter("c > 1").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    n = repeated.count()
    if n:
        few = F.broadcast(repeated) if n <= _BROADCAST_ROWS else repeated
        left = left.unionByName(keyed.join(few, same(repeated), "left_semi").dropDuplicates(["id", "hash"]))
    return left.select("row.*")
