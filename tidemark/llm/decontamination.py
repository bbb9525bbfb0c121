"""Benchmark decontamination with broadcast n-gram windows.

A word is a run of characters other than ASCII signs, after A-Z are lowered. A window is `size`
consecutive words of a benchmark item, or the whole item if it is shorter (but not empty). Documents
are scanned once per block of the benchmark: a block's distinct windows are broadcast as hashes plus
the words themselves, every hash hit is verified word for word, and all words inside a hit are marked.
A block holds about BLOCK_BYTES of item text (and any one item), whose index takes about four times as
much; a larger benchmark is scanned in several passes, so the broadcast stays bounded whatever its size.

Defined results: null or empty texts have no words and no hits; an item without words has no window;
items with a null id mark words but are not listed; repeated items count once; an empty benchmark
marks nothing. Repeated documents keep their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import blocks as byte_blocks
from tidemark.llm.scratch import materialise

BLOCK_BYTES = 16 << 20
#: Lowers A-Z and turns every ASCII character that is in no word into a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WindowIndex:
    """The distinct windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        n = np.array([len(w) for w in words], np.int64)
        self.words, first = np.concatenate([np.zeros(0, np.int32), *words]), np.cumsum(n) - n
        self.by_length = []
        for length in np.unique(np.minimum(n, size)[n > 0]).tolist():
            count = np.where(np.minimum(n, size) == length, n - length + 1, 0)
            owner = np.repeat(np.arange(len(items)), count)
            start = np.arange(len(owner)) + np.repeat(first - (np.cumsum(count) - count), count)
            odd = 0x9E3779B1
            while True:  # until windows of equal hash have equal words
                h = self.hash([self.words[start + k] for k in range(length)], odd)
                order = np.argsort(h, kind="stable")
                new = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
                of = np.repeat(start[order][new], np.diff(np.r_[new, len(h)]))
                if all((self.words[of + k] == self.words[start[order] + k]).all() for k in range(length)):
                    break
                odd += 2
            window = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(h)]))
            pairs = np.unique(np.stack([window, owner[order]]), axis=1)
            edge = np.searchsorted(pairs[0], np.arange(len(new) + 1))
            self.by_length.append((length, odd, h[order][new], start[order][new].astype(np.int32), edge.astype(np.int32), pairs[1].astype(np.int32)))

    @staticmethod
    def hash(columns: np.ndarray, odd: int) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(odd | (odd << 32 & 0xFFFFFFFFFFFFFFFF))
            h ^= h >> np.uint64(29)
        return h

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words of each text, its hit word ranges (merged, in order), and the items found in it."""
        parts = [words_of(t) for t in texts]
        n_words = np.array([len(p) for p in parts], dtype=np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if not self.by_length:
            return n_words, spans, items
        get = self.vocabulary.get
        ids = np.zeros(int((n_words + 1).sum()), dtype=np.int64)  # a 0 after each text: no window crosses it
        first = np.r_[0, np.cumsum(n_words + 1)][:-1]
        for p, at in zip(parts, first.tolist()):
            ids[at : at + len(p)] = np.fromiter(map(get, p, repeat(0)), np.int64, len(p))
        zeros = np.r_[0, np.cumsum(ids == 0)]
        cover = np.zeros(len(ids) + 1, dtype=np.int64)
        for n, odd, hashes, start, edge_, owners in self.by_length:
            at = np.flatnonzero(zeros[n:] == zeros[:-n])
            if not len(at):
                continue
            h = self.hash([ids[at + k] for k in range(n)], odd)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            real = np.flatnonzero(hashes[place] == h)
            for k in range(n):
                real = real[self.words[start[place[real]] + k] == ids[at[real] + k]]
            np.add.at(cover, at[real], 1)
            np.add.at(cover, at[real] + n, -1)
            for doc, w in zip((np.searchsorted(first, at[real], "right") - 1).tolist(), place[real].tolist()):
                items[doc].update(self.items[o] for o in owners[edge_[w] : edge_[w + 1]].tolist() if self.items[o] is not None)
        inside = np.cumsum(cover) > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.r_[0, edge] if inside[0] else edge
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            doc = int(np.searchsorted(first, a, "right")) - 1
            spans[doc].append((a - int(first[doc]), b - int(first[doc])))
        return n_words, spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, spans, items): row is the document as a struct; spans are hit word ranges."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    nbytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-nbytes // block_bytes))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<s:long,e:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for b in range(blocks):
        # At most block_bytes of text (and any one item) reaches the driver at a time.
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        index = spark.sparkContext.broadcast(WindowIndex([(r.item, r.text) for r in part.collect()], size))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for old in byte_blocks(batches, lambda b: b.column(0).field(text_col).cast(pa.string())):
                n, spans, names = index.value.scan(old.column(0).field(text_col).cast(pa.string()).to_pylist())
                spans = [_merged([(x["s"], x["e"]) for x in o], s) for o, s in zip(old.column(2).to_pylist(), spans)]
                names = [sorted(set(o) | s) for o, s in zip(old.column(3).to_pylist(), names)]
                pairs = pa.array([[{"s": a, "e": e} for a, e in s] for s in spans], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
                yield pa.RecordBatch.from_arrays([old.column(0), pa.array(n), pairs, pa.array(names, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

        out = out.mapInArrow(run, out.schema)
        if b + 1 < blocks:
            out = materialise(out, "hits")
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, size, block_bytes=block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return hits.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the given ranges (and without what stands between them)."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """docs without hit documents (remove="documents") or with hit spans cut from them ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    hits = find_hits(docs, benchmark, size, text_col)
    if remove == "documents":
        return hits.filter(F.size("spans") == 0).select("row.*")

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or not len(s) else cut_words(t, [(x["s"], x["e"]) for x in s]))

    cleaned = F.when(F.size("spans") == 0, F.col(f"row.{text_col}")).otherwise(cut(f"row.{text_col}", "spans"))
    return hits.select(*[cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
