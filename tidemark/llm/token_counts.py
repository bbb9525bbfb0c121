"""Token counts by rank-synchronous byte-pair merging.

Texts are cut into the library's own pre-tokens; pre-tokens not seen before by this worker are held as
one ragged numpy array, and in every round each sequence applies its lowest-rank pair everywhere at
once. The surviving symbols are the tokens. Results are remembered per chunk of text between spaces,
because natural text repeats its chunks.

Defined results: a null or empty text has 0 bytes and 0 tokens. Rows are kept one for one (repeated
rows stay repeated); other columns of the input are dropped, so clashing names cannot occur.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAR = np.iinfo(np.int64).max
#: Chunks a worker remembers before it starts afresh; bounds its memory whatever the vocabulary.
CACHE_CHUNKS = 1_000_000


class MergeTable:
    """Byte symbols and ranked merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.symbol = np.full(1 << 10, -1, dtype=np.int64)  # the byte alphabet lies below U+0400
        for c, i in vocab.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        # Open addressing: a pair is looked up with a few gathers instead of a binary search.
        self.mask = (1 << int(8 * len(keys)).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.rank = np.full(self.mask + 1, _FAR, dtype=np.int64)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            slot = (self._slot(keys[left]) + self.probes) & self.mask
            free = self.keys[slot] == -1
            slot, first = np.unique(np.where(free, slot, -1), return_index=True)
            slot, first = slot[slot >= 0], first[slot >= 0]
            self.keys[slot], self.rank[slot] = keys[left[first]], left[first]
            left, self.probes = np.delete(left, first), self.probes + 1
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> 32)) * 0x9E3779B97F4A7C1 >> 20) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.rank[slot], _FAR)
        open_ = np.flatnonzero((out == _FAR) & (self.keys[slot] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & self.mask
            same = self.keys[at] == key[open_]
            out[open_[same]] = self.rank[at[same]]
            open_ = open_[~same & (self.keys[at] != -1)]
        return out

    def count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token; pieces are in the byte alphabet of the vocabulary."""
        if not pieces:
            return np.zeros(0, dtype=np.int64)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        symbols = self.symbol[np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)]
        done = lengths.copy()
        while len(symbols) > 1:
            rank = np.full(len(symbols), _FAR, dtype=np.int64)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), _FAR)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            per = np.diff(np.r_[starts, len(symbols)])
            ended = best == _FAR
            done[owner[starts[ended]]] = per[ended]
            hit = (rank == np.repeat(best, per)) & (rank != _FAR)
            # The same pair can overlap itself (a a a): take every other one from the left of each run.
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run_start) % 2 == 0
            symbols[hit] = self.made[rank[hit]]
            keep = ~np.r_[False, hit[:-1]] & ~np.repeat(ended, per)
            symbols, owner = symbols[keep], owner[keep]
        done[owner] = 1  # what is left has merged to one symbol
        return done


class TokenCounter:
    """Counts the tokens of whole texts; one lives in each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = MergeTable(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def _learn(self, texts: list[str]) -> list[int]:
        """Token counts of texts as they stand, merging all their unknown pre-tokens together."""
        cut = [[p for p, _ in self.split(t)] for t in texts]
        new = list({p for ps in cut for p in ps} - self.pieces.keys())
        self.pieces.update(zip(new, self.table.count(new).tolist()))
        out = [sum(map(self.pieces.__getitem__, ps)) for ps in cut]
        if len(self.pieces) > CACHE_CHUNKS:
            self.pieces.clear()
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), dtype=np.int64)
        segments: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            parts = [text] if text else []
            for s in self.table.special:
                if any(s in p for p in parts):
                    cut = [p.split(s) for p in parts]
                    totals[i] += sum(len(c) - 1 for c in cut)
                    parts = [x for c in cut for x in c if x]
            segments += [(i, p) for p in parts]
        # A space between two other characters always opens a pre-token, so texts split there; the
        # segments in which a space touches other white space are cut by the library as a whole.
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        words = [(i, s, s.split(" ")) for i, s in segments]
        new = list({w for _, _, ws in words for w in ws[1:]} - self.chunks.keys())
        odd = [not w or w[0].isspace() or w[-1].isspace() for w in new]
        self.chunks.update((w, -1) for w, o in zip(new, odd) if o)
        plain = [w for w, o in zip(new, odd) if not o]
        self.chunks.update(zip(plain, self._learn([" " + w for w in plain])))
        whole: list[tuple[int, str]] = []
        for i, s, ws in words:
            counts = list(map(self.chunks.__getitem__, ws[1:]))
            if len(ws) > 1 and (min(counts) < 0 or not ws[0] or ws[0][-1].isspace()):
                whole.append((i, s))
            else:
                totals[i] += sum(counts)
                whole.append((i, ws[0]))
        for (i, _), n in zip(whole, self._learn([s for _, s in whole])):
            totals[i] += n
        return totals


def _blocks(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` text bytes each (one row at least)."""
    size = np.cumsum(np.array([len(x) if x else 0 for x in batch.column(1).cast(pa.large_binary()).to_pylist()]))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit)))
        yield batch.slice(start, end - start)
        start = end


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every whole text; a map without a shuffle.

    tokenizer: a byte-level BPE file of the tokenizers library, at the same path on every executor.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, TokenCounter(tokenizer))
        for whole in batches:
            for batch in _blocks(whole):
                texts = batch.column(1).to_pylist()
                n = counter.count(texts)
                n_bytes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
