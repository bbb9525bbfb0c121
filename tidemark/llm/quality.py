"""Quality classifier from compressed sizes.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into
blocks of BLOCK bytes; each block is compressed with either dictionary and with none. The features are
the normalised difference (bad - good) / (bad + good) and the logarithm of the plain ratio, summed over
the whole text; a logistic fit on labelled documents that the dictionaries have not seen turns them
into a calibrated score.

The fit reads a bounded sample (a parameter): per label the `sample_docs` ids of smallest hash, whole
texts, half for the dictionaries and half for the calibration. Where an id has several texts, the one of
smallest hash is read. Scores read whole texts and nothing but the text.

Defined results: null and empty texts get the score of neutral features; without labels of both
kinds every score is the smoothed share of label 1. Null ids are never training rows and not held out;
an id with both labels is a row of either. Where a label has too little text for a dictionary of
DICTIONARY_BYTES, it gets a smaller one, and none below 256 bytes: texts are then compressed plainly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import blocks

BLOCK = 4096
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
SAMPLE_DOCS = 3000


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from all samples: the largest of DICTIONARY_BYTES, a half, a quarter ... that they allow."""
    size = DICTIONARY_BYTES
    while samples and size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=min(512, size // 4), d=8).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def _blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, ...] = ()):
        self.weights = np.array(weights)
        self.compressors = []
        for d in (good, bad):
            options = {}
            if d:
                options["dict_data"] = zstandard.ZstdCompressionDict(d)
                options["dict_data"].precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **options))
        self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        for i, text in enumerate(texts):
            if blocks := _blocks(text):
                good, bad, plain = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
                difference, ratio = (bad - good) / (bad + good), np.log(plain / sum(map(len, blocks)))
                out[i, 1:] = 10 * difference, ratio, ratio * ratio
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 200) -> np.ndarray:
    """Penalised logistic weights by damped Newton steps.

    A step is halved until the loss falls: on nearly separable samples full steps overshoot and diverge.
    """

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-10 and loss(w - size * step) > now - 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-10:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Learn from labelled documents that are not held out."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("y"))
    by = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for y in (0, 1):  # sample_docs rows each: bounded, so they may be broadcast
        part = usable.filter(F.col("y") == y).distinct().orderBy(by, "doc_id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text of every id, so copies of one id neither fill the sample nor pass its bound.
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted(rows.select(by.alias("h"), "y", "text").collect(), key=lambda r: (r.h, r.y, r.text or ""))
    dictionary = [r for r in rows if r.h % 2 == 0]
    samples = {y: [b for r in dictionary if r.y == y for b in _blocks(r.text)] for y in (0, 1)}
    rest = [r for r in rows if r.h % 2]
    if len({r.y for r in rest}) < 2:
        rest = rows
    y = np.array([r.y for r in rest], dtype=float)
    good, bad = _dictionary(samples[1]), _dictionary(samples[0])
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(good, bad, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    x = Scorer(good, bad).features([r.text for r in rest])
    return QualityModel(good, bad, tuple(_logistic(x, y).tolist()))


def with_score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(row, score): the document as a struct and its score; a map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 112 KiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.good, shared.value.bad, shared.value.weights)
        for batch in blocks(batches, lambda b: b.column(0).field("text")):
            scores = scorer.score(batch.column(0).field("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, rows.schema)


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, **options)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that the classifier rejects."""
    return with_score(docs, fit(docs, labels, **options)).filter("score >= 0.5").select("row.*")
