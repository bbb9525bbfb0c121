import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm.quality import _dictionary, _logistic, fit, keep_good, quality_report


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return read("documents"), read("labels")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality_report(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = labels.collect()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in held) / len(held)
    assert right >= 0.95, right


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    flip = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(tuple(r) for r in quality_report(docs, labels).collect())
    assert a == sorted(tuple(r) for r in quality_report(docs.repartition(5), flip.repartition(3)).collect())


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "ab " * 60_000, 2.0), (2, "ab " * 60_000, 2.0)], "doc_id long, text string, score double")
    got = quality_report(odd, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in quality_report(docs, labels.filter(F.lit(False))).collect()}) == 1
    assert quality_report(docs.filter(F.lit(False)), labels).count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_fit_converges_on_nearly_separable_samples():
    """Undamped Newton steps diverge here (weights of 1e5) and reject good documents."""
    rng = np.random.default_rng(8)
    for n, noise in ((3000, 0.002), (200, 0.0), (50, 0.1)):
        y = (np.arange(2 * n) < n).astype(float)
        ratio = np.where(y == 1, -0.63, -1.69) + rng.normal(0, 0.1, 2 * n) * np.where(y == 1, 1, 9)
        x = np.stack([np.ones(2 * n), np.where(y == 1, 0.81, -1.1) + rng.normal(0, 0.25, 2 * n), ratio, ratio**2], axis=1)
        flip = rng.random(2 * n) < noise
        w = _logistic(x, np.where(flip, 1 - y, y))
        assert np.isfinite(w).all() and np.abs(w).max() < 1e3
        assert (((x @ w) > 0) == (y == 1)).mean() > 0.97


def test_clean_documents_are_kept(tables):
    docs, labels = tables
    held = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    kept = keep_good(docs, labels).select("doc_id")
    good = held.filter("quality = 1")
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count()


def test_scores_against_plain_compression(tables):
    docs, labels = tables
    model = fit(docs, labels)

    def size(block, dictionary):
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, **options).compress(block))

    got = {r.doc_id: r.score for r in quality_report(docs, labels).collect()}
    for r in docs.filter("doc_id % 7 = 0 or length(text) > 20000").collect():
        raw, x = r.text.encode(), np.array([1.0, 0, 0, 0])
        if raw:
            good, bad, plain = (sum(size(raw[i : i + 4096], d) for i in range(0, len(raw), 4096)) for d in (model.good, model.bad, b""))
            ratio = np.log(plain / len(raw))
            x[1:] = 10 * (bad - good) / (bad + good), ratio, ratio**2
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-x @ np.array(model.weights)))) < 1e-9


def test_small_and_conflicting_samples(spark, tables):
    docs, labels = tables
    assert _dictionary([]) == b"" and len(_dictionary([b"abc"])) == 0
    assert 256 <= len(_dictionary([f"some words {i} and {i * 7} more".encode() for i in range(300)])) <= 112 << 10
    both = labels.unionByName(labels.filter("doc_id < 20").withColumn("quality", 1 - F.col("quality")))
    many = docs.unionByName(docs.filter("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7000)))).drop("n"))
    got = {r.doc_id: r.score for r in quality_report(many, both).collect()}
    assert got == {r.doc_id: r.score for r in quality_report(docs, both).collect()}
    few = labels.filter("doc_id < 12")
    assert all(0 <= r.score <= 1 for r in quality_report(docs, few).collect())
