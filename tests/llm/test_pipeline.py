import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_duplicates import brute as classes
from tidemark.llm.mixing import mix, source_targets
from tidemark.llm.quality import quality_report
from tidemark.llm.scratch import mark

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    rows = {r.doc_id: r for r in docs.collect()}
    ids = []
    for _, stage in C.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        ids.append(sorted(r.doc_id for r in kept.select("doc_id").collect()))
    # 1: exactly those that the classifier accepts
    report = quality_report(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids[0] == sorted(r.doc_id for r in report if r.predicted == 1)
    # 2: one of each class, by all pairs
    want = classes([(i, rows[i].text) for i in ids[0]])
    assert ids[1] == sorted({c for _, c, _ in want})
    # 3: no benchmark window
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[2] == sorted(r[0] for r in leaks([(i, rows[i].text) for i in ids[1]], items) if not r[-1])
    # 4: words taken from each source are near its target, no document above three times
    size = lambda i: len(rows[i].text.split())
    taken, have = Counter(), Counter()
    for i, n in Counter(ids[3]).items():
        assert n <= 3 and i in set(ids[2])
        taken[rows[i].source] += n * size(i)
    for i in ids[2]:
        have[rows[i].source] += size(i)
    for s, t in source_targets(list(have.items())).items():
        assert abs(taken[s] - t) <= max(size(i) for i in ids[2] if rows[i].source == s)
    # 5: tokens of every copy, in order
    out = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in C.STAGES[4][1](spark, kept, SF).collect())
    t, at, expect = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i in ids[3]:
        x = np.array([*t.encode(rows[i].text, add_special_tokens=False).ids, 2], "<u4")
        expect.append((at, i, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert out == expect
    before = mark()
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in C.run(spark, SF).collect()) == expect
    assert mark() == before + 1  # intermediate tables are gone


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
    assert mix(docs).count() == 0


def test_repeated_rows(spark):
    """Exact repetitions, also of null ids, pass the near-duplicate stage once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    again = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    texts = [r.text for r in C.STAGES[1][1](spark, again, SF).collect()]
    assert Counter(texts) == Counter(r.text for r in C.STAGES[1][1](spark, docs, SF).collect())
