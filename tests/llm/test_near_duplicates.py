import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.decontamination import words_of
from tidemark.llm.near_duplicates import band_count, keep_one, near_duplicate_report


def brute(rows, size=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            c = len(s & sets[j])
            if c >= threshold * (len(s) + len(sets[j]) - c) - 1e-6:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted([(rows[i][0], name[find(i)], links[i]) for i in range(len(rows))], key=str)


def got(df, **o):
    return sorted([tuple(r) for r in near_duplicate_report(df, **o).collect()], key=str)


def fixture():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(160):
        w = list(base[i % 2 if i < 140 else i % 4])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    rows += [(200 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "..."), (303, "two words"), (304, "Two, WORDS!"), (304, "two words"), (None, "null id alone here and now"), (305, passage * 50)]
    return rows


def test_bands():
    b = band_count(0.8, 0.9995, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.9995 > 1 - (1 - 0.8**6) ** (b - 1)


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, n int").repartition(5)
    want = brute(rows)
    assert got(df) == want
    assert got(df, block_reps=16, block_shingles=2000) == want  # large clusters, split into blocks
    kept = keep_one(df)
    assert kept.columns == df.columns
    want_ids = {c for _, c, _ in want if c is not None}
    assert {r.doc_id for r in kept.collect()} - {None} == want_ids
    assert near_duplicate_report(df.filter(F.lit(False))).count() == 0


def test_keep_one_counts_rows(spark):
    copy = "one two three four five six seven eight nine ten"
    rows = [(1, copy)] * 5 + [(2, copy)] * 3 + [(None, copy)] * 2 + [(None, "a null id with many copies")] * 40 + [(None, "another null id, another text")]
    rows += [(7, "the id of two quite different texts")] * 2 + [(7, "here is the second of the two")] + [(8, None), (8, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(b, a, "x", 4, "y", 5) for a, b in rows], "text string, doc_id long, source string, hash__ int, row string, id int").repartition(5)
    want = [(1, copy), (None, "a null id with many copies"), (None, "another null id, another text"), (7, "the id of two quite different texts"), (7, "here is the second of the two"), *rows[-4:]]
    kept = keep_one(df)
    assert kept.columns == df.columns and {(r.hash__, r.row, r.id) for r in kept.collect()} == {(4, "y", 5)}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert keep_one(df.filter(F.lit(False))).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_recall_on_near_copies(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = got(df), brute([(r.doc_id, r.text) for r in df.collect()])
    assert np.mean([x == y for x, y in zip(a, b)]) >= 0.999
