import duckdb
from pyspark.sql import functions as F

from tidemark.llm.licenses import ANCHORS, CORES, LEADS, NAMES, RULES, SENTENCES, TEXTS, TITLES, oracle, scan_licenses

MIT = """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
CASES = [
    ("Foo bar.\nLicensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0"),
    ("RELEASED!! UNDER!! THE!! MIT!! LICENSE.!! AND!!", "MIT"),
    ("This*** work$$$ is&&& licensed under the GNU General Public License, version 3.### Next", "GPL-3.0-only"),
    ("a.\nLicensed | under | CC | BY-NC | 4.0.\nReleased under the MIT License.", "CC-BY-NC-4.0,MIT"),
    (MIT, "MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: nothing known; more", ""),
    ("no notice", ""), ("", ""), (None, ""), ("Licensed under the MIT License. " * 3000, "MIT"),
]


def test_registry():
    assert len(set(SENTENCES.values())) == len(SENTENCES)
    notices = [f"released under {t}" for t in TITLES if not t.startswith("spdx")]
    missing = [x for x in [*SENTENCES, *notices] if not any(a in x.replace("4 0", "4.0") for a in ANCHORS)]
    assert not missing, missing
    assert all(i in {*SENTENCES.values(), *TITLES.values()} for _, r in RULES for i in r)
    assert all(r for _, r in RULES) and len(CORES) > 10


def test_every_text_and_notice_names_its_licence(spark):
    rows = [(n, t) for n, t in TEXTS if n not in ("BSD-4-Clause",)]
    rows += [(n, f"Foo bar.\n// {LEADS[i % len(LEADS)].capitalize()} {('', 'the ', 'an ')[i % 3]}{t}.\nx") for i, (n, ts) in enumerate(NAMES.items()) for t in ts]
    rows += [(n, f"# SPDX-License-Identifier: {n}\nimport os") for n in NAMES]
    wrapped = [(n, "\n".join(t.replace(" ", "\n * ", 400).replace("\n * ", " ", 7).splitlines())) for n, t in rows if "\n" not in t]
    rows += wrapped
    got = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    wrong = [(n, got[i], t[:90]) for i, (n, t) in enumerate(rows) if n not in got[i].split(",")]
    assert not wrong, wrong
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
    assert scan_licenses(spark.createDataFrame([(1, mpl), (1, mpl), (None, mpl)], "doc_id long, text string")).filter("licenses = 'MPL-2.0'").count() == 3


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, licenses string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(CASES))] == [x for _, x in CASES]
    assert scan_licenses(docs.filter(F.lit(False))).count() == 0


LINES = [
    ("EINEIN!! GEACH!! SCHENSS!!\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("| haanananes |\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("from from from\nReleased under the MIT License.", "MIT"),
    ("// Copyright X\n// Licensed under the Apache\n// License, Version 2.0\nint main", "Apache-2.0"),
    ("# Copyright X\r\n# Released under the MIT License\r\nimport os", "MIT"),
    ("Free? Licensed under the ISC License! More", "ISC"), ("Yes! Released under the MIT License? More", "MIT"),
    ("it is not\nlicensed under the MIT License but\nreleased under the MIT Licenses", ""),
    ("one licensed under the MIT License.", ""), ("a\nLicensed under the MIT.\nLicense", ""),
    ("a\nThis work is licensed under the GNU General Public License,\nversion 3\nb", "GPL-3.0-only"),
]


def test_registry_lines_without_a_full_stop_before_or_after(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(LINES))] == [x for _, x in LINES]


def test_oracle(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = [t for _, t in [*TEXTS, *CASES, *LINES]]
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(t if t and len(t) < 5000 else None for t in texts)], "doc_id long, text string")
    docs = spark.read.parquet(path).select("doc_id", "text").unionByName(odd)
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = sorted(db.execute(oracle()).fetchall())
    got = sorted(tuple(r) for r in scan_licenses(docs).collect())
    assert got == want and sum(bool(r[1]) for r in got) > 50
