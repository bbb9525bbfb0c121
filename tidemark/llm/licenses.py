"""Licence scans by sentence rules, with DataFrame functions only.

A text is folded to lower-case ASCII words. After . ; : before white space and at blank lines stands a
hard boundary, at line ends and at ! and ? a soft one. A sentence of the registry is known where its
words begin and end at boundaries; soft ones may also lie inside it (wrapped lines, "WORD!! WORD!!"). A
document becomes the sequence of identifiers of its known sentences, in order. Rules are identifier
sequences, tried in order (longer ones first): a match names its licence and uses up its sentences.

The registry is made from TEXTS, cut by the same boundaries, and from short notices: a phrase of LEADS,
perhaps an article, and a title of NAMES; SPDX lines are notices too.

Defined results: null or empty texts and texts without a known sentence have no licence (empty
strings, 0); a licence is listed once; repeated rows stay; other columns are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and sentences of public licences, each with the licence that they name.
TEXTS: list[tuple[str, str]] = [
    ("MIT", """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    ("Apache-2.0", """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.

"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-4-Clause", """All advertising materials mentioning features or use of this software must display the following acknowledgement:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0-only", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("AGPL-3.0-only", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-3.0-only", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"""),
    ("EPL-1.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"""),
    ("CDDL-1.0", """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."""),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and subsequent owner(s) of an original work of authorship and/or a database."),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"""),
    ("Artistic-2.0", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("Artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("PSF-2.0", 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software in source or binary form and its associated documentation.'),
]
# How short notices name public licences.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache Software License, Version 2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "Modified BSD License", "New BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "ISC": ("ISC License",),
    "0BSD": ("BSD Zero Clause License",),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License version 3.0", "GNU GPL v3", "GPLv3", "GPL version 3"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPLv3+"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License version 2.0", "GNU GPL v2", "GPLv2", "GPL version 2"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2 or later", "GPLv2+"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, version 1.0", "Eclipse Public License v1.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, version 1.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "EUPL-1.2": ("European Union Public Licence, version 1.2", "European Union Public Licence 1.2", "EUPL v1.2"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
}
# Creative Commons 4.0 licences: the same elements in short and in words.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NAMES |= {f"CC-{k}-4.0": (f"CC {k} 4.0", f"CC-{k}-4.0 License", f"Creative Commons {v} 4.0 International License", f"Creative Commons {v} 4.0 International Public License", f"Creative Commons {v} 4.0 License") for k, v in _CC.items()}
LEADS = (*(f"{x}{v} under" for x in ("", *(f"this {x} is " for x in ("work", "file", "project", "software", "program", "document", "code", "package"))) for v in ("licensed", "released", "distributed", "published", "available", "made available")), "dual licensed under", "license")
#: Sentences that name a licence alone, as runs of TEXTS: (licence, number of the text, first, end).
CORES = [("MIT", 0, 1, 3), ("MIT", 0, 1, 2), ("Apache-2.0", 2, 1, 3), ("Apache-2.0", 2, 0, 1), ("Apache-2.0", 3, 2, 4), ("Apache-2.0", 4, 0, 1), ("BSD-3-Clause", 5, 0, 4), ("BSD-2-Clause", 5, 0, 3), ("ISC", 7, 0, 1), ("0BSD", 8, 0, 1),
         ("GPL-3.0-or-later", 9, 0, 2), ("GPL-2.0-or-later", 10, 0, 3), ("MPL-2.0", 20, 0, 1), ("EPL-2.0", 21, 0, 1), ("EPL-1.0", 22, 0, 1), ("CDDL-1.0", 23, 0, 1), ("BSL-1.0", 25, 1, 2), ("Zlib", 26, 2, 3), ("Unlicense", 27, 0, 1), ("CC0-1.0", 28, 0, 1)]
#: Every sentence of the registry holds one of these, so a text without any has no known sentence.
ANCHORS = ("licens", "licenc", "copyright", "warrant", "redistribut", "permission", "software", "domain", "acknowledgement", "profits", "interruption", "gpl", "mpl", "eupl", "cc0", "creative", "4.0")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps from a lower-case text to words between boundaries (\x01 hard, \x02 soft, then || and //), the
#: same in Java, RE2 and Python: layout signs, "v. 2", "2+", full stops, blank lines, soft ends, words, runs.
_STEPS = [
    (r"[*#$%&|]+", " "), (r"([^a-z0-9]v)[.][^a-z0-9]{1,9}([0-9])", "{1}{2}"), (r"([0-9])[+]", "{1} plus"), (r"[.;:][)\x22'*]*[!?\x20\x09-\x0D]+", "\x01"), (r"\n[!?\x20\x09\x0D]*\n", "\x01"),
    (r"[\n\r!?]", "\x02"), (r"[^a-z0-9\x01\x02]+", " "), (r"[\x20\x02]*\x01[\x20\x01\x02]*", "||"), (r"\x20*\x02[\x20\x02]*", "//"), (r"^[\x20|/]+|[\x20|/]+$", ""),
]


def _pieces(text: str) -> list[str]:
    for pattern, to in _STEPS:
        text = re.sub(pattern, to.replace("{1}", r"\1").replace("{2}", r"\2"), text.lower() if pattern == _STEPS[0][0] else text)
    return [x for x in text.replace("//", " ").split("||") if x]


def _registry() -> tuple[dict[str, str], dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentence to identifier, title of a short notice to identifier, and the ordered rules."""
    known: dict[str, str] = {}
    whole = [(name, tuple(known.setdefault(s, f"{name.lower()}_{n}_{k}") for k, s in enumerate(_pieces(text)))) for n, (name, text) in enumerate(TEXTS)]
    rules = whole + [(name, whole[n][1][a:b]) for name, n, a, b in CORES]
    titles: dict[str, str] = {}
    for name, written in NAMES.items():
        for title in (*written, f"SPDX-License-Identifier {name}"):
            titles["".join(_pieces(title))] = f"{name.lower()}_short"
        rules.append((name, (f"{name.lower()}_short",)))
    # What a longer rule matches is not left to a shorter one.
    return known, titles, sorted(dict.fromkeys(rules), key=lambda r: -len(r[1]))


SENTENCES, TITLES, RULES = _registry()


def _trie(sentences: list[list[str]], sep: str) -> str:
    """A regular expression for any of the word sequences after a separator, longest first, with shared beginnings."""
    by: dict[str, list[list[str]]] = {}
    for s in sentences:
        if s:
            by.setdefault(s[0], []).append(s[1:])
    rest = "|".join(w + _trie(tails, _GAP) for w, tails in sorted(by.items()))
    ends = any(not s for s in sentences)
    return f"(?:{sep}(?:{rest})){'?' * ends}" if rest else ""


_GAP = "(?:\x20|//)"
_LEAD = "(?:" + _trie([_pieces(x)[0].split() for x in LEADS], "") + f"(?:{_GAP}(?:the|a|an))?{_GAP})"
_TITLE, _SPDX = (_trie([t.split() for t in TITLES if t.startswith("spdx ") == x], "") for x in (False, True))
#: A known sentence between boundaries.
_FIND = f"[|/]({_trie([s.split() for s in SENTENCES], '')}|{_LEAD}{_TITLE}|{_SPDX})[|/]"


def _folded(lower: Column) -> Column:
    """Words between boundaries, of a text whose A-Z are lowered; SPDX lines lose their colon first."""
    out = F.replace(lower, F.lit("license-identifier:"), F.lit("license-identifier"))
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return F.concat(F.lit("|"), out, F.lit("|"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses, n_known, sentence_ids) of every document; a projection without a shuffle."""
    text = F.col(text_col).cast("string")
    rough = F.lower(text)  # finds all anchors, and perhaps more
    may = F.lit(False)
    for a in ANCHORS:
        may = may | rough.contains(a)
    known, names = F.array(*map(F.lit, SENTENCES)), F.array(*[F.lit(f"<{n}>") for n in SENTENCES.values()])
    titles, shorts = F.array(*map(F.lit, TITLES)), F.array(*[F.lit(f"<{n}>") for n in TITLES.values()])

    def name(sentence: Column) -> Column:
        at, title = F.array_position(known, sentence), F.regexp_replace(sentence, f"^{_LEAD}", "")
        return F.when(at > 0, F.get(names, at - 1)).otherwise(F.get(shorts, F.array_position(titles, title) - 1))

    found = F.regexp_extract_all(_folded(F.translate(text, _UPPER, _LOWER)), F.lit(_FIND), 1)
    ids = F.transform(found, lambda s: name(F.replace(s, F.lit("//"), F.lit(" "))))
    empty = F.expr("cast(array() as array<string>)")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.when(may, ids).otherwise(empty), empty).alias("ids"))
    rows = rows.withColumn("left", F.array_join("ids", "")).withColumn("found", empty)
    # Each rule sees what the rules before it left; the state is one struct folded over the rule list.
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("".join(f"<{i}>" for i in r)).alias("seq")) for n, r in RULES])
    state = F.aggregate(
        rules, F.struct(F.col("left"), F.col("found")),
        lambda a, r: F.struct(F.replace(a["left"], r["seq"], F.lit("|")).alias("left"), F.when(a["left"].contains(r["seq"]), F.array_union(a["found"], F.array(r["name"]))).otherwise(a["found"]).alias("found")),
    )
    licenses = F.when(F.size("ids") == 0, F.lit("")).otherwise(F.array_join(F.array_sort(state["found"]), ","))
    return rows.select("doc_id", licenses.alias("licenses"), F.size("ids").cast("long").alias("n_known"), F.array_join("ids", "").alias("sentence_ids"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL for scan_licenses over documents."""
    known, titles = (", ".join(f"('{s}', '<{n}>')" for s, n in x.items()) for x in (SENTENCES, TITLES))
    names, seqs = ", ".join(f"'{n}'" for n, _ in RULES), ", ".join("'" + "".join(f"<{i}>" for i in r) + "'" for _, r in RULES)
    folded = f"replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), 'license-identifier:', 'license-identifier')"
    for pattern, to in _STEPS:
        to = "chr(1)" if to == "\x01" else "chr(2)" if to == "\x02" else "'" + to.replace("{1}", "\\1").replace("{2}", "\\2") + "'"
        folded = f"regexp_replace({folded}, {_quoted(pattern)}, {to}, 'g')"
    return f"""
WITH RECURSIVE known(sentence, name) AS (VALUES {known}), titles(title, name) AS (VALUES {titles}),
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
found AS (
  SELECT r, regexp_extract_all('|' || {folded} || '|', {_quoted(_FIND)}, 1) AS s FROM texts
  WHERE regexp_matches(lower(text), '{"|".join(ANCHORS)}')),
each AS (SELECT r, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM found),
folded AS (SELECT r, i, replace(s, '//', ' ') AS s FROM each),
hits AS (
  SELECT e.r, e.i, coalesce(k.name, t.name) AS name FROM folded e
  LEFT JOIN known k ON k.sentence = e.s LEFT JOIN titles t ON t.title = regexp_replace(e.s, '^{_LEAD}', '')),
seqs AS (SELECT r, count(*) AS n, string_agg(name, '' ORDER BY i) AS ids FROM hits GROUP BY r),
run(r, k, rest, found) AS (
  SELECT r, 0, ids, CAST([] AS VARCHAR[]) FROM seqs
  UNION ALL
  SELECT r, k + 1, replace(rest, ([{seqs}])[k + 1], '|'),
    CASE WHEN contains(rest, ([{seqs}])[k + 1]) THEN list_append(found, ([{names}])[k + 1]) ELSE found END
  FROM run WHERE k < {len(RULES)}),
done AS (SELECT r, array_to_string(list_sort(list_distinct(found)), ',') AS licenses FROM run WHERE k = {len(RULES)})
SELECT t.doc_id, coalesce(d.licenses, '') AS licenses, CAST(coalesce(s.n, 0) AS BIGINT) AS n_known, coalesce(s.ids, '') AS sentence_ids
FROM texts t LEFT JOIN seqs s ON t.r = s.r LEFT JOIN done d ON t.r = d.r
"""
