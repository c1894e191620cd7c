"""Licence recognition by sentence identifiers and ordered rules.

A text is split into sentences, these are normalised and looked up in a table of
known licence sentences, or matched with patterns of them where a name stands
within (what is licensed, under which licence, whose name); declared SPDX identifiers are read as they are. The sequence of identifiers of a document is matched
against licence rules - ordered identifiers - longest rule first, from left to
right; an identifier serves one match.

Edge cases: a null or empty text has no sentences and no licence; very long
texts are read whole; a sentence that repeats is an identifier each time;
repeated rows each give a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Identifier -> sentence of a licence, as published.
SENTENCES = {
    "mit.name": "Released under the MIT License.",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache.name": "Licensed under the Apache License, Version 2.0.",
    "apache.header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3.name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ccbync.name": "Licensed under CC BY-NC 4.0.",
    "ccby.name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa.name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "reserved": "All rights reserved.",
}
#: Licence, category, ordered identifiers.
RULES = [
    ("MIT", "permissive", ["mit.grant", "mit.notice"]),
    ("MIT", "permissive", ["mit.name"]),
    ("ISC", "permissive", ["isc.grant"]),
    ("BSD-4-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.endorse"]),
    ("BSD-3-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("BSD-1-Clause", "permissive", ["bsd.grant", "bsd.source"]),
    ("Apache-2.0", "permissive", ["apache.header", "apache.copy"]),
    ("Apache-2.0", "permissive", ["apache.header"]),
    ("Apache-2.0", "permissive", ["apache.name"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl.free", "gpl.warranty"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl.free"]),
    ("GPL-3.0-only", "copyleft", ["gpl3.name"]),
    ("CC-BY-NC-4.0", "noncommercial", ["ccbync.name"]),
    ("CC-BY-4.0", "permissive", ["ccby.name"]),
    ("CC-BY-SA-4.0", "copyleft", ["ccbysa.name"]),
    ("all-rights-reserved", "reserved", ["reserved"]),
]
#: From the most to the least restricting.
CATEGORIES = ["reserved", "noncommercial", "copyleft", "permissive"]
#: Licence -> category, of the licences that titles, names and headers give.
NAMED = {n: c for n, c, w in RULES} | {
    "0BSD": "permissive", "Zlib": "permissive", "BSL-1.0": "permissive", "Unlicense": "permissive", "CC0-1.0": "permissive", "BUSL-1.1": "noncommercial",
    "MPL-1.1": "copyleft", "MPL-2.0": "copyleft", "EPL-1.0": "copyleft", "EPL-2.0": "copyleft",
    **{f"{x}-{w}": "copyleft" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for w in ("only", "or-later")},
    **{f"CC-BY{x}-{v}": c for x, c in (("", "permissive"), ("-SA", "copyleft"), ("-ND", "reserved"), ("-NC", "noncommercial"), ("-NC-SA", "noncommercial"), ("-NC-ND", "noncommercial")) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}
#: Licence -> sentences that name it alone: titles of the text and headers, as published.
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-2.0-only": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.0-only": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0-only": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
}
#: Normalised name, without "the" and "license" -> licence.
NAMES = {
    "mit": "MIT", "isc": "ISC", "apache 2 0": "Apache-2.0", "apache version 2 0": "Apache-2.0", "apache 2": "Apache-2.0", "apache v2": "Apache-2.0", "apache v2 0": "Apache-2.0",
    "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause",
    "bsd 4 clause": "BSD-4-Clause", "unlicense": "Unlicense", "zlib": "Zlib", "cc0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "cc0 1 0 universal": "CC0-1.0", "creative commons zero v1 0 universal": "CC0-1.0",
    "boost software 1 0": "BSL-1.0", "boost software version 1 0": "BSL-1.0", "boost software": "BSL-1.0", "business source 1 1": "BUSL-1.1", "business source version 1 1": "BUSL-1.1", "business source": "BUSL-1.1",
    **{f"{a}{b}{v}": f"{k}-{n}" for k, a in (("MPL", "mozilla public"), ("MPL", "mpl"), ("EPL", "eclipse public"), ("EPL", "epl")) for n, v in (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2 0")) for b in (" ", " v", " v ", " version ") if f"{k}-{n}" in NAMED},
    **{f"{a}{b}{v}": f"{k}-{n}-only" for k, a in (("GPL", "gnu general public"), ("GPL", "gnu gpl"), ("GPL", "gpl"), ("LGPL", "gnu lesser general public"), ("LGPL", "gnu lgpl"), ("LGPL", "lgpl"), ("LGPL", "gnu library general public"), ("AGPL", "gnu affero general public"), ("AGPL", "gnu agpl"), ("AGPL", "agpl"))
       for n, v in (("2.0", "2"), ("2.0", "2 0"), ("2.1", "2 1"), ("3.0", "3"), ("3.0", "3 0")) for b in (" ", " v", " v ", " version ") if f"{k}-{n}-only" in NAMED},
}
_NAMED = {n.lower(): c for n, c in NAMED.items()}
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", re.I)
_OFF = re.compile(r"[^a-z0-9 ]+")


def normal(sentence: str) -> str:
    return " ".join(_OFF.sub(" ", sentence.lower()).split())


_IDS = {normal(v): f"name:{k}" for k, x in TITLES.items() for v in x} | {normal(v): k for k, v in SENTENCES.items()}
_UNDER = re.compile(
    r"(?:(?:this|the|all|our) (?:\w+ ){1,4}?(?:is|are) )?(?:dual )?(?:licen[sc]ed|released|distributed|available|published|provided|offered|made available)"
    r" (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(.+)"
)
_GNU = re.compile(
    r"(?:this \w+|\w+(?: \w+)?|the \w+(?: \w+)*) is free software you can redistribute it and or modify it under the terms of (?:the )?gnu (affero |lesser |library )?general public license"
    r"(?: version \d(?: \d)?)? as published by the free software foundation (?:either )?version (\d)(?: (\d))?(?: of the license)?(?: only)?( or at your option any later version)?"
)
_CC = re.compile(r"(?:a )?(?:creative commons attribution|cc by|creative commons by)( non ?commercial| nc)?( share ?alike| sa| no ?deriv(?:ative)?s| no ?derivative works| nd)? (\d) (\d)(?: international| unported| generic)?(?: public)?")
_ENDORSE = re.compile(r"(?:neither the names? of .+ nor the names of .*contributors may|the names? of .+ may not) be used to endorse or promote products derived from this software without (?:specific )?prior written permission")
_WAIVED = re.compile(r"to the extent possible under law .+ (?:has|have) waived all copyright and related or neighbou?ring rights to .+")
_ADVERT = normal("All advertising materials mentioning features or use of this software must display the following acknowledgement:")


def _name(said: str) -> str | None:
    """The licence of a normalised name."""
    later = said.endswith(" or later") or said.endswith(" or any later version") or said.endswith(" or at your option any later version")
    said = re.sub(r" or (?:at your option )?(?:any )?later(?: version)?$| only$", "", said)
    bare = " ".join(w for w in said.split() if w not in ("license", "licence"))
    if m := _CC.fullmatch(bare):
        found = f"CC-BY{'-NC' if m[1] else ''}{('-SA' if 's' in m[2][1] else '-ND') if m[2] else ''}-{m[3]}.{m[4]}"
        return found if found in NAMED else None
    found = NAMES.get(bare)
    return found.replace("-only", "-or-later") if found and later else found


def known(sentence: str) -> str | None:
    """Identifier of a normalised sentence; name:LICENCE where it names the licence itself."""
    if found := _IDS.get(sentence):
        return found
    if sentence == _ADVERT:
        return "bsd.advert"
    if "endorse or promote" in sentence and _ENDORSE.fullmatch(sentence):
        return "bsd.endorse"
    if "is free software" in sentence and (m := _GNU.fullmatch(sentence)):
        kind = {"affero ": "AGPL", "lesser ": "LGPL", "library ": "LGPL"}.get(m[1], "GPL")
        found = f"{kind}-{m[2]}.{m[3] or 0}-{'or-later' if m[4] else 'only'}"
        return f"name:{found}" if found in NAMED else None
    if sentence.startswith("to the extent possible under law") and _WAIVED.fullmatch(sentence):
        return "name:CC0-1.0"
    if " under " in sentence and (m := _UNDER.fullmatch(sentence)):
        return f"name:{found}" if (found := _name(m[1])) else None
    # A title: the name with the word licence at its end, or within it before a version.
    if ("license" in sentence or "licence" in sentence) and len(sentence) < 100:
        return f"name:{found}" if (found := _name(sentence.removeprefix("the "))) else None
    return None


_END = re.compile(r"(?<=[.!?:;])\s+|\n\s*\n|\n(?=[A-Z])")
#: Pieces that one known sentence may be split into.
SPAN = 8
#: Every known sentence has one of these words, so a text without them has none.
_TRIGGER = re.compile(r"licens|licenc|permission|redistribut|reserved|program is|spdx|unencumbered|under law|cc0|cc.by|under the|under (?:[al]?gpl|mit|isc|apache|bsd|mpl|epl|zlib)", re.I)
assert all(_TRIGGER.search(s) for s in [*SENTENCES.values(), *(x for t in TITLES.values() for x in t)])


def sentence_ids(text: str | None) -> list[str]:
    """Identifiers of the known sentences of a text, in order; spdx:NAME for a declared identifier.

    A sentence of the table may hold sentence ends of its own, so runs of up to
    SPAN pieces are looked up, the longest first.
    """
    if not text or not _TRIGGER.search(text):
        return []
    pieces = [(p, normal(p)) for p in _END.split(text)]
    out, i = [], 0
    while i < len(pieces):
        for k in range(min(SPAN, len(pieces) - i), 0, -1):
            if pieces[i][1] and pieces[i + k - 1][1] and (found := known(" ".join(x for _, x in pieces[i : i + k] if x))):
                out.append(found)
                i += k
                break
        else:
            # The name may stand in the next piece, as a colon ends one.
            here = pieces[i][0]
            near = f"{here} {pieces[i + 1][0]}" if i + 1 < len(pieces) else here
            out += [f"spdx:{m[1].rstrip('.')}" for m in _SPDX.finditer(near) if m.start() < len(here)]
            i += 1
    return out


def match_rules(ids: list[str]) -> list[tuple[str, str]]:
    """(licence, category) of the rules matched, in order."""
    rules = sorted(RULES, key=lambda r: -len(r[2]))
    out, i = [], 0
    while i < len(ids):
        if ids[i].startswith(("spdx:", "name:")):
            name = ids[i][5:]
            out.append((name, _NAMED.get(name.lower(), "declared")))
            i += 1
            continue
        for name, category, want in rules:
            if ids[i : i + len(want)] == want:
                out.append((name, category))
                i += len(want)
                break
        else:
            i += 1
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers), licenses (distinct, sorted), category (the most restricting, or null)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = sentence_ids(text)
                got = match_rules(ids)
                said = {c for _, c in got}
                rows.append((doc, ids, sorted({n for n, _ in got}), next((c for c in [*CATEGORIES, "declared"] if c in said), None)))
            yield pd.DataFrame(rows, columns=["doc_id", "sentences", "licenses", "category"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, sentences array<string>, licenses array<string>, category string")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"), "category")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL of op8 for rules of one sentence, which stands on a line of its own."""
    single = [(n, c, w[0]) for n, c, w in RULES if len(w) == 1]
    known = ", ".join("('{}', '{}', '{}')".format(normal(SENTENCES[w]), n, c) for n, c, w in single)
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES))
    return f"""
k8(s, name, category) AS (VALUES {known}),
l8 AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {docs})
), m8 AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, min(CASE category {order} END) AS c
  FROM l8 JOIN k8 USING (s) GROUP BY doc_id
), op8 AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(licenses, '') AS licenses,
    {"[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"}[c + 1] AS category
  FROM {docs} d LEFT JOIN m8 ON m8.doc_id = d.doc_id
)"""


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES = {"op8_license_scan": f"WITH {sql()} SELECT * FROM op8"}
