"""Quality rules, line dedup, packing, chat formatting, HTML, licences, toxicity, decontamination."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradeloom.llm import chat_format, decontaminate, html_text, license_scan, line_dedup, packing, quality_rules, toxicity

FILES = "/root/testdata/sf0.001"


def test_quality_counts(docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.text_stats(docs, "doc_id").collect()}
    for i, t in texts:
        w = (t or "").replace("\x1c", "").split()
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(wins)
        covered = {k + j for k, x in enumerate(wins) if c[x] > 1 for j in range(5)}
        ls = [x for x in (t or "").split("\n") if x.split()]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(ls) - len(set(ls)))


def test_quality_tail(spark):
    for n, k, p in ((50, 3, 0.05), (2000, 4, 0.005), (10, 0, 0.005), (30000, 120, 0.005)):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        got = spark.range(1).select(quality_rules._binomial_tail(F.lit(n), F.lit(k), p)).collect()[0][0]
        assert got == pytest.approx(want, rel=1e-8)


def test_quality_verdict(spark, no_docs):
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        rows.append((i, " ".join(f"w{i}x{j}" + ("$$" if bad else "") for j in range(20)), "en"))
        labels.append((i, int(not bad), 0))
    rows += [(9000, None, None), (9001, "a " * 30, "en"), (9002, " ".join(f"u{j}" for j in range(30)), "xx")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_quality_rules(docs, lab).collect()}
    assert all(got[i] == (i % 10 != 0) for i in range(3000)) and not got[9000] and not got[9001] and got[9002]
    few = {r["doc_id"]: r["kept"] for r in quality_rules.apply_quality_rules(docs, lab.limit(0)).collect()}
    assert all(few[i] for i in range(3000))
    assert quality_rules.apply_quality_rules(no_docs, lab).count() == 0


def test_quality_oracle_where_rules_fire(spark):
    """Every stratum has enough labels, so that rules are certified; repeated and null labels, ties in the gain; against the SQL."""
    import duckdb

    rows, labels = [], []
    for k, lang in enumerate(("en", "de", None, "es")):
        for i in range(1300):
            doc, bad = 10_000 * k + i, i % 12 == 0
            w = [f"w{i}x{j}" + ("%" if bad and k % 2 == 0 else "") for j in range(20)]
            w = [x.upper() + " AB" if bad and k % 2 else x for x in w]
            rows.append((doc, " ".join(w) + ("\nsame line here\nsame line here" if i % 50 == 0 else ""), lang))
            labels += [(doc, int(not bad), 0)] * (1 + (i % 7 == 0)) + [(doc, None, 1)] * (i % 5 == 0)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.apply_quality_rules(docs, lab).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", lab.toPandas())
    want = con.sql(f"WITH {quality_rules.sql()} SELECT * FROM op2").df()
    assert got.sort_values("doc_id")[want.columns].reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True).astype(got.dtypes[want.columns].to_dict()))
    gone = set(got.loc[~got["kept"], "doc_id"] // 10_000)
    assert gone == {0, 1, 3}


def test_line_dedup(spark, no_docs):
    rows = [(i, f"Menu \nline {i}\n\nline {i}", "a") for i in range(20)] + [(30, "Menu\nx", "b"), (31, None, "a"), (32, "", None), (33, "Menu", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["page"]["doc_id"]: (r["page"]["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0] == ("line 0\n\nline 0", 4, 1) and got[30] == ("Menu\nx", 2, 0) and got[31] == (None, 0, 0) and got[32] == ("", 1, 0) and got[33] == ("", 1, 1)
    assert line_dedup.drop_boilerplate(no_docs).count() == 0


def test_line_dedup_small_sites_ties_and_names(spark):
    """Sites of two and forty pages, a line at the ratio, repeated rows, a very long text, columns named as the operator's own."""
    long_ = "\n".join(f"l{i}" for i in range(50_000))
    rows = [("a", "Home\none", 1, "x"), ("a", "Home\ntwo", 2, "x"), ("b", long_, 3, "x"), ("b", long_, 3, "x")]
    rows += [("c", f"own {i}" + "\ntwice" * (i < 2) + "\nthrice" * (i < 3), 10 + i, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "site string, text string, n_lines long, drop string")
    got = line_dedup.drop_boilerplate(df, site="site").collect()
    by = {}
    for r in got:
        by.setdefault(r["page"]["n_lines"], []).append((r["page"]["text"], r["n_dropped"], r["page"]["drop"]))
    assert by[1] == [("one", 1, "x")] and by[2] == [("two", 1, "x")] and by[3] == [("", 50_000, "x")] * 2
    assert by[10] == [("own 0\ntwice", 1, "x")] and by[13] == [("own 3", 0, "x")]


def test_packing(docs, texts, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, size=256, with_ids=True).collect()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == ids and [r["start"] for r in mine] == list(range(0, len(ids), 256))
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 256 and sorted(by) == list(range(len(by)))
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    got = Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 64
        for x in lengths:
            got[x] += n
    assert got == Counter(histogram)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t \x1c\x1f\x85\xa0  1²Ⅷ.,!'ś漢😀<|>\r\x0b", max_size=60))
def test_units_are_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.units().ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_batches_and_memory(monkeypatch):
    """The same ids whatever is remembered, and after the memory is full."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [f"w{i} and {'y' * i} <|endoftext|>"[: 30 + i] for i in range(60)] + [""]
    monkeypatch.setattr(packing, "MEMORY", 20)
    u = packing.Units(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for _ in range(2):
        assert [np.frombuffer(u.ids(x), "<u4").tolist() for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(u) <= 20


def test_packing_whole_sequences(spark):
    """Documents of 2,047, 2,048 and 2,049 tokens with the end id, and repeated rows."""
    one = " a" * 5000
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(one, add_special_tokens=False).ids
    assert len(ids) == 5000
    rows = spark.createDataFrame([(i, " a" * n) for i, n in ((1, 2046), (2, 2047), (3, 2048), (3, 2048))], "doc_id long, text string")
    got = packing.pack_documents(rows).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got) == [(1, 0, 2047), (2, 0, 2048), (3, 0, 2048), (3, 0, 2048), (3, 2048, 1), (3, 2048, 1)]
    assert len({r["sequence_id"] for r in got}) == 5


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>\n\n<|endoftext|><|endoftext|>x", "<|endoftext", "<<|endoftext|>|>", "<|ENDOFTEXT|>"]


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string"), with_ids=True).collect()
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(ADDED)}
    assert {r["doc_id"]: r["ids"] for r in rows} == want and 50256 in want[1] and 50256 not in want[3]
    assert all(r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]], "<u4").tobytes()) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "a", "b1", "é", "'s", "endoftext"]), max_size=12))
def test_units_with_added_tokens(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "".join(parts)
    assert np.frombuffer(packing.units().ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\\\<\\|im_end|>", "<|im_end|>\n<|im_start|>", "\\", "<s>\\<<SYS>>", "", None, "<|im_sep|>" * 3]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(2, None, None, "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=3)
    out = out.select("*", chat_format.parse_chats(F.col("formatted")).alias("back"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [(r[2], r[3] or "") for r in rows[:8]] and got[1]["valid"]
    assert [(t["role"], t["text"]) for t in got[2]["back"]] == [("", "x"), ("assistant", "y"), ("assistant", "y")] and got[2]["first_bad_turn"] == 1
    assert got[1]["formatted"].count("<|im_start|>") == 8 and got[1]["formatted"].count("[INST]") == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav>Menu</nav>
<article><h1>A &amp; B</h1><p><b>one<br>two&nbsp;  three<p class="notice">no</p><p>fi<span>ve</span><div class="ad">buy<div>x</div></div>six
<aside>side</aside><form>send</form><section id="comments"><p>bad</section></article><footer>f</footer></body></html>"""


def test_html(spark):
    assert html_text.parse(PAGE)[0] == "A & B one two three five six"
    assert html_text.parse("<p>x < y</p><article") == (None, ["x < y"]) or html_text.parse("<p>x < y</p>") == (None, ["x < y"])
    shared = "all of these ten words stand on every page here"
    bare = [(i, "http://h/1", f"<div>{shared}</div><p>own text {i} {shared} end {i}</p>") for i in range(3)]
    rows = [(10, "http://h/2", PAGE), (11, None, None), (12, "u", ""), *bare]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == "A & B one two three five six" and got[11] == "" and got[12] == ""
    assert [got[i] for i in range(3)] == [f"own text {i} {i}" for i in range(3)]  # 'here end' is in a run of eight as well
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_of_a_large_host(spark):
    """Runs that two pages of a host share, in hosts of 1,200 and of 80 pages, against the suffix array over the whole host."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    pages = {}
    for host, n in (("big", 1200), ("small", 80)):
        for i in range(0, n, 2):
            # Eight to ten tokens, too few to be a block of their own.
            run = [word() for _ in range(8 + i % 3)] if i < 80 else []
            for k in (i, i + 1):
                pages[host, k] = [word() for _ in range(3)] + run + [word() for _ in range(2)]
    pages["other", 0] = list(pages["big", 0])
    keys = list(pages)
    rows = [(n, f"http://{h}/{k}", f"<div><p>{' '.join(pages[h, k])}</p></div>") for n, (h, k) in enumerate(keys)]
    rows.append((len(keys), None, f"<p>{' '.join(pages['big', 0])}</p>"))
    got = {x["page_id"]: x["text"].split() for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("big", "small", "other"):
        mine = [n for n, (h, _) in enumerate(keys) if h == host]
        assert [got[n] for n in mine] == html_text.unique_runs([pages[keys[n]] for n in mine])
    assert all(len(got[n]) == 5 for n, (h, _) in enumerate(keys) if h != "other") and got[len(keys)] == pages["big", 0]


def test_pages_of_a_host_are_all_in_its_array(spark):
    """Marked pages show what an unmarked page shares with its host, and a copy of a page loses nothing."""
    shared = "nine words that stand on every page of here"
    rows = [
        (1, "http://h/1", f"<body><article>kept {shared} a</article><div>left out {shared} of one</div></body>"),
        (2, "http://h/2", f"<body><div>own of two {shared} end</div></body>"),
        (3, "http://i/3", f"<body><p>an article {shared} that was published twice</p></body>"),
        (4, "http://i/4", f"<body><p>an article {shared} that was published twice</p></body>"),
    ]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"kept {shared} a" and got[2] == "own of two end"
    assert got[3] == got[4] == f"an article {shared} that was published twice"


def test_suffix_array_across_partitions(spark):
    """Sorted suffixes dealt anyhow to partitions and batches, and by Spark, give what brute force gives."""
    import random

    import pandas as pd

    r = random.Random(4)
    for _ in range(150):
        rows = sorted((h, s, p, n) for n, (h, s, p) in enumerate((r.choice("ab"), r.choice("uvwxyz"), r.choice([1, 1, 1, 2, 3])) for _ in range(r.randrange(1, 40))))
        every = pd.DataFrame([(h, s, p, n, 7) for h, s, p, n in rows], columns=["host", "head", "page", "row", "i"])
        cuts = sorted({0, len(every), *(r.randrange(len(every) + 1) for _ in range(r.randrange(12)))})
        parts = [[every[a : min(a + 3, hi)] for a in range(lo, hi, 3)] for lo, hi in zip(cuts, cuts[1:], strict=False)]
        # What a partition says of a group that it can't settle is held against the others, as shared_starts does.
        said = pd.concat([pd.concat(list(html_text._neighbours(iter(p)))) for p in parts])
        sure, late = said[said["host"].isna()], said[said["host"].notna()]
        across = late.groupby(["host", "head"]).agg(lo=("lo", "min"), hi=("hi", "max"))
        across = set(across[across["lo"] < across["hi"]].index)
        got = sorted([*sure["row"], *[x.row for x in late.itertuples() if x.row is not None and (x.host, x.head) in across]])
        assert got == sorted(n for h, s, p, n in rows if len({q for g, t, q, _ in rows if (g, t) == (h, s)}) > 1)
    pages = [[r.choice("abc") for _ in range(r.randrange(30))] for _ in range(40)]
    tokens = spark.createDataFrame([("h", n, n, w) for n, w in enumerate(pages)], "host string, row long, page long, w array<string>")
    covered = {n: set() for n in range(len(pages))}
    for x in html_text.shared_starts(tokens, 4).collect():
        covered[x["row"]] |= set(range(x["i"], x["i"] + 4))
    assert [[t for i, t in enumerate(w) if i not in covered[n]] for n, w in enumerate(pages)] == html_text.unique_runs(pages, 4)


def test_unique_runs_brute_force():
    pages = [list("xxabcdefghyy"), list("abcdefghij"), list("cdefghijk"), list("zzzzzzzzzzzz"), []]
    got = html_text.unique_runs(pages, 4)
    for p, tokens in enumerate(pages):
        covered = set()
        for i in range(len(tokens) - 3):
            if any(q != p and tokens[i : i + 4] == other[j : j + 4] for q, other in enumerate(pages) for j in range(len(other) - 3)):
                covered |= set(range(i, i + 4))
        assert got[p] == [t for i, t in enumerate(tokens) if i not in covered]


def test_license(docs, no_docs):
    s = license_scan.SENTENCES
    ids = license_scan.sentence_ids(f"x\n{s['mit.grant']}\n\n{s['mit.notice']} more\nAll rights reserved.\nSPDX-License-Identifier: ISC")
    assert ids[0] == "mit.grant" and "reserved" in ids and "spdx:ISC" in ids
    assert license_scan.match_rules(["mit.grant", "mit.notice", "reserved"]) == [("MIT", "permissive"), ("all-rights-reserved", "reserved")]
    assert license_scan.match_rules(["mit.notice"]) == [] and license_scan.sentence_ids(None) == []
    assert license_scan.scan_licenses(docs).where("size(licenses) > 0").count() == 0 and license_scan.scan_licenses(no_docs).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GNU = """This {} is free software; you can redistribute it and/or
modify it under the terms of the GNU {}General Public
License as published by the Free Software Foundation; either
version {} of the License, or (at your option) any later version.
"""
LICENSED = {
    "BSD-2-Clause": [BSD + '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"', "Licensed under the 2-Clause BSD License."],
    "BSD-3-Clause": [BSD + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE",
                     BSD + "\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"],
    "BSD-4-Clause": [BSD + "\n3. All advertising materials mentioning features or use of this software must\n   display the following acknowledgement:\n     This product includes software developed by Example.\n\n4. Neither the name of Example nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"],
    "MIT": ["Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "MIT License", "Released under the MIT License."],
    "GPL-2.0-or-later": [GNU.format("program", "", "2"), "Licensed under the GNU General Public License, version 2 or later."],
    "GPL-2.0-only": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989", "This code is released under the GPLv2.".replace("GPLv2", "GPL v2")],
    "LGPL-2.1-or-later": [GNU.format("library", "Lesser ", "2.1")],
    "LGPL-3.0-only": ["                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"],
    "EPL-2.0": ["Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nx"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free"],
    "CC0-1.0": ["Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION", "To the extent possible under law, A. Writer has waived all copyright and related or neighboring rights to This Work."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission", "Distributed under the Boost Software License, Version 1.0."],
    "BUSL-1.1": ["Business Source License 1.1\n\nParameters"],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under CC BY-ND 4.0."],
    "CC-BY-SA-3.0": ["Licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License."],
}


@pytest.mark.parametrize("name", LICENSED)
def test_usual_licenses(name):
    for text in LICENSED[name]:
        got = license_scan.match_rules(license_scan.sentence_ids("Intro text.\n\n" + text))
        assert {n for n, _ in got} == {name}, text
        assert all(c == license_scan.NAMED[name] for _, c in got)


def test_no_license():
    assert license_scan.sentence_ids("All rights reserved.\nLicensed under the MIT License.") == ["reserved", "name:MIT"]
    for text in ("The court ruled under the law.", "She was released under the bridge.", "All work is published under the name of Smith.", "A driving license", "Neither the name of it nor the license."):
        assert license_scan.match_rules(license_scan.sentence_ids(text)) == []


def maximal(v):
    best = None
    for i in range(len(v)):
        t = 0
        for j in range(i, len(v)):
            t += v[j]
            if t > 0 and (best is None or t > best[2]):
                best = (i, j, t)
    if best is None:
        return []
    i, j, t = best
    return maximal(v[:i]) + [(i, j, t)] + [(a + j + 1, b + j + 1, c) for a, b, c in maximal(v[j + 1 :])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -1.0, -1.0, 2.75, 1.3125, 3.0625, 0.59375]), max_size=18))
def test_segments(v):
    got = toxicity.segments([(i, s) for i, s in enumerate(v) if s > 0], len(v), -1.0)
    assert sum(c for _, _, c in got) == pytest.approx(sum(c for _, _, c in maximal(v)))
    assert [c for *_, c in sorted(got, key=lambda x: -x[2])][:1] == [c for *_, c in sorted(maximal(v), key=lambda x: -x[2])][:1]


def test_toxicity(spark, docs, no_docs):
    import random

    r = random.Random(2)
    rows = [(i, " ".join([*("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(100)), *(["vile", "foulness"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(train.select("doc_id", "text"), train.where("doc_id < 300").select("doc_id", "toxic"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(train, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert all(0 <= x["score"] < 0.5 for x in toxicity.score(docs, model).collect()) and toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(docs, train.limit(0).select("doc_id", "toxic"))
    assert {x["score"] for x in toxicity.score(docs, none).collect()} == {0.0}


def test_lcs():
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_leaks(spark, docs, texts, no_docs):
    items = [(1, " ".join((texts[0][1]).split()[20:60])), (2, "nothing of this sort is in any text at all here now"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noisy = texts[0][1].split()
    noisy[30] = "changed"
    more = spark.createDataFrame([(900, "before " * 50 + " ".join(noisy[20:60]) + " after" * 50), (901, None)], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(all_, bench).collect()}
    want = set()
    for i, t in [*texts, (900, "before " * 50 + " ".join(noisy[20:60]) + " after" * 50)]:
        w, item = decontaminate.normal(t), decontaminate.normal(items[0][1])
        if any(decontaminate.lcs(item, w[k : k + len(item) + 10]) >= 0.8 * len(item) for k in range(0, max(1, len(w) - len(item)), 5)):
            want.add((i, 1))
    assert got == want
    assert decontaminate.find_leaks(no_docs, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_every_length(spark):
    """Items of 5 to 400 words, verbatim and with 60 % of their words kept in order, in long texts."""
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    # Fillers and items share no words, so that idf is alike; an item is one sentence, so 0.6 of it is 0.6 of the answer.
    items = {n: [word() for _ in range(n)] for n in (5, 6, 15, 40, 100, 250, 300, 400)}
    fill = lambda n: [word() for _ in range(n)]
    loose = lambda t: [w if i % 5 in (0, 2, 4) else word() for i, w in enumerate(t)]
    docs, want = [], set()
    for n, t in items.items():
        for k, body in enumerate((t, loose(t))):
            docs.append((10 * n + k, " ".join(fill(150) + body + fill(150))))
            want.add((10 * n + k, n))
    docs += [(10 * n + 5, " ".join(fill(150) + [w if i % 2 else word() for i, w in enumerate(t)] + fill(150))) for n, t in items.items()]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_repeated_words_reach_the_cosine(spark):
    """A window whose words repeat among rarer ones: its length counts a repeated word with the square of its count."""
    words, rare = [f"w{i}" for i in range(8)], [f"r{i}" for i in range(24)]
    # Of 20 texts the item's words are in 7 and the rare ones in 2: their idf are about 1 and 2.
    docs = [(i, " ".join(words)) for i in range(6)] + [(i, f"other{i}") for i in range(6, 18)] + [(18, " ".join(rare)), (100, " ".join(rare[:12] + words + words + rare[12:]))]
    bench = spark.createDataFrame([(1, " ".join(words + words))], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert 100 in {x["doc_id"] for x in got} and all(x["cosine"] >= decontaminate.COSINE for x in got)


@given(st.lists(st.text(alphabet="abCÄñ “”—.,'-\xa0\t\n1\x1c", max_size=60), max_size=8))
@settings(max_examples=200, deadline=None)
def test_hashes_are_those_of_normal_words(texts):
    h, seen = decontaminate.Hasher(), {}
    for t, codes in zip(texts, h.many(texts), strict=True):
        words = decontaminate.normal(t)
        assert len(words) == len(codes)
        for w, c in zip(words, codes.tolist(), strict=True):
            assert seen.setdefault(w, c) == c
    assert len(set(seen.values())) == len(seen)


def test_hashes_of_a_long_text():
    h, text = decontaminate.Hasher(), "some words, of a — text " * 20_000
    assert h.of(text).tolist() == h.of("some words, of a — text").tolist() * 20_000
    assert [len(x) for x in h.many([None, "", " - ", text, "a"])] == [0, 0, 0, 100_000, 1]


def test_rank_is_below_the_passages():
    """Passages that have words in common need fewer dimensions than there are passages."""
    r = np.random.default_rng(5)
    topics = r.random((6, 80))
    a = np.array([topics[i % 6] + 0.2 * r.random(80) for i in range(60)])
    left, _ = decontaminate.randomised_svd(a / np.linalg.norm(a, axis=1, keepdims=True), 60)
    k = decontaminate.fitting_rank(left)
    assert k <= 6 and ((left[:, :k] ** 2).sum(axis=1) >= decontaminate.ENERGY * (left**2).sum(axis=1) - 1e-9).all()


def test_recall_on_paraphrases(spark):
    """Items with a fifth to a third of their words replaced, in documents of the test tables: at least 0.9 of the leaks by the LCS rule are found."""
    import random

    r = random.Random(9)
    sf = "/root/testdata/sf0.001"
    texts = [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if x["text"]]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()
    pool, docs, want = [w for t in texts for w in t.split()], [], set()
    for n, it in enumerate(items):
        for k, keep in enumerate((0.8, 0.66)):
            body = [w if r.random() < keep else r.choice(pool) for w in it["text"].split()]
            at = r.randrange(len(pool) - 200)
            doc, item, said = 1000 + 2 * n + k, decontaminate.normal(it["text"]), decontaminate.normal(decontaminate.answer(it["text"]))
            part = decontaminate.normal(" ".join(body))
            got, hit = decontaminate.lcs(item, part) / len(item), decontaminate.lcs(said, part) / len(said)
            docs.append((doc, " ".join(pool[at : at + 100] + body + pool[at + 100 : at + 200])))
            if got >= decontaminate.LCS or got >= decontaminate.LCS_ANSWER and hit >= decontaminate.ANSWER:
                want.add((doc, it["item_id"]))
    every = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(every, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(want) > 30 and len(want & got) >= 0.9 * len(want)


def test_leaks_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"item{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text), (None, text), (6, " ".join(f"long{i}" for i in range(5000)))], "item_id long, text string")
    assert sorted((x["doc_id"] or 0, x["item_id"]) for x in decontaminate.find_leaks(docs, bench).collect()) == [(0, 5), (1, 5), (1, 5)]


def test_svd():
    a = np.random.default_rng(1).random((20, 60))
    left, right = decontaminate.randomised_svd(a, 20)
    assert np.allclose(left @ right, a)
