"""The pipeline's stages on the smallest tables against plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import linked

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tradeloom.llm import decontaminate, packing, quality_rules  # noqa: E402

SF = "/root/testdata/sf0.001"


def quality(docs, labels):
    """Base rules, and the certified cutoffs by their definition."""
    def stats(t):
        w = (t or "").split()
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(wins)
        rep = len({k + j for k, x in enumerate(wins) if c[x] > 1 for j in range(5)})
        ls = [x for x in (t or "").split("\n") if x.split()]
        up = sum(1 for run in __import__("regex").findall(r"\p{Lu}\p{Lu}+", t or ""))
        sym = sum((t or "").count(x) for x in "#*$%&|<>")
        level = lambda a, b: math.floor(min(1.0, a / max(b, 1)) * quality_rules.STEPS)
        n = len(w)
        return n < 10 or 100 * rep > 20 * n, {"symbols": level(sym, n), "shouts": level(up, n), "dup_lines": level(len(ls) - len(set(ls)), len((t or "").split("\n"))), "repeats": level(rep, n)}

    s = {d: (lang, *stats(t)) for d, (t, lang) in docs.items()}
    seen = [(s[d], q) for d, q in labels if d in s and not s[d][1]]
    strata = {x[0] for x, _ in seen}
    cut = {}
    for lang in strata:
        for rule in quality_rules.RULES:
            good = [x[2][rule] for x, q in seen if x[0] == lang and q]
            bad = [x[2][rule] for x, q in seen if x[0] == lang and not q]
            best = None
            for c in range(quality_rules.STEPS, 0, -1):
                k, hit, n, p = sum(v >= c for v in good), sum(v >= c for v in bad), len(good), quality_rules.ALPHA
                tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
                if not (k < n * p and tail <= quality_rules.DELTA / (len(strata) * 4)):
                    break
                gain = hit * max(n, 1) - 4 * k * max(len(bad), 1)
                if hit and gain > 0 and (best is None or gain > best[0]):
                    best = (gain, c)
            if best:
                cut[lang, rule] = best[1]
    return {d: docs[d] for d, (lang, base, lv) in s.items() if not base and not any(lv[r] >= cut.get((lang, r), 10**9) for r in lv)}


def test_pipeline(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in read("documents").collect()}
    kept = quality({d: x[:2] for d, x in docs.items()}, [(r["doc_id"], r["quality"]) for r in read("labels").collect()])
    pages, having = Counter(docs[d][2] for d in kept), defaultdict(set)
    for d in kept:
        for x in docs[d][0].split("\n"):
            having[docs[d][2], x.strip(" \t\n\x0b\x0c\r")].add(d)
    drop = {k for k, v in having.items() if k[1] and len(v) >= 2 and len(v) > 0.05 * pages[k[0]]}
    lined = {d: "\n".join(x for x in docs[d][0].split("\n") if (docs[d][2], x.strip(" \t\n\x0b\x0c\r")) not in drop) for d in kept}
    alone = {d: lined[d] for d, (_, _, k) in linked(list(lined.items())).items() if k}
    items = [decontaminate.normal(r["text"]) for r in read("benchmark").collect()]
    clean = {}
    for d, t in alone.items():
        w = decontaminate.normal(t)
        if not any(decontaminate.lcs(i, w[k : k + len(i) + 10]) >= 0.8 * len(i) for i in items if len(set(i) & set(w)) >= 0.8 * len(set(i)) for k in range(0, max(1, len(w) - len(i) + 1), 5)):
            clean[d] = t
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(clean)
    for d, t in clean.items():
        ids = len(packing.units().ids(t)) // 4 + 1
        mine = [r for r in got if r["doc_id"] == d]
        assert sum(r["length"] for r in mine) == ids == mine[0]["doc_tokens"]
    assert np.all([r["offset"] + r["length"] <= 2048 for r in got])


def test_stages_on_edge_rows(spark, monkeypatch):
    """Nulls in any column, empty texts, repeated rows, an empty table and columns with clashing names."""
    long_ = " ".join(f"word{i}" for i in range(60))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, component string, __id long, drop string"
    rows = [(1, long_, "en", "a", 1, "x", 5, "d"), (1, long_, "en", "a", 1, "x", 5, "d"), (None, long_ + " more", None, None, None, None, None, None), (None, "few", "en", "a", 1, None, None, None), (2, None, "en", "a", 1, None, None, None), (3, "", None, None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            got = out.collect()
            if part is docs:
                want = {"quality": 3, "lines": 6, "near_duplicates": 6, "decontamination": 6}[name]
                assert len(got) == want, name
    assert sorted({(r["doc_id"], r["doc_tokens"] > 1) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}, key=str) == sorted([(1, True), (None, True), (2, False), (3, False)], key=str)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_rows_are_judged_by_their_own_texts(spark):
    """A leak under a null doc_id goes; of rows of one doc_id only those whose own text leaks or fails."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    good = " ".join(f"plain{i}" for i in range(80))
    leak = f"{good} {item}"
    kind = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `a.b` string"
    rows = [(None, leak), (None, good), (1, leak), (1, good), (2, item), (2, "one"), (3, good), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "r", "x") for d, t in rows], kind)
    left = decontaminate.stage(spark, docs, SF)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(None, good), (1, good), (2, "one"), (3, good), (3, None)])
    left = quality_rules.stage(spark, docs, SF)
    assert left.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in left.collect())
    want = Counter(r for r in rows if r[1] not in ("one", None))
    assert kept == want


def test_pages_of_equal_and_null_ids(spark):
    from tradeloom.llm import html_text

    shared = "this run of eight words is on every page here"
    page = lambda x: f"<html><body><div>{x}</div><div>{shared}</div></body></html>"
    rows = [(None, "http://h/1", page("own words here")), (None, "http://h/2", page("other text there")), (5, "http://h/3", page("first of five")), (5, "http://h/3", page("second of five")), (5, "http://h/3", page("second of five")), (9007199254740993, "http://h/4", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["text"]) for r in html_text.extract(docs).collect())
    assert got == Counter([(None, "own words here"), (None, "other text there"), (5, "first of five"), (5, "second of five"), (5, "second of five"), (9007199254740993, "")])
