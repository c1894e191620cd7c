"""Periodic runs, phrases and token files against brute force, exact round trips and the files' own footers."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tradeloom.llm import periodic_runs as R
from tradeloom.llm import phrases as P
from tradeloom.llm import token_files as T

SF = "/root/testdata/sf0.001"


# --- periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, t, q) for (s, t), q in out.items())


def brute_factors(w):
    out, b = [], 0
    while b < len(w):
        n = 0
        while b + n < len(w) and any(w[s : s + n + 1] == w[b : b + n + 1] for s in range(b)):
            n += 1
        out.append((b, b + max(n, 1)))
        b += max(n, 1)
    return out


def some_words(r, size):
    k, w = r.choice([1, 2, 2, 3, 4]), []
    while len(w) < r.randint(0, size):
        w += [r.randrange(k) for _ in range(r.randint(1, 8))] * r.choice([1, 1, 4, 5, 6, 9])
        if r.random() < 0.3 and len(w) > 10:
            a = r.randrange(len(w))
            w += w[a : a + r.randint(1, 40)]
    return w


def test_runs_brute_force():
    r = random.Random(5)
    for i in range(4000):
        w = some_words(r, 90)
        want = brute_runs(w)
        assert R.runs(w) == want
        assert sorted((a + s, a + t, q) for a, b in R.stretches(np.array(w, np.int64)) for s, t, q in R.runs(w[a:b])) == want
        if i % 40 == 0:
            assert [x[:2] for x in R.factors(w)] == brute_factors(w)
            assert all(w[s : s + e - b] == w[b:e] and s < b for b, e, s in R.factors(w) if s >= 0)


def brute_row(doc, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted and doc is not None and w and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    keep = [True] * len(w)
    for s, t, q in runs:
        keep[s + q : t] = [False] * (t - s - q)
    best = (None,) * 3
    for s, t, q in runs:
        if best[0] is None or (t - s) * best[2] > best[1] * q:
            best = (s, t - s, q)
    listed = "".join(f"{s},{t - s},{q}\n" for s, t, q in runs)
    collapsed = " ".join(x for x, k in zip(w, keep, strict=True) if k)
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    return (doc, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())


def key(row):
    return tuple((x is None, x) for x in row)


def test_periodic_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in R.op11_periodic_runs(spark, SF).collect())
    assert got == sorted(brute_row(*d) for d in docs)
    assert any(r[1] for r in got)


def test_periodic_runs_edges(spark):
    r = random.Random(2)
    texts = [None, "", " \t\n ", "a", "a a a a a a", "a\x1fb a\x1fb", "x " * 20000, "é ü " * 9, "a b c\x0b" * 5 + "a"]
    texts += [" ".join(map(str, some_words(r, 300))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[7], "x"), (5, texts[7], "x"), (None, texts[7], "x"), (None, "a", None), (-3, texts[8], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string").repartition(3)
    got = sorted((tuple(x) for x in R.periodic_runs(docs).collect()), key=key)
    assert got == sorted((brute_row(d, t, False) for d, t, _ in rows), key=key)
    planted = sorted((tuple(x) for x in R.periodic_runs(R.plant(docs)).collect()), key=key)
    assert planted == sorted((brute_row(d, t) for d, t, _ in rows), key=key)
    assert R.periodic_runs(docs.limit(0)).collect() == []
    spans = R.periodic_runs(docs.where("doc_id = 4"), with_runs=True).collect()[0]
    assert [tuple(x) for x in spans["runs"]] == [(0, 6, 1)]


# --- phrases


def brute_phrases(rows, least, top, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang, t = "und" if lang is None else lang, (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w, c = re.findall(r"[^\x20\x09]+", piece), f.setdefault(lang, Counter())
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        drop = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        ranked = []
        for p, a in found.items():
            if p not in drop:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, x in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]))
    return sorted(out)


@pytest.mark.parametrize("block,buckets", [(P.BLOCK, P.BUCKETS), (200, 1 << 16)])
def test_phrases_brute_force(spark, block, buckets):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_phrases([tuple(r) for r in docs.select("lang", "text").collect()], 5, 300)
    got = sorted(tuple(r) for r in P.collocations(docs, least=5, top=300, block=block, buckets=buckets).collect())
    assert len(got) > 300 and got == want


def test_phrases_edges(spark):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["To", "be", "OR", "not", "é", "x\x1fy", "z\xa0"]) + r.choice(["", "", "", ".", ",", "\x0b"]) for _ in range(n))
    rows = [(r.choice(["en", None, "", "en "]), say(r.randint(0, 40)), "x") for _ in range(150)] + [("en", None, "x"), (None, "", None), (None, "a b c d e f " * 40, "x"), ("en", say(4000), "x")] + [("de", "so und so", "x")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string, phrase string").repartition(5)
    got = sorted(tuple(x) for x in P.collocations(docs, least=9, top=50).collect())
    assert got == brute_phrases([x[:2] for x in rows], 9, 50)
    assert P.collocations(docs.limit(0)).collect() == [] and P.collocations(docs, least=10**6).collect() == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 50000, np.uint64))
    h = P.PerfectHash(keys[::2])
    assert sorted(h.slots(keys[::2])) == list(range(len(h))) and (h.slots(keys[1::2]) == -1).all()
    assert (h.keys[h.slots(keys[::2])] == keys[::2]).all() and len(P.PerfectHash(keys[:0])) == 0


def test_scores_past_64_bits(spark):
    big = 3 * 10**12
    level = spark.createDataFrame([(0, "en", "a b", big, [big + 7], [big + 9], 0, 1)], "slot long, lang string, phrase string, n long, heads array<long>, tails array<long>, first long, last long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, total long")
    assert P.rank([level, level], totals).collect()[0]["score"] == 1000 * big * 10**14 // ((big + 7) * (big + 9))


# --- token files


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_rows(rows):
    t, out, start = tokenizer(), [], 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert [tuple(r) for r in T.op13_token_files(spark, SF).orderBy("start").collect()] == library_rows(docs)


def test_token_files_parts(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    T.write_tokens(docs, path, row_group=4 << 10, page=1024, page_rows=5, files=3)
    every = T.read_tokens(spark, path).orderBy("start").collect()
    want = library_rows([tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])
    assert [tuple(r)[:4] for r in every] == want
    assert sorted(tuple(r) for r in T.digests(T.read_tokens(spark, path)).collect()) == want
    whole = np.concatenate([r["ids"] for r in every])
    for a, b in ((0, 5), (1, len(whole)), (100, 101), (1000, 3500), (len(whole) - 3, len(whole) + 9), (len(whole), len(whole) + 1), (7, 7)):
        got = T.read_span(spark, path, a, b).orderBy("at").collect()
        assert [x for r in got for x in r["ids"]] == whole[a:b].tolist()
        assert all(whole[r["at"] : r["at"] + len(r["ids"])].tolist() == r["ids"] for r in got)
    files = sorted(Path(path, "tokens").glob("*.parquet"))
    assert len(files) == 3
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            by = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in by.values())
            assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["ids.list.element"].has_dictionary_page
    assert groups > 3
    plan = T.read_tokens(spark, path).where("doc_id = 7").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in re.search(r"ReadSchema: (\S+)", plan)[1].replace("ids_crc32", "")


def test_token_files_edges(spark, tmp_path):
    rows = [(None, "a <|endoftext|> b", 1), (3, None, 1), (3, "", 1), (3, "same", 1), (3, "same", 1), (-1, "ünï\n\n  x", 1), (None, None, None)] + [(5, "hot id " * (i % 7), 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(4)
    T.write_tokens(docs, str(tmp_path / "t"), files=4)
    got = T.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, n, c) for d, _, n, c in library_rows([x[:2] for x in rows]))
    T.write_tokens(docs.limit(0), str(tmp_path / "none"))
    assert T.digests(T.read_tokens(spark, str(tmp_path / "none"))).collect() == []
    assert T.read_span(spark, str(tmp_path / "none"), 0, 9).collect() == []
