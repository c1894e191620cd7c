"""Suffix dedup, near dedup and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tradeloom.llm import near_dedup, suffix_dedup
from tradeloom.llm.graph import components


def removed(texts, length):
    seen, twice = set(), set()
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, t in data:
        for k in range(len(t) - length + 1):
            (twice if t[k : k + length] in seen else seen).add(t[k : k + length])
    out = {}
    for i, t in data:
        mask = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if t[k : k + length] in twice:
                mask[k : k + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        out[i] = (len(t), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffix_brute_force(docs, texts):
    assert result(suffix_dedup.remove_repeats(docs)) == removed(texts, 400)


def test_suffix_hot_anchors(docs, texts):
    assert result(suffix_dedup.remove_repeats(docs, hot=2)) == removed(texts, 400)


def test_suffix_text_and_empty(docs, texts, no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    by = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    for i, t in texts:
        if by[i]["n_removed"]:
            assert hashlib.sha256(bytes(by[i]["kept"])).hexdigest() == by[i]["kept_sha256"]
            assert sum(s["e"] - s["s"] for s in by[i]["spans"]) == by[i]["n_removed"]


def test_index_against_pairs():
    r = random.Random(5)
    for _ in range(60):
        rows = sorted((r.randrange(3), bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))), b"K" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 14)))) for _ in range(r.randint(2, 14)))
        g, left, right = np.array([x[0] for x in rows]), [x[1] for x in rows], [x[2] for x in rows]
        marks = suffix_dedup.repeated(g, left, right, length=10)
        for i, (k, a, b) in enumerate(rows):
            for d in range(len(a) + 1):
                s = (a[len(a) - d :] + b)[:10]
                want = len(s) == 10 and any(j != i and k2 == k and d <= len(a2) and (a2[len(a2) - d :] + b2)[:10] == s for j, (k2, a2, b2) in enumerate(rows))
                assert bool(marks[i, d]) == want


def linked(texts):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_near_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == linked(texts)


@pytest.mark.parametrize("pivots", [1, 3])
def test_near_small_blocks(docs, texts, pivots):
    """Blocks so small that lists and groups are split: pivots, and what they don't reach, give the same components."""
    groups = near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect()
    sketches = near_dedup.sketch(docs).where("digest is not null").withColumnRenamed("doc_id", "id").select("id", "sig", "digest")
    found = components(near_dedup.candidates(sketches.select("id", "sig"), block=3, pivots=pivots))
    links = components(near_dedup.confirm(docs, found.join(sketches.select("id", "digest"), "id"), block=300, pivots=pivots))
    name = {r["id"]: r["component"] for r in links.collect()}
    assert {r["doc_id"]: r["component_id"] for r in groups} == {r["doc_id"]: name.get(r["doc_id"], r["doc_id"]) for r in groups}


def test_forest_of_a_chain(spark):
    """One hot key whose members are linked in chains: no pivot reaches all of them."""
    r = random.Random(8)
    ids = r.sample(range(1000), 60)
    place = {x: i for i, x in enumerate(ids)}
    links = lambda what, a, b: abs(np.array(what)[a][:, None] - np.array(what)[b][None, :]) == 1
    rows = spark.createDataFrame([(5, x, 1, i + i // 20) for x, i in place.items()], "key long, id long, weight int, at int")
    got = {x["id"]: x["component"] for x in components(near_dedup.forest(rows, "at", links, block=7, pivots=2)).collect()}
    assert got == {x: min(y for y in ids if place[y] // 20 == place[x] // 20) for x in ids}


def test_forest_of_members_that_different_pivots_reach(spark):
    """Chains whose links join members that are linked with one pivot each, of pivots that are not linked."""
    chains = {key: [key * 100 + i for i in range(7)] for key in range(40)}
    members = spark.createDataFrame([(key, i, 1, i) for key, ids in chains.items() for i in ids], "key long, id long, weight long, at long")
    links = lambda at, rows, columns: np.abs(np.array(at)[rows][:, None] - np.array(at)[columns][None, :]) <= 1
    edges = near_dedup.forest(members, "at", links, 2, 2)
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: ids[0] for ids in chains.values() for i in ids}


def test_near_same_id_and_null_id(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (None, a), (None, c), (9, c)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (0, None, True), (0, None, True), (9, 9, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in near_dedup.stage(spark, rows, "").collect()) == ["1", "9", "None", "None"]


def test_near_empty_and_repeated(spark, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d E f")], "doc_id long, text string")
    assert [tuple(r) for r in near_dedup.near_duplicates(rows).orderBy("doc_id").collect()] == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    name = {}
    for a, b in edges:
        for x in (a, b):
            name.setdefault(x, x)
    for _ in range(300):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in name.items() if x in got} and all(name[x] == x for x in set(name) - set(got))
