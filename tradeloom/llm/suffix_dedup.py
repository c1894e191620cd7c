"""Removal of long repeated byte strings by an anchor-partitioned LCP sweep.

Every `LENGTH`-byte string that starts at two places or more is removed from all
of them. A string is routed by content: of its `GRAM`-byte grams the one of
smallest hash, the rightmost of ties, is its anchor, so equal strings meet at
the anchor's hash at equal distance from it. Anchors that occur once end there.
Around the others goes the stretch of text whose strings have this anchor.

For each anchor the stretches are indexed by their Burrows-Wheeler transform,
column by column: the suffixes that begin at the anchor are sorted, then each
step to the left reads the column of preceding bytes and maps the order by it
(last-to-first). Within a run of equal bytes the order stays and the common
prefix of neighbours grows by one; only at run ends is it cut or taken again as
a range minimum. Every column works on all rows; no run is encoded. The larger of a suffix's two
common prefixes is its matching statistic against all others; where it reaches
LENGTH the string is marked. Memory is bounded by a block of anchors, not by the
corpus. The stretches of an anchor with more than `HOT` occurrences are not
gathered: their strings are counted by two 64-bit hashes, which spreads them.

Texts that are equal are indexed once; from LENGTH bytes they go entirely.

Edge cases: a null or empty text has no bytes and no spans, a text shorter than
LENGTH loses nothing; very long texts and runs of one byte are taken whole;
repeated rows are copies of each other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LENGTH, GRAM = 400, 64
#: Occurrences of one anchor that one task indexes; bytes that are hashed, and stretches that are indexed, at a time.
HOT, BLOCK_BYTES, BLOCK_ROWS = 50_000, 1 << 18, 8192
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _doubled(h: np.ndarray, s: int) -> np.ndarray:
    a, b = h[: len(h) - s], h[s:]
    out = a * _C1
    out += b * _C2
    out ^= out >> np.uint64(31)
    return out


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _C2
    h ^= h >> np.uint64(29)
    out, done, s = None, 0, 1
    while True:
        if size & s:
            if out is None:
                out, done = h, s
            else:
                n = min(len(out), len(h) - done)
                out = out[:n] * _C2 + h[done : done + n] * _C1
                out ^= out >> np.uint64(30)
                done += s
        if s * 2 > size:
            return out
        h, s = _doubled(h, s), s * 2


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For each text the rows (hash, position, first and last start of the strings it anchors), int64."""
    out: list[np.ndarray] = [np.empty((0, 4), np.int64)] * len(texts)
    todo: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            todo.append(i)
            held += len(t)
        if todo and (held >= BLOCK_BYTES or i == len(texts) - 1):
            _anchors([texts[j] for j in todo], todo, out, length, gram)
            todo, held = [], 0
    if todo:
        _anchors([texts[j] for j in todo], todo, out, length, gram)
    return out


def _anchors(texts, numbers, out, length, gram):
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = _rolling(data, gram)
    low = np.uint64((1 << 28) - 1)
    at = np.arange(len(h), dtype=np.uint64)
    least = (h & ~low) | (low - at)
    width, s = length - gram + 1, 1
    while s * 2 <= width:
        least = np.minimum(least[: len(least) - s], least[s:])
        s *= 2
    if s < width:
        least = np.minimum(least[: len(least) - (width - s)], least[width - s :])
    pos = (low - (least & low)).astype(np.int64)
    at = 0
    for i, t in zip(numbers, texts, strict=True):
        n = len(t) - length + 1
        p = pos[at : at + n]
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        p = p[first]
        out[i] = np.column_stack((h[p].view(np.int64), p - at, first, last))
        at += len(t)


def repeated(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Marks [row, distance]: the string that begins `distance` bytes left of the row's anchor occurs elsewhere in its group.

    lefts: the bytes before the anchor, rights: those from it on. groups must be sorted.
    """
    m = len(groups)
    left, right = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    marks = np.zeros((m, int(left.max(initial=0)) + 1), bool)
    if m < 2:
        return marks
    wide = int(right.max())
    number = np.cumsum(np.concatenate(([0], groups[1:] != groups[:-1]))).astype(np.int64)
    x = np.zeros((m, wide + 4), np.uint8)
    x[:, :4] = number.astype(">u4").view(np.uint8).reshape(m, 4)
    for r, b in enumerate(rights):
        x[r, 4 : 4 + len(b)] = np.frombuffer(b, np.uint8)
    order = np.argsort(x.view(f"S{wide + 4}").ravel(), kind="stable")
    x, rt = x[order], right[order]
    same = np.ones((m - 1, wide + 1), bool)
    np.equal(x[1:, 4:], x[:-1, 4:], out=same[:, :wide])
    same[:, wide] = False
    lcp = np.zeros(m, np.int64)
    lcp[1:] = np.minimum(same.argmin(axis=1), np.minimum(rt[1:], rt[:-1]))
    g = number[order]
    lcp[1:][g[1:] != g[:-1]] = 0
    del x, same
    # A suffix whose best match falls short even with all bytes to its left is neither marked nor anyone's match.
    best = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    stay = np.flatnonzero(best + left[order] >= length)
    if len(stay) < 2:
        return marks
    if len(stay) < m:
        ends = np.column_stack((np.concatenate(([0], stay[:-1] + 1)), stay + 1)).ravel()
        lcp = np.minimum.reduceat(np.concatenate((lcp, [0])), ends)[::2]
        order, g = order[stay], g[stay]
        lcp[0] = 0
        lcp[1:][g[1:] != g[:-1]] = 0
    before = np.full((m, int(left.max()) + 1), 256, np.int16)
    for r in order:
        b = lefts[r]
        before[r, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    n = len(order)
    for a in range(marks.shape[1]):
        hit = np.flatnonzero(lcp >= length)
        if len(hit):
            marks[order[hit], a] = True
            marks[order[hit - 1], a] = True
        c = before[order, a].astype(np.int64)
        key = g * 512 + c
        runs = key[1:] == key[:-1]
        if (key[1:] < key[:-1]).any():
            perm = np.argsort(key, kind="stable")
            new = key[perm]
            joined = np.concatenate(([False], (new[1:] == new[:-1]) & (new[1:] & 511 < 256)))
            nxt = lcp[perm]
            far = np.flatnonzero(joined & np.concatenate(([False], perm[1:] != perm[:-1] + 1)))
            if len(far):
                ends = np.column_stack((perm[far - 1] + 1, perm[far] + 1)).ravel()
                nxt[far] = np.minimum.reduceat(np.concatenate((lcp, [0])), ends)[::2]
            lcp = np.where(joined, nxt + 1, 0)
            order, g = order[perm], g[perm]
        else:
            lcp[1:] = np.where(runs & (c[1:] < 256), lcp[1:] + 1, 0)
            lcp[0] = 0
    assert n == len(order)
    return marks


def _ranges(marks: np.ndarray):
    """(row, first distance, last distance) of the runs of marks."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return r, a, b - 1


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans of strings that start in the ranges, united where they overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [tuple(x) for x in out]


def _keys() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def scan(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, key of the text, its bytes, digest and anchors."""

    def run(batches):
        for b in batches:
            t = [x.encode("utf-8") for x in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "k1": b["k1"], "k2": b["k2"],
                "n_bytes": [len(x) for x in t], "sha": [hashlib.sha256(x).hexdigest() for x in t],
                "anchors": [a.ravel() for a in anchors(t, length, gram)],
            })

    return docs.select(F.col("doc_id").cast("long"), *_keys()).mapInPandas(run, "doc_id long, k1 long, k2 long, n_bytes long, sha string, anchors array<long>")


def stretches(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, text, shared: array<struct<p,lo,hi,h>>) -> the stretch of each anchor, and ranges marked at once.

    A stretch that a text has twice is repeated throughout: it is marked here and goes on once.
    """

    def run(batches):
        for b in batches:
            rows = []
            for k1, k2, text, shared in zip(b["k1"], b["k2"], b["text"], b["shared"], strict=True):
                t, seen = text.encode("utf-8"), {}
                for x in shared:
                    p, lo, hi, h = x["p"], x["lo"], x["hi"], x["h"]
                    key = (h, p - lo, t[lo : hi + length])
                    if key not in seen:
                        seen[key] = (lo, hi)
                        rows.append((k1, k2, h, p, t[lo:p], t[p : hi + length], None, None))
                    else:
                        if seen[key]:
                            rows.append((k1, k2, None, None, None, None, *seen[key]))
                            seen[key] = None
                        rows.append((k1, k2, None, None, None, None, lo, hi))
            yield pd.DataFrame(rows, columns=["k1", "k2", "h", "p", "l", "r", "s", "e"]).astype({"h": "Int64", "p": "Int64", "s": "Int64", "e": "Int64"})

    return texts.mapInPandas(run, "k1 long, k2 long, h long, p long, l binary, r binary, s long, e long")


def index(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, h, p, l, r) -> (k1, k2, s, e): starts of repeated strings, as ranges."""

    def blocks(batches):
        held, rows = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            if rows >= BLOCK_ROWS:
                one = pd.concat(held) if len(held) > 1 else held[0]
                h = one["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield one.iloc[:cut]
                held, rows = [one.iloc[cut:]], len(one) - cut
        if rows:
            yield pd.concat(held) if len(held) > 1 else held[0]

    def run(batches):
        for block in blocks(batches):
            h = block["h"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))
            at = 0
            while at < len(cuts) - 1:
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_ROWS, "right")) - 1)
                g = block.iloc[cuts[at] : cuts[to]]
                r, a, b = _ranges(repeated(h[cuts[at] : cuts[to]], list(g["l"]), list(g["r"]), length))
                p = g["p"].to_numpy()[r]
                yield pd.DataFrame({"k1": g["k1"].to_numpy()[r], "k2": g["k2"].to_numpy()[r], "s": p - b, "e": p - a})
                at = to

    dealt = parts.select("k1", "k2", "h", "p", "l", "r").repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(run, "k1 long, k2 long, s long, e long")


def counted(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """As index, for anchors that are too frequent: strings are counted by their hashes."""

    def run(batches):
        for b in batches:
            for k1, k2, p, left, right in zip(b["k1"], b["k2"], b["p"], b["l"], b["r"], strict=True):
                t = np.frombuffer(left + right, np.uint8)
                if len(t) >= length:
                    x, y = _rolling(t, length), _rolling(255 - t, length)
                    yield pd.DataFrame({"k1": k1, "k2": k2, "s": p - len(left) + np.arange(len(x)), "x": x.view(np.int64), "y": y.view(np.int64)})

    one = parts.select("k1", "k2", "p", "l", "r").mapInPandas(run, "k1 long, k2 long, s long, x long, y long")
    many = one.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")
    return one.join(many, ["x", "y"]).select("k1", "k2", "s", F.col("s").alias("e"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and where asked for kept and spans: one row per row of docs."""
    every = materialize(scan(docs, length, gram))
    key = ["k1", "k2"]
    first = every.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    heads = every.where(F.size("anchors") > 0).join(first.select(*key, "doc_id"), [*key, "doc_id"], "left_semi")
    rows = F.transform(F.sequence(F.lit(0), F.size("anchors") - 1, F.lit(4)), lambda i: F.struct(F.get("anchors", i).alias("h"), F.get("anchors", i + 1).alias("p"), F.get("anchors", i + 2).alias("lo"), F.get("anchors", i + 3).alias("hi")))
    one = heads.select(*key, F.explode(rows).alias("x")).select(*key, "x.*")
    # Which of an anchor's occurrences is meant does not matter, only whether there are more.
    often = one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = one.join(often, "h").select(*key, F.struct("p", "lo", "hi", "h").alias("x"), (F.col("n") > hot).alias("hot"), "h")
    too = materialize(often.where(F.col("n") > hot).select("h"))
    shared = shared.groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("shared"))
    texts = docs.select(*_keys()).join(shared, key).dropDuplicates(key)
    texts = materialize(texts.select(*key, "text", "shared"))
    parts = materialize(stretches(texts, length))
    found = parts.where("s IS NOT NULL").select(*key, "s", "e")
    parts = parts.where("h IS NOT NULL")
    found = found.unionByName(index(parts.join(too, "h", "left_anti"), length))
    if not too.isEmpty():
        found = found.unionByName(counted(parts.join(too, "h", "left_semi"), length))
    found = found.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))

    def cut(batches):
        for b in batches:
            rows = []
            for k1, k2, text, ranges in zip(b["k1"], b["k2"], b["text"], b["ranges"], strict=True):
                t, at, left = text.encode("utf-8"), 0, []
                spans = covered([(x["s"], x["e"]) for x in ranges], length)
                for s, e in spans:
                    left.append(t[at:s])
                    at = e
                kept = b"".join(left) + t[at:]
                rows.append((k1, k2, len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None, [{"s": s, "e": e} for s, e in spans] if with_text else None))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    done = texts.select(*key, "text").join(found, key).mapInPandas(cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<s:long,e:long>>")
    out = every.drop("anchors").join(first.drop("doc_id"), key).join(done, key, "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    cols = [
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        # kept: null where nothing was removed.
        cols += [F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))).otherwise(F.col("spans")).alias("spans")]
    return out.select(*cols)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
