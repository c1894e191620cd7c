"""Benchmark decontamination by latent semantic retrieval.

Every text becomes the 32-bit hashes of its normal words; from these document
frequencies are counted under hashed buckets, over all texts.
Benchmark items are cut into passages, these are dealt to blocks, and every
block's TF-IDF matrix of passages gets a randomised singular value
decomposition on an executor. The rank is the least at which each passage keeps
`ENERGY` of its squared length, so the space is smaller than the block by as
much as its passages have in common. Documents are read in overlapping windows
- for passages of up to 8, 16 and 32 words windows of 12, 24 and 40 - which are
projected; a window whose cosine with a passage, over the share of its length
that the passage keeps in the space, reaches `COSINE` is a candidate. Windows
whose words can't add up to it are passed over first, by a true bound.

Around the candidate windows of an item, stretches of `reach` words are compared
with the whole item by longest common subsequence of words, and the item's
answer - its last sentence - by its own. A pair is a leak if the common
subsequence has LCS of the item, or LCS_ANSWER of it and ANSWER of the answer.
Words are compared by their 32-bit hashes.

The benchmark is a stated query set: its blocks go to the executors `PASS` at a
time, so what is sent is bounded; a pass reads the documents once.

Edge cases: null or empty texts and items have no words and match nothing;
windows of a text shorter than one are the text; very long texts are read whole;
repeated rows give repeated pairs; a null doc_id stays null; items of a null
item_id are left out; an empty table on either side gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, materialize, row_key, table, whole_row

BUCKETS, BLOCK, PASS, OVER = 1 << 16, 512, 8, 16
#: Longest passage, size and stride of the windows it is searched in.
SCALES = ((8, 12, 4), (16, 24, 8), (32, 40, 8))
COSINE, ENERGY = 0.3, 0.5
LCS, LCS_ANSWER, ANSWER = 0.8, 0.6, 0.6
#: Words that are searched at a time; passages that share a bound; windows that are compared at a time.
PART, GROUP, WINDOWS = 50_000, 48, 512
_WIDE = "“”‘’«»¿¡…–—"
#: Stand for those in the bytes that are hashed; control characters are cut from the ends of words as punctuation is.
_CONTROL = "".join(map(chr, [*range(1, 9), *range(14, 17)]))
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "".join(map(chr, [*range(9), *range(14, 28), 127])) + _WIDE
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
KINDS = "doc_id long, item_id long, cosine double, lcs double, answer_lcs double, first_word long, last_word long"


def normal(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGE))]


class Hasher(WordHashes):
    """32-bit hashes of the normal words of texts."""

    def __init__(self):
        super().__init__(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", "".join(c for c in _EDGE if c < "\x80").encode())

    def bytes(self, text: str | None) -> bytes:
        t = (text or "").lower()
        x = t.encode("utf-8", "surrogatepass")
        # The first bytes of what is written with more than one byte and isn't a letter.
        if b"\xc2" in x or b"\xe1" in x or b"\xe2" in x or b"\xe3" in x:
            if _SPACES.search(t):
                t = " ".join(t.split())
            for i, c in enumerate(_WIDE):
                t = t.replace(c, _CONTROL[i])
            return t.encode("utf-8", "surrogatepass")
        return x

    def of(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts) -> list[np.ndarray]:
        """One array for each text."""
        return [np.maximum((h >> np.uint64(32)).astype(np.uint32), 1) for h in super().many([self.bytes(t) for t in texts])]


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with words, and per bucket how many have a word in it. BUCKETS rows go to the driver."""

    def run(batches):
        hasher, sums, n = Hasher(), np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for x in hasher.many(b["text"]):
                # A bucket that words share is raised once: this is assignment, not accumulation.
                sums[x & np.uint32(BUCKETS - 1)] += 1
                n += bool(len(x))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"b": [-1, *at], "n": [n, *sums[at]]})

    rows = docs.select("text").mapInPandas(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r["b"] < 0:
            n = r["n"]
        else:
            df[r["b"]] = r["n"]
    return n, df


def randomised_svd(a: np.ndarray, rank: int, over: int = OVER, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(left vectors times values, right vectors) of the largest `rank` values."""
    rng = np.random.default_rng(7)
    y = a @ rng.standard_normal((a.shape[1], min(rank + over, *a.shape)))
    for _ in range(steps):
        q, _ = np.linalg.qr(y)
        y = a @ (a.T @ q)
    q, _ = np.linalg.qr(y)
    u, s, v = np.linalg.svd(q.T @ a, full_matrices=False)
    k = min(rank, int((s > 1e-9).sum()))
    return (q @ u[:, :k]) * s[:k], v[:k]


def fitting_rank(left: np.ndarray, energy: float = ENERGY) -> int:
    """The least number of dimensions in which every row keeps `energy` of its squared length."""
    share = np.cumsum(left**2, axis=1) / np.maximum((left**2).sum(axis=1, keepdims=True), 1e-12)
    return int((share < energy).sum(axis=1).max(initial=0)) + 1


def passages(n: int) -> list[tuple[int, int]]:
    """(first, end) of the passages of an item of n words: all of it, or halfway overlapping ones of the longest size."""
    size = SCALES[-1][0]
    if n <= size:
        return [(0, n)]
    return [(s, s + size) for s in range(0, n - size, size // 2)] + [(n - size, n)]


def latent_spaces(items: DataFrame, n: int, df: np.ndarray) -> DataFrame:
    """items (item_id, text, block) -> per block its items, words, passages and latent space."""
    idf = np.log((n + 1) / (df + 1)) + 0.1

    def run(g):
        words = Hasher().many(g["text"])
        vocab = np.unique(np.concatenate(words))
        cuts = [(i, s, e) for i, w in enumerate(words) for s, e in passages(len(w)) if e > s]
        a = np.zeros((len(cuts), max(len(vocab), 1)))
        weight = idf[vocab & np.uint32(BUCKETS - 1)]
        for k, (i, s, e) in enumerate(cuts):
            v = np.searchsorted(vocab, words[i][s:e])
            np.add.at(a[k], v, weight[v])
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        left, right = np.zeros((len(cuts), 1)), np.zeros((1, a.shape[1]))
        if len(cuts):
            left, right = randomised_svd(a, len(cuts))
            k = fitting_rank(left)
            left, right = left[:, :k], right[:k]
        return pd.DataFrame([{
            "block": int(g["block"].iloc[0]), "ids": list(g["item_id"]), "texts": list(g["text"]), "words": vocab.astype("<u4").tobytes(),
            "cuts": np.array(cuts, "<i4").tobytes(), "passages": left.astype("<f4").tobytes(), "space": right.astype("<f4").tobytes(), "rank": right.shape[0],
        }])

    kinds = "block long, ids array<long>, texts array<string>, words binary, cuts binary, passages binary, space binary, rank int"
    return items.groupBy("block").applyInPandas(run, kinds)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of a."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def answer(text: str | None) -> str:
    """The last sentence that has words."""
    return next((p for p in reversed(re.split(r"(?<=[.!?])\s+|\n", text or "")) if normal(p)), "")


def least(n: int) -> int:
    """The least common subsequence that can be a leak of an item of n words."""
    return max(1, math.ceil(min(LCS, LCS_ANSWER) * n - 1e-9))


def reach(n: int) -> int:
    """Words of the stretch that is held against an item of n words."""
    return n + max(10, n // 2)


class _Block:
    def __init__(self, row, idf):
        hasher = Hasher()
        self.ids = list(row["ids"])
        self.words = hasher.many(row["texts"])
        self.answers = [x.tolist() for x in hasher.many([answer(t) for t in row["texts"]])]
        self.counts = [Counter(w.tolist()) for w in self.words]
        self.vocab = np.frombuffer(row["words"], "<u4")
        cuts = np.frombuffer(row["cuts"], "<i4").reshape(-1, 3)
        u = np.frombuffer(row["passages"], "<f4").reshape(len(cuts), -1)
        space = np.frombuffer(row["space"], "<f4").reshape(row["rank"], -1).T
        weight = idf[self.vocab & np.uint32(BUCKETS - 1)]
        # The cosine over the share of its length that a passage keeps: (u / |u|) . q / |window| / |u|, where the projection q is
        # a sum over words. So a word's part of it is known beforehand; the last row is of words that the block hasn't.
        u = u / np.maximum((u**2).sum(axis=1, keepdims=True), 1e-9)
        part = np.zeros((len(self.vocab) + 1, len(u)), np.float32)
        if len(self.vocab):
            part[:-1] = (space * weight[:, None]) @ u.T
        size = cuts[:, 2] - cuts[:, 1]
        self.scales, below = [], 0
        for longest, window, stride in SCALES:
            mine = np.flatnonzero((size > below) & (size <= longest))
            below = longest
            if len(mine):
                n = -(-len(mine) // GROUP)
                parts = np.zeros((n, len(part), GROUP), np.float32)
                for i, p in enumerate(mine):
                    parts[i // GROUP, :, i % GROUP] = part[:, p]
                self.scales.append((window, stride, parts, np.maximum(parts.max(axis=2), 0).T.astype(float), cuts[mine]))
        self.flag = np.zeros(len(self.vocab) + 1, bool)

    def numbers(self, code: np.ndarray) -> np.ndarray:
        """Word numbers of the block, the last number for other words."""
        if not len(self.vocab):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, code), len(self.vocab) - 1)
        return np.where(self.vocab[at] == code, at, len(self.vocab))


class _Lookup:
    """Word numbers of a block by a table of the low bits, so that most words are found by one step."""

    BITS = np.uint32((1 << 20) - 1)

    def __init__(self, block: _Block):
        self.block = block
        self.full = np.zeros(int(self.BITS) + 1, bool)
        self.full[block.vocab & self.BITS] = True

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = np.full(len(code), len(self.block.vocab), np.int64)
        some = np.flatnonzero(self.full[code & self.BITS])
        out[some] = self.block.numbers(code[some])
        return out


def _windows(lengths: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, end) of windows over documents that stand one after the other; the last window ends at the end."""
    many = np.where(lengths > 0, np.maximum(-(-(lengths - size) // stride), 0) + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(step * stride, np.maximum(lengths[doc] - size, 0))
    begin = (np.cumsum(lengths) - lengths)[doc]
    return doc, begin + first, begin + np.minimum(first + size, lengths[doc])


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer_lcs, first_word, last_word of the confirmed pairs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n, df = document_frequency(docs)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    cuts = items.select(F.sum(F.ceil(F.greatest(F.size(F.split("text", r"\s+")) / (SCALES[-1][0] // 2) - 1, F.lit(1))))).collect()[0][0] or 0
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(cuts / (BLOCK * 0.75))))).cast("long"))
    spaces = materialize(latent_spaces(items, n, df))
    out = spark.createDataFrame([], KINDS)
    blocks = sorted(r["block"] for r in spaces.select("block").collect())
    for at in range(0, len(blocks), PASS):
        rows = [r.asDict() for r in spaces.where(F.col("block").isin(blocks[at : at + PASS])).collect()]
        out = out.unionByName(docs.mapInPandas(_search(rows, idf, cosine), KINDS))
    return out


def _search(rows, idf, cosine):
    def run(batches):
        blocks = [_Block(r, idf) for r in rows]
        blocks = [(b, _Lookup(b)) for b in blocks if b.scales]
        names = [c.split()[0] for c in KINDS.split(", ")]
        hasher = Hasher()
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), hasher.many(b["text"])
            lengths = np.array([len(x) for x in texts], np.int64)
            ends, at = np.cumsum(lengths), 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + PART, "right")))
                if ends[to - 1] > ends[at] - lengths[at]:
                    if found := [x for k, of in blocks for x in _part(ids[at:to], np.concatenate(texts[at:to]), lengths[at:to], k, of, idf, cosine)]:
                        yield pd.DataFrame(found, columns=names)
                at = to

    return run


def _norms(code: np.ndarray, weight: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Lengths of windows, a row each, where a word that repeats counts with the square of its count."""
    key = np.where(inside, code.astype(np.int64), -1)
    order = np.argsort(key, axis=1)
    key, weight = np.take_along_axis(key, order, 1), np.take_along_axis(np.where(inside, weight, 0.0), order, 1)
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    sums = np.add.reduceat(weight.ravel(), np.flatnonzero(new.ravel()))
    row = np.nonzero(new)[0]
    return np.sqrt(np.maximum(np.bincount(row, sums**2, len(key)), 1e-12))


def _part(ids, code, lengths, k: _Block, of: _Lookup, idf, cosine):
    """The leaks of some documents that stand one after the other."""
    v = of(code)
    weight = idf[code & np.uint32(BUCKETS - 1)].astype(float)
    total = np.concatenate(([0.0], np.cumsum(weight**2)))
    begin = np.cumsum(lengths) - lengths
    # Document, item, and the words between which the item's stretch lies; cosine.
    near: dict[tuple[int, int], list[list]] = {}
    for window, stride, parts, most, cuts in k.scales:
        doc, first, end = _windows(lengths, window, stride)
        norm = np.sqrt(np.maximum(total[end] - total[first], 1e-12))
        add = np.zeros((len(v) + 1, most.shape[1]))
        np.cumsum(most[v], axis=0, out=add[1:])
        # The most that a window's words can add up to with any passage of a group.
        may, group = np.nonzero(add[end] - add[first] >= (cosine * norm - 1e-6)[:, None])
        for at in range(0, len(may), WINDOWS):
            j, g = may[at : at + WINDOWS], group[at : at + WINDOWS]
            at_ = first[j][:, None] + np.arange(window)
            inside, at_ = at_ < end[j][:, None], np.minimum(at_, len(v) - 1)
            words = np.where(inside, v[at_], len(k.vocab))
            cos = parts[g[:, None], words].sum(axis=1) / _norms(code[at_], weight[at_], inside)[:, None]
            for a, p in zip(*np.nonzero(cos >= cosine), strict=True):
                d, (i, s, e) = int(doc[j[a]]), cuts[g[a] * GROUP + p].tolist()
                n = len(k.words[i])
                slack = reach(n) - n
                lo = int(first[j[a]] - begin[d]) - s - slack
                hi = int(end[j[a]] - begin[d]) + n - e + slack
                near.setdefault((d, i), []).append([max(0, lo), min(int(lengths[d]), hi), float(cos[a, p])])
    for (d, i), found in sorted(near.items()):
        item, said, best = k.words[i].tolist(), k.answers[i], None
        text, numbers = code[begin[d] : begin[d] + lengths[d]], v[begin[d] : begin[d] + lengths[d]]
        mine = k.numbers(k.words[i])
        k.flag[mine] = True
        n, runs = len(item), []
        for lo, hi, c in sorted(found):
            if runs and lo <= runs[-1][1]:
                runs[-1][1], runs[-1][2] = max(hi, runs[-1][1]), max(c, runs[-1][2])
            else:
                runs.append([lo, hi, c])
        size = reach(n)
        for lo, hi, c in runs:
            has = np.concatenate(([0], np.cumsum(k.flag[numbers[lo:hi]])))
            step = max(10, size // 4)
            # Pieces overlap by the reach, so every stretch of that length is whole in one.
            for s in range(0, max(1, hi - lo - size), step):
                e = min(s + size + step, hi - lo)
                if has[e] - has[s] < least(n):
                    continue
                part = text[lo + s : lo + e].tolist()
                # No common subsequence is longer than what the two have in common as bags of words.
                if sum(min(n, k.counts[i][w]) for w, n in Counter(x for x in part if x in k.counts[i]).items()) < least(n):
                    continue
                got, hit = lcs(item, part) / n, lcs(said, part) / len(said) if said else 0.0
                if (got >= LCS or got >= LCS_ANSWER and hit >= ANSWER) and (best is None or got > best[3]):
                    best = (ids[d], k.ids[i], c, got, hit, lo + s, lo + e)
        k.flag[mine] = False
        if best:
            yield best


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a leak. Every row is judged by its own text, whatever its doc_id: null, or that of other rows."""
    keyed = docs.select(whole_row(docs).alias("row"), row_key(docs, "doc_id", "text")[0].alias("doc_id"))
    texts = keyed.select("doc_id", "row.text")
    leaks = materialize(find_leaks(texts, table(spark, sf_dir, "benchmark"))).select("doc_id")
    return keyed.join(leaks, "doc_id", "left_anti").select("row.*")


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
