"""Periodic runs in the words of texts, by the algorithm of Kolpakov and Kucherov.

A run is a longest stretch of words in which words `period` apart are equal and
that holds the smallest such period at least `MIN_EXPONENT` times. For a stretch:

1. its suffix automaton, in which every state knows where it first ends, gives
   the factors of Lempel and Ziv: the longest prefix of the rest that begins
   before it as well (an overlap is allowed), or one new word;
2. Main's algorithm finds the runs that cross or touch the beginning of a
   factor, from longest common extensions to both sides. The factor before would
   have been longer if a run reached back over it by a period, so that only
   periods below a third of the two factors' lengths can occur, and the runs
   begin within twice the factor before plus this one;
3. runs strictly inside a factor are copied from the factor's earlier
   occurrence, from left to right, as a factor may overlap its source.

Only some stretches of a text can hold runs: each three words in succession of
a run occur three times in it, and so they do within the stretch of such words
around it. Stretches are cut down by that count until nothing changes; no run is
lost, as every run lies in one stretch at every step. Work and memory are linear
in the words of a text, which is the unit of work.

Edge cases: null or empty text: no words, no runs; an empty table: no rows;
repeated rows and ids: each row gets its own result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words

MIN_EXPONENT, MIN_LENGTH = 4, 6
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


class _Codes(dict):
    """Word -> number in order of first occurrence."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of parts outside of which no word is in a run of exponent 4 or more."""
    out, todo = [], [(0, codes)]
    while todo:
        at, c = todo.pop()
        n = len(c)
        if n < MIN_LENGTH:
            continue
        k = int(c.max()) + 1
        if k < 1 << 20:
            three = (c[:-2] * k + c[1:-1]) * k + c[2:]
        else:
            pair = np.unique(c[:-1] * k + c[1:], return_inverse=True)[1]
            three = pair[:-1] * k + c[2:]
        if k == 1:
            out.append((at, at + n))
            continue
        _, which, count = np.unique(three, return_inverse=True, return_counts=True)
        good = np.concatenate(([False], count[which] >= 3, [False]))
        edge = np.flatnonzero(good[1:] != good[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            b += 2
            if b - a < MIN_LENGTH:
                continue
            if b - a == n:
                out.append((at, at + n))
            else:
                todo.append((at + a, c[a:b]))
    return sorted(out)


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, source) of the Lempel-Ziv factors; source is -1 for a new word."""
    nxt, link, length, ends = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out, b, n = [], 0, len(w)
    while b < n:
        state, i = 0, b
        while i < n:
            to = nxt[state][w[i]]
            if ends[to] >= i:
                break
            state, i = to, i + 1
        out.append((b, i, ends[state] - (i - b) + 1) if i > b else (b, b + 1, -1))
        b = out[-1][1]
    return out


def _extensions(pattern: list[int], text: list[int], n: int) -> list[int]:
    """For i < n: words that text[i:] and pattern have in common from their beginnings; by Z values, in linear time."""
    m = len(pattern)
    z = [0] * m
    if m:
        z[0] = m
    a = b = 0
    for i in range(1, min(m, n + 1)):
        k = min(z[i - a], b - i) if i < b else 0
        if i + k >= b:
            while i + k < m and pattern[k] == pattern[i + k]:
                k += 1
            a, b = i, i + k
        z[i] = k
    out = [0] * n
    a = b = 0
    for i in range(n):
        k = min(z[i - a], b - i) if i < b and i - a < min(m, n + 1) else 0
        if i + k >= b:
            while k < m and i + k < len(text) and pattern[k] == text[i + k]:
                k += 1
            a, b = i, i + k
        out[i] = k
    return out


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and period."""
    n, found = len(w), {}
    starts: list[tuple[int, int, int]] = []
    parts = factors(w)
    for k, (b, e, source) in enumerate([*parts, (n, n, -1)]):
        before = b - parts[k - 1][0] if k else 0
        top = (before + e - b - 1) // (MIN_EXPONENT - 1)
        if k and top:
            low = max(b - 2 * before - (e - b), 0)
            high = min(e + 1, n)
            left, right = w[low:b][::-1], w[b:high]
            # Four tables of extensions by period: of the words before b and from b on, each against its copy one period away.
            q_right, q_left = min(top, len(right)), min(top, len(left))
            ahead = _extensions(right, right[1:], q_right)
            behind = _extensions(left, right[:q_right][::-1] + left, q_right)
            back = _extensions(left, left[1:], q_left)
            forth = _extensions(right, left[:q_left][::-1] + right, q_left)
            for q in range(1, max(q_right, q_left) + 1):
                if q <= q_right:
                    _keep(found, starts, b - behind[q_right - q], b + q + ahead[q - 1], q, low, b, e, n)
                if q <= q_left:
                    _keep(found, starts, b - q - back[q - 1], b + forth[q_left - q], q, low, b, e, n)
        if source >= 0:
            shift = b - source
            at = bisect.bisect_right(starts, (source, n, n))
            while at < len(starts) and starts[at][0] < e - shift:
                s, t, q = starts[at]
                if t < e - shift:
                    found[s + shift, t + shift] = q
                    starts.append((s + shift, t + shift, q))
                at += 1
    return sorted((s, t, q) for (s, t), q in found.items())


def _keep(found: dict, starts: list, s: int, t: int, q: int, low: int, b: int, e: int, n: int) -> None:
    """Keep [s, t) of period q if it is a run that is found from this factor: it ends in it and begins within the window."""
    if t - s < max(MIN_LENGTH, MIN_EXPONENT * q) or t > e or (s == low and low > 0) or (s, t) in found:
        return
    found[s, t] = q
    bisect.insort(starts, (s, t, q))


def _text(text: str | None) -> tuple[list[tuple[int, int, int]], bytes]:
    """(start, length, period) of the runs by start and period, and the text without their repeats."""
    w = (text or "").encode().split()
    code = _Codes()
    c = np.fromiter(map(code.__getitem__, w), np.int64, len(w))
    every = []
    for a, b in stretches(c):
        every += [(a + s, t - s, q) for s, t, q in runs(c[a:b].tolist())]
    if not every:
        return every, b" ".join(w)
    keep = np.ones(len(w), bool)
    for s, m, q in every:
        keep[s + q : s + m] = False
    return every, b" ".join([w[i] for i in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame, with_runs: bool = False) -> DataFrame:
    """(doc_id, text) -> per row the number of runs, the one of greatest exponent, digests of all runs and of the text without repeats; all runs where asked for."""

    def run(batches):
        names = [c.split()[0] for c in OUT.split(", ")][: 9 if with_runs else 8]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                every, collapsed = _text(text)
                best = (None, None, None)
                for s, m, q in every:
                    # Ordered by start and period, so that the first of equals stays.
                    if best[0] is None or m * best[2] > best[1] * q:
                        best = (s, m, q)
                listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in every).encode()).hexdigest()
                row = (None if doc is None else int(doc), len(every), *best, None if best[0] is None else 1000 * best[1] // best[2], listed, hashlib.sha256(collapsed).hexdigest())
                rows.append((*row, [{"start": s, "length": m, "period": q} for s, m, q in every]) if with_runs else row)
            out = pd.DataFrame(rows, columns=names)
            for c in ("doc_id", "start", "length", "period", "exponent_milli"):
                out[c] = pd.array(out[c].tolist(), "Int64") if len(out) else out[c].astype("Int64")
            yield out

    schema = OUT if with_runs else OUT.rsplit(", runs ", 1)[0]
    # Ids travel as text: a null among them would turn numbers of a batch into floating ones.
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)


def plant(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, by the hash h of doc_id, repeat a stretch from a word on to the end.

    From word a on, word i is the original word a + (i - a) % p. A null doc_id
    has no hash and its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def turned(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    text = F.when((h % 10 == 0) & (F.size(words("text")) > 0), let(words("text"), turned)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(plant(table(spark, sf_dir, "documents")))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
