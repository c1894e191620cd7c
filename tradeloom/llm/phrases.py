"""Phrase collocations: counts by minimal perfect hash over candidates, level by level.

Words of a language are numbered by the slot of a minimal perfect hash, phrases
of k words by the slot of their own. A phrase of k words can only be frequent if
both its parts of k - 1 words are, so a window's key is (slot of the first k - 1
words, slot of the last word): exact, whatever the words. For each k

1. mappers count the hashed keys of windows whose parts are both frequent by
   buckets, at least one for every eight words of the corpus; a window in a bucket
   below the least count is no candidate. Both tests only ever pass over phrases
   that cannot be frequent;
2. the keys that are left, as arrays merged in a tree of tasks by ranges of
   buckets, are the candidates. Blocks of them get a
   minimal perfect hash (bit arrays by level, each with the keys that no other
   key meets there) that stores the key of each slot; a window has a slot only if
   its key is the one stored there;
3. mappers bincount slots in numpy arrays, which are summed in a tree of tasks by
   ranges of slots. Windows keep the slot of their phrase for the next level.

A candidate carries the slots of its first and its last k - 1 words, so that the
counts of all its cuts are read along two chains of slots.

Bounds: a block has BLOCK candidates and is broadcast; more candidates are more
rounds over the windows, not a larger broadcast. A task holds the counts of its
own buckets only. Marks of frequent slots and buckets are one bit each, of 2^32
slots and 2^30 buckets (128 MB) at most; with fewer buckets than an eighth of the
words more candidates pass, and none is lost. Words are told apart by a 64-bit hash of language and word
that is checked to have no two words in common; another seed is taken if it has.

Edge cases: null text: no words; null lang: `und`; empty texts and an empty
table: no rows; repeated rows count again; extra columns are ignored; very long
texts are a row of windows each.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

MIN_COUNT, LONGEST, TOP, NO_LANG = 100, 5, 2000, "und"
#: Candidates of a perfect hash; the most buckets; slots of a range that one task sums; arrays that are summed at a time.
BLOCK, BUCKETS, RANGE, FAN = 1 << 22, 1 << 30, 1 << 16, 64
#: Words of a row of windows, at least (a batch of Spark's has 10,000 rows), texts and rows that are worked on at a time, numbers
#: that are counted at a time, and words of a language that a task remembers.
ROW_WORDS, DOCS, ROWS, COUNT_AT, REMEMBERED = 512, 500, 128, 1 << 20, 1 << 16
NONE = np.uint32(0xFFFFFFFF)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in _BREAKS else 32 if c == 9 else c for c in range(256))
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys -> slots 0 to n - 1; other keys have none, as every slot stores its key."""

    def __init__(self, keys: np.ndarray):
        self.levels, base, left = [], 0, keys
        self.keys = np.empty(len(keys), np.uint64)
        while len(left):
            size = len(left) * 3 // 2 + 1
            at = (_mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            slot = np.where(alone, np.cumsum(alone) - 1 + base, -1).astype(np.int32)
            mine = alone[at]
            self.keys[slot[at[mine]]] = left[mine]
            base += int(mine.sum())
            self.levels.append(slot)
            left = left[~mine]

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for one that is not here."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, slot in enumerate(self.levels):
            if not len(left):
                break
            some = keys[left]
            at = slot[(_mix(some, k) % np.uint64(len(slot))).astype(np.int64)]
            here = np.flatnonzero(at >= 0)
            same = here[self.keys[at[here]] == some[here]]
            out[left[same]] = at[same]
            left = left[at < 0]
        return out


class _Vocabulary(dict):
    """Word -> number, and its hash."""

    def __init__(self, lang: str, seed: int):
        self.head = hashlib.blake2b(f"{len(lang)}:{lang}".encode(), digest_size=8, salt=seed.to_bytes(4, "little"))
        self.hashes = array("Q", [0])
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        h = self.head.copy()
        h.update(word)
        self.hashes.append(int.from_bytes(h.digest(), "little") or 1)
        n = self[word] = len(self)
        return n

    def codes(self, text: bytes) -> np.ndarray:
        """Numbers of the words in order, 0 between pieces."""
        said = text.translate(_PLAIN).replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, said), np.int64, len(said))


def _batch(kind: str, **columns) -> pa.RecordBatch:
    """A batch of the columns of `kind` (as Spark writes schemas); those that are not given are null."""
    types = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    n = max(len(c) for c in columns.values())
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(n, types[t]) if f not in columns else c if isinstance(c := columns[f], pa.Array) else pa.array(c, types[t]) for f, t in fields], [f for f, _ in fields])


def _pieces(batches, rows: int):
    """Some rows of a batch at a time: what is made of all of a batch's at once would be several times as large."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all rows of a binary column, one after the other as they lie, and where each begins and ends."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data or b"")[ends[0] : ends[-1]], ends - ends[0]


def _words_and_phrases(b: pa.RecordBatch) -> tuple[memoryview, memoryview]:
    """The two columns of rows of windows; before there are phrases these are the words."""
    w = _bytes(b["w"])[0]
    return w, w if b["p"].null_count == len(b["p"]) else _bytes(b["p"])[0]


_READ = "windows binary, lang string, word string, hash long, n long"


def _read(seed: int):
    """Rows of windows (word hashes, 0 between pieces) and rows of words (lang, word, hash, count) of this task."""

    def words(lang: str, v: _Vocabulary, counts: np.ndarray):
        said, hashes = list(v)[1:], np.array(v.hashes).view(np.int64)[1:]
        for a in range(0, len(said), 1 << 14):
            part = [w.decode() for w in said[a : a + (1 << 14)]]
            yield _batch(_READ, lang=[lang] * len(part), word=part, hash=hashes[a : a + (1 << 14)], n=counts[1 + a : 1 + a + len(part)])

    def run(batches):
        known: dict[str, _Vocabulary] = {}
        counts: dict[str, np.ndarray] = {}
        for b in _pieces(batches, DOCS):
            rows, by = [], {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                if text:
                    by.setdefault(NO_LANG if lang is None else lang, []).append(text.encode())
            for lang, texts in by.items():
                v = known.setdefault(lang, _Vocabulary(lang, seed))
                held, size, codes = [], 0, []
                for i, t in enumerate(texts):
                    held.append(t)
                    size += len(t)
                    if size >= 6 * ROW_WORDS or i == len(texts) - 1:
                        # A row ends with the end of a piece, so that rows can be joined.
                        codes.append(v.codes(b".".join([*held, b""])))
                        rows.append(np.frombuffer(v.hashes, np.uint64)[codes[-1]].tobytes())
                        held, size = [], 0
                n = np.bincount(np.concatenate(codes), minlength=len(v))
                if lang in counts:
                    n[: len(counts[lang])] += counts[lang]
                counts[lang] = n
                if len(v) > REMEMBERED:
                    yield from words(lang, known.pop(lang), counts.pop(lang))
            if rows:
                yield _batch(_READ, windows=rows)
        for lang, v in known.items():
            yield from words(lang, v, counts[lang])

    return run


_SPARSE = "part long, mapper long, place binary, n binary"


def _sparse(kind: str, numbers: np.ndarray, counts: np.ndarray):
    """Ascending numbers and their counts as a row for each range of numbers."""
    if len(numbers):
        part, at = np.unique(numbers // RANGE, return_index=True)
        places, n = np.split((numbers % RANGE).astype(np.uint16), at[1:]), np.split(counts.astype(np.int64), at[1:])
        yield _batch(kind, part=part, mapper=[TaskContext.get().partitionId()] * len(part), place=[x.tobytes() for x in places], n=[x.tobytes() for x in n])


class _Counts:
    """Counts of numbers below `size`."""

    def __init__(self, size: int, first: int = 0):
        self.size, self.first = size, first
        self.total, self.held, self.waiting = np.zeros(size, np.int64), [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.held.append(numbers)
        self.waiting += len(numbers)
        if self.waiting >= COUNT_AT:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=self.size)
        self.held, self.waiting = [], 0

    def batches(self, kind: str):
        self._flush()
        some = np.flatnonzero(self.total)
        yield from _sparse(kind, some + self.first, self.total[some])


def _tree(rows: DataFrame, mappers: int, merge) -> DataFrame:
    """One row for each range of numbers: FAN arrays of a range are merged in a task, then FAN of what that gives."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        a, b = merge(group.iloc[:, 2], group.iloc[:, 3])
        return pd.DataFrame([(group["part"].iloc[0], group["mapper"].iloc[0] // FAN, a, b)], columns=list(group.columns))

    kind = ", ".join(" ".join(x) for x in (("part", "long"), ("mapper", "long"), *((c, "binary") for c in rows.columns[2:])))
    while True:
        rows = rows.groupBy("part", F.floor(F.col("mapper") / FAN).alias("of")).applyInPandas(lambda _, group: one(group), kind)
        mappers = -(-mappers // FAN)
        if mappers <= 1:
            return rows


def _tree_sum(sparse: DataFrame, mappers: int) -> DataFrame:
    """The counts of all mappers, by range."""

    def total(places, counts) -> tuple[bytes, bytes]:
        out = np.zeros(RANGE, np.int64)
        for place, n in zip(places, counts, strict=True):
            out[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.int64)
        some = np.flatnonzero(out)
        return some.astype(np.uint16).tobytes(), out[some].tobytes()

    return _tree(sparse, mappers, total)


def _tree_union(keys: DataFrame, mappers: int) -> DataFrame:
    """The keys of all mappers, each once, by range, as rows (key, suffix)."""

    def union(arrays, suffixes) -> tuple[bytes, bytes]:
        every, first = np.unique(np.frombuffer(b"".join(arrays), np.uint64), return_index=True)
        return every.tobytes(), np.frombuffer(b"".join(suffixes), np.uint32)[first].tobytes()

    def rows(batches):
        for b in _pieces(batches, ROWS):
            key, suffix = (np.frombuffer(_bytes(b[c])[0], kind) for c, kind in (("keys", np.int64), ("suffixes", np.uint32)))
            for a in range(0, len(key), 1 << 16):
                yield _batch("key long, suffix long", key=key[a : a + (1 << 16)], suffix=suffix[a : a + (1 << 16)].astype(np.int64))

    return _tree(keys, mappers, union).mapInArrow(rows, "key long, suffix long")


def _marks(sums: DataFrame, size: int, least: int) -> np.ndarray:
    """One bool a number: its count is `least` or more. Bits of ranges come to the driver, `size` / 8 bytes."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "bits": [np.packbits(np.bincount(np.frombuffer(p, np.uint16)[np.frombuffer(n, np.int64) >= least], minlength=RANGE).astype(bool)).tobytes() for p, n in zip(b["place"], b["n"], strict=True)]})

    out = np.zeros(-(-size // RANGE) * RANGE // 8, np.uint8)
    for part, bits in sums.mapInPandas(run, "part long, bits binary").toLocalIterator():
        out[part * RANGE // 8 : (part + 1) * RANGE // 8] = np.frombuffer(bits, np.uint8)
    return out


def _bit(marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (marks[numbers >> 3] >> (7 - (numbers & 7)).astype(np.uint8)) & 1 == 1


def _windows(words, phrases, marks: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of windows of k words whose two parts are frequent, their keys, the slots of their last parts, and the number of places.

    words: slot of each word; phrases: slot of the phrase of k - 1 words that
    begins at each place.
    """
    w, p = np.frombuffer(words, np.uint32), np.frombuffer(phrases, np.uint32)
    some = p != NONE
    if marks is not None:
        at = np.flatnonzero(some)
        some[at] = _bit(marks, p[at].astype(np.int64))
    both = np.flatnonzero(some[:-1] & some[1:])
    keys = (p[both].astype(np.uint64) << _32) | w[both + k - 1].astype(np.uint64)
    return both, keys, p[both + 1], len(p)


_KEYS = "part long, mapper long, keys binary, suffixes binary"


def _distinct(size: int, heavy, marks, k: int):
    """Keys, each once, with the slot of their last part, of this task's windows that may be frequent: an array for each range of buckets."""

    def out(held: list, suffix: list):
        keys, first = np.unique(np.concatenate(held), return_index=True)
        last = np.concatenate(suffix)[first]
        part = (_bucket(keys, size) // RANGE).astype(np.int64)
        order = np.argsort(part, kind="stable")
        parts, at = np.unique(part[order], return_index=True)
        mine, ends = np.split(keys[order], at[1:]), np.split(last[order], at[1:])
        yield _batch(_KEYS, part=parts, mapper=[TaskContext.get().partitionId()] * len(parts), keys=[x.tobytes() for x in mine], suffixes=[x.tobytes() for x in ends])

    def run(batches):
        held, suffix, waiting = [], [], 0
        for b in _pieces(batches, ROWS):
            _, keys, last, _ = _windows(*_words_and_phrases(b), marks.value, k)
            good = _bit(heavy.value, _bucket(keys, size))
            held.append(keys[good])
            suffix.append(last[good])
            waiting += len(held[-1])
            if waiting > COUNT_AT:
                yield from out(held, suffix)
                held, suffix, waiting = [], [], 0
        if waiting:
            yield from out(held, suffix)

    return run


def _bucket(keys: np.ndarray, size: int) -> np.ndarray:
    return (_mix(keys, 97) & np.uint64(size - 1)).astype(np.int64)


def _buckets(size: int, marks, k: int):
    """This task's counts of the hashed keys of windows whose parts are frequent."""

    def run(batches):
        held, waiting = [], 0
        for b in _pieces(batches, ROWS):
            _, keys, _, _ = _windows(*_words_and_phrases(b), marks.value, k)
            held.append(_bucket(keys, size))
            waiting += len(keys)
            if waiting >= COUNT_AT:
                yield from _sparse(_SPARSE, *np.unique(np.concatenate(held), return_counts=True))
                held, waiting = [], 0
        if waiting:
            yield from _sparse(_SPARSE, *np.unique(np.concatenate(held), return_counts=True))

    return run


_COUNTED = "w binary, p binary, q binary, " + _SPARSE


def _count(block, first: int, marks, k: int, last: bool):
    """Rows of windows with the slots of this block's phrases, and this task's counts of them.

    After the last block the shorter phrases are not needed any longer, nor are
    rows that have no phrase: without one there is none to come.
    """

    def run(batches):
        counts = _Counts(len(block.value), first)
        for b in _pieces(batches, ROWS):
            ends = _bytes(b["w"])[1]
            at, keys, _, n = _windows(*_words_and_phrases(b), marks.value, k)
            slot = block.value.slots(keys)
            here = np.flatnonzero(slot >= 0)
            counts.add(slot[here])
            own = np.full(n, NONE)
            own[at[here]] = slot[here] + first
            ends = (ends // 4).tolist()
            done = []
            for a, e, q in zip(ends[:-1], ends[1:], b["q"].to_pylist(), strict=True):
                mine = own[a:e]
                if q:
                    mine = np.minimum(mine, np.frombuffer(q, np.uint32))
                done.append(mine.tobytes() if len(mine) and mine.min() != NONE else b"")
            out = _batch(_COUNTED, w=b["w"], q=done) if last else _batch(_COUNTED, w=b["w"], p=b["p"], q=done)
            yield out.filter(pa.array([x != b"" for x in done])) if last else out
        yield from counts.batches(_COUNTED)

    return run


def _number(block, first: int):
    """Word hashes of windows -> slots of the words that this block has."""
    kind = "windows binary, w binary"

    def run(batches):
        for b in _pieces(batches, ROWS):
            h, ends = _bytes(b["windows"])
            slot = block.value.slots(np.frombuffer(h, np.uint64))
            own, ends = np.where(slot >= 0, slot + first, int(NONE)).astype(np.uint32), (ends // 8).tolist()
            parts = [own[a:e] if w is None else np.minimum(own[a:e], np.frombuffer(w, np.uint32)) for a, e, w in zip(ends[:-1], ends[1:], b["w"].to_pylist(), strict=True)]
            yield _batch(kind, windows=b["windows"], w=[x.tobytes() for x in parts])

    return run, kind


def _slotted(block, first: int):
    """The frequent words that this block has, with their slots."""

    def run(batches):
        for b in batches:
            slot = block.value.slots(b["key"].to_numpy(np.int64).view(np.uint64))
            out = pd.DataFrame({"slot": slot + first, "lang": b["lang"], "phrase": b["word"], "n": b["n"]})
            yield out[slot >= 0]

    return run


def _blocks(candidates: DataFrame, columns: list[str], block: int):
    """Blocks of `block` candidates about, each as arrays: (first slot, whether it is the last, perfect hash, slots and other columns of its candidates)."""
    spark, n = candidates.sparkSession, candidates.count()
    if n >= int(NONE):
        raise ValueError(f"{n} candidates are more than slots can number")
    parts = max(1, -(-n * 9 // (8 * block))) if n > block else 1
    # Ranges of slots of two blocks do not meet, so that sums are of one block.
    first = 0
    for k in range(parts):
        mine = candidates if parts == 1 else candidates.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        # BLOCK rows at most, by the number of parts.
        got = mine.select("key", *columns).toPandas()
        keys = got["key"].to_numpy(np.int64).view(np.uint64)
        hashed = PerfectHash(keys)
        slot = hashed.slots(keys)
        yield first, k == parts - 1, hashed, slot, got
        first += -(-len(keys) // RANGE) * RANGE


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """(lang, text) -> per language its `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    levels, totals = count_phrases(docs, least, longest, block, buckets)
    return rank(levels, totals, top)


def _words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows and words of the texts, by a hash that no two words share."""
    for seed in range(16):
        read = materialize(docs.select("lang", "text").mapInArrow(_read(seed), _READ))
        words = materialize(read.where("windows is null").groupBy("hash").agg(F.min("lang").alias("lang"), F.max("lang").alias("_l"), F.min("word").alias("word"), F.max("word").alias("_w"), F.sum("n").alias("n")))
        if words.where("lang <> _l or word <> _w").isEmpty():
            return read, words.drop("_l", "_w")
    raise ValueError("no seed parts all words")


def count_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, block: int = BLOCK, buckets: int = BUCKETS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of words and of the frequent phrases of 2, 3 ... words, and the words of each language.

    A phrase: slot, lang, phrase, n, heads (counts of its first 1, 2 ... words)
    and tails (counts of its last 1, 2 ... words), first and last (slots of its
    parts, one word shorter).
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    read, words = _words(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    every = words.agg(F.sum("n")).collect()[0][0] or 0
    size = min(buckets, max(RANGE, 1 << int(every // 4).bit_length()))
    often = words.where(F.col("n") >= least).withColumnRenamed("hash", "key")
    rows = read.where("windows is not null").select("windows", F.lit(None).cast("binary").alias("w"))
    word = None
    for first, _, hashed, _, _ in _blocks(often, [], block):
        shared = sc.broadcast(hashed)
        rows = rows.mapInArrow(*_number(shared, first))
        mine = often.mapInPandas(_slotted(shared, first), "slot long, lang string, phrase string, n long")
        word = mine if word is None else word.unionByName(mine)
    word = materialize(word)
    none = F.array().cast("array<long>")
    levels = [word.select("slot", "lang", "phrase", "n", none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))]
    if word.isEmpty():
        return levels, totals
    rows = materialize(rows.select("w", F.lit(None).cast("binary").alias("p")))
    marks = sc.broadcast(None)
    for k in range(2, longest + 1):
        mappers = rows.rdd.getNumPartitions()
        heavy = sc.broadcast(_marks(_tree_sum(rows.mapInArrow(_buckets(size, marks, k), _SPARSE), mappers), size, least))
        candidates = materialize(_tree_union(rows.mapInArrow(_distinct(size, heavy, marks, k), _KEYS), mappers))
        counted, slots, tables = rows.withColumn("q", F.lit(None).cast("binary")), 0, []
        sums = []
        for first, last, hashed, slot, got in _blocks(candidates, ["suffix"], block):
            if not len(hashed) and last and not tables:
                break
            suffix = np.empty(len(hashed), np.int64)
            suffix[slot] = got["suffix"].to_numpy()
            shared = sc.broadcast(hashed)
            done = materialize(counted.mapInArrow(_count(shared, first, marks, k, last), _COUNTED))
            counted = done.where("w is not null").select("w", "p", "q")
            total = materialize(_tree_sum(done.where("w is null").select("part", "mapper", "place", "n"), mappers))
            sums.append(total)
            tables.append(_phrases(total, shared, sc.broadcast(suffix), first, least))
            slots = first + len(hashed)
            mappers = max(counted.rdd.getNumPartitions(), 1)
        if not tables:
            break
        total, found = sums[0], tables[0]
        for x, y in zip(sums[1:], tables[1:], strict=True):
            total, found = total.unionByName(x), found.unionByName(y)
        levels.append(materialize(_chain(found, levels[-1], levels[0])))
        marks = sc.broadcast(_marks(total, slots, least))
        rows = counted.select("w", F.col("q").alias("p"))
    return levels, totals


def _phrases(total: DataFrame, hashed, suffix, first: int, least: int) -> DataFrame:
    """Frequent slots of a block: slot, first, word, last, n."""

    def run(batches):
        for b in batches:
            for part, place, n in zip(b["part"], b["place"], b["n"], strict=True):
                at, n = np.frombuffer(place, np.uint16).astype(np.int64) + part * RANGE, np.frombuffer(n, np.int64)
                at, n = at[n >= least], n[n >= least]
                key = hashed.value.keys[at - first]
                yield pd.DataFrame({"slot": at, "first": (key >> _32).astype(np.int64), "word": (key & _LOW).astype(np.int64), "last": suffix.value[at - first], "n": n})

    return total.mapInPandas(run, "slot long, first long, word long, last long, n long")


def _chain(found: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Texts and the counts of all first and last parts, read from the two parts one word shorter."""
    head = shorter.select(F.col("slot").alias("first"), "lang", F.col("phrase").alias("_p"), F.concat("heads", F.array("n")).alias("heads"))
    tail = shorter.select(F.col("slot").alias("last"), F.concat("tails", F.array("n")).alias("tails"))
    word = words.select(F.col("slot").alias("word"), F.col("phrase").alias("_w"))
    out = found.join(head, "first").join(tail, "last").join(word, "word")
    return out.select("slot", "lang", F.concat_ws(" ", "_p", "_w").alias("phrase"), "n", "heads", "tails", "first", "last")


def rank(levels: list[DataFrame], totals: DataFrame, top: int = TOP) -> DataFrame:
    """Scores of the weakest cuts, without phrases that a longer one holds as often, the best of each language."""
    kept = []
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            # A longer phrase as frequent has one of one word more in between that is.
            longer = levels[k]
            size = lambda c: F.element_at(c, -1)
            same = longer.where(F.col("n") == size("heads")).select(F.col("first").alias("slot")).unionByName(longer.where(F.col("n") == size("tails")).select(F.col("last").alias("slot")))
            level = level.join(same.distinct(), "slot", "left_anti")
        kept.append(level.select("lang", "phrase", "n", "heads", "tails"))
    kind = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not kept:
        return totals.sparkSession.createDataFrame([], kind)
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    wide = lambda c: c.cast("decimal(16,0)")
    # Cut after k words: heads[k - 1] is the first part; tails has the last parts by length, so the rest is the k-th from its end.
    cuts = F.zip_with("heads", F.reverse("tails"), lambda l, r: F.struct(wide(l).alias("l"), wide(r).alias("r")))
    one = out.join(totals, "lang").select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), F.posexplode(cuts).alias("k", "c"))
    one = one.select("lang", "phrase", "a", "n", "k", F.col("c.l").alias("l"), F.col("c.r").alias("r"))
    one = one.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (l * r)"))
    worst = one.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("c"))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = worst.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    ranked = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLES: dict[str, str] = {}
