"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents are tokenized by a byte-level BPE; an end id closes each. A document
of more than `size` tokens gives whole pieces of `size` and a rest. The
histogram of piece lengths - at most `size` rows, whatever the corpus - goes to
the driver, where lengths are placed longest first, each into the shortest open
pack that has room. What is kept is patterns with counts, not packs: a length's
step makes at most one new pattern and splits at most one. Patterns are joined
back to pieces by rank: the k-th piece of a length takes the k-th place that
patterns have for that length. Ranks come from counts of (length, salt) groups,
so that a length of very many copies is spread over tasks.

Ids are those that the tokenizers library gives for the same vocabulary: units
between white space do not influence each other, so their ids are remembered (a
bounded number of them); a unit not yet seen is encoded by tiktoken's ranks of
that vocabulary. A text is first split at the added tokens of the vocabulary's
JSON (<|endoftext|>), whose ids stand as they are, as in the library.

Edge cases: null or empty text: the end id alone; very long texts: several
pieces; repeated rows are packed each; an empty table: no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

SIZE, END_ID = 2048, 1
#: Units whose ids a Python worker remembers, and their longest length.
MEMORY, MEMORY_CHARS = 200_000, 24
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Units(dict):
    """Unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = _added(os.path.splitext(ranks_path)[0] + ".json")
        # Longest first, as the library takes the longest that begins at a place.
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.encode = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode(unit)).tobytes()
        if len(unit) <= MEMORY_CHARS and len(self) < MEMORY:
            self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        parts = self.split(text) if self.split else [text]
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, _UNIT.findall(text)))
        return b"".join(self.added[x] if k % 2 else b"".join(map(self.__getitem__, _UNIT.findall(x))) for k, x in enumerate(parts))


def _added(path: str) -> dict[str, bytes]:
    """Added tokens of a vocabulary's JSON and their ids; none where it has no JSON."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    # That list alone: the vocabulary is many times as large.
    at = re.search(r'"added_tokens"\s*:\s*(?=\[)', text)
    found = json.JSONDecoder().raw_decode(text, at.end())[0] if at else []
    if odd := [x["content"] for x in found if x["single_word"] or x["lstrip"] or x["rstrip"]]:
        raise ValueError(f"{path}: added tokens that take or need what stands beside them: {odd}")
    return {x["content"]: np.array([x["id"]], dtype="<u4").tobytes() for x in found}


_units: dict[str, Units] = {}


def units(ranks_path: str | None = None) -> Units:
    """One per Python worker and vocabulary."""
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if ranks_path not in _units:
        _units[ranks_path] = Units(ranks_path)
    return _units[ranks_path]


def tokenize(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> one row per piece, with the ids where asked for."""

    def run(batches):
        u, end = units(ranks_path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = u.ids(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    row = (doc, at, len(part) // 4, zlib.crc32(part), n)
                    rows.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (PIECES + ", ids" * with_ids).split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES + ", ids array<int>" * with_ids)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Length -> count; patterns (count, lengths in order), each summing to `size` at most."""
    room: list[list[tuple[int, list[int]]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], size
        while left:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                room[size - length].append((left, [length]))
                break
            n, have = room[space].pop()
            m = min(n, left)
            if n > m:
                room[space].append((n - m, have))
            room[space - length].append((m, [*have, length]))
            left -= m
    return [p for r in room for p in r]


def _places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Per length: (first rank, rank after the last, sequence of the first, offset)."""
    places: dict[int, list] = {}
    base = 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            mine = places.setdefault(length, [])
            first = mine[-1][1] if mine else 0
            mine.append((first, first + n, base, offset))
            offset += length
        base += n
    return sorted(places.items())


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces, as a stored table, with sequence_id and offset added."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = spark.createDataFrame(_places(shortest_pack_first(histogram, size)), "length long, places array<struct<first:long,after:long,base:long,offset:long>>")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("k", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start")))
    ranked = ranked.join(counts, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k") - 1)
    # One row per length, `size` at most.
    out = ranked.join(F.broadcast(places), "length")
    out = out.withColumn("p", F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["after"]))[0])
    return out.select(*pieces.columns, (F.col("p.base") + F.col("rank") - F.col("p.first")).alias("sequence_id"), F.col("p.offset").alias("offset"))


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(materialize(tokenize(docs, size, end_id, ranks_path, with_ids)), size)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: one row per piece."""
    return pack_documents(docs)


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
