"""Shared helpers: tables, shared intermediate storage, word rules."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs in one process (tests) is a temporary
    folder made; a cluster without a shared folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tradeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only its own tasks. The
    written files also give the planner true sizes, so that a join is
    broadcast only if the table is under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column | str) -> Column:
    """Array of the words of a text; null has none. JVM only."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once per row and not once per use."""
    return F.transform(F.array(value), body)[0]


def row_key(docs: DataFrame, *columns: str) -> list[Column]:
    """Two 64-bit hashes of a row's values in the columns, null unlike any text: rows of equal values share them, whatever their ids."""
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name clashes with another."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


class WordHashes:
    """64-bit hashes of the words of texts, by whole arrays of bytes: no step is taken word by word and nothing is remembered.

    A word is a run of bytes other than `space`, without the bytes of `edge` at
    its ends; one of these alone is no word.
    """

    #: Bytes that are hashed at a time.
    PART = 1 << 16

    def __init__(self, space: bytes = b" \t\n\x0b\x0c\r", edge: bytes = b""):
        self.space = space
        self.kind = bytes(0 if c in space else 1 if c in edge else 2 for c in range(256))
        self.value = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self._grow(self.PART + 1)

    def _grow(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.power, self.inverse = (np.array([1] + [x] * n, np.uint64).cumprod() for x in (base, pow(base, -1, 1 << 64)))

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """One array for each text."""
        out, held, size = [], [], 0
        for x in texts:
            if held and size + len(x) + len(held) > self.PART:
                out += self._block(held)
                held, size = [], 0
            if len(x) >= self.PART:
                # A very long text goes by parts that end at white space.
                out.append(np.concatenate([self._block([p])[0] for p in self._cut(x)]))
                continue
            held.append(x)
            size += len(x)
        return out + (self._block(held) if held else [])

    def _cut(self, text: bytes):
        at = 0
        while len(text) - at >= self.PART:
            to = max(text.rfind(c, at, at + self.PART) for c in (b" ", b"\n"))
            if to < at:
                to = min((x for c in self.space if (x := text.find(c, at + self.PART)) >= 0), default=len(text) - 1)
            yield text[at : to + 1]
            at = to + 1
        yield text[at:]

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b" ".join(texts)
        if len(data) > len(self.power):
            self._grow(len(data))
        kind, data = np.frombuffer(data.translate(self.kind), np.uint8), np.frombuffer(data, np.uint8)
        core = np.flatnonzero(kind == 2)
        if not len(core):
            return [np.empty(0, np.uint64)] * len(texts)
        word = np.cumsum(kind == 0, dtype=np.int32)[core]
        new = np.flatnonzero(word[1:] != word[:-1])
        first, end = core[np.concatenate(([0], new + 1))], core[np.append(new, len(core) - 1)] + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=total[1:])
        h = (total[end] - total[first]) * self.inverse[first]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        ends = np.cumsum([len(x) + 1 for x in texts])
        return np.split(h, np.searchsorted(first, ends[:-1]))
