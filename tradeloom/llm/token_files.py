"""Token files: documents as Parquet list columns that can be read in part.

A data set is two folders. `tokens` has one row a document, in ascending order
of doc_id over files and within them: doc_id, local (ids before it in its file),
n_tokens, ids_crc32 and the ids as a list column. `files` has one row for each
of these files: its number and the count of ids before it, so that `start` is
local plus that count and no file has to know the others when it is written.

Ids are dictionary encoded (a vocabulary of 50,000 takes 16 bits an id); doc_id
and the counts ascend or are small and are delta encoded; row groups and pages
have sizes of their own and each page its entry in the column index. So counts
are read without ids (column pruning), and the ids of a document, or of a range
of documents or of tokens, by the row groups and pages that hold them.

Texts are dealt by ranges of (doc_id, hash of the text, a random number), which
also parts many rows of one id, and each task encodes its range in order: ids
are made once and never shuffled.

Edge cases: a null doc_id sorts first; null or empty text: the end id alone;
very long texts are one row; repeated rows are written each, one after another;
an empty table gives empty folders and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .packing import units

END_ID = 0
#: Bytes of a row group and of a page, rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 128 << 10, 1000
#: Ids that are put into one batch for the writer.
BATCH = 1 << 20
TOKENS = "file int, doc_id long, local long, n_tokens long, ids_crc32 long, ids array<int>"
FILES = "file int, before long, n_documents long, n_tokens long, first_doc long, last_doc long"


def _encode(end_id: int, ranks_path: str | None):
    def run(batches):
        u, end = units(ranks_path), np.array([end_id], "<u4").tobytes()
        file, local = TaskContext.get().partitionId(), 0
        names = [c.split()[0] for c in TOKENS.split(", ")]

        def block(rows: list) -> pa.RecordBatch:
            doc, before, n, crc, ids = zip(*rows, strict=True)
            ends = np.concatenate(([0], np.cumsum(n))).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            numbers = [pa.array(x, pa.int64()) for x in (doc, before, n, crc)]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int32()), *numbers, lists], names)

        rows, size = [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = u.ids(text.as_py() or "") + end
                n = len(ids) // 4
                rows.append((doc, local, n, zlib.crc32(ids), ids))
                local, size = local + n, size + n
                if size >= BATCH:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, ranks_path: str | None = None, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS, files: int | None = None) -> None:
    """(doc_id, text) as token files under path; `files` fixes their number, else they follow the session's shuffle."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("_h"), F.rand(13).alias("_r"))
    keys = ["doc_id", "_h", "_r"]
    dealt = (keyed.repartitionByRange(files, *keys) if files else keyed.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    out = dealt.select("doc_id", "text").mapInArrow(_encode(end_id, ranks_path), TOKENS)
    kind = {
        # Packed ids leave little to compress: zstd made files a seventh smaller for a third more of the writer's and reader's time.
        "compression": "lz4_raw", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows,
        # Documents differ in length a thousandfold: sizes are looked at often.
        "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 1000, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 1000,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
    }
    out.write.options(**{k: str(v) for k, v in kind.items()}).parquet(f"{path}/tokens")
    # One row a file, whatever the number of documents.
    counts = _tokens(spark, path).groupBy("file").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    rows, before = [], 0
    for r in sorted(counts.collect(), key=lambda r: r["file"]):
        rows.append((r["file"], before, r["n_documents"], r["n_tokens"], r["first_doc"], r["last_doc"]))
        before += r["n_tokens"]
    spark.createDataFrame(rows, FILES).coalesce(1).write.parquet(f"{path}/files")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids: columns that are not asked for are not read, and filters on doc_id reach the pages."""
    files = spark.read.schema(FILES).parquet(f"{path}/files").select("file", "before")
    return _tokens(spark, path).join(files, "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_span(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """doc_id, at, ids: the ids at places start to end (not included) of the whole sequence; only files that hold some are opened further than their index."""
    files = spark.read.schema(FILES).parquet(f"{path}/files").where((F.col("before") < end) & (F.col("before") + F.col("n_tokens") > start))
    here = {r["file"]: r["before"] for r in files.collect()}
    if not here:
        return _tokens(spark, path).limit(0).select("doc_id", F.col("local").alias("at"), "ids")
    before = F.create_map(*[F.lit(x) for kv in here.items() for x in kv])[F.col("file")]
    inner = F.lit(False)
    for file, b in here.items():
        inner = inner | ((F.col("file") == file) & (F.col("local") < end - b) & (F.col("local") + F.col("n_tokens") > start - b))
    first = F.greatest(F.lit(start) - before - F.col("local"), F.lit(0))
    after = F.least(F.lit(end) - before - F.col("local"), F.col("n_tokens"))
    got = _tokens(spark, path).where(inner)
    return got.select("doc_id", (before + F.col("local") + first).alias("at"), F.slice("ids", (first + 1).cast("int"), (after - first).cast("int")).alias("ids"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all but doc_id and start computed from the ids as they are read."""

    def run(batches):
        for b in batches:
            ids = b["ids"]
            ends, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(), "<i4")
            n = np.diff(ends).astype("int64")
            crc = [zlib.crc32(flat[a:e]) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(read_tokens(spark, path))


QUERIES = {"op13_token_files": op13_token_files}
ORACLES: dict[str, str] = {}
