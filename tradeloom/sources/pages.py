"""Documents on disk: page text from PDF bytes through a plug-in, and side-car tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .files import read_files

PAGES = "run_id long, source_file string, page int, method string, text_chars int, text string, note string"


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, source_file, content) of the PDF files of a folder: those at its top are run 0, those under a number that run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return _placed(files, folder).select("run_id", "source_file", "content")


def _placed(files: DataFrame, folder: str) -> DataFrame:
    """Files with run_id and source_file; those that lie deeper, or under no number, are left out."""
    top = F.lit(folder.rstrip("/").rpartition("/")[2])
    parts = F.split("path", "/")
    out = files.withColumn("source_file", F.element_at(parts, -1)).withColumn("_up", F.element_at(parts, -2)).withColumn("_upper", F.element_at(parts, -3))
    run = F.when(F.col("_up") == top, F.lit(0).cast("long")).when((F.col("_upper") == top) & F.col("_up").rlike("^[0-9]{1,18}$"), F.col("_up").try_cast("bigint"))
    return out.withColumn("run_id", run).where("run_id IS NOT NULL")


def extract_pages(pdfs: DataFrame, read: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str] | None = None, min_chars: int = 80) -> DataFrame:
    """One row per page: direct text if it is long enough, else OCR; an error is a row, never a failed task.

    read and ocr are plug-ins for the libraries at hand.
    """

    def run(batches):
        for b in batches:
            rows = []
            for run_id, name, content in zip(b["run_id"], b["source_file"], b["content"], strict=True):
                try:
                    pages = read(content)
                except Exception as e:  # noqa: BLE001  kept as a row
                    rows.append((run_id, name, 1, "ocr_error", 0, "", str(e)))
                    continue
                for i, text in enumerate(pages):
                    if len(text.strip()) >= min_chars:
                        rows.append((run_id, name, i + 1, "direct", 0, text, ""))
                    elif ocr is None:
                        rows.append((run_id, name, i + 1, "ocr_unavailable", 0, text, "no OCR at hand"))
                    else:
                        try:
                            rows.append((run_id, name, i + 1, "ocr", 0, ocr(content, i), ""))
                        except Exception as e:  # noqa: BLE001  kept as a row
                            rows.append((run_id, name, i + 1, "ocr_error", 0, "", str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    out = pdfs.mapInPandas(run, PAGES).withColumn("text", clean_text("text"))
    return out.withColumn("text_chars", F.length("text"))


def read_side_car(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a flat JSON object of strings; nothing where the file is broken or no object."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    parsed = raw.select(F.from_json("v", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "value")).where(F.btrim("value") != "").select("key", F.btrim("value").alias("value"))


def read_side_cars(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(run_id, key, value) of the side-car files of that name: at the top of a folder for run 0, under a number for that run.

    Read as files, since their names begin with a low line, which Spark's own
    readers pass over. Broken ones and blank values are left out.
    """
    files = read_files(spark, folder, f"*{name}", plain=True)
    run = F.when(F.col("name") == name, F.lit(0).cast("long")).when(F.col("name").rlike("^[0-9]{1,18}/[^/]*$") & F.col("name").endswith(f"/{name}"), F.substring_index("name", "/", 1).try_cast("bigint"))
    parsed = files.select(run.alias("run_id"), F.from_json("content", "map<string,string>").alias("m")).where("run_id IS NOT NULL")
    return parsed.select("run_id", F.explode("m").alias("key", "value")).where(F.btrim("value") != "").select("run_id", "key", F.btrim("value").alias("value"))


def with_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The original file name where one is mapped, else the name of the source file."""
    n = names.select(F.col("key").alias("source_file"), F.col("value").alias("mapped"))
    return pages.join(n, "source_file", "left").withColumn("file", F.coalesce("mapped", "source_file")).drop("mapped")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_file").agg(F.count("*").alias("pages"), *[F.count_if(F.col("method") == m).alias(m) for m in ("direct", "ocr", "ocr_unavailable", "ocr_error")])

