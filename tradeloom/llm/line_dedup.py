"""Line dedup by site-relative frequency. DataFrame functions only.

A line is a newline-separated part; it is compared after trimming ASCII white
space, and blank lines are never boilerplate. Per site: the number of pages that
contain a line over the number of pages of the site. Lines above `ratio` are
dropped wherever they stand on that site, if they stand on `min_pages` pages at
least - two, as a line of one page repeats nothing.

Lines are counted under two 64-bit hashes, first within each task; no text is
shuffled. A site has fewer than (mean lines a page / ratio) such lines, however
many pages it has; the table of these is written and then joined, by broadcast
only if its size is under the session's threshold.

Edge cases: a null text stays null and counts as a page without lines; a null
site is a site of its own; a text whose lines all go becomes empty; repeated
rows are pages of their own; an empty table gives no rows; other columns stay,
whatever their names; a line at the ratio stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

RATIO, MIN_PAGES = 0.05, 2
EDGE = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    line = F.btrim(line, F.lit(EDGE))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site -> array of the keys of its boilerplate lines."""
    rows = pages.select(F.col(site).alias("site"), F.split(F.col(text), "\n").alias("lines"))
    total = rows.groupBy("site").agg(F.count("*").alias("n"))
    filled = F.filter("lines", lambda x: F.btrim(x, F.lit(EDGE)) != "")
    line = rows.select("site", F.explode(F.array_distinct(F.transform(filled, lambda x: F.btrim(x, F.lit(EDGE))))).alias("l")).select("site", _key(F.col("l")).alias("k"))
    seen = line.groupBy("site", "k").agg(F.count("*").alias("c")).where(F.col("c") >= min_pages)
    hot = seen.join(total, seen["site"].eqNullSafe(total["site"])).where(F.col("c") > ratio * F.col("n")).select(seen["site"], "k")
    return hot.groupBy("site").agg(F.sort_array(F.collect_list("k")).alias("drop"))


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page: the row, with boilerplate lines cut from its text; n_lines and n_dropped (long)."""
    b = materialize(boilerplate(pages, site, text, ratio, min_pages))
    # Apart from the columns of pages, whose names may be any.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{site}`").alias("of"), F.split(F.col(f"`{text}`"), "\n").alias("lines"))
    out = rows.join(b, F.col("of").eqNullSafe(F.col("site")), "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _key(x))))
    out = out.select("page", "lines", kept.alias("kept"))
    return out.select(
        F.struct(*[F.array_join("kept", "\n").alias(c) if c == text else F.col(f"page.`{c}`").alias(c) for c in pages.columns]).alias("page"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("page.doc_id", "page.text", "n_lines", "n_dropped")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without boilerplate lines, n_chars of the new text."""
    out = drop_boilerplate(docs)
    return out.select(*[F.length("page.text").cast("long").alias(c) if c == "n_chars" else F.col(f"page.`{c}`") for c in docs.columns])


def sql(docs: str = "documents") -> str:
    trim = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
l5 AS (
  SELECT doc_id, source, i, line, {trim.format("line")} AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE text IS NOT NULL)
), b5 AS (
  SELECT c.source, c.t FROM (SELECT source, t, count(DISTINCT doc_id) AS c FROM l5 WHERE t <> '' GROUP BY ALL) c
  JOIN (SELECT source, count(*) AS n FROM {docs} GROUP BY ALL) n ON n.source IS NOT DISTINCT FROM c.source
  WHERE c.c >= {MIN_PAGES} AND c.c > {RATIO} * n.n
), m5 AS (
  SELECT l5.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b5.t IS NULL), '') AS text,
    count(*) AS n_lines, count(b5.t) AS n_dropped
  FROM l5 LEFT JOIN b5 ON b5.source IS NOT DISTINCT FROM l5.source AND b5.t = l5.t GROUP BY l5.doc_id
), op5 AS (
  SELECT d.doc_id, m5.text, coalesce(m5.n_lines, 0) AS n_lines, coalesce(m5.n_dropped, 0) AS n_dropped
  FROM {docs} d LEFT JOIN m5 ON m5.doc_id = d.doc_id
)"""


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": f"WITH {sql()} SELECT * FROM op5"}
