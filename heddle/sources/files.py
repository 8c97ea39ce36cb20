"""Scans and sinks of document files, as DataFrames over Spark's binaryFile source and its writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import safe_cell, safe_filename
from heddle.sources.markup import blocks_of

# Accepted media types per extension, and the largest upload.
MEDIA_TYPES = {
    "pdf": ["application/pdf"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "csv": ["text/csv", "application/csv", "application/vnd.ms-excel"],
    "md": ["text/markdown", "text/plain", "text/x-markdown"],
    "markdown": ["text/markdown", "text/plain", "text/x-markdown"],
}
MAX_BYTES = 50 * 1024 * 1024

BLOCKS = "path string, n int, kind string, text string, level int, start int, stop int, source string, problem string"


def upload_problem(name: Column, media_type: Column, content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why an upload is refused, or null."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(x for k, v in MEDIA_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    mime = F.lower(F.trim(F.substring_index(media_type, ";", 1)))
    magic = lambda n: F.decode(F.substring(content, 1, n), "ISO-8859-1")
    return (
        F.when(safe_filename(name).isNull(), "bad file name")
        .when(content.isNull() | (F.octet_length(content) == 0), "empty file")
        .when(F.octet_length(content) > max_bytes, "file too large")
        .when(known[ext].isNull(), "unsupported file type")
        .when(~F.array_contains(known[ext], mime), "media type does not match the extension")
        .when((ext == "pdf") & (magic(5) != "%PDF-"), "not a PDF file")
        .when(ext.isin("docx", "xlsx") & (magic(2) != "PK"), "not an Office file")
    )


def read_blocks(files: DataFrame) -> DataFrame:
    """files (path, content) to their blocks, by extension; a file that can't be read has one row with a problem."""

    def run(batches):
        for part in batches:
            rows = [row for path, content in part[["path", "content"]].itertuples(index=False) for row in blocks_of(path, bytes(content))]
            out = pd.DataFrame(rows, columns=["path", "n", "kind", "text", "level", "start", "stop", "source", "problem"])
            yield out.astype({"level": "Int32", "start": "Int32", "stop": "Int32", "n": "Int32"})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def flat(rows: DataFrame) -> DataFrame:
    """Rows for CSV: arrays joined by '; ', arrays of structs as a number of passages, text made safe for spreadsheets."""
    out = []
    for field in rows.schema:
        kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind.startswith("array<struct"):
            c = F.concat(F.size(c).cast("string"), F.lit(" passage(s)"))
        elif kind.startswith("array"):
            c = safe_cell(F.array_join(F.transform(c, lambda x: x.cast("string")), "; "))
        elif kind == "string":
            c = safe_cell(c)
        out.append(c.alias(field.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def overwrite_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Idempotent: replaces exactly the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def running_lines(lines: DataFrame) -> DataFrame:
    """lines (doc, page, y, page_height, text): without headers and footers, table-of-contents leaders and page numbers.

    A line that stands, with digits aside, on at least half of the pages (two at least) is a running one.
    """
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    edge = (F.col("y") < 0.12 * F.col("page_height")) | (F.col("y") > 0.88 * F.col("page_height"))
    rows = lines.withColumn("key", key).withColumn("edge", edge)
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    often = rows.groupBy("doc", "key").agg(F.countDistinct("page").alias("on")).join(pages, "doc").where(F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2))).select("doc", "key")
    number = F.col("edge") & F.col("text").rlike(r"(?i)^\s*(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$")
    return rows.where(~F.col("text").rlike(r"\.{4,}\s*\d+\s*$") & ~number).join(often, ["doc", "key"], "left_anti").drop("key", "edge")


def font_headings(lines: DataFrame) -> DataFrame:
    """lines (doc, n, size, bold, text): headings by font with their level; the body size is the one with most text."""
    weight = lines.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("w"))
    body = weight.groupBy("doc").agg(F.max_by("size", F.struct("w", (-F.col("size")).alias("s"))).alias("body"))
    big = lines.join(body, "doc").where((F.col("size") >= F.col("body") + 1.0) | F.col("bold"))
    sizes = big.select("doc", "size").distinct().withColumn("rank", F.expr("row_number() over (partition by doc order by size desc)"))
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\.?\s+\S", 1)
    return big.join(sizes, ["doc", "size"]).select("doc", "n", "text", F.when(number != "", F.size(F.split(number, r"\."))).otherwise(F.col("rank")).cast("int").alias("level"))
