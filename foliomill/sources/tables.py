"""Readers for pages and Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.constants import MARKDOWN_FILE, MARKDOWN_GLOB


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Spread a frame that comes in fewer partitions than there are cores.

    For work that needs no shuffle of its own: a small file in one piece would keep all but
    one core idle. Tables of many files are left as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per HTML file: ``url`` (its path) and ``html``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def is_markdown_path(path: Column) -> Column:
    return path.rlike(MARKDOWN_FILE)


def read_markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per Markdown file below ``path``: ``path`` and ``text``, by file ending in any case.

    Other files are not listed, let alone read. Bytes that are not UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MARKDOWN_GLOB).load(path)
    return files.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\A\x{FEFF}", "").alias("text"))
