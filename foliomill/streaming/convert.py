"""Continuous conversion and naming of arriving pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import slugify_url
from foliomill.operators.naming import number_within
from foliomill.plans.page_markdown import convert_pages

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def page_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The pages of a table, which may be one file or a folder of files.

    The path is a pattern: a stream takes a plain path for a folder, and a pattern for whatever has that name.
    """
    return spark.readStream.schema(PAGE_SCHEMA).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def _run(stream: DataFrame, write_batch, state: str) -> None:
    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def convert_stream(stream: DataFrame, out: str) -> None:
    """Convert all pages that have arrived. Each batch replaces its own folder, so a repeated
    batch does not double its rows."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        convert_pages(batch, keep=("url",)).write.mode("overwrite").parquet(f"{out}/pages/batch={batch_id}")

    _run(stream, write_batch, f"{out}/state")


SEEN_SCHEMA = "slug STRING, seen BIGINT, batch BIGINT, bucket INT"


def _seen(spark: SparkSession, out: str, batch_id: int, buckets: list[int], compact_every: int) -> DataFrame:
    """``(slug, seen)`` before a batch, of the given buckets: the last snapshot and the counts of the batches since."""
    base = batch_id // compact_every * compact_every - 1
    paths = [f"{out}/seen/batch={k}" for k in range(base + 1, batch_id)]
    rows = spark.createDataFrame([], SEEN_SCHEMA)
    if paths:
        rows = rows.unionByName(spark.read.schema(SEEN_SCHEMA).option("basePath", f"{out}/seen").parquet(*paths))
    if base >= 0:
        rows = rows.unionByName(spark.read.schema(SEEN_SCHEMA).option("basePath", f"{out}/snapshots").parquet(f"{out}/snapshots/batch={base}"))
    return rows.where(F.col("bucket").isin(buckets)).groupBy("bucket", "slug").agg(F.sum("seen").alias("seen"))


def name_batch(batch: DataFrame, batch_id: int, out: str, buckets: int = 64, compact_every: int = 20) -> None:
    """Name the pages of one batch and add its counts to the state; a repeated batch replaces what it wrote.

    The state is a table of counts per slug and batch in ``buckets`` by hash. A batch reads the buckets that its slugs
    fall into and writes a row for each of its own slugs; every ``compact_every`` batches the sums are written once more, as a
    snapshot that later batches start from.
    """
    spark = batch.sparkSession
    slugs = number_within(batch.select("page_id", slugify_url("url").alias("slug")), ["slug"], "page_id")
    bucket = F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int")
    slugs = slugs.withColumn("bucket", bucket)
    here = f"{out}/seen/batch={batch_id}"
    slugs.groupBy("bucket", "slug").agg(F.max("ordinal").alias("seen")).write.mode("overwrite").partitionBy("bucket").parquet(here)
    counted = spark.read.schema(SEEN_SCHEMA).option("basePath", f"{out}/seen").parquet(here)
    touched = sorted(r.bucket for r in counted.select("bucket").distinct().collect())
    seen = _seen(spark, out, batch_id, touched, compact_every).drop("bucket")
    number = F.col("ordinal") + F.coalesce("seen", F.lit(0))
    name = F.when(number > 1, F.concat_ws("-", "slug", number.cast("string"))).otherwise(F.col("slug"))
    slugs.join(seen, "slug", "left").select("page_id", "slug", number.alias("ordinal"), name.alias("name")) \
        .write.mode("overwrite").parquet(f"{out}/names/batch={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        everything = _seen(spark, out, batch_id, list(range(buckets)), compact_every).unionByName(counted.select("bucket", "slug", "seen"))
        everything.groupBy("bucket", "slug").agg(F.sum("seen").alias("seen")) \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/snapshots/batch={batch_id}")


def name_stream(stream: DataFrame, out: str, buckets: int = 64, compact_every: int = 20) -> None:
    """Give arriving pages file names that go on counting where earlier batches stopped; see ``name_batch``."""
    _run(stream, lambda batch, batch_id: name_batch(batch, batch_id, out, buckets, compact_every), f"{out}/state")
