"""Files from rows, on any file system that Arrow can reach."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("target", "content")))


def write_files(entries: DataFrame, folder_uri: str, path_col: str = "path", content_col: str = "content",
                part_col: str | None = None, folder_col: str | None = None) -> DataFrame:
    """Write each row's ``content`` to ``folder_uri/path``, from the executors; gives the manifest ``(target, staged, n_bytes, sha256)``.

    With ``part_col`` a file is the rows of its path in the order of that column. With ``folder_col`` each of
    its values, such as the root of a tree, has a folder of its own. Two rows that would be the same file, or the
    same part of one, are an error before anything is written: no content is lost.

    All files are first written to a folder of this run, ``_staged-...``, each attempt of a task under names of its own. What the
    attempts that count have written is the manifest, committed once, by Spark, to ``_manifest/<run>``. Only then are the
    files moved into place; a move that is repeated finds its work done. A job that fails before the manifest is
    committed leaves the files of the target as they were. ``folder_uri`` must be visible to all executors.
    """
    spark, run = entries.sparkSession, uuid.uuid4().hex
    target = F.col(path_col) if folder_col is None else F.concat_ws("/", F.col(folder_col).cast("string"), path_col)
    part = F.lit(0) if part_col is None else F.col(part_col)
    rows = entries.select(target.alias("target"), part.alias("part"), F.col(content_col).alias("content"))
    double = rows.groupBy("target", "part").count().where("count > 1").select("target").limit(3).collect()
    if double:
        raise ValueError(f"several rows for one file, such as {[r.target for r in double]}")

    def stage(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder_uri)
        attempt = f"_staged-{run}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{attempt}", recursive=True)
        for k, (path, parts) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
            digest, size = hashlib.sha256(), 0
            with system.open_output_stream(f"{root}/{attempt}/{k}") as out:
                for _, content in parts:
                    data = (content or "").encode()
                    digest.update(data)
                    size += out.write(data)
            yield pa.RecordBatch.from_pydict({"target": [path], "staged": [f"{attempt}/{k}"], "n_bytes": [size], "sha256": [digest.hexdigest()]})

    def publish(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder_uri)
        for batch in batches:
            for path, staged in zip(batch.column("target").to_pylist(), batch.column("staged").to_pylist()):
                place = f"{root}/{path}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                if system.get_file_info(f"{root}/{staged}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{staged}", place)
                elif system.get_file_info(place).type == fs.FileType.NotFound:
                    raise FileNotFoundError(staged)
            yield batch.select(["target"])

    if part_col is not None:
        rows = rows.repartition("target").sortWithinPartitions("target", "part")
    schema = "target string, staged string, n_bytes bigint, sha256 string"
    manifest_path = f"{folder_uri}/{MANIFEST}/{run}"
    rows.select("target", "content").mapInArrow(stage, schema).write.parquet(manifest_path)
    manifest = spark.read.schema(schema).parquet(manifest_path)
    manifest.mapInArrow(publish, "target string").write.format("noop").mode("overwrite").save()
    return manifest
