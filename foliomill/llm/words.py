"""Words of Arrow text columns, as dense codes, and chunks of documents."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 8 << 20
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most ``limit`` bytes of text (a longer row stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            give_back()


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(offsets, codes, words)``: row i has the words ``words[codes[offsets[i]:offsets[i + 1]]]``.

    Words are runs of characters other than blank and U+0009 to U+000D; NULL has none.
    ``lower`` folds A-Z only.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    return kept[ends], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; a bijection."""
    values = values ^ (values >> _MIX[2])
    values = values * _MIX[0]
    values = values ^ (values >> _MIX[2])
    values = values * _MIX[1]
    return values ^ (values >> _MIX[2])


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each position belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for a row without any."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def chunk_count(docs: DataFrame, text: str, chunk_bytes: int) -> int:
    """How many chunks of about ``chunk_bytes`` of text the documents fill."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.count("*") * 16).first()[0]
    return max(1, -(-int(total) // chunk_bytes))


def chunk_of(*cols: str | Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("int")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, unless PYTHONPATH has it there."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_foliomill_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="foliomill-")).resolve()
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "foliomill-package.zip", "w") as out:
        for path in sorted((root / "foliomill").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(folder / "foliomill-package.zip"))
    context._foliomill_shipped = True


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: its lineage is the written table."""
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
