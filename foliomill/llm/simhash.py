"""SimHash near-duplicates: fingerprints, a pivot distance table, links and components.

Pairs are looked for among fingerprints that agree in two of six blocks of bits; fingerprints
that differ in at most four bits always do. In such a bucket, distances to the pivots (random
reference fingerprints, computed once per fingerprint) differ by at most the distance of the
pair; pairs with a larger difference in any coordinate are discarded, and the rest is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.components import components
from foliomill.llm.words import mix, slices, written

MAX_BITS = 4
BLOCKS = 6
PIVOTS = 16
TILE = 512


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """One mask for each pair of blocks; the 64 bits are cut into blocks as equal as can be."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(parts, 2)]


def _fingerprint(words: list[bytes], size: int) -> int:
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[: len(words) - size].tolist()], (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``(id_col, fingerprint)``: the SimHash of each whole text, as a signed 64-bit number.

    A-Z is lowered; shingles of ``shingle`` words, repeats included, are hashed by XXH64 with seed
    42. A bit is set if over half of the hashes have it. A text of fewer words is one shingle; one
    without words, or NULL, has fingerprint 0.
    """
    schema = docs.select(id_col, F.lit(0).cast("bigint").alias("fingerprint")).schema

    def task(batches):
        for part in slices(batches, text):
            lines = pc.cast(pc.ascii_lower(pc.fill_null(part.column(text), "")), pa.binary()).to_pylist()
            marks = np.fromiter((_fingerprint(x.split(), shingle) for x in lines), np.uint64, len(lines))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(marks.view(np.int64))], [id_col, "fingerprint"])

    return docs.select(id_col, text).mapInArrow(task, schema)


def _groups(batches, keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by the keys, as tables of many groups at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= col[1:] != col[:-1]
            new[0] |= bool(rest) and rest[-1].column(k)[rest[-1].num_rows - 1].as_py() != col[0].item()
        cut = np.flatnonzero(new)
        if len(cut):
            if int(cut[-1]) or rest:
                yield pa.Table.from_batches([*rest, batch.slice(0, int(cut[-1]))])
            rest = [batch.slice(int(cut[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def near_pairs(marks: np.ndarray, table: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs within a group (rows sorted by it) at up to ``max_bits`` bits.

    ``table`` holds the pivot distances of each row. Where a group is a tile of a larger
    bucket, ``side`` says which half a row is of: only pairs of unlike sides are looked at (0: any).
    """
    found_a, found_b = [], []
    start = np.arange(len(marks))
    for shift in range(1, len(marks)):
        start = start[start + shift < len(marks)]
        start = start[group[start] == group[start + shift]]
        if not len(start):
            break
        a = start[(side[start] == 0) | (side[start] != side[start + shift])]
        b = a + shift
        for k in range(table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[near], b[near]
        close = np.bitwise_count(marks[a] ^ marks[b]) <= max_bits
        found_a.append(a[close])
        found_b.append(b[close])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (start[:0], start[:0])


def spanning(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked row to the row of smallest ``order`` in its local component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    nodes = nodes[(rank := np.argsort(order[nodes], kind="stable"))]
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    a, b = place[back[: len(a)]], place[back[len(a):]]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all() and (label[a] == label[b]).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def links(marks: DataFrame, max_bits: int = MAX_BITS, masks: list[int] | None = None, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` between rows of ``marks``, ``(fingerprint, rep)``, at up to ``max_bits`` bits; a and b are their ``rep``.

    Rows that agree in all bits of a mask meet in a bucket. By default the masks are pairs of ``BLOCKS`` blocks, which miss nothing
    up to four bits. Not every pair is returned: the links of a bucket go to the smallest row of each component in it, which
    keeps connectivity.
    A bucket of over ``tile`` rows is cut into parts, and each pair of parts is a group of its own, spread over tasks.
    """
    if masks is None:
        if BLOCKS - max_bits < 2:
            raise ValueError(f"{BLOCKS} blocks miss pairs beyond {BLOCKS - 2} bits: give other masks")
        masks = block_masks(BLOCKS)
    reference = pivot_fingerprints(pivots)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")).alias("k"))
                              for i, m in enumerate(signed)]))
    distances = F.array(*[F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(int(p)).cast("bigint"))).cast("tinyint")
                          for p in reference.view(np.int64)])
    rows = marks.select("fingerprint", "rep", distances.alias("d"))
    slim = rows.select(key.alias("b")).select("b.t", "b.k")
    # Only large buckets need to be known before; written, their size is known too, and the few there are get broadcast.
    large = written(slim.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large-buckets")
    parts = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
    wide = rows.select("*", key.alias("b")).select("fingerprint", "rep", "d", "b.t", "b.k").join(large, ["t", "k"], "left")
    mine = F.pmod(F.xxhash64("fingerprint", "rep"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(
        F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"),
        F.when(mine == o, 0).when(mine < o, 1).otherwise(2).cast("tinyint").alias("side")))
    tiled = wide.select("t", "k", "fingerprint", "rep", "d", F.explode(tiles).alias("x")).select("t", "k", "x.i", "x.j", "x.side", "fingerprint", "rep", "d")
    by = ["t", "k", "i", "j"]

    def task(batches):
        for group in _groups(batches, tuple(by)):
            n = group.num_rows
            change = np.zeros(n, bool)
            for c in by:
                col = group.column(c).to_numpy()
                change[1:] |= col[1:] != col[:-1]
            mark = group.column("fingerprint").to_numpy().view(np.uint64)
            table = np.asarray(group.column("d").combine_chunks().flatten()).reshape(n, -1)
            a, b = near_pairs(mark, table, np.cumsum(change), group.column("side").to_numpy(), max_bits)
            if len(a):
                rep = group.column("rep").to_numpy()
                a, b = spanning(a, b, rep)
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return tiled.repartition(*by).sortWithinPartitions(*by).mapInArrow(task, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: components of fingerprints at up to ``max_bits`` bits.

    ``component_id`` is the smallest id reachable, the row's own included. Rows of one fingerprint
    are one node. A row with NULL id has component NULL unless another row of its component has an
    id. Repeated rows give repeated results.
    """
    marks = written(fingerprints(docs, id_col, text, shingle), "fingerprints")
    nodes = written(marks.groupBy("fingerprint").agg(F.min(id_col).alias("least")).withColumn("rep", F.col("fingerprint")), "nodes")
    near = components(links(nodes.select("fingerprint", "rep"), max_bits))
    smallest = near.join(nodes, F.col("node") == F.col("fingerprint")).groupBy("component").agg(F.min("least").alias("smallest"))
    of_mark = near.join(smallest, "component").select(F.col("node").alias("linked"), "smallest")
    nodes = nodes.join(of_mark, F.col("fingerprint") == F.col("linked"), "left").select(
        "fingerprint", F.coalesce("smallest", "least").alias("component_id"))
    return marks.join(nodes, "fingerprint").select(id_col, "fingerprint", "component_id")
