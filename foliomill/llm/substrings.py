"""Substring dedup: windows of words that occur elsewhere too, found by FM-indexes of shards.

A window of words is placed by its minimizer, the k-mer of smallest hash in it: equal windows have
equal minimizers, so they meet in one shard, and a shard index is searched only by texts that can
match in it. Neighbouring windows of one minimizer form a segment. Segments whose minimizer occurs once in
the corpus cannot repeat and are not sent. Each shard builds a compressed FM-index over its
different segments, and streams them through it by backward search (see ``fm_index``).

Documents are dealt to chunks of bounded size. What travels between chunks and shards are
arrays of hashes, one row for each (chunk, shard); the documents are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliomill.llm.fm_index import FMIndex, repeated_windows
from foliomill.llm.words import chunk_count, chunk_of, mix, rows_of, word_codes, word_hashes

WINDOW = 35
KMER = 8
HOT = 1000
CHUNK_BYTES = 8 << 20
PIECE = 1 << 14  # windows whose hashes are laid side by side at a time
_POWERS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


class Segments:
    """The segments of some texts: runs of neighbouring windows with one minimizer."""

    def __init__(self, texts, window: int, kmer: int):
        self.offsets, codes, words = word_codes(texts)
        self.hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
        n = len(self.hashes)
        self.window = window
        empty = np.zeros(0, np.int64)
        self.first, self.count, self.minimizer = empty, empty, np.zeros(0, np.uint64)
        if n < window:
            return
        grams = np.zeros(n - kmer + 1, np.uint64)
        for k in range(kmer):
            grams = mix(grams + self.hashes[k:k + len(grams)])
        best = np.lib.stride_tricks.sliding_window_view(grams, window - kmer + 1)
        starts = np.arange(n - window + 1)
        row = rows_of(self.offsets)
        starts = starts[row[starts] == row[starts + window - 1]]
        at = np.empty(len(starts), np.int64)
        for k in range(0, len(starts), PIECE):
            part = starts[k:k + PIECE]
            at[k:k + len(part)] = part + best[part].argmin(axis=1)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        begins = np.flatnonzero(new)
        self.first = starts[begins]  # the first window
        self.count = np.diff(np.append(begins, len(starts)))  # how many windows
        self.minimizer = grams[at[begins]]

    def single_windows(self, which: np.ndarray) -> None:
        """Cut the chosen segments into their windows, each a segment of its own."""
        rest = np.flatnonzero(~which)
        cut = np.flatnonzero(which)
        times = self.count[cut]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.first = np.concatenate([self.first[rest], np.repeat(self.first[cut], times) + step])
        self.minimizer = np.concatenate([self.minimizer[rest], np.repeat(self.minimizer[cut], times)])
        self.count = np.concatenate([self.count[rest], np.ones(len(step), np.int64)])
        self.single = np.arange(len(self.first)) >= len(rest)

    def keep(self, which: np.ndarray) -> None:
        self.first, self.count, self.minimizer = self.first[which], self.count[which], self.minimizer[which]

    def contents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hash, offsets, word positions)`` of each segment."""
        sizes = self.count + self.window - 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
        at = np.repeat(self.first, sizes) + place
        terms = mix(self.hashes[at]) * _POWERS[place]
        total = np.add.reduceat(terms, offsets[:-1]) if len(sizes) else np.zeros(0, np.uint64)
        return mix(total + sizes.astype(np.uint64)), offsets, at


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _by_part(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[edges[p]:edges[p + 1]]) for p in range(parts) if edges[p + 1] > edges[p]]


def _repeats(segments: Segments, answers: pa.Table) -> None:
    """Keep the segments whose minimizer occurs twice or more in the corpus; cut very common ones."""
    keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in answers.column("keys").to_pylist()]])
    hot = np.concatenate([np.zeros(0, bool), *[np.frombuffer(x, bool) for x in answers.column("hot").to_pylist()]])
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order]
    if not len(keys):
        segments.keep(np.zeros(0, np.int64))
        segments.single = np.zeros(0, bool)
        return
    at = np.minimum(np.searchsorted(keys, segments.minimizer), len(keys) - 1)
    found = keys[at] == segments.minimizer
    segments.keep(np.flatnonzero(found))
    segments.single_windows(hot[at[found]])


def search_shard(blobs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(content hash, mask of repeated windows)`` of the segments of a shard, where any repeats.

    Each item has the contents of one chunk: hashes, sizes, whether the chunk holds it twice, and words.
    """
    hashes = np.concatenate([b[0] for b in blobs])
    sizes = np.concatenate([b[1] for b in blobs]).astype(np.int64)
    twice = np.concatenate([b[2] for b in blobs])
    words = np.concatenate([b[3] for b in blobs])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    distinct, at, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    copies = np.maximum(times, np.bincount(back, twice, minlength=len(distinct)) + 1)
    sizes = sizes[at]
    # Two copies in the index stand for any number of equal segments.
    rows = np.concatenate([np.arange(len(at)), np.flatnonzero(copies >= 2)])
    ends = np.cumsum(sizes[rows] + 1)
    starts = ends - sizes[rows] - 1
    symbols, coded, counts = np.unique(words, return_inverse=True, return_counts=True)
    coded = coded + 1  # 0 ends a segment
    text = np.zeros(int(ends[-1]), np.int64)
    step = np.arange(int(sizes[rows].sum())) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
    text[np.repeat(starts, sizes[rows]) + step] = coded[np.repeat(offsets[at][rows], sizes[rows]) + step]
    in_text = np.bincount(text, minlength=len(symbols) + 1)
    usable = in_text >= 2
    usable[0] = False
    # Symbols that occur once share a code: none of them is ever searched for.
    narrow = np.cumsum(usable) + 1
    narrow[~usable] = 1
    narrow[0] = 0
    text = narrow[text]
    del words, hashes, times, back, offsets, coded, counts, in_text, step
    sigma = int(text.max()) + 1
    fine = np.ones(sigma, bool)
    fine[:2] = False
    index = FMIndex(text, sigma, int(sizes.max()))
    n = len(at)
    masks = repeated_windows(index, text, fine, starts[:n], ends[:n] - 1, window)
    return distinct[masks > 0], masks[masks > 0]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER,
                   chunk_bytes: int = CHUNK_BYTES, untouched: bool = False) -> DataFrame:
    """``(id_col, n_words, n_removed, kept)``: ``kept`` has the words, joined by one blank, that no repeated window covers.

    A window is ``window`` neighbouring words of one document; it repeats if its words also start anywhere
    else, in the same document too. Windows are judged on the input. A NULL text has no words.
    Repeated rows and ids are documents of their own. A document shorter than a window is kept whole.
    With ``untouched``, texts that lose no word are given as they are, white space and NULL included.
    """
    if not kmer < window <= kmer + 31:
        raise ValueError("a segment holds at most 32 windows: kmer < window <= kmer + 31")
    chunks = chunk_count(docs, text, chunk_bytes)
    dealt = docs.select(F.col(id_col), F.col(text).alias("_text"), chunk_of(F.col(id_col), F.col(text), chunks=chunks).alias("_chunk"))

    def minimizers(group: pa.Table) -> pa.Table:
        segments = Segments(group.column("_text"), window, kmer)
        keys, counts = np.unique(segments.minimizer, return_counts=True)
        parts = _by_part(keys, chunks)
        chunk = group.column("_chunk")[0].as_py()
        return pa.table({"_part": pa.array([p for p, _ in parts], pa.int32()), "_chunk": pa.array([chunk] * len(parts), pa.int32()),
                         "keys": pa.array([_blob(keys[i]) for _, i in parts], pa.binary()),
                         "counts": pa.array([_blob(counts[i].astype(np.uint32)) for _, i in parts], pa.binary())})

    def repeated(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()]
        distinct, back = np.unique(np.concatenate(own), return_inverse=True)
        totals = np.bincount(back, np.concatenate(counts), minlength=len(distinct))[back]
        edges = np.cumsum([len(k) for k in own])[:-1]
        of_row = np.split(totals, edges)
        return pa.table({"_chunk": group.column("_chunk").cast(pa.int32()),
                         "keys": pa.array([_blob(k[t >= 2]) for k, t in zip(own, of_row)], pa.binary()),
                         "hot": pa.array([_blob(t[t >= 2] >= HOT) for t in of_row], pa.binary())})

    def contents(group: pa.Table, answers: pa.Table) -> pa.Table:
        segments = Segments(group.column("_text"), window, kmer)
        _repeats(segments, answers)
        hashes, offsets, at = segments.contents()
        # A cut window is placed by all of its words, any other segment by its minimizer.
        home = np.where(segments.single, hashes, mix(segments.minimizer))
        distinct, index, counts = np.unique(hashes, return_index=True, return_counts=True)
        rows = {k: [] for k in ("_part", "hashes", "sizes", "twice", "words")}
        for part, of in _by_part(home[index], chunks):
            sizes = np.diff(offsets)[index[of]]
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows["_part"].append(part)
            rows["hashes"].append(_blob(distinct[of]))
            rows["sizes"].append(_blob(sizes.astype(np.uint8)))
            rows["twice"].append(_blob(counts[of] >= 2))
            rows["words"].append(_blob(segments.hashes[at[np.repeat(offsets[:-1][index[of]], sizes) + step]].astype(np.uint32)))
        chunk = group.column("_chunk")[0].as_py() if group.num_rows else 0
        return pa.table({"_part": pa.array(rows["_part"], pa.int32()), "_chunk": pa.array([chunk] * len(rows["_part"]), pa.int32()),
                         **{k: pa.array(rows[k], pa.binary()) for k in ("hashes", "sizes", "twice", "words")}})

    def searched(group: pa.Table) -> pa.Table:
        blobs = [tuple(np.frombuffer(group.column(c)[i].as_py(), t) for c, t in (("hashes", np.uint64), ("sizes", np.uint8), ("twice", bool), ("words", np.uint32)))
                 for i in range(group.num_rows)]
        found, masks = search_shard(blobs, window)
        out_hashes, out_masks = [], []
        for own, *_ in blobs:
            at = np.minimum(np.searchsorted(found, own), max(0, len(found) - 1))
            hit = found[at] == own if len(found) else np.zeros(len(own), bool)
            out_hashes.append(_blob(own[hit]))
            out_masks.append(_blob(masks[at[hit]]))
        return pa.table({"_chunk": group.column("_chunk").cast(pa.int32()), "hashes": pa.array(out_hashes, pa.binary()), "masks": pa.array(out_masks, pa.binary())})

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_words", LongType()),
                         StructField("n_removed", LongType()), StructField("kept", StringType())])

    def removed(group: pa.Table, answers: pa.Table, found: pa.Table) -> pa.Table:
        segments = Segments(group.column("_text"), window, kmer)
        offsets = segments.offsets
        _repeats(segments, answers)
        hashes = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in found.column("hashes").to_pylist()]])
        masks = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x, np.uint32) for x in found.column("masks").to_pylist()]])
        order = np.argsort(hashes)
        hashes, masks = hashes[order], masks[order]
        change = np.zeros(offsets[-1] + 1, np.int64)
        if len(hashes):
            own = segments.contents()[0]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == own)
            mask, first = masks[at[hit]], segments.first[hit]
            for k in range(32):
                starts = first[(mask >> np.uint32(k) & 1).astype(bool)] + k
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
        keep = np.cumsum(change)[:-1] == 0
        n_words = np.diff(offsets)
        gone = np.concatenate([[0], np.cumsum(~keep)])
        n_removed = gone[offsets[1:]] - gone[offsets[:-1]]
        kept = []
        for i, line in enumerate(group.column("_text").cast(pa.binary()).to_pylist()):
            if untouched and not n_removed[i]:
                kept.append(line)
                continue
            words = (line or b"").split()
            if n_removed[i]:
                words = [w for w, k in zip(words, keep[offsets[i]:offsets[i + 1]].tolist()) if k]
            kept.append(b" ".join(words))
        return pa.Table.from_arrays([group.column(id_col), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                     pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    placed = dealt.groupBy("_chunk")
    keys = placed.applyInArrow(minimizers, "_part int, _chunk int, keys binary, counts binary")
    answers = keys.groupBy("_part").applyInArrow(repeated, "_chunk int, keys binary, hot binary")
    sent = placed.cogroup(answers.groupBy("_chunk")).applyInArrow(
        contents, "_part int, _chunk int, hashes binary, sizes binary, twice binary, words binary")
    found = sent.groupBy("_part").applyInArrow(searched, "_chunk int, hashes binary, masks binary")
    both = answers.select("_chunk", "keys", "hot", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("masks")).unionByName(
        found.select("_chunk", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("hot"), "hashes", "masks"))

    def last(group: pa.Table, more: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.Table.from_arrays([group.column(id_col)] + [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())], schema.names)
        is_key = pc.is_valid(more.column("keys"))
        return removed(group, more.filter(is_key), more.filter(pc.invert(is_key)))

    return placed.cogroup(both.groupBy("_chunk")).applyInArrow(last, schema)
