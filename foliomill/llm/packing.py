"""Packing documents into sequences of a fixed length, balanced by attention cost.

Documents are tokenized and cut into pieces of at most a sequence. Pieces are dealt by hash to
groups of bounded size; within a group, in one task, they go in descending order to the
sequence of lowest cost that has room for them. The cost of a piece is linear in its tokens (projections,
feed-forward) plus quadratic (attention within the piece). A group has as many sequences as
its tokens fill; what fits nowhere as a whole is cut to fill the room left.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from foliomill.llm.words import chunk_count, chunk_of, slices, word_codes

GROUP_BYTES = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHED, SHORT = 1_000_000, 64
ENCODED, SLICE = 1_000, 4 << 20
_TOKENIZERS: dict[str, object] = {}
_WORDS: dict[str, "WordIds"] = {}


def tokenizer_file() -> str:
    """The tokenizer of the queries: the file that FOLIOMILL_TOKENIZER names, or the public word-level one."""
    if named := os.environ.get("FOLIOMILL_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def ragged_take(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, values)`` of the chosen rows, one after the other."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[rows] - (ends - sizes), sizes)
    at += np.arange(len(at))
    return np.concatenate([[0], ends]), values[at]


class WordIds:
    """The ids of words. The first ``CACHED`` different ones of a worker that have up to ``SHORT`` bytes are remembered, in Arrow and numpy
    arrays: next to no room, and looked up all at once."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.words = pa.array([], pa.string())
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        sizes: list[int] = []
        flat: list[np.ndarray] = [np.zeros(0, np.uint32)]
        # What the tokenizer gives for a word takes hundreds of times the room of its ids.
        for k in range(0, len(words), ENCODED):
            ids = [x.ids for x in encode(words.slice(k, ENCODED).to_pylist(), add_special_tokens=False)]
            sizes.extend(map(len, ids))
            flat.append(np.array(list(chain.from_iterable(ids)), np.uint32))
        return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.concatenate(flat)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of each word; no word comes twice."""
        words = words.cast(pa.string())
        # The words asked for are hashed, not the many remembered ones.
        found = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(found >= 0)
        is_new = np.ones(len(words), bool)
        is_new[found[known]] = False
        new = np.flatnonzero(is_new)
        fresh = words.take(pa.array(new))
        offsets, ids = self.encoded(fresh)
        old_offsets, old_ids = ragged_take(self.offsets, self.ids, known)
        rows = np.empty(len(words), np.int64)
        rows[found[known]] = np.arange(len(known))
        rows[new] = len(known) + np.arange(len(new))
        room = CACHED - len(self.words)
        if room > 0 and len(new):
            short = np.flatnonzero(pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= SHORT)[:room]
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(short))])
            more, kept = ragged_take(offsets, ids, short)
            self.offsets, self.ids = np.concatenate([self.offsets, self.offsets[-1] + more[1:]]), np.concatenate([self.ids, kept])
        return ragged_take(np.concatenate([old_offsets, old_offsets[-1] + offsets[1:]]), np.concatenate([old_ids, ids]), rows)


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path].of(words)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """``(id_col, start, length, doc_tokens, ids)``: the tokens of each document and ``end_id``, cut every ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers. A NULL text is empty, so every document has a
    token. The tokenizer must not look across white space (the word-level one does not): each different
    word of a batch is encoded once.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *[StructField(c, LongType()) for c in ("start", "length", "doc_tokens")],
                         StructField("ids", BinaryType())])

    def task(batches):
        for part in slices(batches, text, SLICE):
            offsets, codes, words = word_codes(part.column(text))
            of_word, flat = word_ids(words, tokenizer_path)
            ends, ids = ragged_take(of_word, flat, codes)
            edges = ends[offsets]
            # Each text's ids and the end, one after the other; every text is cut from its own beginning.
            totals = np.diff(edges) + 1
            bounds = np.concatenate([[0], np.cumsum(totals)])
            flat = np.insert(ids, edges[1:], np.uint32(end_id)).astype("<u4")
            many = -(-totals // capacity)
            rows = np.repeat(np.arange(part.num_rows), many)
            starts = (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            lengths = np.minimum(capacity, totals[rows] - starts)
            # Pieces lie side by side, so their offsets cut one buffer.
            cuts = np.append(bounds[rows] + starts, bounds[-1]) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)])
            columns = [part.column(id_col).take(pa.array(rows)), pa.array(starts), pa.array(lengths), pa.array(totals[rows]), data.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text).mapInArrow(task, schema)


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(piece, from, length, sequence, offset)`` of the pieces of one group.

    Descending, each to the sequence of lowest cost with room; ties to the first. A piece without room
    anywhere is cut to fill the roomiest sequences.
    """
    count = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    out = []

    def put(piece, start, length, seq):
        out.append((piece, start, length, seq, capacity - int(room[seq])))
        room[seq] -= length
        cost[seq] += LINEAR * length + QUADRATIC * length * length

    for piece in np.argsort(-lengths, kind="stable"):
        length, start = int(lengths[piece]), 0
        fits = np.where(room >= length, cost, np.inf)
        best = int(fits.argmin())
        if fits[best] < np.inf:
            put(piece, 0, length, best)
            continue
        while length:
            seq = int(room.argmax())
            part = min(length, int(room[seq]))
            put(piece, start, part, seq)
            start, length = start + part, length - part
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1,
         capacity: int = 2048, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(id_col, start, length, doc_tokens, ids, sequence_id, offset)``: one row for each piece.

    All tokens of all documents are kept, each in one piece. A group leaves less than one
    sequence of padding. Repeated rows are packed as often as they occur; NULL ids too.
    """
    groups = chunk_count(docs.select(F.col(text)), text, group_bytes)
    pieces = token_pieces(docs, tokenizer_path, id_col, text, end_id, capacity)
    dealt = pieces.withColumn("_g", chunk_of(F.col(id_col), "start", "doc_tokens", F.crc32("ids"), chunks=groups))
    schema = StructType([*[f for f in dealt.schema.fields if f.name != "_g"], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        length = group.column("length").to_numpy()
        # Ties in an order that does not depend on how the rows came.
        order = np.lexsort((group.column("start").to_numpy(), group.column(id_col).cast(pa.string()).fill_null("").to_numpy(zero_copy_only=False).astype(str)))
        first = int(group.column("_g")[0].as_py()) << 24
        rows = np.array(assign(length[order], capacity), np.int64).reshape(-1, 5)
        at = order[rows[:, 0]]
        ids = group.column("ids")
        cut = [ids[int(i)].as_py()[4 * s:4 * (s + n)] for i, s, n in zip(at, rows[:, 1], rows[:, 2])]
        return pa.Table.from_arrays([
            group.column(id_col).take(pa.array(at)), pa.array(group.column("start").to_numpy()[at] + rows[:, 1]), pa.array(rows[:, 2]),
            group.column("doc_tokens").take(pa.array(at)), pa.array(cut, pa.binary()), pa.array(first + rows[:, 3]), pa.array(rows[:, 4])], schema.names)

    return dealt.groupBy("_g").applyInArrow(task, schema)
