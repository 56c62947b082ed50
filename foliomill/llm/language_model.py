"""Language-model scores by a weighted backoff automaton.

The model is a smoothed n-gram model. P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K), where h' is h
without its first word and K a constant; below the unigrams stands the share of new words,
P(w) = c(w) / (N + V), with V / (N + V) for any word that training has not seen. As an automaton: a state is a history
seen in training, an arc of a state a word seen after it, weighted log10 P(w | h). Any other word takes the
failure arc to the state of h', weighted log10(K / (c(h) + K)). The start state of a text has no history.

The automaton of a whole corpus fits no single machine. Documents are dealt to chunks; each
chunk lists its different n-grams with their training counts, counts are added up by n-gram, and each
chunk gets the totals back. From them it builds the states, arcs and failure arcs that its own texts can reach, and walks
all of its texts side by side, once, from left to right, each carrying its state. Scores do not depend on the chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from foliomill.llm.words import chunk_count, chunk_of, mix, rows_of, sums_of, word_codes, word_hashes

CHUNK_BYTES = 8 << 20
STRIDE = 512
END = np.uint64(0x5851F42D4C957F2D)


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array by significance: sorted keys and small counts then compress well in the shuffle."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).reshape(-1)


class Tokens:
    """The tokens of some texts: lowered words, then one end each; and their n-grams as 64-bit keys."""

    def __init__(self, texts, order: int):
        offsets, codes, words = word_codes(texts, lower=True)
        rows = np.arange(len(offsets) - 1)
        hashes = mix(word_hashes(words))
        self.offsets = offsets + np.append(rows, len(rows))
        token = np.full(self.offsets[-1], END, np.uint64)
        inside = np.ones(len(token), bool)
        inside[self.offsets[1:] - 1] = False
        token[inside] = hashes[codes]
        self.row = rows_of(self.offsets)
        place = np.arange(len(token)) - self.offsets[:-1][self.row]
        # keys[k]: the n-gram of k + 1 tokens that ends here; valid from place k on. The lowest bits tell its order.
        self.keys, self.valid = [], []
        now = np.zeros(len(token), np.uint64)
        for k in range(order):
            shifted = np.zeros(len(token), np.uint64)
            shifted[k:] = token[: len(token) - k] if k else token
            now = mix(now * np.uint64(3) + shifted)
            self.keys.append(now & ~np.uint64(7) | np.uint64(k))
            self.valid.append(place >= k)

    def numbered(self) -> np.ndarray:
        """The different n-grams, ascending; ``ids[k]`` then numbers the one of k + 1 tokens that ends at each place (-1: none)."""
        codes, keys = pd.factorize(np.concatenate([k[v] for k, v in zip(self.keys, self.valid)]))
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.ids, at = [], 0
        for valid in self.valid:
            own = np.full(len(valid), -1, np.int64)
            many = int(valid.sum())
            own[valid] = place[codes[at:at + many]]
            self.ids.append(own)
            at += many
        return keys[order]

    def counts(self, of_row: np.ndarray, n: int) -> np.ndarray:
        """How often each n-gram occurs, by the weights of the texts."""
        total = np.zeros(n, np.int64)
        for own, valid in zip(self.ids, self.valid):
            total += np.bincount(own[valid], of_row[self.row[valid]], minlength=n).astype(np.int64)
        return total


class Automaton:
    """States and arcs of the n-grams that some texts can reach. Number g stands for an n-gram: as an arc, for its last word after
    the words before; as a state, for all of its words as history. ``ROOT`` is the state without history."""

    ROOT = -1

    def __init__(self, tokens: Tokens, counts: np.ndarray, n_tokens: int, n_types: int, smoothing: float):
        order, n = len(tokens.ids), len(counts)
        self.seen = counts > 0
        self.depth = np.zeros(n + 1, np.int8)  # of a state; the last entry is the root's
        prefix, shorter = np.full(n, -1, np.int64), np.full(n, self.ROOT, np.int64)
        p = np.where(self.seen, counts, 0) / max(1, n_tokens + n_types)
        self.unseen = np.log10(n_types / (n_tokens + n_types)) if n_types else 0.0
        for k, own in enumerate(tokens.ids):
            at = np.flatnonzero(tokens.valid[k])
            self.depth[own[at]] = k + 1
            if k:
                prefix[own[at]], shorter[own[at]] = tokens.ids[k - 1][at - 1], tokens.ids[k - 1][at]
                grams = np.unique(own[at])
                grams = grams[self.seen[grams]]
                p[grams] = (counts[grams] + smoothing * p[shorter[grams]]) / (counts[prefix[grams]] + smoothing)
        self.arc = np.log10(p, where=self.seen, out=np.zeros(n))
        self.failure = np.log10(smoothing / (counts + smoothing)) if smoothing else np.full(n, -np.inf)
        self.shorter = shorter
        # A history has at most order - 1 words.
        self.after = np.where(self.depth[:n] < order, np.arange(n), shorter)

    def walk(self, tokens: Tokens) -> tuple[np.ndarray, int]:
        """The log10 probability of each text, and how many failure arcs were taken.

        Long texts are cut: a walker begins ``order`` - 1 tokens before its part, at the root, and so is in the part's state
        when it gets there. All walkers take a step at a time.
        """
        order, sizes = len(tokens.ids), np.diff(tokens.offsets)
        many = -(-sizes // STRIDE)
        text = np.repeat(np.arange(len(sizes)), many)
        first = tokens.offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        stop = np.minimum(first + STRIDE, tokens.offsets[1:][text])
        begin = np.maximum(first - (order - 1), tokens.offsets[:-1][text])
        by = np.argsort(begin - stop, kind="stable")
        begin, quiet, lengths = begin[by], (first - begin)[by], (stop - begin)[by]
        score, state, failures = np.zeros(len(by)), np.full(len(by), self.ROOT), 0
        running = len(by)
        for step in range(int(lengths[0]) if len(by) else 0):
            while lengths[running - 1] <= step:
                running -= 1
            place, now = begin[:running] + step, state[:running]
            gain = np.zeros(running)
            todo = np.arange(running)
            for m in range(order - 1, 0, -1):
                deep = self.depth[now[todo]] == m
                mine, rest = todo[deep], todo[~deep]
                arc = tokens.ids[m][place[mine]]
                known = self.seen[arc]
                went, failed = mine[known], mine[~known]
                gain[went] += self.arc[arc[known]]
                gain[failed] += self.failure[now[failed]]
                failures += int((quiet[failed] <= step).sum())
                now[failed] = self.shorter[now[failed]]
                now[went] = self.after[arc[known]]
                todo = np.concatenate([rest, failed])
            arc = tokens.ids[0][place[todo]]
            known = self.seen[arc]
            gain[todo] += np.where(known, self.arc[arc], self.unseen)
            now[todo] = np.where(known, self.after[arc], self.ROOT)
            score[:running] += np.where(quiet[:running] <= step, gain, 0.0) if step < order - 1 else gain
        return np.bincount(text[by], score, minlength=len(sizes)), failures


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", order: int = 2, smoothing: float = 500.0,
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)`` of each text.

    ``train`` tells the rows that the counts come from. ``score`` is the log10 probability of the
    text's tokens under the automaton of ``order``, ``base_score`` the add-one unigram one, ``n_known`` the tokens
    seen in training. A NULL or empty text has one token, its end. NULL in ``train`` is false. Without any training row
    ``base_score`` and ``score`` are 0. Repeated rows count and are scored as often as they occur.
    """
    chunks = chunk_count(docs, text, chunk_bytes)
    dealt = docs.select(F.col(id_col), F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"),
                        chunk_of(F.col(id_col), F.col(text), chunks=chunks).alias("_chunk"))

    def own_counts(group: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray]:
        tokens = Tokens(group.column("_text"), order)
        learn = group.column("_train").to_numpy().astype(np.int64)
        keys = tokens.numbered()
        return tokens, keys, tokens.counts(learn, len(keys)).astype(np.uint32)

    def by_part(keys: np.ndarray) -> list[np.ndarray]:
        """The places of the keys of each part, in ascending order of the keys."""
        part = (mix(keys) % np.uint64(chunks)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[by], np.arange(chunks + 1))
        return [by[edges[p]:edges[p + 1]] for p in range(chunks)]

    def listed(group: pa.Table) -> pa.Table:
        _, keys, counts = own_counts(group)
        cut = by_part(keys)
        chunk = group.column("_chunk")[0].as_py()
        return pa.table({"_part": pa.array(range(chunks), pa.int32()), "_chunk": pa.array([chunk] * chunks, pa.int32()),
                         "keys": pa.array([planes(keys[c]) for c in cut], pa.binary()),
                         "counts": pa.array([planes(counts[c]) for c in cut], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        own = [from_planes(x, np.uint64) for x in group.column("keys").to_pylist()]
        counts = np.concatenate([from_planes(x, np.uint32) for x in group.column("counts").to_pylist()])
        edges = np.cumsum([len(k) for k in own])[:-1]
        distinct, back = np.unique(np.concatenate(own), return_inverse=True)
        totals = np.bincount(back, counts, minlength=len(distinct)).astype(np.uint64)
        unigram = totals[(distinct & np.uint64(7)) == 0]
        n_tokens, n_types = int(unigram.sum()), int((unigram > 0).sum())
        rows = group.num_rows
        # A chunk knows the order of its own keys: the totals alone go back.
        return pa.table({"_chunk": group.column("_chunk").cast(pa.int32()), "_part": group.column("_part").cast(pa.int32()),
                         "tokens": pa.array([n_tokens] * rows, pa.int64()), "types": pa.array([n_types] * rows, pa.int64()),
                         "totals": pa.array([planes(t) for t in np.split(totals[back], edges)], pa.binary())})

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("_train", BooleanType()),
                         *[StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                         *[StructField(c, DoubleType()) for c in ("base_score", "score")]])

    def scored(group: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, keys, counts = own_counts(group)
        counts = counts.astype(np.int64)
        places = by_part(keys)
        for part, totals in zip(answers.column("_part").to_pylist(), answers.column("totals").to_pylist()):
            counts[places[part]] = from_planes(totals, np.uint64).astype(np.int64)
        n, v = sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())
        known, base, full = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if group.num_rows:
            known = counts[tokens.ids[0]]
            base = np.log10((known + 1) / (n + v + 1)) if n else np.zeros(len(known))
            full = Automaton(tokens, counts, n, v, smoothing).walk(tokens)[0] if n else np.zeros(group.num_rows)
        return pa.Table.from_arrays([
            group.column(id_col), group.column("_train"), pa.array(np.diff(tokens.offsets), pa.int64()),
            pa.array(sums_of((known > 0).astype(np.int64), tokens.offsets), pa.int64()), pa.array(np.full(group.num_rows, n), pa.int64()),
            pa.array(sums_of(base, tokens.offsets).astype(np.float64)), pa.array(full)], schema.names)

    placed = dealt.groupBy("_chunk")
    answers = placed.applyInArrow(listed, "_part int, _chunk int, keys binary, counts binary").groupBy("_part").applyInArrow(
        added, "_chunk int, _part int, tokens bigint, types bigint, totals binary")
    return placed.cogroup(answers.groupBy("_chunk")).applyInArrow(scored, schema).drop("_train")
