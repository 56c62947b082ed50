"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its words, a word the set of its n-grams of characters, with a blank on
either side. The value of an n-gram in a text is how often the different words hold it,
divided by the square root of the number of different words. Each value is scaled by the log
ratio of the n-gram's shares in texts of either class; a logistic regression is fitted on the
scaled values. N-grams are hashed into a fixed number of weights, so a model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import give_back, mix, rows_of, slices, word_codes

SIZES = (3, 4, 5)
SLICE = 4 << 20
PIECE, BLOCK = 1 << 14, 1 << 18  # words whose n-grams are made at a time, entries added at a time
_FACTORS = mix(np.arange(1, max(SIZES) + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Model:
    """Weights of hashed n-grams (the log-count ratio multiplied in) and an intercept."""

    weights: np.ndarray
    intercept: float


def word_ngrams(words: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(word number, hashed n-gram)`` of each n-gram of each word, for each of ``SIZES``."""
    padded = [f" {w.lower()} " for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), [len(w) for w in padded])
    spread = mix(points + np.uint64(1))
    found = []
    value = np.zeros(len(points), np.uint64)
    for k, factor in enumerate(_FACTORS):  # value: of the k + 1 characters from here on
        value = value[: max(0, len(points) - k)] + spread[k:] * factor
        if k + 1 in SIZES:
            inside = np.flatnonzero(owner[: len(value)] == owner[k:])
            found.append((owner[inside], (value[inside] >> np.uint64(64 - bits)).astype(np.int32)))
    return found


def sample_ngrams(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, hashed n-gram)`` of each n-gram of all words, those of one size after the other."""
    pieces = []
    for k in range(0, len(words), PIECE):
        pieces.append([(owner + np.int32(k), gram) for owner, gram in word_ngrams(words.slice(k, PIECE).to_pylist(), bits)])
    empty = [np.zeros(0, np.int32)]
    return tuple(np.concatenate(empty + [piece[i][side] for i in range(len(SIZES)) for piece in pieces]) for side in (0, 1))


def word_scores(words: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of the n-grams of each word."""
    bits = int(len(weights)).bit_length() - 1
    sums = np.zeros(len(words))
    for k in range(0, len(words), PIECE):
        piece = words.slice(k, PIECE)
        owner, gram = map(np.concatenate, zip(*word_ngrams(piece.to_pylist(), bits)))
        sums[k:k + len(piece)] = np.bincount(owner, weights[gram].astype(np.float64), minlength=len(piece))
    return sums


def _sums(index: np.ndarray, values: Callable[[slice], np.ndarray], n: int) -> np.ndarray:
    """What ``np.bincount`` gives for the values, added in the same order, with room for one block of them."""
    out = np.zeros(n)
    for k in range(0, len(index), BLOCK):
        block = slice(k, k + BLOCK)
        np.add.at(out, index[block].astype(np.intp), values(block))
    return out


def distinct_words(offsets: np.ndarray, codes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, word)`` of each different word of each row."""
    pairs = np.unique(rows_of(offsets) * max(n_words, 1) + codes)
    return pairs // max(n_words, 1), pairs % max(n_words, 1)


def _fit(rows: list[tuple[pa.Array, np.ndarray]], weight_of: dict[int, float], bits: int, rounds: int, penalty: float) -> Model:
    texts = pa.concat_arrays([t for t, _ in rows])
    y = np.concatenate([label for _, label in rows]).astype(np.float64)
    offsets, codes, words = word_codes(texts)
    doc, word = (x.astype(np.int32) for x in distinct_words(offsets, codes, len(words)))
    n, v, m = len(y), len(words), 1 << bits
    del texts, offsets, codes
    gram_word, gram = sample_ngrams(words, bits)
    del words
    norm = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    row_weight = np.where(y == 1, weight_of[1], weight_of[0])
    row_weight = row_weight / row_weight.sum()

    def spread(values):  # from rows to n-grams
        scaled = values * norm
        of_word = _sums(word, lambda block: scaled[doc[block]], v)
        return _sums(gram, lambda block: of_word[gram_word[block]], m)

    def gathered(values):  # from n-grams to rows
        of_word = _sums(gram_word, lambda block: values[gram[block]], v)
        return _sums(doc, lambda block: of_word[word[block]], n) * norm

    positive, negative = spread(y) + 1, spread(1 - y) + 1
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    share = float(row_weight @ y)
    w, b = np.zeros(m), np.log(share / (1 - share))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(gathered(w * ratio) + b, -500, 500)))
        slope = (p - y) * row_weight
        step = np.append(ratio * spread(slope) + penalty * w, slope.sum())
        first = 0.9 * first + 0.1 * step
        second = 0.99 * second + 0.01 * step * step
        move = 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    return Model((w * ratio).astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", id_col: str = "doc_id",
        rows_per_class: int = 2000, bits: int = 18, rounds: int = 60, penalty: float = 1e-6) -> Model:
    """Fit a model on the texts of ``docs`` that ``labels`` (one label of each id) tells.

    The fit takes a bounded sample: of each class the ``rows_per_class`` ids with the smallest hash. It is
    drawn from ids alone; only the sampled texts are moved. Classes weigh as often as they occur among
    all labelled rows. One task fits the sample; the model (``2 ** bits`` weights) is all that the driver gets.
    Rows with a NULL label take no part, a NULL text is empty, of rows with one id one text is taken. Without rows of
    both classes the model is constant: class 1 if nothing else occurs, else 0.
    """
    one_of = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
    known = docs.select(F.col(id_col).alias("i")).distinct().join(one_of, "i")
    counts = dict(known.groupBy("y").count().collect())
    if len(counts) < 2:
        return Model(np.zeros(1 << bits, np.float32), 40.0 if 1 in counts else -40.0)
    order = [F.xxhash64("i", F.lit("sample")), "i"]
    chosen = known.where("y = 0").orderBy(*order).limit(rows_per_class).unionByName(known.where("y = 1").orderBy(*order).limit(rows_per_class))
    # At most 2 * rows_per_class ids: the broadcast has a fixed bound.
    sample = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    weight_of = {k: n / min(n, rows_per_class) for k, n in counts.items()}

    def task(batches):
        rows = [(b.column("t").fill_null(""), b.column("y").to_numpy(zero_copy_only=False)) for b in batches]
        if rows:
            model = _fit(rows, weight_of, bits, rounds, penalty)
            rows.clear()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])], ["w", "b"])

    # In a fixed order, so that a repeated fit adds up in the same order.
    one = sample.coalesce(1).sortWithinPartitions("y", *order).select("t", "y")
    w, b = one.mapInArrow(task, "w binary, b double").first()
    return Model(np.frombuffer(bytes(w), np.float32), b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of class 1 to each row, 0 to 1. A NULL or empty text scores by the intercept."""
    schema = docs.select(*[c for c in docs.columns if c != out], F.lit(0.0).alias(out)).schema
    names = schema.names

    def task(batches):
        for part in slices(batches, text, SLICE):
            offsets, codes, words = word_codes(part.column(text), lower=True)
            doc, word = distinct_words(offsets, codes, len(words))
            of_word = word_scores(words, model.weights)
            norm = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=part.num_rows), 1))
            z = np.bincount(doc, of_word[word], minlength=part.num_rows) * norm + model.intercept
            scores = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([scores if n == out else part.column(n) for n in names], names)

    return docs.mapInArrow(task, schema)


def predicted(score_col: str | Column = "score", threshold: float = 0.3) -> Column:
    """1 where the score reaches the threshold, else 0; a NULL score counts as 0."""
    col = F.col(score_col) if isinstance(score_col, str) else score_col
    return F.coalesce(col >= threshold, F.lit(False)).cast("int")


def labels_of(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One label of each id: the largest, where several are given; NULL ids and labels are left out."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
