"""Quality rules with thresholds that adapt to each language and source.

Every text gets a few measures. Their distributions are kept as mergeable quantile sketches: counts of
logarithmic bins, by language, source and measure. Sketches merge by adding up counts, so those of a language, or of
all rows, come from the same table, and results do not depend on the order of the rows. The limits
are fences around the tails; documents are joined with the limits of their group.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.words import mix, rows_of, slices, sums_of, word_codes, written

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REPEAT_WINDOW = 5
GAMMA = 1.02  # a bin spans 2 %
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_punctuation")

# Of each measure: its expression, its least spread (for distributions next to no width), and whether low values are bad too.
_WORDS = "greatest(n_words, 1)"
MEASURES = {
    "word_length": (f"word_chars / {_WORDS}", 0.1, True),
    "symbols": (f"n_symbols / {_WORDS}", 0.01, False),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.03, False),
    "repeats": (f"n_repeat_words / {_WORDS}", 0.02, False),
    "capitals": ("n_upper / greatest(n_letters, 1)", 0.01, False),
    "punctuation": (f"n_punctuation / {_WORDS}", 0.02, False),
}


def _byte_sums(texts: pa.Array, chosen: bytes) -> np.ndarray:
    """How many bytes of each text are among the chosen ones."""
    table = np.zeros(256, np.uint8)
    table[list(chosen)] = 1
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(len(texts), np.int64)
    hits = table[np.frombuffer(data, np.uint8)[edges[0]:edges[-1]]]
    return sums_of(hits.astype(np.int64), edges - edges[0])


def repeat_words(offsets: np.ndarray, codes: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Of each row, the words within windows that occur twice or more in the row."""
    row = rows_of(offsets)
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(len(offsets) - 1, np.int64)
    starts = np.flatnonzero(row[:n] == row[window - 1:])
    key = mix(row[starts].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        key = mix(key * np.uint64(3) + codes[starts + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    double = np.zeros(len(key), bool)
    double[order[1:][same]] = True
    double[order[:-1][same]] = True
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, starts[double], 1)
    np.add.at(change, starts[double] + window, -1)
    return sums_of((np.cumsum(change)[:-1] > 0).astype(np.int64), offsets)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
    return len(lines), len(lines) - len(set(lines))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and the counts of each whole text. NULL counts as empty."""
    keep = [c for c in docs.columns if c != text and c not in COUNTS]
    schema = docs.select(*keep, *[F.lit(0).cast("bigint").alias(c) for c in COUNTS]).schema
    upper, lower = bytes(range(65, 91)), bytes(range(97, 123))

    def task(batches):
        for part in slices(batches, text):
            texts = pc.fill_null(part.column(text), "")
            offsets, codes, words = word_codes(texts)
            of_word = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            lines = np.array([_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
            capitals = _byte_sums(texts, upper)
            counts = {
                "n_words": np.diff(offsets), "word_chars": sums_of(of_word[codes] if len(codes) else codes.astype(np.int64), offsets),
                "n_symbols": _byte_sums(texts, SYMBOLS), "n_dup_lines": lines[:, 1], "n_repeat_words": repeat_words(offsets, codes),
                "n_lines": lines[:, 0], "n_upper": capitals, "n_letters": capitals + _byte_sums(texts, lower),
                "n_punctuation": _byte_sums(texts, PUNCTUATION)}
            yield pa.RecordBatch.from_arrays([part.column(c) if c in keep else pa.array(counts[c], pa.int64()) for c in schema.names], schema.names)

    return docs.mapInArrow(task, schema)


def _bin(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / log(GAMMA)).cast("int")).otherwise(-(1 << 20))


def _bin_value(bin_no: Column) -> Column:
    return F.when(bin_no == -(1 << 20), 0.0).otherwise(F.pow(F.lit(GAMMA), bin_no - 0.5))


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, measure, bin, n)``: the quantile sketch of every measure in every group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(e).cast("double").alias("value")) for k, (e, _, _) in MEASURES.items()]))
    rows = counted.where("n_words > 0").select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("m"))
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), _bin(F.col("m.value")).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], **wanted: float) -> DataFrame:
    """The quantiles by name and ``rows`` of each measure, by the keys: sketches are merged first."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    # At most one row per bin, whatever the number of documents.
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bin"))
    ranked = merged.select(*keys, "measure", "bin", upto.alias("upto"), F.sum("n").over(group).alias("rows"))

    def at(q):
        return F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bin")))

    return ranked.groupBy(*keys, "measure").agg(*[_bin_value(at(q)).alias(name) for name, q in wanted.items()], F.max("rows").alias("rows"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``low``, ``high`` (quartiles) and ``rows`` of each measure, by the keys."""
    return quantiles(sketch, keys, low=0.25, high=0.75)


def limits(sketch: DataFrame, fence: float = 5.0, weight_rows: int = 100) -> DataFrame:
    """``(lang, source, measure, floor, ceiling)``.

    A limit lies ``fence`` spreads off the median; the spread of a side is the distance of its tail (the 10 % or 90 %
    quantile) from the median, at least the measure's least. A group of n rows has a say of n / (n + ``weight_rows``) in its limits and its language the
    rest, as the language has against all rows: no number of rows makes them jump. No limit of a group goes further than
    twice that of its language from the middle: a source that is mostly junk does not set its own standard.
    """
    least = F.create_map(*[F.lit(x) for k, (_, s, _) in MEASURES.items() for x in (k, s)])
    two_sided = F.col("measure").isin([k for k, (_, _, both) in MEASURES.items() if both])

    def fenced(keys, tag):
        q = quantiles(sketch, keys, low=0.1, middle=0.5, high=0.9)

        def spread(distance):
            return F.greatest(distance, F.element_at(least, F.col("measure")))

        return q.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], F.col("measure").alias(f"{tag}_measure"),
                        F.when(two_sided, F.col("middle") - fence * spread(F.col("middle") - F.col("low"))).otherwise(F.lit(float("-inf"))).alias(f"{tag}_floor"),
                        (F.col("middle") + fence * spread(F.col("high") - F.col("middle"))).alias(f"{tag}_ceiling"), F.col("rows").alias(f"{tag}_rows"))

    own, of_lang, of_all = fenced(["lang", "source"], "own"), fenced(["lang"], "lang"), fenced([], "all")
    rows = own.join(of_lang, own.own_lang.eqNullSafe(of_lang.lang_lang) & (own.own_measure == of_lang.lang_measure)).join(
        of_all, F.col("own_measure") == F.col("all_measure"))

    def blended(own, n, parent):
        # Without a lower limit both are infinite.
        say = F.col(n) / (F.col(n) + weight_rows)
        return F.when(own == parent, own).otherwise(say * own + (1 - say) * parent)

    def pick(side, bound):
        parent = blended(F.col(f"lang_{side}"), "lang_rows", F.col(f"all_{side}"))
        return blended(bound(F.col(f"own_{side}"), parent), "own_rows", parent)

    return rows.select(F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), F.col("own_measure").alias("measure"),
                       pick("floor", lambda own, parent: F.greatest(own, parent - F.abs(parent))).alias("floor"),
                       pick("ceiling", lambda own, parent: F.least(own, 2 * parent)).alias("ceiling"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fence: float = 5.0, weight_rows: int = 100) -> DataFrame:
    """The columns of ``docs`` but the text, its counts, ``base_failed``, ``kept`` and ``reasons``.

    ``base_failed``: fewer than 10 words, or more than 20 % of them in repeated 5-word windows. ``reasons``
    lists the measures outside the limits of the document's language and source (NULL is a group). All rows
    come back; repeated rows are judged alike. A text of any length is counted whole. Columns named like a result are an error.
    """
    results = {*COUNTS, "base_failed", "kept", "reasons", "_limits", "_lang", "_source"}
    if clash := results & {c.lower() for c in docs.columns}:
        raise ValueError(f"{sorted(clash)} are columns of the result: pass them under other names")
    counted = written(text_counts(docs, text), "counts")
    found = limits(sketches(counted, lang, source), fence, weight_rows)
    wide = found.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("floor", "ceiling")))).alias("_limits"))
    wide = wide.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_limits")
    # The limits are a row per group; the optimizer broadcasts them if they are small, else a hot source is split.
    rows = counted.join(wide, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")

    def outside(k, expression):
        value, bound = F.expr(expression), F.element_at("_limits", F.lit(k))
        return F.when((value < bound["floor"]) | (value > bound["ceiling"]), F.lit(k))

    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    reasons = F.array_compact(F.array(*[outside(k, e) for k, (e, _, _) in MEASURES.items()]))
    return rows.withColumns({"base_failed": failed, "reasons": reasons}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("_limits")
