"""From raw documents to packed training sequences, in five stages.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the
next one's documents. Rows repeated in all columns are told apart by number only, NULLs are kept as they
are, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import mixing, packing, simhash, substrings, toxicity
from foliomill.llm.words import WORD, ship, written
from foliomill.sources.tables import read_table

# The result holds a model's scores and token ids: SQL cannot express it.
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic.

    As in the query of the operator, a quarter of the labels is held out. A document without text stays.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), toxicity.labels_of(read_table(spark, sf_dir, "labels")))
    score = unused(docs, "_score")
    return toxicity.score(docs, model, out=score).where(toxicity.predicted(score) == 0).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicate documents the one with the smallest doc_id.

    The groups are those of the SimHash operator: fingerprints of four-word shingles at up to four bits, linked over any number
    of steps. Documents of one id are told apart by their text; of rows equal in both, one stays. Documents without
    words are equal.
    """
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content")))
    found = simhash.near_duplicates(keyed.select(key, "text"), key)
    first = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur elsewhere too.

    A document that loses words has its other words joined by one blank, and a new n_chars; any other
    document stays as it is, white space included.
    """
    others = [c for c in docs.columns if c != "text"]
    found = substrings.repeated_words(docs.select(F.struct(*others).alias("_row"), "text"), "_row", untouched=True)
    out = {c: F.col(f"_row.`{c}`") for c in others} | {"text": F.col("kept")}
    if "n_chars" in others:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    key, times = unused(docs, "_key"), unused(docs, "_times")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64(*docs.columns).alias("row")))
    mixed = mixing.mix_sources(keyed.select(key, "source", size.alias("size")), id_col=key)
    # Rows equal in all columns share a key; together they are taken as often as all of them are.
    copies = mixed.groupBy(key).agg(F.sum("copies").cast("int").alias(times)).where(F.col(times) > 0)
    rows = keyed.dropDuplicates([key]).join(copies, key)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of at most 2048."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_file())


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
