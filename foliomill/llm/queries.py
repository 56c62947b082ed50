"""The queries of this folder by name: each takes a session and a data folder and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import (
    conversations, language_model, mixing, neighbours, packing, quality, sharding, simhash, substrings, toxicity, url_filters, whitening, wrappers,
)
from foliomill.llm.words import WORD, ship
from foliomill.sources.tables import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @wraps(fn)
    def shipped(spark, sf):
        ship(spark)
        return fn(spark, sf)

    REGISTRY[fn.__name__] = shipped
    return shipped


def crc_of_id(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op1_nn_descent(spark, sf):
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


@query
def op2_adaptive_quality(spark, sf):
    judged = quality.judge(read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


@query
def op3_wrapper_text(spark, sf):
    pages = wrappers.extract(read_table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op4_backoff_automaton(spark, sf):
    held_out = F.coalesce(crc_of_id(7) == 2, F.lit(False))
    scored = language_model.score(read_table(spark, sf, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_kd_shards(spark, sf):
    rows = read_table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("content"))
    sharded = sharding.kd_shards(rows, ["lang", "source", "n_chars"], "size", 40, group="content")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "together")


@query
def op6_fm_substrings(spark, sf):
    found = substrings.repeated_words(read_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_simhash_near_dedup(spark, sf):
    found = simhash.near_duplicates(read_table(spark, sf, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op8_cost_packing(spark, sf):
    packed = packing.pack(read_table(spark, sf, "documents").select("doc_id", "text"), packing.tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_toxicity(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(crc_of_id(4) != 2), toxicity.labels_of(read_table(spark, sf, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_of_id(4) == 2, F.lit(False)).alias("held_out"), "score", toxicity.predicted().alias("predicted"))


@query
def op10_pivotal_mix(spark, sf):
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    docs = read_table(spark, sf, "documents").select("doc_id", "source", size.alias("size"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op11_url_automaton(spark, sf):
    return url_filters.judge(read_table(spark, sf, "pages").select("page_id", "url"))


@query
def op12_chebyshev_whitening(spark, sf):
    return whitening.whiten(read_table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op13_target_alignment(spark, sf):
    return conversations.repair(conversations.damage(read_table(spark, sf, "conversations")), present="present")
