"""The queries of the folder, run whole at the smallest scale, and against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from foliomill.llm.queries import REGISTRY
from foliomill.llm.sql import ORACLE

COLUMNS = {
    "op1_nn_descent": ["query_id", "rank", "vec_id", "score"],
    "op2_adaptive_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_wrapper_text": ["page_id", "url", "text", "n_chars"],
    "op4_backoff_automaton": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_kd_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_fm_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op8_cost_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_pivotal_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_url_automaton": ["page_id", "host", "path", "rule", "verdict"],
    "op12_chebyshev_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_target_alignment": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


def test_names():
    assert set(REGISTRY) == set(COLUMNS) and set(ORACLE) <= set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, sf, name):
    got = REGISTRY[name](spark, sf).toPandas()
    assert set(COLUMNS[name]) <= set(got.columns)
    if "doc_id" in COLUMNS[name] and name != "op8_cost_packing":
        assert sorted(got.doc_id) == list(range(200))
    if name in ORACLE:
        con = duckdb.connect()
        for table in ("documents", "pages", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        theirs = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(theirs.columns)
        rows = [sorted(f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None), key=repr) for f in (got, theirs)]
        assert rows[0] == rows[1]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        assert [t for _, t in now.dtypes] == [t for _, t in docs.dtypes], name
        seen.append(now.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    copies = [r["count"] for r in now.groupBy("doc_id").count().collect()]
    assert set(copies) <= {1, 2}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).toPandas()
    assert packed.length.groupby(packed.sequence_id).sum().max() <= 2048
    assert corpus_pipeline.run(spark, sf).toPandas().length.sum() == packed.length.sum()


def test_stages_take_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 300, "en", None, 600)], docs.schema)
    clashing = odd.selectExpr("*", "'a' AS _key", "'b' AS _row", "'c' AS _removed", "'d' AS _score", "'e' AS kept", "'f' AS copies", "'g' AS _n")
    for table in (odd, odd.limit(0), odd.where("doc_id IS NULL"), clashing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            out.count()
            if name != "pack":
                assert out.columns == table.columns
                assert "_key" not in out.columns or {tuple(r)[5:] for r in out.collect()} <= set([tuple("abcdefg")])
