import random
import tracemalloc

import numpy as np
import pyarrow as pa

from foliomill.llm import toxicity as T


def test_held_out_rows_are_told_apart(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdeilnorst", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(4000):
        words = rng.choices(vocabulary, k=rng.randrange(5, 120))
        if bad := i % 8 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zagrufo", "Zagrufen", "kuxump"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    train = docs.where("doc_id % 3 <> 0")
    model = T.fit(train, train.select("doc_id", "label"))
    got = T.score(docs.where("doc_id % 3 = 0"), model).withColumn("p", T.predicted()).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.p == r.label for r in got) >= 0.97 * len(got)
    again = T.fit(train.repartition(7), train.select("doc_id", "label").repartition(3))
    assert (again.weights == model.weights).all() and again.intercept == model.intercept


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 50_000, None)], "doc_id bigint, text string, score string")
    known = spark.createDataFrame([(1, "good", 0), (2, "bad", 1), (2, "bad", 1), (3, None, None)], "doc_id bigint, text string, label int")
    model = T.fit(known, known.select("doc_id", "label").distinct())
    got = T.score(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got if not r.text}) == 1
    assert T.score(docs.limit(0), model).count() == 0
    nothing = T.fit(docs, docs.selectExpr("doc_id", "1 as label").limit(0))
    assert all(r.score < 1e-9 for r in T.score(docs, nothing).collect())
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert [tuple(r) for r in T.labels_of(labels).collect()] == [(1, 1)]


def peak_mb(work):
    tracemalloc.start()
    work()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return peak / 1e6


def test_memory_of_ngrams_is_bounded():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(120_000)]
    texts = pa.array([" ".join(words[i:i + 60]) for i in range(0, len(words), 60)])
    rows = [(texts, np.arange(len(texts)) % 2)]
    assert peak_mb(lambda: T._fit(rows, {0: 2.0, 1: 1.0}, 18, 2, 1e-6)) < 70
    weights = np.random.default_rng(1).standard_normal(1 << 18).astype(np.float32)
    assert peak_mb(lambda: T.word_scores(pa.array(words), weights)) < 20
    # Pieces and blocks add up in the same order as the whole.
    owner, gram = map(np.concatenate, zip(*T.word_ngrams(words, 18)))
    assert (np.bincount(owner, weights[gram].astype(float)) == T.word_scores(pa.array(words), weights)).all()
    assert all((a == b).all() for a, b in zip((owner, gram), T.sample_ngrams(pa.array(words), 18)))
