import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pytest import approx as pytest_approx

from pyspark.sql import functions as F

from foliomill.llm import language_model as L


def tokens_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*folded.encode().split(), None]


def reference(rows, order, smoothing):
    grams = Counter()
    train = 0
    for _, text, learn in rows:
        if learn:
            t = tokens_of(text)
            train += len(t)
            grams.update(tuple(t[i:i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    types = sum(len(g) == 1 for g in grams)

    def p(word, history):
        if not history:
            c = grams[(word,)]
            return (c or types) / (train + types)
        h = grams[history]
        lower = p(word, history[1:])
        return (grams[(*history, word)] + smoothing * lower) / (h + smoothing) if h else lower

    out = {}
    for i, text, _ in rows:
        t = tokens_of(text)
        base = sum(math.log10((grams[(w,)] + 1) / (train + types + 1)) for w in t)
        full = sum(math.log10(p(w, tuple(t[max(0, k - order + 1):k]))) for k, w in enumerate(t))
        out[i] = (len(t), sum(grams[(w,)] > 0 for w in t), train, base, full)
    return out


def test_scores_match_the_definition(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "ça", "Ça", "d.", "e", "f\x1cg"]
    texts = [None, "", "  ", "unseen words only"] + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(80)]
    rows = [(i, t, i % 7 != 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, learn boolean, score double")
    for order, size in ((1, 1 << 20), (2, 300), (3, 700)):
        expected = reference(rows, order, 5.0)
        got = L.score(docs, F.col("learn"), order=order, smoothing=5.0, chunk_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            n, known, train, base, full = expected[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, full, rel_tol=1e-9)


def test_failure_arcs_are_taken_where_an_arc_is_missing(monkeypatch):
    """States and failures counted by hand-written rules over the n-grams of the training texts."""
    rng = random.Random(6)
    train = [" ".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(12)]
    asked = [" ".join(rng.choices("abcdxy", k=rng.randrange(0, 15))) for _ in range(40)]
    for order in (1, 2, 3, 4):
        grams = Counter()
        for t in map(tokens_of, train):
            grams.update(tuple(t[i:i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
        expected = 0
        for t in map(tokens_of, asked):
            history = ()
            for w in t:
                while history and not grams[(*history, w)]:
                    history, expected = history[1:], expected + 1
                history = (*history, w)[-(order - 1):] if order > 1 and grams[(*history, w)] else ()
        tokens = L.Tokens(pa.array(train + asked), order)
        keys = tokens.numbered()
        counts = tokens.counts(np.array([1] * len(train) + [0] * len(asked)), len(keys))
        n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
        only = L.Tokens(pa.array(asked), order)
        whole = L.Automaton(tokens, counts, n, v, 5.0)
        at = tokens.offsets[len(train)]
        only.ids = [ids[at:] for ids in tokens.ids]  # the numbers of the whole table
        want = reference([(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(asked)], order, 5.0)
        for stride in (1, 2, 3, 512):
            monkeypatch.setattr(L, "STRIDE", stride)
            scores, failures = whole.walk(only)
            assert failures == expected
            assert scores.tolist() == pytest_approx([want[100 + i][4] for i in range(len(asked))])


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "a b a c a b", True)] + [(i, f"a {w}", False) for i, w in enumerate(["a", "b", "c", "zz"], 1)] + [(5, "a", False)],
                                 "doc_id bigint, text string, learn boolean")
    got = {r.doc_id: r.score for r in L.score(docs, F.col("learn")).collect()}
    # P(next | a) over all words and the end; each text's remaining factors are taken off.
    ends = reference([(0, "a b a c a b", True)], 2, 500.0)
    rows = [(0, "a b a c a b", True)]
    full = {w: reference(rows + [(9, f"a {w}", False)], 2, 500.0)[9][4] for w in ["a", "b", "c", "zz"]}
    assert ends and all(math.isclose(got[i], full[w], rel_tol=1e-9) for i, w in enumerate(["a", "b", "c", "zz"], 1))
    total = 7 + 4

    def p(word_count, pair_count):
        return (pair_count + 500 * word_count / total) / (3 + 500)

    assert math.isclose(p(3, 0) + p(2, 2) + p(1, 1) + p(1, 0) + p(4, 0), 1.0)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", None), (None, "b", False), (1, "a", None)], "doc_id bigint, text string, learn boolean")
    got = L.score(docs, F.col("learn")).collect()
    assert len(got) == 3 and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert L.score(docs.limit(0), F.col("learn")).count() == 0
