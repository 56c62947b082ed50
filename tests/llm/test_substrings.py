import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliomill.llm import substrings as S
from foliomill.llm.fm_index import FMIndex, repeated_windows, sorted_suffixes


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(t[i:i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((doc_id, len(t), sum(gone), b" ".join(w for w, g in zip(t, gone) if not g).decode()))
    return sorted(out, key=str)


def corpus(seed, vocabulary, n=60, longest=260):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randrange(20, 90)) for _ in range(6)]
    rows = [None, "", " \t", "one two", "z " * 200, "ab cd " * 60]
    for _ in range(n):
        t = rng.choices(words, k=rng.randrange(0, longest))
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(t) + 1)
            t[at:at] = p[rng.randrange(5):len(p) - rng.randrange(5)]
        rows.append(rng.choice([" ", "\n", " \x0b\t "]).join(t))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, vocabulary, size", [(1, 2000, 1 << 20), (2, 3, 3000), (3, 40, 2500)])
def test_all_repeated_windows_are_found(spark, monkeypatch, seed, vocabulary, size):
    rows = corpus(seed, vocabulary)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.repeated_words(docs, chunk_bytes=size).collect()), key=str)
    assert got == brute(rows, S.WINDOW)


def test_very_common_minimizers_are_split(spark):
    rows = corpus(4, 500, n=40)
    line = " ".join(f"c{i}" for i in range(12))
    rng = random.Random(5)
    rows += [(1000 + i, " ".join([*(f"x{rng.randrange(10**6)}" for _ in range(40)), line, *(f"y{rng.randrange(10**6)}" for _ in range(40))])) for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.repeated_words(docs).collect()), key=str)
    assert got == brute(rows, S.WINDOW)


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 5, 40), 0) for _ in range(30)])
    index = FMIndex(text, 5, 64)
    for _ in range(200):
        pattern = rng.integers(1, 5, rng.integers(1, 6))
        low, high = np.array([0]), np.array([len(text)])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        n = sum((text[i:i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1))
        assert high[0] - low[0] == n
    starts = np.arange(30) * 41
    masks = repeated_windows(index, text, np.arange(5) > 0, starts, starts + 40, 9)
    seen = Counter(tuple(text[s + i:s + i + 9]) for s in starts for i in range(32))
    assert masks.tolist() == [sum(1 << i for i in range(32) if seen[tuple(text[s + i:s + i + 9])] > 1) for s in starts]


def test_edges(spark):
    same = " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(1, same), (1, same), (None, "a")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in S.repeated_words(docs).collect()), key=str) == [(1, 50), (1, 50), (None, 0)]
    assert S.repeated_words(docs.limit(0)).count() == 0


def peak(work):
    tracemalloc.start()
    work()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most


def test_memory_of_a_shard_is_a_few_arrays():
    text = np.random.default_rng(3).integers(0, 5000, 1 << 18)
    assert peak(lambda: sorted_suffixes(text, 64)) < 5 * text.nbytes
    lines = pa.array([" ".join(f"w{i}" for i in range(k, k + 2000)) for k in range(150)])
    assert peak(lambda: S.Segments(lines, 35, 8)) < 120 * 300_000
