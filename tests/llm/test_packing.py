import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomill.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, capacity):
    """Every id in one piece, sequences gapless and not too long, little padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for doc_id, text in rows:
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        ids = encoded(text)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist()
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == ids
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_seq)


def test_pieces_hold_all_ids(spark):
    rng = random.Random(1)
    odd = [None, "", " ", "Don't <|endoftext|>stop\x0bé é ́x ΑΣ ΑΣ. 12³   a b \x1c c", "日本語" * 900, "x" * 5000, "we'll 've'LL <|START"]
    words = ["alpha", "Beta,", "ÇA", "it's", "1234", "!?", "naïve", "ẛ̣", "İ"]
    rows = list(enumerate(odd + [" ".join(rng.choices(words, k=rng.randrange(0, 1500))) for _ in range(60)]))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, ids string")
    got = P.pack(docs, PATH, capacity=256).collect()
    total = sum(len(encoded(t)) for _, t in rows)
    assert check(rows, got, 256) == -(-total // 256)
    many = P.pack(docs, PATH, capacity=256, group_bytes=20_000).collect()
    groups = len({r.sequence_id >> 24 for r in many})
    assert groups > 3 and check(rows, many, 256) <= -(-total // 256) + groups
    crc = docs.sparkSession.createDataFrame([(got[0].ids,)], "ids binary").select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(got[0].ids)


def test_costs_are_balanced():
    lengths = np.array([100] * 8 + [50] * 16)
    rows = P.assign(lengths, 400)
    costs = defaultdict(float)
    for _, _, n, seq, _ in rows:
        costs[seq] += n + n * n / 2048
    assert len(costs) == 4 and max(costs.values()) - min(costs.values()) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert len(P.pack(docs, PATH).collect()) == 3
    assert P.pack(docs.limit(0), PATH).count() == 0


def test_remembered_words_are_not_copied():
    words = P.WordIds(PATH)
    words.words = pa.array([f"w{i}" for i in range(200_000)])
    words.offsets, words.ids = np.arange(200_001), np.arange(200_000, dtype=np.uint32)
    asked = ["w7", "unbelievably", "w199999", "w0"]
    tracemalloc.start()
    offsets, ids = words.of(pa.array(asked))
    offsets, ids = words.of(pa.array(asked))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    new = Tokenizer.from_file(PATH).encode("unbelievably", add_special_tokens=False).ids
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[7], new, [199999], [0]]
    assert len(words.words) == 200_001 and peak < 3_500_000


def test_words_beyond_the_memory_are_encoded_each_time(monkeypatch):
    monkeypatch.setattr(P, "CACHED", 3)
    monkeypatch.setattr(P, "ENCODED", 2)
    words, tokenizer = P.WordIds(PATH), Tokenizer.from_file(PATH)
    for asked in (["one", "x" * 70, "naïve"], [], ["two", "one", "three", "x" * 70, "four"], ["four", "two", "one"]):
        offsets, ids = words.of(pa.array(asked, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(w, add_special_tokens=False).ids for w in asked]
    assert words.words.to_pylist() == ["one", "naïve", "two"]
