import random

import numpy as np
import xxhash

import corpus_pipeline
from foliomill.llm import simhash as S
from foliomill.llm.components import components


def reference_mark(text, size=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    rows = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def smallest_reachable(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(i, 900 + (i - 899) % 30) for i in range(900, 930)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    nodes = {x for link in links for x in link if link[0] != link[1]}
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == smallest_reachable(links, nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_match_all_pairs_in_split_buckets_as_well(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = set(base.tolist())
    for b in base[:8]:
        for _ in range(60):
            m = int(b)
            for k in rng.choice(64, rng.integers(1, 8), replace=False):
                m ^= 1 << int(k)
            marks.add(m)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    rows = spark.createDataFrame([(m, m) for m in signed], "fingerprint bigint, rep bigint")
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    expected = smallest_reachable(pairs, {x for p in pairs for x in p})
    for tile in (4, 512):
        got = {r.node: r.component for r in components(S.links(rows, tile=tile)).collect()}
        assert got == expected


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one two", "ONE two", "a\x0bb\x1cc d e"]
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.randrange(60, 400))
        texts += [" ".join(words), " ".join(words)]
        for _ in range(3):
            changed = list(words)
            for _ in range(rng.randrange(1, 4)):
                changed[rng.randrange(len(changed))] = "x"
            texts.append(" ".join(changed))
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    marks = {i: reference_mark(t) for i, t, _ in rows}
    pairs = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    expected = smallest_reachable(pairs, marks)
    got = S.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint & ((1 << 64) - 1) for r in got} == marks
    assert {r.doc_id: r.component_id for r in got} == expected
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]


def test_stage_keeps_one_document_of_each_group(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=200)) for _ in range(4)]
    rows = [(i, base[i % 4], "en", "a", 1) for i in range(40)] + [(7, base[0] + " x", "en", "a", 1), (None, "alone in the world", "en", None, None), (50, "", "en", "a", 0), (51, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = {k: reference_mark(t) for k, (_, t, *_) in enumerate(rows)}
    root = smallest_reachable([(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4], marks)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert len(kept) == len(set(root.values())) and {0, 1, 2, 3, None, 50} == {r.doc_id for r in kept}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
