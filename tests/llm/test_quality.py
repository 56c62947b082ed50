import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomill.llm import quality as Q


def counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", "\n\n", "a", "a b c d e a b c d e", "x " * 30, "é#\x1c &|\n\n é#\x1c &|\né#\x1c &|", "日本 $$\x0b<>"]
    texts += [rng.choice([" ", "\n"]).join(rng.choices(["aa", "b", "ç*", "Dd\n"], k=rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    for r in Q.text_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id]


def sample(n, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 10))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(60, 200))
        kind = "clean"
        if i % 10 == 0:
            kind = rng.choice(["symbols", "capitals", "bars", "loop"])
            words = {"symbols": [w + rng.choice(["%%%", "###"]) for w in words], "capitals": [w.upper() + "!!" for w in words],
                     "bars": [x for w in words for x in (w, "|")], "loop": [w for w in words[:10] for _ in range(15)]}[kind]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), kind))
    return rows


def test_junk_goes_and_clean_texts_stay(spark):
    rows = sample(3000)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kind string")
    got = Q.judge(docs).collect()
    assert len(got) == 3000
    assert sum(r.kept for r in got if r.kind == "clean") >= 0.995 * sum(r.kind == "clean" for r in got)
    assert not any(r.kept for r in got if r.kind != "clean")
    assert all(not r.kept for r in got if r.base_failed)


def test_quantiles_are_near_and_merge(spark):
    rng = random.Random(3)
    values = {(lang, source): [rng.randrange(20, 4000) for _ in range(300)] for lang in "xy" for source in "ab"}
    rows = [(100, v, lang, source) for (lang, source), vs in values.items() for v in vs]
    counted = spark.createDataFrame(rows, "n_words bigint, word_chars bigint, lang string, source string").selectExpr(
        "*", *[f"cast(0 as bigint) as {c}" for c in Q.COUNTS if c not in ("n_words", "word_chars")])
    sketch = Q.sketches(counted)
    for keys in (["lang", "source"], ["lang"]):
        for r in Q.quartiles(sketch, keys).where("measure = 'word_length'").collect():
            own = sorted(v / 100 for (lang, source), vs in values.items() for v in vs if lang == r.lang and ("source" not in keys or source == r.source))
            assert r.rows == len(own)
            assert abs(r.low / own[-(-len(own) // 4) - 1] - 1) < 0.02 and abs(r.high / own[-(-3 * len(own) // 4) - 1] - 1) < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "a b", "en", "s"), (1, "a b", "en", "s")], "doc_id bigint, text string, lang string, source string")
    got = Q.judge(docs).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept for r in got)
    assert Q.judge(docs.limit(0)).count() == 0
    assert Q.judge(docs.withColumn("floor", F.lit(1)).withColumn("measure", F.lit("x"))).count() == 3
    with pytest.raises(ValueError):
        Q.judge(docs.withColumn("n_words", F.lit(1)))


def test_limits_follow_the_tails_of_their_group(spark):
    rng = random.Random(5)
    rows = [(i, text, lang, source, kind) for i, text, lang, source, kind in sample(2000, seed=6) if kind == "clean"]
    rows += [(5000 + i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100)), "en", "a", "letters") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kind string")
    got = Q.judge(docs).collect()
    assert all("word_length" in r.reasons and not r.base_failed for r in got if r.kind == "letters")
    assert sum(r.kept for r in got if r.kind == "clean") >= 0.995 * sum(r.kind == "clean" for r in got)
    wide = [(i, 100, 400 + (i % 101 - 50) * 4, "en", "wide") for i in range(505)] + [(i, 100, 400 + (i % 101 - 50), "en", "narrow") for i in range(505)]
    counted = spark.createDataFrame(wide, "doc_id bigint, n_words bigint, word_chars bigint, lang string, source string").selectExpr(
        "*", *[f"cast(0 as bigint) as {c}" for c in Q.COUNTS if c not in ("n_words", "word_chars")])
    found = {r.source: r for r in Q.limits(Q.sketches(counted)).where("measure = 'word_length'").collect()}
    assert found["narrow"].floor > 0.5 and found["narrow"].ceiling - 4 < 0.5 * (found["wide"].ceiling - 4)


def test_verdicts_match_a_plain_computation(spark):
    """Limits from sorted bins of plain lists, blended by rows, and every verdict of texts that include very long ones."""
    rows = sample(600, seed=9) + [(9000, "word " * 300_000, "en", "a", "long"), (9001, " ".join(f"w{i}" for i in range(200_000)), "de", None, "long")]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    counted = {r.doc_id: r.asDict() for r in Q.text_counts(docs).collect()}
    names = {k: e.replace("greatest", "max") for k, (e, _, _) in Q.MEASURES.items()}
    value = {(i, k): eval(e, {"max": max}, c) for i, c in counted.items() for k, e in names.items()}

    def fences(ids, k):
        def bin_of(v):
            return -(1 << 20) if v <= 0 else math.ceil(math.log(v) / math.log(Q.GAMMA))

        bins = sorted(bin_of(value[i, k]) for i in ids)
        low, middle, high = ((0.0 if b == -(1 << 20) else Q.GAMMA ** (b - 0.5)) for b in (bins[max(0, math.ceil(q * len(bins)) - 1)] for q in (0.1, 0.5, 0.9)))
        least, both = Q.MEASURES[k][1:]
        return (middle - 5 * max(middle - low, least) if both else -math.inf), middle + 5 * max(high - middle, least), len(ids)

    def blend(own, n, parent):
        return own if own == parent else n / (n + 100) * own + 100 / (n + 100) * parent

    for i, r in got.items():
        c, expected = counted[i], []
        for k in Q.MEASURES:
            whole = CACHE[k] = CACHE.get(k) or fences(list(counted), k)
            lang = fences([j for j, x in counted.items() if x["lang"] == c["lang"]], k) if (k, c["lang"]) not in CACHE else CACHE[k, c["lang"]]
            CACHE[k, c["lang"]] = lang
            key = (k, c["lang"], c["source"])
            own = CACHE.setdefault(key, None) or fences([j for j, x in counted.items() if (x["lang"], x["source"]) == key[1:]], k)
            CACHE[key] = own
            parent = [blend(lang[s], lang[2], whole[s]) for s in (0, 1)]
            floor = blend(max(own[0], parent[0] - abs(parent[0])), own[2], parent[0])
            ceiling = blend(min(own[1], 2 * parent[1]), own[2], parent[1])
            if not floor <= value[i, k] <= ceiling:
                expected.append(k)
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        assert (r.reasons, r.base_failed, r.kept) == (expected, failed, not failed and not expected), i


CACHE: dict = {}
