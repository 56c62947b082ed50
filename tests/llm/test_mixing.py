import random
from collections import defaultdict

from pyspark.sql import functions as F

from foliomill.llm import mixing as M


def filled(sizes, weights, share=1.5, most=2.0):
    """Water filling, source by source."""
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_w = sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and weights[s] * rest / open_w >= most * sizes[s]} if open_w else set()
        if not over:
            return {s: most * sizes[s] if s in full else weights[s] * rest / open_w for s in sizes}
        full |= over


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 3, 10, 50, 50, 400]) for i in range(rng.randrange(1, 9))}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
        rows = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "source string, source_size bigint, w double")
        got = {r.source: r.target for r in M.source_targets(rows, F.col("w")).collect()}
        expected = filled(sizes, weights)
        assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def test_mass_is_kept_and_reruns_agree(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "é"]), rng.choice([None, 0, 1, 7, 50, 900])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = M.mix_sources(docs).collect()
    assert len(got) == 3000
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * (r.size or 0)
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 900 for s in target)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n or 0
    order = [*sorted(s for s in sizes if s is not None), None]
    expected = filled({s: sizes[s] for s in order}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert all(abs(target[s] - expected[s]) < 1e-6 for s in order)
    again = M.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_probabilities_hold_on_average(spark):
    rows = spark.range(40).select(F.lit("a").alias("source"), F.col("id").alias("row"), (F.col("id") % 5 + 1).alias("size"),
                                  (F.col("id") % 4 / 4 + 0.1).alias("p"))
    taken = defaultdict(int)
    runs = 60
    for seed in range(runs):
        for r in M.pivotal_rounding(rows, seed=seed, block=8).collect():
            taken[r.row] += r.take
    for k in range(4):
        share = sum(taken[i] for i in range(40) if i % 4 == k) / (10 * runs)
        assert abs(share - (k / 4 + 0.1)) < 0.08


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5)] * 300 + [(2, "b", 1)], "doc_id bigint, source string, size bigint")
    got = M.mix_sources(docs).collect()
    assert len(got) == 301 and abs(sum(r.copies * r.size for r in got if r.source == "a") - got[0].target) <= 5
