import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing

SIZES, TARGETS = "doc long, source string, n_tokens int", "source string, target_share double, max_repeats int"


def best_below(lengths, counts, budget):
    sums = {0}
    for size, n in zip(lengths, counts):
        sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= budget}
    return max(sums)


@pytest.mark.parametrize(("table", "back"), [(1 << 16, 4), (7, 1)])
def test_fit_is_the_best_there_is(table, back):
    rnd = random.Random(4)
    for _ in range(300):
        lengths = rnd.sample(range(1, 40), rnd.randint(1, 6))
        counts = [rnd.randint(1, 4) for _ in lengths]
        budget = rnd.randint(0, 200)
        taken = mixing.fit_lengths(np.array(lengths), np.array(counts), budget, table, back)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert int((taken * np.array(lengths)).sum()) == best_below(lengths, counts, budget)


def test_long_documents_and_large_budgets_are_fitted_exactly():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(200_000, 3_000_000, 50)) * 2
    counts = rng.integers(1, 4000, len(lengths))
    budget = int((lengths * counts).sum() // 3) // 2 * 2
    assert int((mixing.fit_lengths(lengths, counts, budget) * lengths).sum()) == budget
    assert list(mixing.fit_lengths(np.array([700]), np.array([10**9]), 1500)) == [2]


def test_fit_is_exact_where_small_documents_are_left():
    lengths, counts = np.array([1, 3, 50, 170]), np.array([40, 20, 30, 10])
    for budget in range(0, 3200, 37):
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert int((taken * lengths).sum()) == best_below([1, 3, 50, 170], [40, 20, 30, 10], budget) == min(budget, 3300)


def sizes(spark, n=400):
    rnd = random.Random(9)
    rows = [(i, s, rnd.randint(1, 80)) for i, s in zip(range(n), itertools.cycle(["a", "a", "a", "a", "b", "c", "unlisted"]))]
    return spark.createDataFrame([*rows, (9001, "a", 0), (9002, "empty", 0)], SIZES)


def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 4), ("absent", 0.1, 3), ("empty", 0.0, 3)], TARGETS)


def test_shares_are_met_within_repeats(spark):
    held, wanted = sizes(spark), targets(spark)
    mixed = mixing.mix(held, wanted)
    rows = {r.source: r for r in mixing.shares(mixed, wanted, held).collect()}
    assert abs(rows["a"].actual_share - 5 / 9) < 0.001 and abs(rows["b"].actual_share - 2 / 9) < 0.001 and abs(rows["c"].actual_share - 2 / 9) < 0.001
    assert rows["absent"].tokens == rows["unlisted"].tokens == rows["empty"].tokens == 0
    assert mixed.groupBy("doc").count().filter("count > 1").count() == 0
    most = {r.source: r.m for r in mixed.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 4
    assert rows["a"].tokens >= 0.99 * rows["a"].held_tokens  # the scarcest source is used up


def test_seed_and_total(spark):
    held, wanted = sizes(spark), targets(spark)
    ids = lambda **k: {(r.doc, r.copies) for r in mixing.mix(held, wanted, **k).collect()}
    assert ids(total=500) == ids(total=500)
    assert ids(total=500) != ids(total=500, seed=1)
    total = mixing.mix(held, wanted, total=500).agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert 480 <= total <= 501
    everything = mixing.mix(held, wanted, total=10**9)
    assert everything.filter("source = 'c'").agg(F.min("copies")).first()[0] == 4


def test_token_sizes_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "hello world", 0), (2, "a", None, 0), (3, None, "x", 0), (1, "a", "hello world", 0), (4, "a", "", 0)], "doc_id long, source string, text string, n_tokens int")
    assert sorted(tuple(r) for r in mixing.token_sizes(docs).collect()) == [(1, "a", 2), (2, "a", 0), (4, "a", 0)]
    assert mixing.mix(sizes(spark).limit(0), targets(spark)).count() == 0
    assert mixing.mix(sizes(spark), targets(spark).limit(0)).count() == 0
