import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import neardup


def brute(texts, words, threshold):
    def shingles(t):
        w = neardup._WORD.findall(t.lower())
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = {i: s for i, t in texts if t and (s := shingles(t))}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    out = []
    for g in range(60):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(30, 200))]
        out += [edited(rnd, base, e) for e in range(rnd.randint(1, 5))]
    boiler = "the budget of this project covers nothing at all " * 3
    out += [boiler + edited(rnd, [f"b{rnd.randrange(9000)}" for _ in range(60)], 1) for _ in range(150)]
    return list(enumerate(out)) + [(9000, None), (9001, ""), (9002, "too short"), (9003, out[0]), (9004, out[0])]


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.5), (5, 0.8)])
def test_all_pairs_against_brute_force(spark, texts, words, threshold):
    df = spark.createDataFrame(texts, "id long, text string")
    sets = neardup.token_sets(df, "id", "text", neardup.WordShingles(words, words))
    found = {tuple(r) for r in neardup.all_pairs(*neardup.similar_sets(sets, threshold)).collect()}
    wanted = brute(texts, words, threshold)
    assert not found - wanted and len(found) >= 0.98 * len(wanted) and len(wanted) > 50


def test_large_nodes_are_compared_in_blocks(spark, monkeypatch):
    """Near copies that agree in nearly every slot never leave their node."""
    monkeypatch.setattr(neardup, "NODE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 12)
    base = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join([*base, f"tail{i}"])) for i in range(40)]
    df = spark.createDataFrame(texts, "id long, text string")
    links, members = neardup.similar_sets(neardup.token_sets(df, "id", "text", neardup.WordShingles()), 0.8)
    assert links.count() == 40 * 39 // 2 and members.count() == 40


def test_trees_grow_with_the_levels(spark, texts, monkeypatch):
    needed = [neardup.trees_for([1.0] * d, 0.5) for d in range(9)]
    assert needed == sorted(needed) and needed[3] <= neardup.TREES < needed[8] and neardup.trees_for([1.0] * 8, 0.8) <= neardup.TREES
    assert neardup.trees_for([0.1, 0.01, 0.01, 0.01, 0.01], 0.5) <= neardup.TREES
    assert abs(neardup.expected_recall([1.0], 8, 0.5) - (1 - (1 - 0.375) ** 8)) < 1e-9
    monkeypatch.setattr(neardup, "NODE", 3)
    monkeypatch.setattr(neardup, "RECALL", 0.98)
    grown = []
    real = neardup._grow
    monkeypatch.setattr(neardup, "_grow", lambda s, t, first, n, d: grown.append((first, n)) or real(s, t, first, n, d))
    df = spark.createDataFrame(texts, "id long, text string")
    sets = neardup.token_sets(df, "id", "text", neardup.WordShingles(3, 3))
    found = {tuple(r) for r in neardup.all_pairs(*neardup.similar_sets(sets, 0.5, 4)).collect()}
    wanted = brute(texts, 3, 0.5)
    assert grown[0] == (0, 4) and grown[1][0] == 4
    assert not found - wanted and len(found) >= 0.98 * len(wanted)


def test_groups(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string").withColumn("group_id", F.lit("clash")).withColumn("rep", F.lit(1))
    df = df.unionByName(df.limit(5))
    found = {r.id: r for r in neardup.near_duplicates(df, "id", "text", 3, 0.5).collect()}
    assert found[0].group_id == found[9003].group_id == found[9004].group_id == 0
    assert found.keys() == {i for i, _ in texts}
    assert all(found[i].group_id == i and found[i].links == 0 for i in (9000, 9001, 9002))
    parent = {i: i for i in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(texts, 3, 0.5):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert sum(found[i].group_id == root(i) for i in found) >= 0.98 * len(found)


def test_names_stay_in_their_tenant(spark):
    rows = [(1, "u", "x/Quarterly report final.md"), (2, "u", "y/quarterly-report-final2.pdf"), (3, "v", "Quarterly report final.md"), (4, "u", ".md"), (5, None, "Quarterly report final.md"), (6, "u", None), (7, "u", "a.b")]
    df = spark.createDataFrame(rows, "id long, user_id string, path string")
    sets = neardup.token_sets(df, "id", "path", neardup.NameGrams(3), "user_id")
    assert {tuple(r) for r in neardup.all_pairs(*neardup.similar_sets(sets, 0.5)).collect()} == {(1, 2)}


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert neardup.near_duplicates(df, "id", "text").count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "id long, text string")
    assert [tuple(r) for r in neardup.near_duplicates(one, "id", "text").collect()] == [(1, 1, 0)]
