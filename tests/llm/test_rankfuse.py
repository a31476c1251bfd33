import itertools
import math
import random

from pyspark.sql import functions as F

from marlstone.llm import rankfuse
from marlstone.operators import ranking

KIND = "request long, item long, channel string, score double, at int"


def fused(df, **more):
    return rankfuse.aggregate_ranks(df, "request", "item", version="at", **more)


def plain(rows):
    """Significance by the definition."""
    newest = {}
    for r, i, c, s, at in rows:
        key = (at, s is not None, -math.inf if s is None else s)
        if (r, i, c) not in newest or key > newest[r, i, c][0]:
            newest[r, i, c] = (key, s)
    scored = {k: v[1] for k, v in newest.items() if v[1] is not None and not math.isnan(v[1])}
    out = {}
    for r in {k[0] for k in scored}:
        items, channels = {k[1] for k in scored if k[0] == r}, sorted({k[2] for k in scored if k[0] == r})
        for i in items:
            ranks = []
            for c in channels:
                values = [scored[r, j, c] for j in items if (r, j, c) in scored]
                if (r, i, c) not in scored:
                    ranks.append(1.0)
                    continue
                s = scored[r, i, c]
                ranks.append((sum(v > s for v in values) + (sum(v == s for v in values) + 1) / 2) / len(items))
            m = len(ranks)
            tails = [sum(math.comb(m, j) * x**j * (1 - x) ** (m - j) for j in range(k, m + 1)) for k, x in enumerate(sorted(ranks), 1)]
            out[r, i] = min(1.0, min(tails) * m)
    return out, scored


def winners(scored):
    out = set()
    for r in {k[0] for k in scored}:
        items, channels = {k[1] for k in scored if k[0] == r}, {k[2] for k in scored if k[0] == r}
        get = lambda i, c: scored.get((r, i, c), -math.inf)  # noqa: B023, E731
        for i in items:
            if all(2 * sum((r, i, c) in scored and get(i, c) > get(j, c) or ((r, i, c) in scored and (r, j, c) not in scored) for c in channels) > len(channels) for j in items - {i}):
                out.add((r, i))
    return out


def data(seed):
    rnd = random.Random(seed)
    rows = []
    for r in range(25):
        for i, c in itertools.product(range(rnd.randint(1, 9)), rnd.sample(["a", "b", "c", "d", "e"], rnd.randint(1, 5))):
            for at in range(rnd.randint(0, 2)):
                rows.append((r, i, c, rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random() * 10 ** rnd.randint(-3, 6)]), at))
    return rows


def test_against_the_definition(spark):
    rows = data(1)
    df = spark.createDataFrame(rows, KIND).withColumn("ranks", F.lit("clash")).withColumn("position", F.lit(0))
    df = df.unionByName(df.limit(20))
    found = fused(df).collect()
    wanted, scored = plain(rows)
    assert {(r.request, r.item) for r in found} == wanted.keys()
    assert all(abs(r.significance - wanted[r.request, r.item]) < 1e-9 for r in found)
    for _, group in itertools.groupby(sorted(found, key=lambda r: (r.request, r.position)), key=lambda r: r.request):
        group = list(group)
        assert [r.position for r in group] == list(range(1, len(group) + 1))
        assert all((a.significance, a.mean, a.item) <= (b.significance, b.mean, b.item) for a, b in itertools.pairwise(group))
    assert {tuple(r) for r in rankfuse.majority_winners(fused(df), "request", "item").collect()} == winners(scored)


def test_requests_too_large_for_a_task(spark, monkeypatch):
    rows = data(3)
    df = spark.createDataFrame(rows, KIND)
    columns = ["request", "item", "significance", "mean", "position", "n", "ranks", "scored"]
    whole = sorted(map(tuple, fused(df).select(*columns).collect()))
    assert {tuple(r) for r in rankfuse.winners(df, "request", "item", version="at").collect()} == winners(plain(rows)[1])
    monkeypatch.setattr(rankfuse, "WHOLE", 15)
    monkeypatch.setattr(ranking, "GROUP_ROWS", 4)
    assert len(rankfuse._sides(df, "request", "item", "channel", "score", "at")) == 2
    assert sorted(map(tuple, fused(df).select(*columns).collect())) == whole
    assert {tuple(r) for r in rankfuse.winners(df, "request", "item", version="at").collect()} == winners(plain(rows)[1])


def test_winners_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(rankfuse, "FOLD", 2)
    rows = data(2)
    df = spark.createDataFrame(rows, KIND)
    assert {tuple(r) for r in rankfuse.majority_winners(fused(df), "request", "item").collect()} == winners(plain(rows)[1])


def test_hot_groups_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP_ROWS", 50)
    df = spark.createDataFrame([("g", float(i % 97), i, 1 + i % 3) for i in range(500)] + [("h", 1.0, 1, 1), (None, 1.0, 2, 1), ("h", None, 3, 1)], "k string, v double, t int, w int")
    for weight in (None, "w"):
        found = ranking.running_position(df, ["k"], "v", ["t"], weight=weight).collect()
        for k in ("g", "h", None):
            total = 0
            for r in sorted((r for r in found if r.k == k), key=lambda r: (r.v is not None, r.v or 0, r.t)):
                total += r.w if weight else 1
                assert r.position == total


def test_scale_does_not_matter(spark):
    rows = [(1, i, c, s, 0) for i in range(5) for c, s in (("small", i / 1e6), ("large", (4 - i) * 1e9), ("mid", float(i)))]
    order = lambda rows: [r.item for r in fused(spark.createDataFrame(rows, KIND)).orderBy("position").collect()]
    assert order(rows) == order([(r, i, c, math.atan(s), at) for r, i, c, s, at in rows])


def test_nothing(spark):
    df = spark.createDataFrame([(1, 1, "a", None, 0), (None, 1, "a", 1.0, 0)], KIND)
    assert fused(df).count() == 0
    assert rankfuse.majority_winners(fused(df), "request", "item").count() == 0
    assert rankfuse.winners(df, "request", "item", version="at").count() == 0
    lone = spark.createDataFrame([(1, 1, "a", 0.0, 0), (1, 2, "a", None, 0)], KIND)
    assert [tuple(r) for r in rankfuse.majority_winners(fused(lone), "request", "item").collect()] == [(1, 1)]
