import pytest

from marlstone.operators import ranking, sized, versions
from marlstone.operators.ranking import running_position


@pytest.mark.parametrize("pick", [versions.newest, versions.newest_of_few])
def test_newest(spark, pick):
    rows = [(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (2, None, "null version"), (2, 0, "known"), (None, 1, "a"), (None, 2, "b"), (3, 5, "tie x"), (3, 5, "tie y"), (4, 1, None)]
    df = spark.createDataFrame(rows, "k long, v int, t string")
    found = {r.k: r.t for r in pick(df, ["k"], ["v"]).collect()}
    assert found == {1: "new", 2: "known", None: "b", 3: found[3], 4: None} and found[3] in ("tie x", "tie y")
    assert pick(df, ["k"], ["v"]).count() == 5 and pick(df, ["k"], ["v"]).columns == df.columns
    assert pick(df.limit(0), ["k"], ["v"]).count() == 0
    assert pick(df.select("k"), ["k"]).count() == 5


def test_many_repeated_keys_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sized, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k long, v int")
    assert sorted(map(tuple, versions.newest_of_few(df, ["k"], ["v"]).collect())) == [(1, 2), (2, 1)]


def test_broadcast_is_decided_by_size(spark):
    stored = sized.sized(spark.range(1000).withColumnRenamed("id", "k"))
    plan = lambda: spark.range(100_000_000).withColumnRenamed("id", "k").join(stored, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and sized.fits(stored)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100)
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 502), (502, 500), (7, 7), (None, 3), (900, 800), (900, 800)]
    found = {r.node: r.component for r in sized.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {**{i: 1 for i in range(1, 201)}, **{i: 500 for i in (500, 501, 502)}, 800: 800, 900: 800}
    assert sized.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 2), ("a", 1.0, 1), (None, 5.0, 1), ("b", None, 1)], "k string, v double, t int")
    assert {(r.k, r.v, r.t): r.position for r in running_position(df, ["k"], "v", ["t"]).collect()} == {("a", 1.0, 1): 1, ("a", 1.0, 2): 2, ("a", 2.0, 1): 3, (None, 5.0, 1): 1, ("b", None, 1): 1}


def test_positions_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP_ROWS", 50)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 20)
    df = spark.createDataFrame([("hot", 1.0 if i % 10 else None, (i * 7) % 400, "clash") for i in range(400)] + [("few", 1.0, i, "clash") for i in range(5)], "k string, v double, t int, position string")
    found = {k: [r.position for r in sorted((r for r in rows if r.k == k), key=lambda r: (r.v is not None, r.v or 0, r.t))] for rows in [running_position(df, ["k"], "v", ["t"]).collect()] for k in ("hot", "few")}
    assert found == {"hot": list(range(1, 401)), "few": list(range(1, 6))}
