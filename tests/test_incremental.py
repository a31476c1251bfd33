import pytest
from pyspark.sql import functions as F

from marlstone.operators import incremental
from marlstone.operators.incremental import CommitConflict, VersionedTable, pending, run_once, update_ledger

KIND = "k long, v string"


@pytest.fixture
def make(spark, tmp_path):
    return lambda name="t": VersionedTable(spark, f"{tmp_path}/{name}", KIND)


def rows(spark, *data):
    return spark.createDataFrame(list(data), KIND)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_are_immutable_and_deltas_exact(spark, make):
    t = make()
    assert t.read().count() == 0 and t.latest() == 0
    t.append(rows(spark, (1, "a"), (2, "b"), (2, "b"), (3, None)))
    t.delete(F.col("k") == 2)
    t.append(rows(spark, (4, "d")))
    t.delete(F.col("k").isin(1, 4))
    assert got(t.read(1)) == [(1, "a"), (2, "b"), (2, "b"), (3, None)]
    assert got(t.read(3)) == [(1, "a"), (3, None), (4, "d")]
    assert got(t.read()) == [(3, None)]
    assert got(t.changes(1, 2)) == [(2, "b", -2)]
    assert got(t.changes(1, 4)) == [(1, "a", -1), (2, "b", -2)]
    assert got(t.changes(4, 1)) == [(1, "a", 1), (2, "b", 2)]
    assert got(t.changes(0, 3)) == [(1, "a", 1), (3, None, 1), (4, "d", 1)]
    assert got(t.changes(2, 2)) == []


def test_rewritten_files_cancel_out(spark, make):
    t = make()
    t.append(rows(spark, (1, "a"), (2, "b")))
    t.overwrite(t.read().repartition(1).unionByName(rows(spark, (3, "c"))))
    assert got(t.changes(1, 2)) == [(3, "c", 1)]
    assert len(got(t.changes(1, 2, net=False))) == 5


def test_concurrent_commits_conflict(spark, make):
    t = make()
    base = t.manifest()
    files = t.stage(rows(spark, (1, "a")))
    t.commit(base, files)
    with pytest.raises(CommitConflict):
        t.commit(base, files)
    assert t.latest() == 1


def test_runs_survive_failures_without_skipping_or_repeating(spark, make):
    source, sink = make("source"), make("sink")
    for n in range(3):
        source.append(rows(spark, (n, "x"), (n, "x")))
        if n == 1:
            with pytest.raises(ZeroDivisionError):
                run_once(source, sink, lambda d: 1 / 0)
            sink.stage(source.changes(1, 2, net=False))  # died after writing
        if n != 0:
            run_once(source, sink, lambda d: d)
    assert run_once(source, sink, lambda d: d) == sink.latest()
    assert got(sink.read()) == [(n, "x") for n in range(3) for _ in range(2)]
    assert sink.manifest().processed == {"source": 3}


def test_the_log_is_summed_up_every_few_versions(spark, make, monkeypatch):
    monkeypatch.setattr(incremental, "CHECKPOINT", 3)
    t = make()
    for n in range(4):
        t.append(rows(spark, (n, "x")).coalesce(1))
    t.delete(F.col("k") == 1)
    t.append(rows(spark, (9, "y")).coalesce(1))
    t.delete(F.col("k") == 3)
    assert t._versions(whole=True) == [3, 6]
    read = []
    load = t._load
    t._load = lambda at: read.append(at) or load(at)
    assert got(t.read()) == [(0, "x"), (2, "x"), (9, "y")]
    assert len(read) == 2  # one manifest and the entry after it
    assert got(t.changes(4, 7)) == [(1, "x", -1), (3, "x", -1), (9, "y", 1)]


def test_repeated_deletes_do_not_write_older_vectors_again(spark, make):
    t = make()
    t.append(rows(spark, *[(n, "x") for n in range(20)]).repartition(4))
    t.delete(F.col("k") < 3)
    t.delete(F.col("k") < 6)
    t.delete(F.col("k") > 100)
    vectors = sorted({d for ds in t.manifest().deleted.values() for d in ds})
    assert [spark.read.parquet(v).count() for v in vectors] == [3, 3]
    assert t.read().count() == 14


def test_only_new_files_are_read(spark, make):
    t = make()
    t.append(rows(spark, (1, "a"), (2, "b")))
    old = set(t.manifest().files)
    t.append(rows(spark, (3, "c")))
    assert not old & set(t.changes(1, 2).inputFiles())


def test_vacuum_keeps_what_versions_refer_to(spark, make, tmp_path):
    t = make()
    rows(spark, (7, "z")).write.parquet(f"{tmp_path}/outside")
    t.adopt(f"{tmp_path}/outside")
    t.append(rows(spark, (1, "a"), (2, "b")))
    t.delete(F.col("k") == 1)
    t.stage(rows(spark, (5, "never")))
    assert t.vacuum() == 1
    assert got(t.read()) == [(2, "b"), (7, "z")]
    t.overwrite(t.read())
    assert t.vacuum() >= 2
    assert got(t.read()) == [(2, "b"), (7, "z")] and spark.read.parquet(f"{tmp_path}/outside").count() == 1


def feed(spark, *data, start=0):
    kind = "event_id long, user_id string, path string, type string, content_hash string, old_path string, detected_at timestamp, other string"
    base = spark.createDataFrame([(start + i, "u", p, t, h, o, d, "x") for i, (p, t, h, o, d) in enumerate(data)], kind.replace("detected_at timestamp", "detected_at string"))
    return base.withColumn("detected_at", F.to_timestamp_ntz("detected_at"))


def stored(spark, *data):
    kind = "user_id string, path string, content_hash string, indexed_at string, embedding_model_version string, linked_notes string, other int"
    return spark.createDataFrame([("u", p, h, at, m, n, 1) for p, h, at, m, n in data], kind)


@pytest.fixture
def work(spark, tmp_path):
    names = (("feed", incremental.FEED), ("state", incremental.STATE), ("ledger", incremental.LEDGER))
    return [VersionedTable(spark, f"{tmp_path}/{n}", kind) for n, kind in names]


def due(work):
    return sorted((r.path, r.action) for r in pending(*work).collect())


def day(n):
    return f"2025-01-{n:02d} 00:00:00"


AT = "2025-01-01T00:00:00.000Z"


def test_pending_work(spark, work):
    events = feed(
        spark,
        ("new", "created", "A", None, day(1)),
        ("same", "updated", "ABC", None, day(1)),
        ("changed", "updated", "B", None, day(3)),
        ("changed", "deleted", None, None, day(2)),  # late
        ("gone", "deleted", None, None, day(1)),
        ("never", "deleted", None, None, day(1)),
        ("to", "moved", "M", "from", day(1)),
        ("half", "created", "H", None, day(1)),
        ("nohash", "updated", None, None, day(1)),
        ("model.png", "created", "I", None, day(1)),
        ("links.png", "created", "I", None, day(1)),
        (None, "created", "X", None, day(1)),
    )
    work[0].append(events.unionByName(events.limit(3)))
    work[1].append(
        stored(
            spark,
            ("same", "abc", AT, "m", None), ("changed", "a", AT, "m", None), ("gone", "g", AT, "m", None), ("from", "m", AT, "m", None), ("half", "h", AT, None, None),
            ("quiet", "q", AT, "m", None), ("quiet", "old", "2024-01-01T00:00:00.000Z", None, None), ("unfinished", "q", AT, None, None), ("nohash", "z", AT, "m", None),
            # an image is complete by its links alone, other pictures by the model
            ("model.png", "i", AT, "m", None), ("links.png", "i", AT, None, "[]"), ("quiet.webp", "i", AT, None, "[]"), ("anim.gif", "i", AT, None, "[]"), (None, "x", AT, "m", None),
        )
    )
    wanted = ["new", "changed", "to", "half", "unfinished", "nohash", "model.png", "anim.gif"]
    assert due(work) == sorted([(p, "index") for p in wanted] + [("gone", "remove"), ("from", "remove")])


def test_pending_of_empty_tables(spark, work):
    assert due(work) == []
    work[0].append(feed(spark, ("a", "created", "A", None, day(1))).limit(0))
    assert due(work) == []
    work[1].append(stored(spark, ("a", "a", AT, "m", None)))
    assert due(work) == []
    work[0].append(feed(spark, ("b", "created", "B", None, day(1))))
    assert due(work) == [("b", "index")]


def test_runs_read_what_is_new_and_end_at_the_same_work(spark, work):
    events, states, ledger = work
    events.append(feed(spark, *[(f"f{n}", "created", "A", None, day(1)) for n in range(50)]))
    assert len(due(work)) == 50
    first = ledger.latest()
    assert update_ledger(*work) == first  # no news, no version
    states.append(stored(spark, *[(f"f{n}", "a", AT, "m", None) for n in range(40)]))
    assert len(due(work)) == 10
    events.append(feed(spark, ("f3", "deleted", None, None, day(2)), ("f4", "updated", "B", None, day(2)), start=100))
    before = set(ledger.manifest().files)
    assert due(work) == sorted([(f"f{n}", "index") for n in range(40, 50)] + [("f3", "remove"), ("f4", "index")])
    new = [f for f in ledger.manifest().files if f not in before]
    assert spark.read.parquet(*new).count() == 2  # the two paths the delivery speaks of
    assert ledger.manifest().processed == {"feed": 2, "state": 1}


def test_withdrawn_records_are_judged_anew(spark, work):
    events, states, _ = work
    events.append(feed(spark, ("a", "created", "A", None, day(1)), ("a", "updated", "B", None, day(2)), ("b", "created", "B", None, day(1))))
    states.append(stored(spark, ("a", "a", AT, "m", None), ("b", "b", AT, "m", None), ("c", "c", AT, None, None)))
    assert due(work) == [("a", "index"), ("c", "index")]
    events.delete(F.col("event_id") == 1)  # the update of a
    states.delete(F.col("path").isin("b", "c"))
    assert due(work) == [("b", "index")]
    states.overwrite(stored(spark, ("b", "b", AT, "m", None)))
    assert due(work) == [("a", "index")]


def test_a_failed_run_is_repeated(spark, work, monkeypatch):
    work[0].append(feed(spark, ("a", "created", "A", None, day(1))))
    with monkeypatch.context() as m:
        m.setattr(work[2], "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pending(*work)
    assert work[2].latest() == 0
    assert due(work) == [("a", "index")]
