from pyspark.sql import functions as F

from marlstone.functions.vector import hashing_embedder
from marlstone.operators import changes, corpus, index

ROWS = "user_id string, path string, content_hash string"


def files(spark, *rows):
    return spark.createDataFrame([("u", *r) if len(r) == 2 else r for r in rows], ROWS)


def events(df):
    return sorted((r.path, r.type, r.content_hash, r.old_path) for r in df.collect())


def test_all_kinds(spark):
    old = files(spark, ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"))
    new = files(spark, ("a", "1"), ("b", "9"), ("e", "3"), ("f", "5"))
    assert events(changes.diff(new, old)) == [("b", "updated", "9", None), ("d", "deleted", None, None), ("e", "moved", "3", "c"), ("f", "created", "5", None)]
    assert len(events(changes.diff(new, old, moves=False))) == 5
    assert events(changes.diff(old, old)) == []


def test_repeated_hashes(spark):
    old, new = files(spark, ("a", "1"), ("b", "1")), files(spark, ("c", "1"), ("d", "1"))
    assert events(changes.diff(new, old)) == [("a", "deleted", None, None), ("c", "moved", "1", "b"), ("d", "moved", "1", "b")]


def test_no_move_between_tenants_or_without_hash(spark):
    old, new = files(spark, ("u", "a", "1"), ("u", "n", None)), files(spark, ("v", "b", "1"), ("u", "m", None))
    assert sorted(x[1] for x in events(changes.diff(new, old))) == ["created", "created", "deleted", "deleted"]


def test_first_run_and_empty_snapshot(spark):
    some = files(spark, ("a", "1"))
    assert [x[1] for x in events(changes.diff(some, some.limit(0)))] == ["created"]
    assert [x[1] for x in events(changes.diff(some.limit(0), some))] == ["deleted"]


def test_stability(spark):
    assert [r.path for r in changes.stable(files(spark, ("a", "1"), ("b", "1")), files(spark, ("a", "1"), ("b", "2"), ("c", "3"))).collect()] == ["a"]


def test_backlinks(spark):
    notes = spark.createDataFrame([("u", "n1.md", "x ![[img/p.png|cap]]"), ("u", "n2.md", "![[p.png]] ![[p.png]]"), ("v", "n3.md", "![[p.png]]"), ("u", "n4.md", None)], "user_id string, path string, content string")
    images = spark.createDataFrame([("u", "files/p.png"), ("u", "q.png"), ("u", "p.md")], "user_id string, path string")
    assert [(r.image, r.linked_notes) for r in changes.backlinks(images, notes).collect()] == [("files/p.png", ["n1.md", "n2.md"])]


def docs(spark, *rows):
    return spark.createDataFrame([("u", *r) for r in rows], "user_id string, path string, content string")


def run(spark, content, state, current):
    snapshot = content.select("user_id", "path", F.sha2("content", 256).alias("content_hash"))
    return corpus.ingest(content, state, current, hashing_embedder(8), snapshot)


def test_ingest_keeps_vectors_of_moved_files(spark):
    state, current = files(spark).limit(0), spark.createDataFrame([], index.SCHEMA)
    _, first, state = run(spark, docs(spark, ("a.md", "alpha"), ("b.md", "beta")), state, current)
    first = spark.createDataFrame(first.select(*index.SCHEMA.names).collect(), index.SCHEMA)
    state = spark.createDataFrame(state.collect(), state.schema)
    happened, second, after = run(spark, docs(spark, ("moved/a.md", "alpha"), ("b.md", "beta two")), state, first)
    assert sorted(r.type for r in happened.collect()) == ["moved", "updated"]
    rows = {r.path: r for r in second.collect()}
    assert rows.keys() == {"moved/a.md", "b.md"} and rows["moved/a.md"].title == "a"
    assert rows["moved/a.md"].vector == next(r.vector for r in first.collect() if r.path == "a.md")
    assert sorted(r.path for r in after.collect()) == ["b.md", "moved/a.md"]


def test_index_mutations(spark):
    rows = spark.createDataFrame([(1, "u", "p", 0), (2, "u", "p", 1), (3, "v", "p", 0), (4, None, "p", 0), (5, "", "q", 0)], "row_id long, user_id string, path string, chunk_index int")
    ids = lambda df: sorted(r.row_id for r in df.collect())
    assert ids(index.stale_tail(rows, spark.createDataFrame([("u", "p", 1)], "user_id string, path string, n int"))) == [1, 3, 4, 5]
    assert ids(index.purge_tenant(rows, "u")) == [3, 4, 5]
    assert ids(index.purge_unowned(rows)) == [1, 2, 3]
    assert ids(index.delete_where(rows, "u", F.col("chunk_index") >= 1)) == [1, 3, 4, 5]
    assert ids(index.upsert(rows, rows.filter("row_id = 1").withColumn("row_id", F.lit(9).cast("long")))) == [2, 3, 4, 5, 9]
    assert ids(index.tenant(rows, "v")) == [3]


def test_payload_from_frontmatter(spark):
    df = spark.createDataFrame([({"tags": '["a","b"]', "project": '"P"', "other": "3"},), ({"tags": '"one"'},), ({},)], "m map<string,string>")
    out = index.payload(df, F.col("m")).collect()
    assert [(r.tags, r.project, r.extra_metadata) for r in out] == [(["a", "b"], "P", '{"other":"3"}'), (["one"], None, "{}"), ([], None, "{}")]


def test_reindex_jobs(spark):
    state = files(spark, ("a/x", "1"), ("a/y", "2"), ("ab/z", "3"), ("v", "a/x", "4"))
    job = corpus.reindex(state, "u", "folder", "a", lambda rows: rows.filter("content_hash IS NULL").count())
    assert (job.status, job.total_files, job.files_processed) == ("completed", 2, 2)
    failed = corpus.reindex(state, "u", "full", None, lambda rows: 1 / 0)
    assert failed.status == "failed" and failed.errors and failed.total_files == 3


def test_layout_and_older_schemas(spark, tmp_path):
    old = spark.createDataFrame([("u", "p", 1), ("v", "q", 2)], "user_id string, path string, extra int")
    rows = index.conform(old, index.SCHEMA)
    assert rows.columns == index.SCHEMA.names
    index.write_layout(rows, f"{tmp_path}/ix")
    back = spark.read.schema(index.SCHEMA).parquet(f"{tmp_path}/ix").filter("user_id = 'v'")
    assert [r.path for r in back.collect()] == ["q"]
    assert "PartitionFilters: [isnotnull(user_id" in back._jdf.queryExecution().toString()


def test_progress(spark):
    df = spark.createDataFrame([("created",), ("deleted",), ("moved",)], "type string")
    assert tuple(changes.progress(df).first()) == (3, 2)
