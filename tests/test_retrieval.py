import pytest
from pyspark.sql import functions as F

from marlstone.operators import context, evaluate, index, search


def rows(spark, data):
    names = ["row_id", "user_id", "path", "title", "chunk_index", "section_path", "text", "tags", "project", "status", "type", "content_hash", "extra_metadata", "vector"]
    full = [tuple({**dict.fromkeys(names), "tags": [], "chunk_index": 0, "title": "t", "user_id": "a", **d}[n] for n in names) for d in data]
    return spark.createDataFrame(full, index.SCHEMA)


def asked(spark, *data):
    return spark.createDataFrame([tuple(d) for d in data], "query_id long, user_id string, query_text string, k int, vector array<float>")


@pytest.fixture(scope="module")
def corpus(spark):
    return rows(
        spark,
        [
            {"row_id": 1, "path": "x/a.md", "text": "alpha beta", "vector": [1.0, 0.0], "tags": ["p", "q"], "status": "open"},
            {"row_id": 2, "path": "x/b.md", "text": "beta", "vector": [1.0, 0.0], "tags": ["q"]},
            {"row_id": 3, "path": "y/c.md", "text": "gamma", "vector": [0.0, 1.0], "title": "alpha beta"},
            {"row_id": 4, "path": "y/d.md", "text": None, "vector": [1.0, 0.0]},
            {"row_id": 5, "path": "x/e.md", "text": "alpha beta", "vector": [1.0, 0.0], "user_id": "b"},
            {"row_id": 6, "path": "z.md", "text": "beta", "vector": [float("nan"), 1.0]},
        ],
    )


def test_semantic_ties_tenants_and_bad_vectors(spark, corpus):
    q = asked(spark, (1, "a", "", 2, [2.0, 0.0]), (2, "c", "", 5, [1.0, 0.0]), (3, "a", "", 5, None))
    found = [(r.query_id, r["rank"], r.row_id, r.score) for r in search.semantic(q, corpus, dim=2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 1, 1.0), (1, 2, 2, 1.0)]


def test_semantic_in_blocks(spark, corpus, monkeypatch):
    q = asked(spark, (1, "a", "", 5, [1.0, 1.0]), (2, "a", "", 1, [0.0, 3.0]))
    whole = sorted(map(tuple, search.semantic(q, corpus, dim=2).select("query_id", "rank", "row_id").collect()))
    monkeypatch.setattr(search, "BLOCK", 1)
    assert sorted(map(tuple, search.semantic(q, corpus, dim=2).select("query_id", "rank", "row_id").collect())) == whole


def test_lexical_needs_all_terms_in_one_field(spark, corpus):
    q = asked(spark, (1, "a", "Beta ALPHA", 5, None), (2, "a", "alpha gamma", 5, None), (3, "a", "!?", 5, None), (4, "a", None, 5, None))
    found = sorted((r.query_id, r["rank"], r.row_id) for r in search.lexical(q, corpus).collect())
    assert found == [(1, 1, 1), (1, 2, 3)]


def test_filters(spark, corpus):
    q = asked(spark, (1, "a", "beta", 1, None))
    assert [r.row_id for r in search.lexical(q, corpus, search.Filters.of(tags=("q",), folder="x/b")).collect()] == [2]
    assert search.lexical(q, corpus, search.Filters.of(folder="x/b"), "post").count() == 0
    assert [r.row_id for r in search.lexical(q, corpus, search.Filters.of(status="open")).collect()] == [1]
    with pytest.raises(ValueError):
        search.Filters.of(path="x")
    with pytest.raises(ValueError):
        search.check_limit(51)


def test_fusion_adds_over_occurrences(spark, corpus):
    hits = search.fuse(
        spark.createDataFrame([(1, 1, 9, "p", 0), (1, 2, 8, "p", 1), (1, 3, 7, "q", 0)], "query_id long, rank int, row_id long, path string, chunk_index int").withColumns({c: F.lit(None).cast("string") for c in search.RESULT if c not in ("path", "chunk_index")}),
        spark.createDataFrame([(1, 1, 7, "q", 0)], "query_id long, rank int, row_id long, path string, chunk_index int").withColumns({c: F.lit(None).cast("string") for c in search.RESULT if c not in ("path", "chunk_index")}),
        spark.createDataFrame([(1, 5)], "query_id long, k int"),
    ).orderBy("rank")
    got = [(r.row_id, round(r.score, 9)) for r in hits.collect()]
    assert got == [(9, round(1 / 61 + 1 / 62, 9)), (7, round(1 / 63 + 1 / 61, 9))]


def test_empty_index(spark, corpus):
    q = asked(spark, (1, "a", "beta", 5, [1.0, 0.0]))
    assert search.hybrid(q, corpus.limit(0)).count() == 0


def results(spark, data):
    full = [(1, i + 1, i, d.get("score", 1.0), d["path"], "t", d.get("i", 0), d.get("s"), d.get("text", "w"), d.get("type")) for i, d in enumerate(data)]
    return spark.createDataFrame(full, "query_id long, rank int, row_id long, score double, path string, title string, chunk_index int, section_path string, text string, type string")


def test_budget_passes_over_what_does_not_fit(spark):
    long, short = "w " * 900, "w " * 90
    found = context.assemble(results(spark, [{"path": "a", "text": long}, {"path": "b", "text": short * 3, "score": 0.9}, {"path": "c", "text": short, "score": 0.8}]), budget=1000)
    assert [(r.path, r.ordinal) for r in found.orderBy("ordinal").collect()] == [("a", 0), ("c", 1)]
    assert found.agg(F.sum("tokens")).first()[0] <= 1000


def test_floor_is_relative_and_notes_are_merged_in_order(spark):
    data = [{"path": "a", "s": "t > 2", "text": "two", "score": 0.02}, {"path": "a", "s": "t > 1", "text": "one", "score": 0.01}, {"path": "b", "score": 0.005}]
    r = results(spark, data)
    pack = context.assemble(r)
    assert [(x.path, x.text, x.sections) for x in pack.collect()] == [("a", "one\n\ntwo", ["t > 1", "t > 2"])]
    m = context.meta(r, pack).first()
    assert (m.chunks_included, m.chunks_excluded, m.budget_rejected) == (1, 1, 0)
    assert list(context.nested(pack).first().sections) == ["implementation"]


def test_context_of_nothing(spark):
    assert context.assemble(results(spark, [{"path": "a"}]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        context.check(999, 0.3)


def test_recall(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"]), (["a"], [])], "got array<string>, want array<string>")
    assert [r[0] for r in df.select(evaluate.recall_at_k(F.col("got"), F.col("want"), 2)).collect()] == [0.5, 0.0, 0.0]
    assert df.select(evaluate.recall_at_k(F.col("got"), F.col("want"), 2, distinct=False)).first()[0] == 1.0
