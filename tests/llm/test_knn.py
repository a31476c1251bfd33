import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import knn

KIND = "id long, vector array<double>"


def frame(spark, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors], KIND)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 64))
    near = centres[rng.integers(0, 400, 800)] + 0.25 * rng.normal(size=(800, 64))
    return np.vstack([centres, near]) * rng.uniform(0.1, 9, (1200, 1))


def exact(x, y, k, skip):
    a, b = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    s = a @ b.T
    if skip:
        np.fill_diagonal(s, -2)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(s, order, 1)


def test_close_neighbours_are_found(spark, cloud):
    df = frame(spark, enumerate(cloud))
    found = {(r.query, r.point) for r in knn.nearest(df, least=0.9).collect()}
    order, s = exact(cloud, cloud, 10, True)
    wanted = {(i, int(j)) for i in range(len(cloud)) for j, c in zip(order[i], s[i]) if c >= 0.9}
    assert len(wanted) > 500 and found <= wanted and len(found) >= 0.995 * len(wanted)


def test_recall_of_plain_top_k(spark, cloud):
    df = frame(spark, enumerate(cloud))
    asked = df.filter("id % 20 = 0")
    got = {}
    for r in knn.nearest(df, asked, k=11, **knn.WIDE).filter("query <> point").collect():
        got.setdefault(r.query, set()).add(r.point)
    order, _ = exact(cloud, cloud, 10, True)
    recall = np.mean([len(got[i] & set(order[i].tolist())) / 10 for i in range(0, len(cloud), 20)])
    assert recall >= 0.9


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.ones((60, 64)) + 0.01 * rng.normal(size=(60, 64))
    monkeypatch.setattr(knn, "BLOCK", 8)
    found = knn.nearest(frame(spark, enumerate(vectors)), least=0.9)
    order, _ = exact(vectors, vectors, 10, True)
    got = {(r.query, r.point) for r in found.collect()}
    assert len(got) == 600 and len(got & {(i, int(j)) for i in range(60) for j in order[i]}) >= 0.99 * 600


def test_copies_of_a_vector_cost_no_more_than_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 64))
    vectors = [base[0]] * 40 + [base[1]] * 3 + [base[2], base[0] + 0.01 * base[3]]
    stored = []
    real = knn.materialize
    monkeypatch.setattr(knn, "materialize", lambda df, name="stage": stored.append((name, real(df, name))) or stored[-1][1])
    df = frame(spark, enumerate(vectors))
    found = {(r.query, r["rank"]): r.point for r in knn.nearest(df, k=3, least=0.9).collect()}
    for i in range(40):  # the smallest ids among the copies
        assert [found[i, r] for r in (1, 2, 3)] == [j for j in range(4) if j != i][:3]
    assert [found[40, r] for r in (1, 2)] == [41, 42] and (40, 3) not in found
    assert [found[44, r] for r in (1, 2, 3)] == [0, 1, 2]
    assert dict(stored)["hashed"].count() == 4 and dict(stored)["neighbours"].count() <= 4
    asked = df.filter("id in (7, 44)")
    found = {(r.query, r["rank"]): r.point for r in knn.nearest(df, asked, k=3, least=0.9).collect()}
    assert [found[7, r] for r in (1, 2, 3)] == [0, 1, 2] and [found[44, r] for r in (1, 2, 3)] == [44, 0, 1]


def test_dense_clusters_store_a_few_pairs_for_each_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=64) + 0.05 * rng.normal(size=(700, 64))
    stored = {}
    real = knn.materialize
    monkeypatch.setattr(knn, "materialize", lambda df, name="stage": stored.setdefault(name, real(df, name)))
    found = {(r.query, r.point) for r in knn.nearest(frame(spark, enumerate(vectors)), least=0.9).collect()}
    order, _ = exact(vectors, vectors, 10, True)
    assert stored["neighbours"].count() <= 700 * knn.K * knn.SPARE
    assert len(found & {(i, int(j)) for i in range(700) for j in order[i]}) >= 0.99 * 7000


def test_ties_bad_vectors_and_scales(spark):
    e = np.eye(64)
    rows = [(1, e[0].tolist()), (2, (e[0] * 1e-30).tolist()), (3, (e[0] * 1e30).tolist()), (4, [0.0] * 64), (5, [1.0] * 32), (6, []), (7, None), (8, [float("nan")] * 64), (9, [None] * 64), (10, e[1].tolist())]
    df = spark.createDataFrame(rows, KIND).withColumn("rank", F.lit("clash")).withColumn("bucket", F.lit(1))
    found = sorted((r.query, r.point, r["rank"]) for r in knn.nearest(df, least=0.9, k=1).collect())
    assert found == [(1, 2, 1), (2, 1, 1), (3, 1, 1)]
    assert knn.nearest(df.limit(0)).count() == 0
    assert knn.nearest(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [8, 11, 14])
def test_recall_at_the_least_cosine_stays_as_buckets_grow(bits):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    tables = knn.tables_for(0.9, 64, bits, knn.PROBES)
    asked, stored = knn.hash_codes(a.astype(np.float32), bits, tables, knn.PROBES), knn.hash_codes(b.astype(np.float32), bits, tables, 1)
    found = np.any([(x == y).any(1) for x, y in zip(asked, stored)], axis=0).mean()
    assert found >= knn.RECALL - 0.01, (tables, found)
