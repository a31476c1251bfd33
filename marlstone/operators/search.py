"""Batched semantic, lexical and hybrid retrieval over many tenants and queries at once.

Queries are (query_id, user_id, query_text, vector, k); rows of the index are as ``operators.index`` writes them. Every path
joins on the tenant, so no query ever sees another tenant's rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clamp, terms
from marlstone.functions.vector import usable
from marlstone.operators.sized import sized
from marlstone.operators.stored import NARROW, LiveIndex, StoredIndex, opened, places, tenant_bucket, term_check, term_key
from marlstone.session import materialize

# Constant of reciprocal-rank fusion, over-fetch of its inputs, limits of a request, context's pool.
RRF_K, OVERFETCH, LIMIT_RANGE, DEFAULT_LIMIT, CONTEXT_POOL = 60, 2, (1, 50), 10, 50
#: Rows of a tenant, and queries of a tenant, that meet in one task.
BLOCK = 4096
RESULT = ["path", "title", "chunk_index", "section_path", "text", "tags", "project", "status", "type"]


@dataclass(frozen=True)
class Filters:
    """Conditions on the payload; all optional, all must hold. ``tags`` matches any of its values."""

    tags: tuple[str, ...] | None = None
    project: str | None = None
    status: str | None = None
    type: str | None = None
    folder: str | None = None

    @classmethod
    def of(cls, **given) -> Filters:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filter: {', '.join(sorted(unknown))}")
        return cls(**given)

    def payload(self) -> Column:
        out = F.lit(True)
        if self.tags:
            out &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in self.tags]))
        for name in ("project", "status", "type"):
            if getattr(self, name) is not None:
                out &= F.col(name) == getattr(self, name)
        return F.coalesce(out, F.lit(False))

    def in_folder(self) -> Column:
        return F.col("path").startswith(self.folder) if self.folder else F.lit(True)


Index = DataFrame | LiveIndex | StoredIndex


def check_limit(limit: int) -> int:
    low, high = LIMIT_RANGE
    if not low <= limit <= high:
        raise ValueError(f"limit must be from {low} to {high}")
    return limit


def requests(queries: DataFrame) -> DataFrame:
    """Queries as they come from outside: a missing limit is the default, one out of range fails the batch."""
    low, high = LIMIT_RANGE
    k = F.coalesce(F.col("k").cast("int"), F.lit(DEFAULT_LIMIT))
    return queries.withColumn("k", F.when(k.between(low, high), k).otherwise(F.raise_error(F.lit(f"limit must be from {low} to {high}")).cast("int")))


def _kept(rows: DataFrame, filters: Filters | None, folder_mode: str) -> DataFrame:
    if folder_mode not in ("pre", "post"):
        raise ValueError("folder_mode is 'pre' or 'post'")
    filters = filters or Filters()
    rows = rows.filter(filters.payload())
    return rows.filter(filters.in_folder()) if folder_mode == "pre" else rows


class _Batch:
    """A batch of queries, written once, with its largest limit and the buckets of its tenants."""

    def __init__(self, queries: DataFrame, index: Index):
        self.index, self.queries = opened(index), sized(queries.withColumn("terms", F.array_distinct(terms("query_text"))), "queries")
        self.most, self.buckets = self.queries.agg(F.coalesce(F.max("k"), F.lit(0)), F.collect_set(tenant_bucket())).first()

    def rows(self) -> DataFrame:
        return self.index.rows(self.buckets)

    def with_payload(self, hits: DataFrame) -> DataFrame:
        """Stored hits with the payload of their rows; texts are read for the tenants asked for and moved for the hits alone."""
        return self.rows().select("row_id", *RESULT).join(hits, "row_id").select("query_id", "rank", "row_id", "score", *RESULT)


def _tenant_blocks(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(user_id, qb, pb): in how many blocks the queries and the rows of a tenant are cut."""
    both = queries.select("user_id", F.lit(1).alias("q"), F.lit(0).alias("p")).unionByName(points.select("user_id", F.lit(0).alias("q"), F.lit(1).alias("p")))
    sizes = both.groupBy("user_id").agg(F.ceil(F.sum("q") / BLOCK).alias("qb"), F.ceil(F.sum("p") / BLOCK).alias("pb")).filter("qb > 0 AND pb > 0")
    return sized(sizes, "tenants")


def _blocked(rows: DataFrame, tenants: DataFrame, own: str, own_as: str, other: str, other_as: str) -> DataFrame:
    """Rows with their own block, repeated for every block of the other side of their tenant."""
    joined = rows.join(tenants, "user_id")
    return joined.withColumn(own_as, F.pmod(F.xxhash64("id"), F.col(own))).withColumn(other_as, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("qb", "pb")


def _top_k(group: pa.Table) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.float64())])
    is_query = group.column("k").is_valid().to_numpy()
    if not is_query.any() or is_query.all():
        return schema.empty_table()
    ids, k = group.column("id").to_numpy(), group.column("k").to_pandas().fillna(0).to_numpy().astype(int)
    least = group.column("least").to_pandas().fillna(-2.0).to_numpy()
    vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    q, p = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    a, b = vectors[q], vectors[p]
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    b = b / np.linalg.norm(b, axis=1, keepdims=True)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 512):
        s = a[at : at + 512] @ b.T
        for i in range(len(s)):
            row, m = s[i], min(int(k[q[at + i]]), len(p))
            if m < 1:
                continue
            floor = max(np.partition(row, len(row) - m)[len(row) - m] - 1e-9, least[q[at + i]])
            best = np.flatnonzero(row >= floor)  # ties at the last place stay in until ids decide
            out.append((np.full(len(best), ids[q[at + i]]), ids[p[best]], row[best]))
    if not out:
        return schema.empty_table()
    return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)


def _semantic_hits(batch: _Batch, filters: Filters | None, folder_mode: str, dim: int, overfetch: int) -> DataFrame:
    rows = _kept(batch.index.vectors(batch.buckets, dim), filters, folder_mode)
    asked = batch.queries.filter(usable(F.col("vector"), dim))
    least = F.col("least").cast("double") if "least" in asked.columns else F.lit(None).cast("double")
    q = asked.select("user_id", F.col("query_id").alias("id"), (F.col("k") * overfetch).cast("int").alias("k"), least.alias("least"), F.col("vector").cast("array<double>").alias("vector"))
    p = rows.select("user_id", F.col("row_id").alias("id"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("least"), F.col("vector").cast("array<double>").alias("vector"))
    tenants = _tenant_blocks(q, p)
    both = _blocked(q, tenants, "qb", "x", "pb", "y").unionByName(_blocked(p, tenants, "pb", "y", "qb", "x"))
    found = both.groupBy("user_id", "x", "y").applyInArrow(_top_k, "query_id long, row_id long, score double")
    # rounding before ordering makes ties independent of the order of floating-point sums
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    ranked = found.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= batch.most * overfetch)
    ranked = ranked.join(q.select(F.col("id").alias("query_id"), "k"), "query_id").filter(F.col("rank") <= F.col("k"))
    return sized(ranked.select("query_id", "rank", "row_id", clamp("score").alias("score")), "semantic")


def semantic(queries: DataFrame, index: Index, filters: Filters | None = None, folder_mode: str = "pre", dim: int = 64, overfetch: int = 1) -> DataFrame:
    """(query_id, rank, row_id, score, payload): the k rows of the query's tenant most similar to its vector.

    Exact. Rows and queries of a tenant are cut into blocks that meet pairwise as matrix products, so a hot tenant is
    spread over tasks; each keeps k per query. ``least`` of a query, if there, is a floor on the score. Scores are
    clamped to [0, 1]; ties go to the smaller row id. Unusable vectors take no part. ``folder_mode='post'`` filters the
    folder after the limit, as an index without prefix search must. Of a stored index only the tenants asked for are read.
    """
    batch = _Batch(queries, index)
    out = batch.with_payload(_semantic_hits(batch, filters, folder_mode, dim, overfetch))
    return out.filter((filters or Filters()).in_folder()) if folder_mode == "post" else out


def _lexical_hits(batch: _Batch, filters: Filters | None, folder_mode: str, overfetch: int) -> DataFrame:
    each = batch.queries.select("user_id", "query_id", (F.col("k") * overfetch).alias("k"), F.explode("terms").alias("term")).withColumns({"key": term_key(), "check": term_check()})
    posted, often = batch.index.lists(each.select("key", "check").distinct())
    named = each.join(often, ["key", "check"], "left").groupBy("query_id", "k").agg(F.sort_array(F.collect_list(F.struct("df", "key", "check"))).alias("keys"))
    # of a query all of whose terms occur, the rarest term and the others
    named = named.filter(F.col("keys")[0]["df"].isNotNull())
    named = named.select("query_id", "k", F.col("keys")[0]["key"].alias("key"), F.col("keys")[0]["check"].alias("check"), F.slice("keys", 2, F.size("keys")).alias("rest"))
    found = sized(places(posted.join(sized(named, "rarest"), ["key", "check"]), "query_id", "k", "rest").drop("key", "check"), "candidates")
    one = found.filter(F.size("rest") == 0).select("query_id", "k", "row_id")
    more = found.filter(F.size("rest") > 0).select("query_id", "k", "row_id", "field", F.size("rest").alias("n"), F.explode("rest").alias("x"))
    more = more.select("query_id", "k", "n", F.col("x.key").alias("m_key"), F.col("x.check").alias("m_check"), F.col("row_id").alias("m_row"), F.col("field").alias("m_field"))
    named = more.withColumn("m_spot", F.xxhash64("m_key", "m_row", "m_field"))
    keys = more.select(F.col("m_key").alias("key"), F.col("m_check").alias("check")).distinct()
    there = places(posted.join(keys, ["key", "check"], "left_semi")).withColumn("spot", F.xxhash64("key", "row_id", "field"))
    # joined by one number; what it is made of stays a condition beside it
    same = F.expr("spot = m_spot AND key - m_key = 0 AND check - m_check = 0 AND row_id - m_row = 0 AND field - m_field = 0")
    all_ = there.join(named, same).groupBy("query_id", "k", "row_id", "field", "n").count()
    matched = sized(one.unionByName(all_.filter("count = n").select("query_id", "k", "row_id")).distinct(), "matched")
    hits = _kept(batch.rows().select(*NARROW), filters, folder_mode).select("row_id", "path", "chunk_index").join(matched, "row_id")
    order = Window.partitionBy("query_id").orderBy("path", "chunk_index", "row_id")
    # the batch's largest limit lets every task drop what cannot be among the first before the exchange
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= batch.most * overfetch).filter(F.col("rank") <= F.col("k"))
    return ranked.select("query_id", "rank", "row_id", "path", F.lit(1.0).alias("score"))


def lexical(queries: DataFrame, index: Index, filters: Filters | None = None, folder_mode: str = "pre", overfetch: int = 1) -> DataFrame:
    """(query_id, rank, row_id, score, payload): the first k rows by (path, chunk_index) of which one field holds all terms
    of the query. Fields are text, title and section_path; the score is 1.

    Of the inverted lists the query's rarest term is read first, by the frequencies of its terms; the other terms are looked up for
    its rows only. Texts are moved for the results alone. A query without terms matches nothing.
    """
    batch = _Batch(queries, index)
    out = batch.with_payload(sized(_lexical_hits(batch, filters, folder_mode, overfetch), "lexical").drop("path"))
    return out.filter((filters or Filters()).in_folder()) if folder_mode == "post" else out


def fuse(semantic_hits: DataFrame, lexical_hits: DataFrame, limits: DataFrame, fuse_on: str = "path") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists per query: a path's score is the sum of 1 / (rank + 60) over all its
    occurrences; its first row, semantic before lexical, stands for it; ties keep that order. ``limits`` is (query_id, k)."""
    key = {"path": "path", "chunk": "row_id"}[fuse_on]
    carried = [c for c in semantic_hits.columns if c not in ("query_id", "rank", "row_id", "score")]
    columns = ["query_id", "rank", "row_id", *carried]
    listed = semantic_hits.select(*columns).withColumn("list", F.lit(0)).unionByName(lexical_hits.select(*columns).withColumn("list", F.lit(1)))
    first = F.struct("list", "rank", "row_id", *carried)
    fused = listed.groupBy("query_id", F.col(key).alias("__key")).agg(F.sum(1.0 / (F.col("rank") + RRF_K)).alias("score"), F.min_by(first, F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank")
    ranked = fused.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order))
    kept = ranked.join(limits, "query_id").filter(F.col("rank") <= F.col("k"))
    return kept.select("query_id", "rank", F.col("first.row_id").alias("row_id"), clamp("score").alias("score"), *[F.col(f"first.{c}").alias(c) for c in carried])


def hybrid(queries: DataFrame, index: Index, filters: Filters | None = None, folder_mode: str = "pre", fuse_on: str = "path") -> DataFrame:
    """Fusion of the semantic and the lexical list, each fetched to twice the limit; payloads are read for the fused list alone."""
    batch = _Batch(queries, index)
    semantic_ = batch.rows().select("row_id", "path").join(_semantic_hits(batch, filters, folder_mode, 64, OVERFETCH), "row_id")
    lists = [semantic_, _lexical_hits(batch, filters, folder_mode, OVERFETCH)]
    if folder_mode == "post":
        lists = [hits.filter((filters or Filters()).in_folder()) for hits in lists]
    fused = fuse(*[h.select("query_id", "rank", "row_id", "score", "path") for h in lists], batch.queries.select("query_id", "k"), fuse_on)
    return batch.with_payload(sized(fused.drop("path"), "fused"))


def respond(search: Callable[[], DataFrame], limit: int) -> tuple[DataFrame, float]:
    """The nested responses of a batch, written once, and its milliseconds."""
    check_limit(limit)
    began = time.perf_counter()
    out = materialize(response(search(), limit), "response")
    return out, (time.perf_counter() - began) * 1000


def response(results: DataFrame, limit: int) -> DataFrame:
    """Per query the nested result list, its size and the limit."""
    return results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", *RESULT))).alias("results"), F.count("*").alias("total")).withColumn("limit", F.lit(limit))
