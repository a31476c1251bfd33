"""Named queries of the core and the SQL they are checked against. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.vector import EMBED_TOKENS, hashing_embedder
from marlstone.operators import changes, chunking, context, corpus, evaluate, incremental, index, metrics, packing, search, stored
from marlstone.operators.versions import newest, newest_of_few
from marlstone.session import file_versions, materialize, path_exists, scratch, ship_package, table
from marlstone.sources import registry
from marlstone.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- relations ------------------------------------------------------------------------------------------------------
def chunk_rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Newest version of every chunk; only the columns named are read and moved."""
    rows = table(spark, sf, "chunks")
    if columns:
        rows = rows.select("chunk_id", "upserted_at", *columns)
    return newest_of_few(rows, ["chunk_id"], ["upserted_at"])


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the index: chunks of notes, which carry metadata, and points of other files, which carry vectors."""
    notes = newest_of_few(table(spark, sf, "chunks"), ["chunk_id"], ["upserted_at"]).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("vector", F.lit(None).cast("array<float>")).withColumnRenamed("chunk_id", "row_id")
    points = newest_of_few(table(spark, sf, "points"), ["vec_id"], ["upserted_at"]).withColumnRenamed("vec_id", "row_id")
    none = {c: F.lit(None).cast("string") for c in ("project", "status", "type", "content_hash", "extra_metadata")}
    points = points.withColumns({**none, "tags": F.array().cast("array<string>")})
    names = index.SCHEMA.fieldNames()
    return notes.select(*names).unionByName(points.select(*names))


_STORED: dict[tuple, str] = {}


def stored_index(spark: SparkSession, sf: str) -> stored.StoredIndex:
    """The index over the given tables, written by the first query of a session that searches it and searched by the others as long as
    the tables' files are the same."""
    key = (spark.sparkContext.applicationId, *(x for name in ("chunks", "points") for x in file_versions(spark, f"{sf}/{name}.parquet")))
    if key in _STORED and path_exists(spark, f"{_STORED[key]}/lists/_SUCCESS"):
        return stored.StoredIndex(spark, _STORED[key])
    out = stored.StoredIndex.write(index_rows(spark, sf), scratch(spark, "index"))
    _STORED[key] = out.root
    return out


def request_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = newest(table(spark, sf, "search_requests"), ["request_id"], ["issued_at"])
    rows = rows.select(F.col("request_id").alias("query_id"), "user_id", "category", "query_text", F.col("result_limit").alias("k"), F.col("score_threshold").alias("least"), "vector")
    return search.requests(rows)


def term_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose text is the last term of the query; a name, mostly."""
    return request_rows(spark, sf).withColumn("query_text", F.element_at(T.terms("query_text"), -1))


_TOK = r"'[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B]'"
_OK = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_BASE = r"""
WITH RECURSIVE nc AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1),
     np AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY upserted_at DESC) = 1),
     ix AS (SELECT chunk_id AS row_id, user_id, path, title, chunk_index, section_path, text, coalesce(tags, []) AS tags, project, status, type, NULL::FLOAT[] AS vector FROM nc
            UNION ALL SELECT vec_id, user_id, path, title, chunk_index, section_path, text, [], NULL, NULL, NULL, vector FROM np),
     rq AS (SELECT request_id AS query_id, user_id, category, query_text, result_limit AS k, score_threshold AS least, vector FROM search_requests
            QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY issued_at DESC) = 1)"""
_SEM = (
    r""",
     sc AS (SELECT q.query_id, i.row_id, i.path, i.chunk_index, i.section_path, i.title, i.text, i.type, round(list_cosine_similarity(q.vector::DOUBLE[], i.vector::DOUBLE[]), 9) AS score, q.k, q.least
            FROM rq q JOIN ix i ON i.user_id = q.user_id WHERE i.text IS NOT NULL AND """
    + _OK.format("q.vector")
    + " AND "
    + _OK.format("i.vector")
    + "{filter}),"
    + r"""
     sm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM sc WHERE least IS NULL OR score >= least
            QUALIFY rank <= {times} * k)"""
)
_LEX = r""",
     tq AS (SELECT query_id, user_id, k, list_distinct(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+')) AS terms FROM rq WHERE len(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}]+')) > 0),
     lx AS (SELECT q.query_id, i.row_id, i.path, i.chunk_index, i.section_path, i.title, i.text, i.type, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY i.path, i.chunk_index, i.row_id) AS rank, q.k
            FROM tq q JOIN ix i ON i.user_id = q.user_id
            WHERE i.text IS NOT NULL{filter} AND (list_has_all(regexp_extract_all(lower(i.text), '[\p{{L}}\p{{N}}]+'), terms) OR list_has_all(regexp_extract_all(lower(coalesce(i.title, '')), '[\p{{L}}\p{{N}}]+'), terms)
                   OR list_has_all(regexp_extract_all(lower(coalesce(i.section_path, '')), '[\p{{L}}\p{{N}}]+'), terms))
            QUALIFY rank <= {times} * k)"""
_FUSE = r""",
     un AS (SELECT query_id, row_id, path, chunk_index, section_path, title, text, type, rank, 0 AS l FROM sm UNION ALL SELECT query_id, row_id, path, chunk_index, section_path, title, text, type, rank, 1 FROM lx),
     fu AS (SELECT query_id, path, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, min(l * 1000000 + rank) AS first FROM un GROUP BY ALL),
     hy AS (SELECT f.query_id, f.path, least(1.0, f.score) AS score, u.row_id, u.chunk_index, u.section_path, u.title, u.text, u.type, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.first) AS rank
            FROM fu f JOIN un u ON u.query_id = f.query_id AND u.path = f.path AND u.l * 1000000 + u.rank = f.first)"""
_SECTION = """coalesce(CASE lower(type) WHEN 'summary' THEN 'summary' WHEN 'overview' THEN 'summary' WHEN 'architecture' THEN 'architecture' WHEN 'arch' THEN 'architecture'
       WHEN 'adr' THEN 'adrs' WHEN 'decision' THEN 'adrs' WHEN 'glossary' THEN 'glossary' WHEN 'definition' THEN 'glossary' END,
  CASE WHEN contains({p}, '/adr/') THEN 'adrs' WHEN contains({p}, '/decisions/') THEN 'adrs' WHEN contains({p}, '/architecture/') THEN 'architecture' WHEN contains({p}, '/arch/') THEN 'architecture'
       WHEN contains({p}, '/glossary/') THEN 'glossary' WHEN contains({p}, '/definitions/') THEN 'glossary' WHEN contains({p}, '/summary/') THEN 'summary' WHEN contains({p}, '/overview/') THEN 'summary' END,
  'implementation')""".format(p="('/' || regexp_replace(lower(path), '^/', '') || '/')")


def _sem(times: int = 1, filter_: str = "") -> str:
    return _SEM.replace("{filter}", filter_).replace("{times}", str(times))


def _lex(times: int = 1, filter_: str = "") -> str:
    return _LEX.format(times=times, filter=filter_)


def _lex_last() -> str:
    """As ``_lex``, with the last term of the request alone."""
    whole, last = r"list_distinct(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+')) AS terms", r"[regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+')[-1]] AS terms"
    return _lex().replace(whole, last)


# --- retrieval ------------------------------------------------------------------------------------------------------
def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "row_id", "path", F.round("score", 6).alias("score"))


@query(_BASE + _sem() + " SELECT query_id, rank, row_id, path, round(greatest(0, least(1, score)), 6) AS score FROM sm")
def semantic_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every request's nearest rows of its tenant, above its threshold."""
    return _ranked(search.semantic(request_rows(spark, sf), stored_index(spark, sf)))


@query(_BASE + _sem(1, " AND i.path LIKE 'Projects/%'") + " SELECT query_id, rank, row_id, path, round(greatest(0, least(1, score)), 6) AS score FROM sm")
def semantic_folder_pre(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.semantic(request_rows(spark, sf), stored_index(spark, sf), search.Filters.of(folder="Projects/")))


@query(_BASE + _sem() + " SELECT query_id, rank, row_id, path, round(greatest(0, least(1, score)), 6) AS score FROM sm WHERE path LIKE 'Projects/%'")
def semantic_folder_post(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.semantic(request_rows(spark, sf), stored_index(spark, sf), search.Filters.of(folder="Projects/"), "post"))


@query(_BASE + _lex() + " SELECT query_id, rank, row_id, path, score FROM lx")
def lexical_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All terms of every request's text in one field."""
    return _ranked(search.lexical(request_rows(spark, sf), stored_index(spark, sf)))


@query(_BASE + _lex_last() + " SELECT query_id, rank, row_id, path, score FROM lx")
def lexical_last_term(spark: SparkSession, sf: str) -> DataFrame:
    """The last term of every request, a name mostly: long lists, where the whole texts give short ones."""
    return _ranked(search.lexical(term_requests(spark, sf), stored_index(spark, sf)))


@query(_BASE + _lex(1, " AND list_has_any(i.tags, ['ops', 'draft']) AND i.status = 'active' AND i.path LIKE 'Projects/%'") + " SELECT query_id, rank, row_id, path, score FROM lx")
def lexical_filtered(spark: SparkSession, sf: str) -> DataFrame:
    wanted = search.Filters.of(tags=("ops", "draft"), status="active", folder="Projects/")
    return _ranked(search.lexical(request_rows(spark, sf), stored_index(spark, sf), wanted))


@query(_BASE + _lex() + " SELECT query_id, rank, row_id, path, score FROM lx WHERE path LIKE 'Projects/%'")
def lexical_folder_post(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.lexical(request_rows(spark, sf), stored_index(spark, sf), search.Filters.of(folder="Projects/"), "post"))


@query(
    _BASE
    + r""",
     tq AS (SELECT query_id, user_id, k, list_distinct(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+')[-2:]) AS terms FROM rq WHERE len(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+')) > 0)
     SELECT q.query_id, i.row_id, i.path, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY i.path, i.chunk_index, i.row_id) AS rank
     FROM tq q JOIN ix i ON i.user_id = q.user_id
     WHERE i.text IS NOT NULL AND (list_has_all(regexp_extract_all(lower(i.text), '[\p{L}\p{N}]+'), terms) OR list_has_all(regexp_extract_all(lower(coalesce(i.title, '')), '[\p{L}\p{N}]+'), terms)
            OR list_has_all(regexp_extract_all(lower(coalesce(i.section_path, '')), '[\p{L}\p{N}]+'), terms))
     QUALIFY rank <= q.k"""
)
def lexical_two_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The last two terms of the requests: both must occur in one field."""
    two = request_rows(spark, sf).withColumn("query_text", F.array_join(F.slice(T.terms("query_text"), F.greatest(F.size(T.terms("query_text")) - 1, F.lit(1)), 2), " "))
    return _ranked(search.lexical(two, stored_index(spark, sf)))


@query(_BASE + _sem(2) + _lex(2) + _FUSE + " SELECT h.query_id, h.rank, h.row_id, h.path, round(h.score, 6) AS score FROM hy h JOIN rq USING (query_id) WHERE h.rank <= rq.k")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Both lists fused by reciprocal ranks."""
    return _ranked(search.hybrid(request_rows(spark, sf), stored_index(spark, sf)))


@query(_BASE + _sem() + _lex() + " SELECT (SELECT count(*) FROM sm JOIN rq USING (query_id) JOIN ix USING (row_id) WHERE ix.user_id <> rq.user_id) AS foreign_rows, (SELECT count(*) FROM sm) + (SELECT count(*) FROM lx) AS total_rows")
def tenant_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Results that belong to another tenant: none."""
    q, rows = request_rows(spark, sf), stored_index(spark, sf)
    found = search.semantic(q, rows).select("query_id", "row_id").unionByName(search.lexical(q, rows).select("query_id", "row_id"))
    owned = found.join(index_rows(spark, sf).select("row_id", F.col("user_id").alias("owner")), "row_id").join(q.select("query_id", "user_id"), "query_id")
    return owned.agg(F.count_if(F.col("owner") != F.col("user_id")).alias("foreign_rows"), F.count("*").alias("total_rows"))


@query(
    _BASE
    + r""", t AS (SELECT user_id, row_id, 'text' AS field, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM ix
            UNION ALL SELECT user_id, row_id, 'title', unnest(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'))) FROM ix WHERE text IS NOT NULL
            UNION ALL SELECT user_id, row_id, 'section_path', unnest(list_distinct(regexp_extract_all(lower(section_path), '[\p{L}\p{N}]+'))) FROM ix WHERE text IS NOT NULL)
     SELECT user_id, term, field, count(*) AS postings FROM t GROUP BY ALL"""
)
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the inverted lists by term."""
    return index.postings(index_rows(spark, sf).filter("text IS NOT NULL")).groupBy("user_id", "term", "field").agg(F.count("*").alias("postings"))


# --- context packs --------------------------------------------------------------------------------------------------
_BUDGET = 1000


def _pool(requests: DataFrame, rows: stored.StoredIndex) -> DataFrame:
    return materialize(search.hybrid(requests.withColumn("k", F.lit(search.CONTEXT_POOL)), rows), "pool")  # read twice or more


_NOTES = (
    _BASE.replace("result_limit AS k", "50 AS k")
    + _sem(2)
    + _lex(2)
    + _FUSE
    + r""",
     po AS (SELECT * FROM hy WHERE rank <= 50),
     fl AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id), 9) AS rel FROM po),
     nt AS (SELECT query_id, path, max(rel) AS score, min(rank) AS first, arg_min(title, rank) AS title, arg_min(type, rank) AS type,
                   string_agg(text, chr(10) || chr(10) ORDER BY coalesce(section_path, ''), chunk_index, row_id) AS text FROM fl WHERE rel >= 0.3 GROUP BY ALL),
     cd AS (SELECT *, len(regexp_extract_all(text, """
    + _TOK
    + ")) AS tokens, "
    + _SECTION
    + r""" AS section, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, path) AS ord FROM nt),
     gr AS (SELECT DISTINCT query_id, 0::BIGINT AS ord, 0::BIGINT AS used, false AS taken FROM cd
            UNION ALL SELECT c.query_id, c.ord, CASE WHEN g.used + c.tokens <= 1000 THEN g.used + c.tokens ELSE g.used END, g.used + c.tokens <= 1000 FROM gr g JOIN cd c ON c.query_id = g.query_id AND c.ord = g.ord + 1),
     pk AS (SELECT c.* FROM cd c JOIN gr g ON g.query_id = c.query_id AND g.ord = c.ord WHERE g.taken)"""
)
@query(_NOTES + " SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY ord) AS \"position\", path, round(score, 6) AS score, tokens, text FROM pk")
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    """A context pack of 1,000 tokens for every request."""
    pack = context.assemble(_pool(request_rows(spark, sf), stored_index(spark, sf)), budget=_BUDGET)
    return pack.select("query_id", "section", F.col("position").cast("long").alias("position"), "path", F.round("score", 6).alias("score"), "tokens", "text")


@query(
    _NOTES
    + """ SELECT f.query_id, 1000::BIGINT AS token_budget, coalesce(p.used, 0)::BIGINT AS tokens_used, coalesce(p.n, 0) AS chunks_included, f.under AS chunks_excluded, coalesce(c.n, 0) - coalesce(p.n, 0) AS budget_rejected
     FROM (SELECT query_id, count(*) FILTER (WHERE rel < 0.3) AS under FROM fl GROUP BY 1) f LEFT JOIN (SELECT query_id, sum(tokens) AS used, count(*) AS n FROM pk GROUP BY 1) p USING (query_id)
     LEFT JOIN (SELECT query_id, count(*) AS n FROM cd GROUP BY 1) c USING (query_id)"""
)
def context_meta(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(request_rows(spark, sf), stored_index(spark, sf))
    return context.meta(pool, context.assemble(pool, budget=_BUDGET), budget=_BUDGET)


@query(_NOTES + " SELECT query_id, path, round(rel, 6) AS relative FROM fl WHERE rel >= 0.3")
def context_floor(spark: SparkSession, sf: str) -> DataFrame:
    return context.over_floor(_pool(request_rows(spark, sf), stored_index(spark, sf))).select("query_id", "path", F.round("relative", 6).alias("relative"))


# --- chunking -------------------------------------------------------------------------------------------------------
def _packing_sql(source: str, most: int, glue: str) -> str:
    """``source`` gives (key, i, part); i counts from 1."""
    return (
        f"""WITH RECURSIVE src AS ({source}), p AS (SELECT key, i, part, len(regexp_extract_all(part, {_TOK})) AS n FROM src),
     f AS (SELECT key, 1::BIGINT AS i, 0::BIGINT AS g, n AS used FROM p WHERE i = 1
           UNION ALL SELECT p.key, p.i, CASE WHEN f.used + p.n > {most} THEN f.g + 1 ELSE f.g END, CASE WHEN f.used + p.n > {most} THEN p.n ELSE f.used + p.n END FROM f JOIN p ON p.key = f.key AND p.i = f.i + 1)"""
        + f" SELECT f.key, f.g AS chunk_index, string_agg(p.part, '{glue}' ORDER BY p.i) AS text FROM f JOIN p ON p.key = f.key AND p.i = f.i GROUP BY ALL"
    )


@query(
    _packing_sql("SELECT doc_id AS key, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)", 60, "\n").replace(
        "SELECT f.key,", "SELECT f.key AS doc_id,"
    )
)
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document packed up to 60 tokens."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(packing.pack_lines("text", 60)).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    _packing_sql(
        r"SELECT chunk_id AS key, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS part FROM (SELECT chunk_id, list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n\s*'), lambda x: length(trim(x)) > 0) AS s"
        " FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL))",
        100,
        "\n\n",
    ).replace("SELECT f.key,", "SELECT f.key AS chunk_id,")
)
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of every chunk packed up to 100 tokens."""
    rows = chunk_rows(spark, sf, "text").filter("text IS NOT NULL")
    return rows.select("chunk_id", F.posexplode(packing.pack_paragraphs("text", 100)).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    r"""WITH s AS (SELECT user_id, path, chunk_index AS seq, chunk_id, coalesce(section_path, '') AS section_path, text, len(regexp_extract_all(text, """
    + _TOK
    + r""")) AS tokens FROM (SELECT * FROM chunks WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1)),
     o AS (SELECT *, row_number() OVER (PARTITION BY user_id, path ORDER BY seq, chunk_id) AS ord FROM s),
     g AS (SELECT *, sum((tokens >= 100)::INT) OVER (PARTITION BY user_id, path ORDER BY ord) AS grp FROM o),
     m AS (SELECT user_id, path, grp, min(ord) AS first, arg_min(section_path, ord) AS section_path, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, sum(tokens)::BIGINT AS tokens FROM g GROUP BY ALL)
     SELECT user_id, path, row_number() OVER (PARTITION BY user_id, path ORDER BY first) - 1 AS chunk_index, section_path, text, tokens FROM m"""
)
def section_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Short sections of a note joined to the one before."""
    rows = chunk_rows(spark, sf, "user_id", "path", "chunk_index", "section_path", "text").filter("text IS NOT NULL").withColumn("tokens", T.token_count("text").cast("long")).withColumn("section_path", F.coalesce("section_path", F.lit("")))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("user_id", "path").orderBy("chunk_index", "chunk_id")))
    return packing.merge_short(rows, ["user_id", "path"], "ord", "tokens", "section_path", "text").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    r"""WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, concat_ws(', ', CASE WHEN trim(o_orderkey::VARCHAR) <> '' THEN 'o_orderkey: ' || o_orderkey END,
                   CASE WHEN trim(o_orderstatus) <> '' THEN 'o_orderstatus: ' || o_orderstatus END, CASE WHEN trim(o_orderpriority) <> '' THEN 'o_orderpriority: ' || o_orderpriority END) AS line FROM orders)
     SELECT o_custkey, ((n - 1) // 5) AS chunk_index, 'customer-' || o_custkey || ' > Rows ' || min(n) || '-' || max(n) AS section_path, string_agg(line, chr(10) ORDER BY n) AS text FROM r GROUP BY o_custkey, (n - 1) // 5"""
)
def chunk_csv_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of every customer as a CSV document, five rows a chunk."""
    rows = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    name = F.concat(F.lit("customer-"), F.col("o_custkey").cast("string"))
    return chunking.csv_rows(rows, ["o_custkey"], "n", ["o_orderkey", "o_orderstatus", "o_orderpriority"], name, 5).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _documents_json(spark: SparkSession, sf: str, field: str) -> DataFrame:
    """Every note as JSON: its chunks' texts and, between them, a node that is no text."""
    rows = chunk_rows(spark, sf, "user_id", "path", "chunk_index", "text").select("user_id", "path", F.struct("chunk_index", "chunk_id", F.lit("text").alias("type"), "text", (F.col("chunk_id") % 7 == 0).alias("isDeleted")).alias("x"))
    other = rows.withColumn("x", F.struct(F.col("x.chunk_index"), (-F.col("x.chunk_id")).alias("chunk_id"), F.lit("group").alias("type"), F.lit("frame").alias("text"), F.lit(False).alias("isDeleted")))
    listed = rows.unionByName(other).groupBy("user_id", "path").agg(F.array_sort(F.collect_list("x")).alias(field))
    return listed.select("user_id", "path", F.to_json(F.struct(field)).alias("content"), T.stem("path").alias("name"))


_TRIMMED = r"regexp_replace(text, '^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]+|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]+$', '', 'g')"
_TEXTS = rf"""
WITH t AS (SELECT user_id, path, chunk_index AS seq, chunk_id, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1') AS name, {_TRIMMED} AS text FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1),
     k AS (SELECT *, row_number() OVER (PARTITION BY user_id, path ORDER BY seq, chunk_id) AS ord FROM t WHERE text <> ''"""


@query(_TEXTS + ") SELECT user_id, path, ord - 1 AS chunk_index, name || ' > Node ' || ord AS section_path, text FROM k")
def chunk_canvas(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.canvas(_documents_json(spark, sf, "nodes"), ["user_id", "path"], "content", "name").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    _TEXTS
    + f""" AND chunk_id % 7 <> 0), l AS (SELECT *, len(regexp_extract_all(text, {_TOK})) >= 100 AS long FROM k),
     b AS (SELECT *, long OR coalesce(lag(long) OVER (PARTITION BY user_id, path ORDER BY ord), true) AS opens FROM l),
     g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id, path ORDER BY ord) AS grp FROM b)
     SELECT user_id, path, (grp - 1)::BIGINT AS chunk_index, any_value(name) || ' > Text ' || grp AS section_path, string_agg(text, chr(10) ORDER BY ord) AS text FROM g GROUP BY user_id, path, grp"""
)
def chunk_excalidraw(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of drawings, neighbours of fewer than 100 tokens joined."""
    return chunking.excalidraw(_documents_json(spark, sf, "elements"), ["user_id", "path"], "content", "name", 100).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    rf"""WITH RECURSIVE d AS (SELECT DISTINCT page_id, user_id, path, page_num, {_TRIMMED} AS text FROM pdf_pages WHERE text IS NOT NULL),
     z AS (SELECT *, len(regexp_extract_all(text, {_TOK})) AS n FROM d), y AS (SELECT * FROM z WHERE n >= 10),
     src AS (SELECT page_id AS key, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS part FROM (SELECT page_id, CASE WHEN n > 500 THEN list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n\s*'), lambda x: length(trim(x)) > 0) ELSE [text] END AS s FROM y)),
     p AS (SELECT key, i, part, len(regexp_extract_all(part, {_TOK})) AS n FROM src),
     f AS (SELECT key, 1::BIGINT AS i, 0::BIGINT AS g, n AS used FROM p WHERE i = 1
           UNION ALL SELECT p.key, p.i, CASE WHEN f.used + p.n > 500 THEN f.g + 1 ELSE f.g END, CASE WHEN f.used + p.n > 500 THEN p.n ELSE f.used + p.n END FROM f JOIN p ON p.key = f.key AND p.i = f.i + 1),
     c AS (SELECT f.key, f.g, string_agg(p.part, chr(10) || chr(10) ORDER BY p.i) AS text FROM f JOIN p ON p.key = f.key AND p.i = f.i GROUP BY ALL)
     SELECT user_id, path, row_number() OVER (PARTITION BY user_id, path ORDER BY page_num, page_id, g) - 1 AS chunk_index, path || ' > Page ' || page_num AS section_path, c.text FROM c JOIN y ON y.page_id = c.key"""
)
def chunk_pdf(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pdf_pages").select("page_id", "user_id", "path", "page_num", "text").distinct()
    return chunking.pdf_pages(pages, ["user_id", "path"], "page_num", "text", F.col("path")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query()
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every document parsed as a Markdown note."""
    docs = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return chunking.markdown(docs, ["doc_id"])


@query()
def ingest_index(spark: SparkSession, sf: str) -> DataFrame:
    """One run from an empty index: documents as files, chunked by format and embedded."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL AND path IS NOT NULL").groupBy("user_id", "path").agg(F.max_by("text", "doc_id").alias("content"))
    snapshot = docs.select("user_id", "path", T.content_hash("content").alias("content_hash"))
    none = spark.createDataFrame([], index.SCHEMA)
    _, rows, _ = corpus.ingest(docs, snapshot.limit(0), none, hashing_embedder(), snapshot)
    return rows.select("user_id", "path", "chunk_index", "section_path", "text", F.size("vector").alias("dim"))


# --- changes and state ----------------------------------------------------------------------------------------------
def _state(spark: SparkSession, sf: str) -> DataFrame:
    rows = newest(table(spark, sf, "indexed_files"), ["user_id", "path"], ["indexed_at"])
    return rows.select("user_id", "path", "file_id", F.lower("content_hash").alias("content_hash"))


def _before_after(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A stored state without every 7th file, and a snapshot without every 5th, with every 11th changed and every 13th moved."""
    rows = _state(spark, sf)
    old = rows.filter("file_id % 7 <> 0").drop("file_id")
    path = F.when(F.col("file_id") % 13 == 0, F.concat(F.lit("Moved/"), "path")).otherwise(F.col("path"))
    hash_ = F.when(F.col("file_id") % 11 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    return old, rows.filter("file_id % 5 <> 0").select("user_id", path.alias("path"), hash_.alias("content_hash"))


_SIDES = """
WITH st AS (SELECT user_id, path, file_id, lower(content_hash) AS h FROM indexed_files QUALIFY row_number() OVER (PARTITION BY user_id, path ORDER BY indexed_at DESC) = 1),
     o AS (SELECT user_id, path, h FROM st WHERE file_id % 7 <> 0),
     n AS (SELECT user_id, CASE WHEN file_id % 13 = 0 THEN 'Moved/' || path ELSE path END AS path, CASE WHEN file_id % 11 = 0 THEN h || 'x' ELSE h END AS h FROM st WHERE file_id % 5 <> 0),
     j AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.path, o.path) AS path, n.h AS new_h, o.h AS old_h,
                  CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN n.h IS DISTINCT FROM o.h THEN 'updated' ELSE 'unchanged' END AS type
           FROM n FULL JOIN o ON n.user_id = o.user_id AND n.path = o.path)"""


@query(_SIDES + " SELECT user_id, path, type, new_h AS content_hash FROM j")
def changes_classify(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _before_after(spark, sf)
    return changes.classify(new, old).select("user_id", "path", "type", "content_hash")


@query(
    _SIDES
    + """, src AS (SELECT user_id, old_h AS h, max(path) AS old_path FROM j WHERE type = 'deleted' AND old_h IS NOT NULL GROUP BY ALL),
     mv AS (SELECT j.user_id, j.path, 'moved' AS type, new_h AS content_hash, src.old_path FROM j JOIN src ON src.user_id = j.user_id AND src.h = j.new_h WHERE type = 'created')
     SELECT * FROM mv UNION ALL SELECT user_id, path, type, new_h, NULL FROM j WHERE type = 'updated'
     UNION ALL SELECT user_id, path, type, new_h, NULL FROM j WHERE type = 'created' AND (user_id, path) NOT IN (SELECT (user_id, path) FROM mv)
     UNION ALL SELECT user_id, path, type, NULL, NULL FROM j WHERE type = 'deleted' AND (user_id, path) NOT IN (SELECT (user_id, old_path) FROM mv)"""
)
def changes_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Change events with moves."""
    old, new = _before_after(spark, sf)
    return changes.diff(new, old)


@query(_SIDES + " SELECT user_id, path, h AS content_hash FROM n")
def state_after(spark: SparkSession, sf: str) -> DataFrame:
    """The state after the events is the snapshot."""
    old, new = _before_after(spark, sf)
    return changes.next_state(old, changes.diff(new, old), new)


@query(_SIDES + " SELECT n.user_id, n.path, n.h AS content_hash FROM n JOIN o ON n.user_id = o.user_id AND n.path = o.path AND n.h = o.h")
def stable_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _before_after(spark, sf)
    return changes.stable(old, new)


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, "user_id", "path", "text").filter("text IS NOT NULL").select("user_id", F.concat("path", F.lit("#"), "chunk_id").alias("path"), F.col("text").alias("content"))


@query(
    r"""WITH n AS (SELECT DISTINCT user_id, path || '#' || chunk_id AS note, unnest(regexp_extract_all(text, '!\[\[([^\]]+)\]\]', 1)) AS ref FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1)),
     e AS (SELECT DISTINCT user_id, note, string_split(string_split(ref, '|')[1], '/')[-1] AS name FROM n),
     i AS (SELECT DISTINCT user_id, 'attachments/' || name AS image, name FROM e WHERE regexp_matches(lower(name), '\.(png|jpg|jpeg|gif|svg|webp|bmp)$'))
     SELECT i.user_id, image, string_agg(note, '|' ORDER BY note) AS linked_notes FROM i JOIN e ON e.user_id = i.user_id AND e.name = i.name GROUP BY ALL"""
)
def backlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that embed each image."""
    notes = _embedded(spark, sf)
    images = notes.select("user_id", F.explode(changes.embeds("content")).alias("name")).distinct().select("user_id", F.concat(F.lit("attachments/"), "name").alias("path"))
    return changes.backlinks(images, notes).withColumn("linked_notes", F.array_join("linked_notes", "|"))


@query("WITH e AS (SELECT DISTINCT event_id, user_id, path, type FROM file_change_events), n AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY path, type, event_id) - 1) // 100 AS batch FROM e) SELECT user_id, batch, count(*) AS events FROM n GROUP BY ALL")
def event_batches(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "file_change_events").select("event_id", "user_id", "path", "type").distinct()
    return changes.in_batches(events).groupBy("user_id", "batch").agg(F.count("*").alias("events"))


@query("SELECT user_id, count(*) AS events, count(*) FILTER (WHERE type <> 'deleted') AS to_process FROM file_change_events GROUP BY 1")
def event_progress(spark: SparkSession, sf: str) -> DataFrame:
    return changes.progress(table(spark, sf, "file_change_events"), ["user_id"])


# --- index mutations ------------------------------------------------------------------------------------------------
def _old_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = chunk_rows(spark, sf, "user_id", "path", "title", "chunk_index", "text", "status").select(F.col("chunk_id").alias("row_id"), "user_id", "path", "title", "chunk_index", "text", "status")
    return rows.filter("row_id % 3 <> 0"), rows.filter("row_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), F.coalesce("text", F.lit(""))))


_OLDNEW = """
WITH c AS (SELECT chunk_id AS row_id, user_id, path, title, chunk_index, text, status FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1),
     o AS (SELECT * FROM c WHERE row_id % 3 <> 0), n AS (SELECT row_id, user_id, path, title, chunk_index, 'new ' || coalesce(text, '') AS text, status FROM c WHERE row_id % 5 = 0)"""


@query(_OLDNEW + " SELECT * FROM o WHERE row_id NOT IN (SELECT row_id FROM n) UNION ALL SELECT * FROM n")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return index.upsert(*_old_new(spark, sf), ["row_id"])


@query(_OLDNEW + " SELECT * FROM o WHERE (user_id, path) NOT IN (SELECT (user_id, path) FROM n) UNION ALL SELECT * FROM n")
def replace_documents(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_new(spark, sf)
    return index.replace_documents(old, new, new)


@query(_OLDNEW + " SELECT c.* FROM c LEFT JOIN (SELECT user_id, path, min(chunk_index) + 1 AS m FROM c GROUP BY ALL HAVING min(row_id) % 2 = 0) s USING (user_id, path) WHERE m IS NULL OR chunk_index < m")
def stale_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_rows(spark, sf, "user_id", "path", "title", "chunk_index", "text", "status").select(F.col("chunk_id").alias("row_id"), "user_id", "path", "title", "chunk_index", "text", "status")
    sizes = rows.groupBy("user_id", "path").agg((F.min("chunk_index") + 1).alias("n"), F.min("row_id").alias("r")).filter("r % 2 = 0")
    return index.stale_tail(rows, sizes)


@query(_OLDNEW + " SELECT row_id, user_id, path, title, chunk_index, text, CASE WHEN chunk_index >= 2 AND user_id = 'u-harbor' THEN 'archived' ELSE status END AS status FROM c")
def patch_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_rows(spark, sf, "user_id", "path", "title", "chunk_index", "text", "status").select(F.col("chunk_id").alias("row_id"), "user_id", "path", "title", "chunk_index", "text", "status")
    return index.patch_payload(rows, (F.col("chunk_index") >= 2) & (F.col("user_id") == "u-harbor"), status="archived")


@query(_OLDNEW + r""", m AS (SELECT DISTINCT user_id, path AS old_path, 'Moved/' || path AS path FROM n)
     SELECT o.row_id, o.user_id, coalesce(m.path, o.path) AS path, CASE WHEN m.path IS NULL THEN o.title ELSE regexp_replace(string_split(m.path, '/')[-1], '(.)\.[^.]*$', '\1') END AS title, o.chunk_index, o.text, o.status
     FROM o LEFT JOIN m ON m.user_id = o.user_id AND m.old_path = o.path""")
def move_documents(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_new(spark, sf)
    return index.move_documents(old, new.select("user_id", F.col("path").alias("old_path"), F.concat(F.lit("Moved/"), "path").alias("path")).distinct())


@query(_OLDNEW + " SELECT user_id, count(*) AS rows_left FROM c WHERE NOT (user_id = 'u-harbor' AND status = 'archived') OR status IS NULL GROUP BY 1")
def delete_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_rows(spark, sf, "user_id", "status")
    return index.delete_where(rows, "u-harbor", F.col("status") == "archived").groupBy("user_id").agg(F.count("*").alias("rows_left"))


@query("SELECT user_id, count(*) AS rows_left FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1) WHERE user_id <> 'u-harbor' AND user_id <> '' GROUP BY 1")
def purge_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return index.purge_unowned(index.purge_tenant(chunk_rows(spark, sf, "user_id"), "u-harbor")).groupBy("user_id").agg(F.count("*").alias("rows_left"))


@query("""
WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1)
SELECT chunk_id, concat_ws(';', CASE WHEN project IS NOT NULL THEN 'project=' || project END, CASE WHEN chunk_id % 2 = 1 THEN 'reviewed=yes' END, CASE WHEN chunk_id % 2 = 0 AND status IS NOT NULL THEN 'status=' || status END) AS metadata FROM c""")
def patch_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A patch that adds a key and removes another, on odd rows."""
    old = F.map_filter(F.create_map(F.lit("project"), F.col("project"), F.lit("status"), F.col("status")), lambda _, v: v.isNotNull())
    patch = F.when(F.col("chunk_id") % 2 == 1, F.create_map(F.lit("status"), F.lit(None).cast("string"), F.lit("reviewed"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.array_sort(F.map_entries(index.patch_metadata(old, patch)))
    return chunk_rows(spark, sf, "project", "status").select("chunk_id", F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


# --- scalar functions -----------------------------------------------------------------------------------------------
@query(r"SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(regexp_replace(text, '!\[\[[^\]]*\]\]', '', 'g'), '\[\[([^\]|]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g') AS text FROM chunks WHERE text IS NOT NULL")
def plain_wiki(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, "text").filter("text IS NOT NULL").select("chunk_id", T.plain_wiki("text").alias("text"))


@query(f"SELECT chunk_id, any_value({_SECTION}) AS section FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1) GROUP BY chunk_id")
def classify_section(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, "type", "path").select("chunk_id", T.section_of("type", "path").alias("section"))


@query("SELECT DISTINCT chunk_id, sha256(text) AS sha FROM chunks WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, "text").filter("text IS NOT NULL").select("chunk_id", T.content_hash("text").alias("sha"))


@query("""WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1),
     h AS (SELECT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(user_id || ':' || path || ':' || chunk_index)) AS h FROM c)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', instr('0123456789abcdef', h[17]) % 4 + CASE WHEN instr('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Name-based ids of all chunks."""
    return index.with_ids(chunk_rows(spark, sf, "user_id", "path", "chunk_index")).select("chunk_id", "point_id")


@query(rf"SELECT doc_id, len(regexp_extract_all(text, {_TOK})) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS terms FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.token_count("text").cast("long").alias("tokens"), F.size(F.array_distinct(T.terms("text"))).cast("long").alias("terms"))


_BLANK_TOK = r"'[ \t\n\r\f\x0B]*(?:[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B])'"


@query(f"SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, {_BLANK_TOK})[1:8191], '')) AS whole, array_to_string(regexp_extract_all(text, {_BLANK_TOK})[1:40], '') AS start FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut to what an embedder takes, and to 40 tokens."""
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.content_hash(T.truncate_tokens("text", EMBED_TOKENS)).alias("whole"), T.truncate_tokens("text", 40).alias("start"))


@query(r"""SELECT CASE WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp', 'bmp') THEN 'image' WHEN e IN ('md', 'pdf', 'csv', 'canvas', 'excalidraw') THEN e ELSE 'md' END AS file_type, count(*) AS files
     FROM (SELECT lower(regexp_extract(string_split(path, '/')[-1], '\.([^.]*)$', 1)) AS e FROM indexed_files) GROUP BY 1""")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "indexed_files").groupBy(T.file_type("path").alias("file_type")).agg(F.count("*").alias("files"))


# --- evaluation -----------------------------------------------------------------------------------------------------
def _channel_lists(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, channel, rank, path) of the first ten scored points per channel, path standing for the point."""
    last = table(spark, sf, "search_results").groupBy("request_id", "vec_id", "channel").agg(F.max(F.struct("scored_at", "score")).alias("l"))
    scored = last.filter("l.score IS NOT NULL AND NOT isnan(l.score)").select(F.col("request_id").alias("query_id"), "channel", F.col("vec_id").alias("path"), F.col("l.score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "path"))).filter(F.col("rank") <= evaluate.DEPTH)


_RECALL = """
WITH s AS (SELECT request_id AS query_id, vec_id, channel, score FROM (SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY request_id, vec_id, channel ORDER BY scored_at DESC, score DESC) = 1) WHERE score IS NOT NULL AND NOT isnan(score)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, vec_id) AS rank FROM s),
     g AS (SELECT query_id, vec_id FROM r WHERE channel = 'usage' AND rank <= 3), q AS (SELECT DISTINCT request_id AS query_id, category FROM search_requests),
     n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
     h AS (SELECT query_id, category, n, {}) FROM n JOIN q USING (query_id))"""
_RECALL = _RECALL.replace(
    "{})",
    ", ".join(f"(SELECT count(*) FROM r WHERE r.query_id = n.query_id AND channel = '{c}' AND rank <= 10 AND vec_id IN (SELECT vec_id FROM g WHERE g.query_id = n.query_id)) / n::DOUBLE AS {c}" for c in ("semantic", "lexical", "rerank")),
)


@query(_RECALL + " SELECT query_id, category, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(rerank, 6) AS rerank FROM h")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of three channels against the three points used most."""
    lists = _channel_lists(spark, sf)
    relevant = lists.filter("channel = 'usage' AND rank <= 3").groupBy("query_id").agg(F.collect_set("path").alias("relevant"))
    out = relevant.join(request_rows(spark, sf).select("query_id", "category"), "query_id")
    for c in ("semantic", "lexical", "rerank"):
        got = evaluate.ranked_lists(lists.filter(F.col("channel") == c)).withColumnRenamed("retrieved", f"__{c}")
        out = out.join(got, "query_id", "left").withColumn(c, evaluate.recall_at_k(F.coalesce(f"__{c}", F.array().cast("array<long>")), F.col("relevant")))
    return out.select("query_id", "category", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "rerank")])


@query(
    _RECALL
    + """, a AS (SELECT category, count(*) AS queries, round(avg(round(semantic, 6)), 6) AS semantic, round(avg(round(lexical, 6)), 6) AS lexical, round(avg(round(rerank, 6)), 6) AS rerank FROM h GROUP BY ROLLUP (category))
     SELECT *, semantic >= 0.7 AND lexical >= 0.7 AND rerank >= 0.7 AS passed FROM a"""
)
def recall_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(recall_at_k(spark, sf), ["semantic", "lexical", "rerank"])


# --- monitoring -----------------------------------------------------------------------------------------------------
@query("SELECT event_id, count(*) OVER w AS in_window, round(count(*) OVER w / 300.0::DOUBLE, 9) AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)")
def metric_rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rolling_rate(table(spark, sf, "events"), ["event_type"], 300).select("event_id", "in_window", F.round("rate", 9).alias("rate"))


_COUNTER = """
WITH i AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS up FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events)),
     r AS (SELECT *, sum(up) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) / 300.0::DOUBLE AS rate FROM i)"""


def _counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counter_rate(table(spark, sf, "events"), ["user_id", "event_type"], 300, tie="event_id")


@query(_COUNTER + " SELECT event_id, round(rate, 6) AS rate FROM r")
def metric_counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a user's events of a type as a counter with resets: its rate over five minutes."""
    return _counter_rates(spark, sf).select("event_id", F.round("rate", 6).alias("rate"))


@query(
    _COUNTER
    + """, l AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, event_type, arg_max(rate, (ts, event_id)) AS rate FROM r GROUP BY ALL)
     SELECT window_start, event_type, round(sum(rate), 6) AS value FROM l GROUP BY ALL"""
)
def metric_sum_by(spark: SparkSession, sf: str) -> DataFrame:
    """Rates summed over users by type, hour by hour."""
    summed = metrics.sum_by(_counter_rates(spark, sf), ["event_type"], ["user_id", "event_type"], "1 hour", tie="event_id")
    return summed.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.round("value", 6).alias("value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS increase FROM events GROUP BY ALL")
def metric_increase_1h(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.increase(table(spark, sf, "events"), ["event_type"], "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def counters_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(table(spark, sf, "events"), ["event_type"])


@query("SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1")
def gauges_last(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gauges(table(spark, sf, "events"), ["user_id"], tie="event_id").select("user_id", F.round("value", 6).alias("value"))


_LE = "(VALUES (5.0), (10.0), (25.0), (50.0), (75.0), (100.0), (250.0), ('inf'::DOUBLE)) b(le)"
_BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0]


@query(f"SELECT event_type, le::VARCHAR AS le, count(*) FILTER (WHERE value <= le) AS count FROM events, {_LE} GROUP BY ALL")
def histogram_buckets(spark: SparkSession, sf: str) -> DataFrame:
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return metrics.histogram(table(spark, sf, "events"), ["event_type"], _BOUNDS).select("event_type", le.alias("le"), "count")


@query(f"""
WITH h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS c FROM events, {_LE} GROUP BY ALL),
     o AS (SELECT *, lag(le, 1, 0.0::DOUBLE) OVER w AS low, lag(c, 1, 0) OVER w AS base, max(c) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS want FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (want - base) / (c - base) END, 6) AS p95 FROM o WHERE c >= want AND base < want""")
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    buckets = metrics.histogram(table(spark, sf, "events"), ["event_type"], _BOUNDS)
    return metrics.histogram_quantile(buckets, ["event_type"], 0.95).select("event_type", F.round("value", 6).alias("p95"))


@query("SELECT event_type, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY 1")
def metric_mean(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.histogram(table(spark, sf, "events"), ["event_type"], _BOUNDS).filter("isnull(nullif(le, double('Infinity')))")
    return h.select("event_type", F.round(metrics.ratio(F.col("sum"), F.col("count")), 6).alias("mean"))


@query("""
WITH i AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS up FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, round(sum(up), 4) AS increase FROM i GROUP BY 1""")
def counter_resets(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a user as a counter: drops are resets."""
    return metrics.increments(table(spark, sf, "events"), ["user_id"], tie="event_id").groupBy("user_id").agg(F.round(F.sum("increase"), 4).alias("increase"))


@query("""
WITH b AS (SELECT *, value > 20 AS bad, min(ts) OVER (PARTITION BY user_id) AS born FROM events)
SELECT event_id, bool_and(bad) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AND epoch_us(ts) - epoch_us(born) >= 3600000000 AS firing FROM b""")
def alert_held(spark: SparkSession, sf: str) -> DataFrame:
    """Values over 20 for an hour."""
    return metrics.held_for(table(spark, sf, "events"), ["user_id"], F.col("value") > 20, 3600).select("event_id", "firing")


# --- registry and jobs ----------------------------------------------------------------------------------------------
@query("""
WITH a AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'updated' END AS change
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal <> b.c_acctbal""")
def registry_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = rows.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return registry.diff(rows.filter("c_custkey % 5 <> 0"), new, "c_custkey")


@query("SELECT path, count(*) AS versions FROM indexed_files WHERE user_id = 'u-harbor' AND starts_with(path, 'Projects/') GROUP BY 1")
def reindex_scope(spark: SparkSession, sf: str) -> DataFrame:
    """State rows of a tenant's folder."""
    return corpus.scope_of(table(spark, sf, "indexed_files"), "u-harbor", "folder", "Projects").groupBy("path").agg(F.count("*").alias("versions"))


# --- streaming ------------------------------------------------------------------------------------------------------
def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


@query("""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS total FROM events
WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def stream_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute counts of the event stream whose window the watermark has passed."""
    out = scratch(spark, "stream")
    counts = jobs.windowed_counts(_stream(spark, sf, "events"), ["event_type"])
    counts.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/data").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS deliveries, count(DISTINCT event_id) AS events FROM file_change_events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed streamed into a versioned table, each micro-batch once, and read back."""
    root = scratch(spark, "feed")
    kept = "event_id long, user_id string, path string, type string"
    feed = incremental.VersionedTable(spark, f"{root}/table", kept)
    jobs.ingest_stream(_stream(spark, sf, "file_change_events").select("event_id", "user_id", "path", "type"), feed, "feed", f"{root}/state").awaitTermination()
    return feed.read().groupBy("user_id").agg(F.count("*").alias("deliveries"), F.count_distinct("event_id").alias("events"))


# --- problem 4: only new or changed records -------------------------------------------------------------------------
_PENDING = """
WITH side AS (SELECT user_id, path, detected_at, event_id, type <> 'deleted' AS here, lower(content_hash) AS h FROM file_change_events
              UNION ALL SELECT user_id, old_path, detected_at, event_id, false, NULL FROM file_change_events WHERE type = 'moved' AND old_path IS NOT NULL AND old_path <> path),
     last AS (SELECT * FROM side QUALIFY row_number() OVER (PARTITION BY user_id, path ORDER BY detected_at DESC, event_id DESC, here DESC) = 1),
     st AS (SELECT user_id, path, lower(content_hash) AS sh, CASE WHEN regexp_matches(path, '(?i)\\.(png|jpg|svg|webp)$') THEN linked_notes IS NOT NULL ELSE embedding_model_version IS NOT NULL END AS complete
            FROM indexed_files QUALIFY row_number() OVER (PARTITION BY user_id, path ORDER BY indexed_at DESC) = 1),
     j AS (SELECT coalesce(l.user_id, s.user_id) AS user_id, coalesce(l.path, s.path) AS path, l.user_id IS NOT NULL AS ev, coalesce(here, true) AS here, h, s.user_id IS NOT NULL AS known, sh, complete
           FROM last l FULL JOIN st s ON l.user_id = s.user_id AND l.path = s.path)
SELECT user_id, path, CASE WHEN here THEN 'index' ELSE 'remove' END AS action FROM j
WHERE (here AND (NOT known OR NOT complete OR (ev AND NOT coalesce(sh = h, false)))) OR (NOT here AND known)"""


def _work_tables(spark: SparkSession) -> tuple[incremental.VersionedTable, incremental.VersionedTable, incremental.VersionedTable]:
    root = scratch(spark, "pending")
    return tuple(incremental.VersionedTable(spark, f"{root}/{name}", kind) for name, kind in (("feed", incremental.FEED), ("state", incremental.STATE), ("ledger", incremental.LEDGER)))


@query(_PENDING)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files the next run must index or remove. The given files become the first version of feed and state, without a copy."""
    feed, states, ledger = _work_tables(spark)
    ship_package(spark)
    feed.adopt(f"{sf}/file_change_events.parquet")
    states.adopt(f"{sf}/indexed_files.parquet")
    return incremental.pending(feed, states, ledger)


@query(_PENDING)
def p4_increments(spark: SparkSession, sf: str) -> DataFrame:
    """The same, reached over versions: the feed arrives in three deliveries, the state in two, with rows of other paths that a
    deletion vector takes out again; every version is followed by a run, one of which fails before its commit."""
    feed, states, ledger = _work_tables(spark)
    events, rows = table(spark, sf, "file_change_events"), table(spark, sf, "indexed_files")
    delivery = F.coalesce(F.pmod(F.col("scan_no"), F.lit(3)), F.lit(0))
    half = F.pmod(F.xxhash64("path", "indexed_at"), F.lit(2))
    strays = rows.withColumn("path", F.concat(F.lit("Strays/"), "path"))
    states.append(rows.filter(half == 0).unionByName(strays))
    for number in range(3):
        feed.append(events.filter(delivery == number))
        if number == 1:
            states.append(rows.filter(half == 1))
            ledger.stage(ledger.read())  # a run that dies after writing and before committing
        if number == 2:
            states.delete(F.col("path").startswith("Strays/"))
        incremental.update_ledger(feed, states, ledger)
    return incremental.pending(feed, states, ledger)


@query("SELECT user_id, count(*) AS deliveries FROM file_change_events GROUP BY 1")
def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The feed arriving in three versions, each processed by a run of its own; one run fails before its commit and is
    repeated. Every delivery is in the output once."""
    root = scratch(spark, "runs")
    kind = "event_id long, user_id string, scan_no int"
    source, sink = incremental.VersionedTable(spark, f"{root}/source", kind), incremental.VersionedTable(spark, f"{root}/sink", kind)
    feed = table(spark, sf, "file_change_events").select("event_id", "user_id", "scan_no")
    for number in range(3):
        source.append(feed.filter(F.coalesce(F.pmod(F.col("scan_no"), F.lit(3)), F.lit(0)) == number))
        if number == 1:
            sink.stage(source.changes(number, number + 1, net=False))  # a run that dies after writing and before committing
        incremental.run_once(source, sink, lambda delta: delta)
    return sink.read().groupBy("user_id").agg(F.count("*").alias("deliveries"))
