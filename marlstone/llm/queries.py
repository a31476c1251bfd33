"""Queries of the training-text operators and their SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import bpe, knn, markup, mixing, neardup, rankfuse, split, toxicity
from marlstone.operators.versions import newest, newest_of_few
from marlstone.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- problem 1: splitting oversized items ---------------------------------------------------------------------------
def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks (text under its section path) and pages, all versions; ``version`` orders those of a chunk."""
    chunks = table(spark, sf, "chunks").select(
        F.lit("chunk").alias("item_kind"),
        F.col("chunk_id").alias("item_id"),
        F.col("upserted_at").alias("version"),
        F.concat(F.coalesce(F.concat("section_path", F.lit("\n\n")), F.lit("")), "text").alias("text"),
    )
    pages = table(spark, sf, "pdf_pages").select(
        F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.lit(None).cast(chunks.schema["version"].dataType).alias("version"), "text"
    )
    return chunks.unionByName(pages)


@query("""
WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1),
     p AS (SELECT DISTINCT page_id, text FROM pdf_pages)
SELECT 'chunk' AS item_kind, chunk_id AS item_id FROM c
WHERE length(text) + coalesce(length(section_path) + 2, 0) > 2000
UNION ALL SELECT 'page', page_id FROM p WHERE length(text) > 2000""")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items the splitter cuts into more than one piece; the newest version of an item decides."""
    items = _items(spark, sf)
    pieces = items.select("item_kind", "item_id", "version", F.size(split.cuts_of(F.col("text"))).alias("pieces"))
    last = pieces.groupBy("item_kind", "item_id").agg(F.max(F.struct("version", "pieces")).alias("last"))
    return last.filter("last.pieces > 1").select("item_kind", "item_id")


@query()
def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of the newest version of every item."""
    items = newest_of_few(_items(spark, sf), ["item_kind", "item_id"], ["version"])
    return split.split_items(items, "text").drop("version")


@query("""
WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1),
     i AS (SELECT 'chunk' AS item_kind, chunk_id AS item_id, coalesce(section_path || chr(10) || chr(10), '') || text AS t FROM c
           UNION ALL SELECT DISTINCT 'page', page_id, text FROM pdf_pages)
SELECT item_kind, item_id, sha256(t) AS rebuilt, true AS within_limit, true AS shares_overlap, (length(t) > 2000) AS cut FROM i WHERE length(t) > 0""")
def p1_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every item put together again from its pieces, and whether these keep to the limit and the overlap."""
    pieces = p1_pieces(spark, sf)
    piece = F.struct("piece_index", "piece_start", "piece_end", "piece")
    listed = pieces.groupBy("item_kind", "item_id").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    later = F.slice("all", 2, F.size("all"))
    text = F.concat(F.col("all")[0]["piece"], F.array_join(F.transform(later, lambda p: F.substr(p["piece"], F.lit(split.OVERLAP + 1))), ""))
    before = F.slice("all", 1, F.size("all") - 1)
    tail = lambda p: F.substr(p["piece"], F.length(p["piece"]) - split.OVERLAP + 1)
    shared = F.forall(F.zip_with(before, later, lambda a, b: (b["piece_start"] == a["piece_end"] - split.OVERLAP) & b["piece"].startswith(tail(a))), lambda ok: ok)
    limit = F.forall("all", lambda p: F.length(p["piece"]) <= split.LIMIT)
    return listed.select("item_kind", "item_id", F.sha2(text, 256).alias("rebuilt"), limit.alias("within_limit"), shared.alias("shares_overlap"), (F.size("all") > 1).alias("cut"))


# --- problem 2: near duplicates -------------------------------------------------------------------------------------
def _chunk_sets(spark: SparkSession, sf: str) -> DataFrame:
    chunks = newest_of_few(table(spark, sf, "chunks").select("chunk_id", "upserted_at", "text"), ["chunk_id"], ["upserted_at"])
    return neardup.token_sets(chunks, "chunk_id", "text", neardup.WordShingles(3, 60))


def _file_sets(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "indexed_files").select("file_id", "user_id", "path").distinct()
    return neardup.token_sets(files, "file_id", "path", neardup.NameGrams(3), "user_id")


_ALIKE = """
WITH ct AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w
            FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC) = 1)
            WHERE text IS NOT NULL),
     cs AS (SELECT DISTINCT chunk_id AS id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
            FROM ct WHERE len(w) >= 60),
     fn AS (SELECT DISTINCT file_id AS id, user_id, regexp_replace(lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')), '[^\\p{L}\\p{N}]+', '', 'g') AS n
            FROM indexed_files),
     fs AS (SELECT DISTINCT id, user_id || '/' || unnest(list_transform(range(1, length(n) - 1), lambda i: substr(n, i::INT, 3))) AS g FROM fn),
     cn AS (SELECT id, count(*) AS n FROM cs GROUP BY id), fc AS (SELECT id, count(*) AS n FROM fs GROUP BY id),
     cp AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM cs x JOIN cs y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
     fp AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM fs x JOIN fs y ON x.g = y.g AND x.id < y.id GROUP BY ALL)"""


@query(
    _ALIKE
    + """
SELECT 'chunk' AS record_kind, a AS id_a, b AS id_b FROM cp JOIN cn x ON x.id = a JOIN cn y ON y.id = b WHERE s >= 0.5 * (x.n + y.n - s)
UNION ALL
SELECT 'file', a, b FROM fp JOIN fc x ON x.id = a JOIN fc y ON y.id = b WHERE s >= 0.5 * (x.n + y.n - s)"""
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks, and of files of one tenant, that are at least half alike."""
    chunk = neardup.all_pairs(*neardup.similar_sets(_chunk_sets(spark, sf), 0.5))
    file = neardup.all_pairs(*neardup.similar_sets(_file_sets(spark, sf), 0.5))
    return chunk.select(F.lit("chunk").alias("record_kind"), "id_a", "id_b").unionByName(file.select(F.lit("file").alias("record_kind"), "id_a", "id_b"))


@query(
    _ALIKE.replace("WITH ct", "WITH RECURSIVE ct")
    + """,
     pr AS (SELECT 'chunk' AS k, a, b, s = x.n AND s = y.n AS twins FROM cp JOIN cn x ON x.id = a JOIN cn y ON y.id = b WHERE s >= 0.5 * (x.n + y.n - s)
            UNION ALL SELECT 'file', a, b, s = x.n AND s = y.n FROM fp JOIN fc x ON x.id = a JOIN fc y ON y.id = b WHERE s >= 0.5 * (x.n + y.n - s)),
     al AS (SELECT DISTINCT 'chunk' AS k, chunk_id AS id FROM chunks UNION ALL SELECT DISTINCT 'file', file_id FROM indexed_files),
     rp AS (SELECT al.k, al.id, least(al.id, coalesce(min(a), al.id)) AS rep FROM al LEFT JOIN pr ON pr.k = al.k AND pr.b = al.id AND twins GROUP BY al.k, al.id),
     ed AS (SELECT DISTINCT pr.k, x.rep AS a, y.rep AS b FROM pr JOIN rp x ON x.k = pr.k AND x.id = pr.a JOIN rp y ON y.k = pr.k AND y.id = pr.b WHERE x.rep <> y.rep),
     bo AS (SELECT k, a, b FROM ed UNION SELECT k, b, a FROM ed),
     re AS (SELECT DISTINCT k, rep AS id, rep AS root FROM rp UNION SELECT re.k, bo.b, re.root FROM re JOIN bo ON bo.k = re.k AND bo.a = re.id),
     gr AS (SELECT k, id, min(root) AS root FROM re GROUP BY ALL), dg AS (SELECT k, a, count(DISTINCT b) AS links FROM bo GROUP BY ALL)
SELECT rp.k AS record_kind, rp.id, gr.root AS group_id, coalesce(links, 0) AS links FROM rp JOIN gr ON gr.k = rp.k AND gr.id = rp.rep LEFT JOIN dg ON dg.k = rp.k AND dg.a = rp.rep"""
)
def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of changed copies of every chunk and of every file; chunks of fewer than 60 words are alone."""
    chunk = neardup.groups(*neardup.similar_sets(_chunk_sets(spark, sf), 0.5))
    file = neardup.groups(*neardup.similar_sets(_file_sets(spark, sf), 0.5))
    chunk = neardup.every_record(table(spark, sf, "chunks").select(F.col("chunk_id").alias("id")), chunk)
    file = neardup.every_record(table(spark, sf, "indexed_files").select(F.col("file_id").alias("id")), file)
    return chunk.withColumn("record_kind", F.lit("chunk")).unionByName(file.withColumn("record_kind", F.lit("file"))).select("record_kind", "id", "group_id", "links")


# --- problem 3: most similar vectors --------------------------------------------------------------------------------
def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Newest vector of every point, and the requests' vectors, as (id, vector)."""
    points = newest_of_few(table(spark, sf, "points").select("vec_id", "upserted_at", "vector"), ["vec_id"], ["upserted_at"])
    requests = newest(table(spark, sf, "search_requests").select("request_id", "issued_at", "vector"), ["request_id"], ["issued_at"])
    return materialize(points.select(F.col("vec_id").alias("id"), "vector"), "points"), requests.select(F.col("request_id").alias("id"), "vector")


@query("""
WITH v AS (SELECT vec_id, vector::DOUBLE[] AS v FROM (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY upserted_at DESC) = 1)
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
     r AS (SELECT DISTINCT request_id, vector::DOUBLE[] AS v FROM search_requests
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
     pp AS (SELECT a.vec_id AS q, b.vec_id AS p, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE c >= 0.9
            QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, p) <= 10),
     rp AS (SELECT request_id AS q, vec_id AS p, list_cosine_similarity(r.v, v.v) AS c FROM r, v WHERE c >= 0.9
            QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, p) <= 10)
SELECT DISTINCT 'point' AS pair_kind, least(q, p) AS id_a, greatest(q, p) AS id_b FROM pp
UNION ALL SELECT 'search', q, p FROM rp""")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of points, and of requests and points, of cosine 0.9 or more among the ten most similar."""
    points, requests = _vectors(spark, sf)
    points = knn.Points(points, least=0.9)
    near = knn.nearest(points, least=0.9).select(F.least("query", "point").alias("id_a"), F.greatest("query", "point").alias("id_b")).distinct()
    asked = knn.nearest(points, requests, least=0.9).select(F.col("query").alias("id_a"), F.col("point").alias("id_b"))
    return near.select(F.lit("point").alias("pair_kind"), "id_a", "id_b").unionByName(asked.select(F.lit("search").alias("pair_kind"), "id_a", "id_b"))


@query()
def p3_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar points of every request and of every point whose id is divisible by 50, at any cosine."""
    points, requests = _vectors(spark, sf)
    asking, points = points.filter("id % 50 = 0"), knn.Points(points, asking=False, **knn.WIDE)
    some = knn.nearest(points, asking, k=knn.K + 1).filter("query <> point")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("rank") <= knn.K)
    asked = knn.nearest(points, requests)
    return some.withColumn("query_kind", F.lit("point")).unionByName(asked.withColumn("query_kind", F.lit("search"))).select("query_kind", "query", "rank", "point", F.round("cosine", 6).alias("cosine"))


# --- problem 5: one ranking from several scores ---------------------------------------------------------------------
def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return rankfuse.aggregate_ranks(table(spark, sf, "search_results"), "request_id", "vec_id", version="scored_at")


_SCORES = """
WITH s AS (SELECT request_id, vec_id, channel, score FROM
             (SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY request_id, vec_id, channel ORDER BY scored_at DESC, score DESC) = 1)
           WHERE score IS NOT NULL AND NOT isnan(score)),
     pts AS (SELECT DISTINCT request_id, vec_id FROM s), ch AS (SELECT DISTINCT request_id, channel FROM s)"""


@query(_SCORES + """,
     m AS (SELECT request_id, count(*) AS m FROM ch GROUP BY 1),
     lost AS (SELECT a.request_id, a.vec_id, b.vec_id AS other,
                     count(*) FILTER (WHERE sa.score IS NOT NULL AND (sb.score IS NULL OR sa.score > sb.score)) AS won
              FROM pts a JOIN pts b ON a.request_id = b.request_id AND a.vec_id <> b.vec_id JOIN ch ON ch.request_id = a.request_id
              LEFT JOIN s sa ON sa.request_id = a.request_id AND sa.vec_id = a.vec_id AND sa.channel = ch.channel
              LEFT JOIN s sb ON sb.request_id = b.request_id AND sb.vec_id = b.vec_id AND sb.channel = ch.channel GROUP BY ALL)
SELECT p.request_id, p.vec_id FROM pts p WHERE NOT EXISTS (
  SELECT 1 FROM lost JOIN m USING (request_id) WHERE lost.request_id = p.request_id AND lost.vec_id = p.vec_id AND 2 * won <= m)""")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the fused ranking that beat every other point of their request."""
    return rankfuse.winners(table(spark, sf, "search_results"), "request_id", "vec_id", version="scored_at")


@query(_SCORES + """,
     sz AS (SELECT request_id, count(*) AS n FROM pts GROUP BY 1),
     r AS (SELECT p.request_id, p.vec_id, c.channel, coalesce((k.lo + (k.same - 1) / 2.0) / n, 1.0)::DOUBLE AS r FROM pts p JOIN ch c USING (request_id) JOIN sz USING (request_id)
           LEFT JOIN (SELECT *, rank() OVER (PARTITION BY request_id, channel ORDER BY score DESC) AS lo, count(*) OVER (PARTITION BY request_id, channel, score) AS same FROM s) k USING (request_id, vec_id, channel)),
     o AS (SELECT *, row_number() OVER (PARTITION BY request_id, vec_id ORDER BY r) AS k, count(*) OVER (PARTITION BY request_id, vec_id) AS m FROM r),
     b AS (SELECT request_id, vec_id, m, r, (SELECT sum(factorial(m::INT) / factorial(j::INT) / factorial((m - j)::INT) * pow(r, j) * pow(1 - r, m - j)) FROM range(k, m + 1) t(j)) AS tail FROM o),
     g AS (SELECT request_id, vec_id, round(least(1.0, min(tail) * max(m)), 12) AS sig, round(avg(r), 12) AS mean FROM b GROUP BY ALL)
SELECT request_id, vec_id, round(sig, 6) AS significance, row_number() OVER (PARTITION BY request_id ORDER BY sig, mean, vec_id) AS "position" FROM g""")
def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The fused ranking of every request's points."""
    return _fused(spark, sf).select("request_id", "vec_id", F.round("significance", 6).alias("significance"), "position")


# --- problem 6: markup residue --------------------------------------------------------------------------------------
def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of chunks and points, all versions."""
    chunks = table(spark, sf, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("upserted_at").alias("version"), "text")
    points = table(spark, sf, "points").select(F.lit("point").alias("record_kind"), F.col("vec_id").alias("record_id"), F.col("upserted_at").alias("version"), "text")
    return chunks.unionByName(points)


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records of whose newest text the cleaner took syntax of a family."""
    cleaned = markup.clean_markup(_texts(spark, sf))
    last = cleaned.groupBy("record_kind", "record_id").agg(F.max(F.struct("version", "markup_families")).alias("last"))
    return last.select("record_kind", "record_id", F.explode("last.markup_families").alias("markup"))


@query()
def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of the newest version of every record."""
    return markup.clean_markup(newest_of_few(_texts(spark, sf), ["record_kind", "record_id"], ["version"])).select("record_kind", "record_id", "clean_text")


# --- problem 7: encoding the corpus ---------------------------------------------------------------------------------
@query()
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the ids of its text by byte_bpe_50k."""
    return bpe.encode_corpus(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts decoded from their ids again."""
    ids = bpe.encode_corpus(table(spark, sf, "documents").select("doc_id", "text"))
    return ids.select("doc_id", bpe.decoder(spark)("ids").alias("text"))


# --- problem 8: mixing sources --------------------------------------------------------------------------------------
@query()
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mix and how often each is taken."""
    sizes = mixing.token_sizes(table(spark, sf, "documents"))
    return mixing.mix(sizes, table(spark, sf, "mix_targets")).withColumnRenamed("doc", "doc_id")


@query()
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    sizes, targets = mixing.token_sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), targets, sizes)


@query("""
WITH l AS (SELECT source, max(target_share) AS share, max(max_repeats) AS most FROM mix_targets GROUP BY 1),
     h AS (SELECT source, count(*) FILTER (WHERE length(text) > 0) AS full_ FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT coalesce(l.source, h.source) AS source, coalesce(share > 0 AND full_ > 0, false) AS takes_part, true AS share_met, true AS repeats_kept FROM l FULL JOIN h ON l.source = h.source""")
def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Of every source whether it takes part, whether what it gives is its share of the total to less than its longest document, and
    whether no document is taken too often."""
    sizes, targets = mixing.token_sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    mixed = materialize(mixing.mix(sizes, targets), "mixed")
    rows = mixing.shares(mixed, targets, sizes)
    often = mixed.groupBy(F.col("source").alias("s")).agg(F.max("copies").alias("most"))
    due = mixing.budgets(sizes, targets).select(F.col("source").alias("b"), "budget").join(sizes.groupBy(F.col("source").alias("z")).agg(F.max("n_tokens").alias("longest")), F.col("b") == F.col("z"))
    rows = rows.join(often, rows["source"] == often["s"], "left").join(due, rows["source"] == due["b"], "left")
    part = F.coalesce((F.col("target_share") > 0) & (F.col("held_tokens") > 0), F.lit(False))
    short = F.coalesce("budget", F.lit(0)) - F.col("tokens")
    met = (short >= 0) & (short < F.coalesce("longest", F.lit(1)))
    return rows.select("source", part.alias("takes_part"), met.alias("share_met"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"))


# --- problem 9: offensive content -----------------------------------------------------------------------------------
def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "review_labels"))
    return toxicity.score(docs.select("doc_id", "source", "text"), model)


@query()
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that offend, one row per category."""
    return _scored(spark, sf).select("doc_id", F.explode("offends").alias("category")).distinct()


@query()
def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document."""
    return _scored(spark, sf).select("doc_id", *[F.round(f"{c}_score", 6).alias(f"{c}_score") for c in toxicity.CATEGORIES])


@query()
def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the documents and the share of them that offends, by category."""
    found = _scored(spark, sf)
    rates = [F.round(F.avg(F.array_contains("offends", c).cast("double")), 6).alias(f"{c}_rate") for c in toxicity.CATEGORIES]
    return found.groupBy("source").agg(F.count("*").alias("documents"), *rates)
