"""An index on shared storage: rows by tenant, vectors apart from texts, inverted lists by tenant and term.

Written once and searched many times. Files are parted by a bucket of the tenant, inverted lists by a bucket of tenant and
term, so a search reads the buckets it asks for; inside files rows are sorted, and a large bucket is spread over files. A list
holds the row ids of a term by field; the list of a frequent term comes in parts, each of the rows of one shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.vector import usable
from marlstone.operators.index import SCHEMA, conform, postings
from marlstone.session import materialize

TENANT_BUCKETS, TERM_BUCKETS = 16, 16
#: Rows, and entries of inverted lists, that one file of a bucket holds at most, about.
FILE_ROWS, FILE_ENTRIES = 500_000, 20_000_000
#: Entries of the inverted lists that a row has, about; only the number of files depends on it.
ENTRIES = 100
FIELDS = ["text", "title", "section_path"]
#: Columns that rank and filter results; texts are fetched for the results alone.
NARROW = ["row_id", "path", "chunk_index", "tags", "project", "status", "type"]


def tenant_bucket() -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(TENANT_BUCKETS)).cast("int")


def term_key() -> Column:
    return F.xxhash64("user_id", "term")


def term_check() -> Column:
    """Beside the key it makes 96 bits that stand for tenant and term, so that texts are neither stored in the lists nor joined on."""
    return F.hash("user_id", "term")


def term_bucket() -> Column:
    return F.pmod("key", F.lit(TERM_BUCKETS)).cast("int")


def _listed(entries: DataFrame, shards: int) -> DataFrame:
    """(key, check, df, text, title, section_path) of entries (key, check, field, row_id): row ids by field, at most those of a shard in
    one list."""
    shard = F.pmod(F.xxhash64("row_id"), F.lit(shards)).alias("shard")
    ids = [F.collect_list(F.when(F.col("field") == i, F.col("row_id"))).alias(f) for i, f in enumerate(FIELDS)]
    return entries.groupBy("key", "check", shard).agg(F.count("*").alias("df"), *ids).drop("shard")


def _entries(rows: DataFrame) -> DataFrame:
    number = F.coalesce(*[F.when(F.col("field") == f, F.lit(i)) for i, f in enumerate(FIELDS)])
    return postings(rows).select(term_key().alias("key"), term_check().alias("check"), number.alias("field"), "row_id")


def places(lists: DataFrame, *more: str) -> DataFrame:
    """(key, check, field, row_id) and more columns, one row per entry of lists."""
    each = F.concat(*[F.transform(f, lambda r: F.struct(F.lit(i).alias("field"), r.alias("row_id"))) for i, f in enumerate(FIELDS)])
    return lists.select("key", "check", *more, F.explode(each).alias("e")).select("key", "check", *more, "e.field", "e.row_id")


class LiveIndex:
    """The same interface over plain index rows; what is asked of them is worked out anew each time."""

    def __init__(self, rows: DataFrame):
        self.all = rows.filter("text IS NOT NULL")

    def rows(self, buckets: list[int]) -> DataFrame:
        return self.all

    def vectors(self, buckets: list[int], dim: int) -> DataFrame:
        return self.all.filter(usable(F.col("vector"), dim)).select("user_id", *NARROW, "vector")

    def lists(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, check, text, title, section_path) of the wanted (key, check), and the wanted that occur: (key, check, df)."""
        posted = materialize(_listed(_entries(self.all).join(wanted, ["key", "check"], "left_semi"), TERM_BUCKETS), "posted")
        return posted.drop("df"), posted.groupBy("key", "check").agg(F.sum("df").alias("df"))


class StoredIndex:
    """An index under ``root``, as ``write`` lays it out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @staticmethod
    def write(rows: DataFrame, root: str) -> StoredIndex:
        """Rows without a text are not found by any search and not stored. Repeated row ids are the caller's to avoid."""
        rows = conform(rows, SCHEMA).filter("text IS NOT NULL")
        count = rows.count()
        spread = lambda per, times=1: max(1, math.ceil(count * times / per))
        apart = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n))

        def put(part: DataFrame, name: str) -> None:
            part.write.option("compression", "zstd").mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")

        n = spread(FILE_ROWS)
        kept = rows.withColumn("bucket", tenant_bucket()).repartition(TENANT_BUCKETS * n, "bucket", apart(n))
        put(kept.sortWithinPartitions("bucket", "user_id", "path", "chunk_index"), "rows")
        stored = rows.sparkSession.read.parquet(f"{root}/rows")
        put(stored.filter("vector IS NOT NULL").select("user_id", *NARROW, "vector", "bucket").repartition(TENANT_BUCKETS * n, "bucket", apart(n)), "vectors")
        n = spread(FILE_ENTRIES, ENTRIES)
        listed = _listed(_entries(stored), n).withColumn("bucket", term_bucket())
        put(listed.repartition(TERM_BUCKETS * n, "bucket", F.pmod("key", F.lit(n * 7))).sortWithinPartitions("bucket", "key"), "lists")
        return StoredIndex(rows.sparkSession, root)

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def rows(self, buckets: list[int]) -> DataFrame:
        """Rows of the tenants of some buckets."""
        return self._read("rows", buckets).drop("bucket")

    def vectors(self, buckets: list[int], dim: int) -> DataFrame:
        return self._read("vectors", buckets).drop("bucket").filter(usable(F.col("vector"), dim))

    def lists(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """As in ``LiveIndex``; the lists hold the terms of the wanted buckets. The driver learns at most as many numbers as there are
        buckets."""
        lists = self._read("lists", wanted.agg(F.collect_set(term_bucket())).first()[0]).drop("bucket")
        often = lists.select("key", "check", "df").join(wanted, ["key", "check"], "left_semi").groupBy("key", "check").agg(F.sum("df").alias("df"))
        return lists.drop("df"), often


def opened(index: DataFrame | LiveIndex | StoredIndex) -> LiveIndex | StoredIndex:
    return LiveIndex(index) if isinstance(index, DataFrame) else index
