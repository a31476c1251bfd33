"""The index: payload rows with vectors, and its mutations as plans over snapshots.

Built-in sources have no MERGE, so a mutation is the old rows without the changed keys, and the new rows. Rows are keyed by
(user_id, path, chunk_index); replacing all rows of a changed path also removes the tail that a longer version left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import chunk_uuid, stem, terms

KEY = ["user_id", "path", "chunk_index"]
PROMOTED = ["tags", "project", "status", "type"]
_KINDS = {"row_id": T.LongType(), "chunk_index": T.IntegerType(), "tags": T.ArrayType(T.StringType()), "vector": T.ArrayType(T.FloatType())}
_NAMES = "row_id user_id path title chunk_index section_path text tags project status type content_hash extra_metadata vector".split()
SCHEMA = T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in _NAMES])


def tenant(index: DataFrame, user_id: str | None) -> DataFrame:
    """The rows of one tenant; the only way in for single-tenant readers."""
    if not user_id:
        raise ValueError("a tenant is required")
    return index.filter(F.col("user_id") == user_id)


def payload(chunks: DataFrame, metadata: Column) -> DataFrame:
    """Chunks with the four promoted fields of a note's metadata (map<string,string> of JSON values) and the rest as JSON."""
    text = F.transform_values(metadata, lambda _, v: F.regexp_replace(v, '^"|"$', ""))
    given = metadata["tags"]
    tags = F.when(F.substring(given, 1, 1) == "[", F.from_json(given, "array<string>")).when(given.isNotNull(), F.array(text["tags"])).otherwise(F.array().cast("array<string>"))
    rest = F.map_filter(metadata, lambda k, _: ~k.isin(PROMOTED))
    return chunks.withColumns({"tags": tags, "project": text["project"], "status": text["status"], "type": text["type"], "extra_metadata": F.to_json(rest)})


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with their name-based point id; equal keys always have equal ids."""
    return rows.withColumn("point_id", chunk_uuid("user_id", "path", "chunk_index"))


def omit(map_: Column, keys: list[str]) -> Column:
    return F.map_filter(map_, lambda k, _: ~k.isin(keys))


def upsert(index: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows replace those of equal keys."""
    return index.join(rows.select(*(keys or KEY)).distinct(), keys or KEY, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_documents(index: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """All rows of the documents (user_id, path) are replaced by ``rows``; a document without new rows has none left."""
    return index.join(documents.select("user_id", "path").distinct(), ["user_id", "path"], "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_documents(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.join(documents.select("user_id", "path").distinct(), ["user_id", "path"], "left_anti")


def delete_where(index: DataFrame, user_id: str, condition: Column) -> DataFrame:
    """Without the tenant's rows that meet the condition."""
    return index.filter(~F.coalesce((F.col("user_id") == user_id) & condition, F.lit(False)))


def stale_tail(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Without rows at or past the new number of chunks, ``sizes`` being (user_id, path, n)."""
    joined = index.join(sizes.select("user_id", "path", F.col("n").alias("__n")), ["user_id", "path"], "left")
    return joined.filter(F.col("__n").isNull() | (F.col("chunk_index") < F.col("__n"))).drop("__n").select(*index.columns)


def patch_payload(index: DataFrame, condition: Column, **values) -> DataFrame:
    """Payload columns set where the condition holds; vectors stay."""
    held = F.coalesce(condition, F.lit(False))
    return index.withColumns({c: F.when(held, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def move_documents(index: DataFrame, moves: DataFrame) -> DataFrame:
    """Path and title rewritten for moves (user_id, old_path, path), vectors kept; rows already at the new path give way."""
    to = moves.select("user_id", F.col("old_path").alias("__old"), F.col("path").alias("__new"))
    clear = index.join(to.select("user_id", F.col("__new").alias("path")), ["user_id", "path"], "left_anti")
    stays = clear.join(to.select("user_id", F.col("__old").alias("path")), ["user_id", "path"], "left_anti")
    goes = index.join(to, (index["user_id"] == to["user_id"]) & (index["path"] == to["__old"])).drop(to["user_id"])
    goes = goes.withColumn("path", F.col("__new")).withColumn("title", stem("__new")).select(*index.columns)
    return stays.select(*index.columns).unionByName(goes)


def purge_tenant(index: DataFrame, user_id: str) -> DataFrame:
    return index.filter(~F.col("user_id").eqNullSafe(user_id))


def purge_unowned(index: DataFrame) -> DataFrame:
    return index.filter(F.col("user_id").isNotNull() & (F.col("user_id") != ""))


def patch_metadata(old: Column, updates: Column) -> Column:
    """Shallow merge of maps, updates winning; a null value removes its key."""
    keys = F.map_keys(updates)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(keys, k))
    return F.map_concat(kept, F.map_filter(updates, lambda _, v: v.isNotNull()))


def set_state(state: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """State rows with the columns that ``updates`` (user_id, path, columns) has for them."""
    new = updates.select("user_id", "path", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = state.join(new, ["user_id", "path"], "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in state.columns])


def apply_changes(index: DataFrame, events: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after a batch of events, ``rows`` holding the new chunks of created and updated paths. Moves keep their
    vectors; deletes of images touch nothing, as images have no rows."""
    moved = move_documents(index, events.filter("type = 'moved'").select("user_id", "old_path", "path"))
    left = delete_documents(moved, events.filter("type = 'deleted'"))
    return replace_documents(left, rows, events.filter("type IN ('created', 'updated')"))


# --- layout ---------------------------------------------------------------------------------------------------------
def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order; those an older version lacks are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_layout(index: DataFrame, location: str) -> None:
    """The index partitioned by tenant and sorted by path inside files, so that readers prune by both. A large tenant is spread over
    tasks by path instead of being written by one."""
    placed = index.repartition("user_id", F.pmod(F.xxhash64("path"), F.lit(16)))
    placed.sortWithinPartitions("user_id", "path", "chunk_index").write.mode("overwrite").partitionBy("user_id").option("compression", "zstd").parquet(location)


def postings(index: DataFrame) -> DataFrame:
    """(user_id, term, field, row_id): the inverted lists of the three full-text fields."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(terms(f)).alias("terms")) for f in ("text", "title", "section_path")])
    each = index.select("user_id", "row_id", F.explode(fields).alias("f"))
    return each.select("user_id", F.explode("f.terms").alias("term"), F.col("f.field").alias("field"), "row_id")
