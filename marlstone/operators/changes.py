"""Change feed of a snapshot against the stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import IMAGE_EXTENSIONS, base_name, extension
from marlstone.operators.ranking import running_position

KEY = ["user_id", "path"]


def classify(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """(user_id, path, type, content_hash, old_hash) with type created, updated, unchanged or deleted; one row per path."""
    new = snapshot.select(*KEY, F.col("content_hash").alias("content_hash"), F.lit(True).alias("here"))
    old = state.select(*KEY, F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    both = new.join(old, KEY, "full")
    kind = F.when(F.col("known").isNull(), "created").when(F.col("here").isNull(), "deleted").when(~F.col("content_hash").eqNullSafe(F.col("old_hash")), "updated").otherwise("unchanged")
    return both.select(*KEY, kind.alias("type"), "content_hash", "old_hash")


def diff(snapshot: DataFrame, state: DataFrame, moves: bool = True) -> DataFrame:
    """Change events (user_id, path, type, content_hash, old_path).

    A created path whose hash equals that of a deleted path of its tenant is a move from it; where several deleted
    paths have the hash, from the last by name, and several created ones may claim the same. Deleted paths that no
    move has used stay deleted.
    """
    all_ = classify(snapshot, state).filter("type <> 'unchanged'")
    plain = all_.filter("type = 'updated'").select(*KEY, "type", "content_hash", F.lit(None).cast("string").alias("old_path"))
    created, deleted = all_.filter("type = 'created'"), all_.filter("type = 'deleted'")
    none = F.lit(None).cast("string")
    if not moves:
        rest = created.select(*KEY, "type", "content_hash", none.alias("old_path")).unionByName(deleted.select(*KEY, "type", none.alias("content_hash"), none.alias("old_path")))
        return plain.unionByName(rest)
    sources = deleted.filter("old_hash IS NOT NULL").groupBy("user_id", F.col("old_hash").alias("content_hash")).agg(F.max("path").alias("old_path"))
    arrived = created.join(sources, ["user_id", "content_hash"], "left")
    arrived = arrived.select(*KEY, F.when(F.col("old_path").isNotNull(), "moved").otherwise("created").alias("type"), "content_hash", "old_path")
    used = arrived.filter("type = 'moved'").select("user_id", F.col("old_path").alias("path"))
    gone = deleted.join(used, KEY, "left_anti").select(*KEY, "type", none.alias("content_hash"), none.alias("old_path"))
    return plain.unionByName(arrived).unionByName(gone)


def stable(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the current snapshot whose hash the previous look at the files has shown too; others wait for the next."""
    return current.join(previous.select(*KEY, F.col("content_hash").alias("__seen")), KEY).filter(F.col("__seen") == F.col("content_hash")).drop("__seen")


def next_state(state: DataFrame, events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """State after the events: rows of deleted and moved-from paths leave, rows of new and changed paths come from the
    snapshot. Commit it after the index, so that a failed run is repeated."""
    gone = events.select("user_id", "path").unionByName(events.filter("type = 'moved'").select("user_id", F.col("old_path").alias("path"))).distinct()
    fresh = snapshot.join(events.filter("type <> 'deleted'").select(*KEY).distinct(), KEY, "left_semi")
    return state.join(gone, KEY, "left_anti").unionByName(fresh.select(*[c for c in state.columns if c in fresh.columns]), allowMissingColumns=True)


def embeds(content: str | Column) -> Column:
    """File names of the embeds in a note: alias and folder stripped."""
    inner = F.regexp_extract_all(F.col(content) if isinstance(content, str) else content, F.lit(r"!\[\[([^\]]+)\]\]"), 1)
    return F.array_distinct(F.transform(inner, lambda x: F.element_at(F.split(F.element_at(F.split(x, r"\|"), 1), "/"), -1)))


def backlinks(images: DataFrame, notes: DataFrame) -> DataFrame:
    """(user_id, image, linked_notes): the notes of the tenant that embed an image by its name, sorted. ``images`` is (user_id,
    path), ``notes`` (user_id, path, content). Images nobody embeds have no row."""
    refs = notes.select("user_id", F.col("path").alias("note"), F.explode(embeds("content")).alias("name"))
    wanted = images.filter(extension("path").isin(IMAGE_EXTENSIONS)).select("user_id", F.col("path").alias("image"), base_name("path").alias("name"))
    return wanted.join(refs, ["user_id", "name"]).groupBy("user_id", "image").agg(F.sort_array(F.collect_set("note")).alias("linked_notes"))


def in_batches(events: DataFrame, size: int = 100) -> DataFrame:
    """Events with the batch they are sent in, ``size`` a batch per tenant, in order of path. Ranges of a busy tenant are cut by the first
    bytes of its paths."""
    first = F.conv(F.rpad(F.hex(F.substring(F.encode("path", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    numbered = running_position(events.withColumn("__order", first), ["user_id"], "__order", ["path", "type"])
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long")).drop("__order", "position")


def progress(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events, and those of them that are work (all but deletions)."""
    return events.groupBy(*(by or [])).agg(F.count("*").alias("events"), F.count_if(F.col("type") != "deleted").alias("to_process"))
