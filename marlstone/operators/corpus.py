"""Ingest of a tenant's files into the index: dispatch by format, one run from snapshot to committed index, reindex jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import file_type, stem
from marlstone.operators import changes, chunking, index

DOC = ["user_id", "path"]


def chunk_documents(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(user_id, path, title, chunk_index, section_path, text) of documents (user_id, path, content) by their format, and of PDF
    pages (user_id, path, page_num, text). Images have no chunks."""
    named = docs.withColumn("title", stem("path")).withColumn("__kind", file_type("path"))
    one = lambda kind: named.filter(F.col("__kind") == kind)
    keep = [*DOC, "title"]
    parts = [
        chunking.markdown(one("md"), keep, "content", "title"),
        chunking.csv_text(one("csv"), keep, "content", "title"),
        chunking.canvas(one("canvas"), keep, "content", "title"),
        chunking.excalidraw(one("excalidraw"), keep, "content", "title"),
    ]
    if pages is not None:
        parts.append(chunking.pdf_pages(pages.withColumn("title", stem("path")), keep, "page_num", "text", F.col("title")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest(docs: DataFrame, state: DataFrame, current: DataFrame, embed: Callable[[Column], Column], snapshot: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, index', state') of one run. Only created and updated documents are read, chunked and embedded; moved ones keep
    their vectors. Images are not embedded: the state rows of new, changed and moved ones get the notes among ``docs`` that embed
    them, as a JSON list, if the state has ``linked_notes``. Write the index before the state."""
    events = changes.diff(snapshot, state)
    work = events.filter("type IN ('created', 'updated')").select(*DOC, F.col("content_hash"))
    fresh = docs.join(work, DOC)
    sheets = pages.join(work.select(*DOC), DOC, "left_semi") if pages is not None else None
    rows = chunk_documents(fresh.select(*DOC, "content"), sheets).join(work, DOC)
    rows = rows.withColumn("vector", embed(F.col("text"))).withColumn("row_id", F.xxhash64(*DOC, "chunk_index"))
    after = changes.next_state(state, events, snapshot)
    if "linked_notes" in after.columns:
        after = link_images(after, events, docs)
    return events, index.apply_changes(current, events, rows), after


def link_images(state: DataFrame, events: DataFrame, notes: DataFrame) -> DataFrame:
    """State with the links of the images that the events speak of; an image that no note embeds has an empty list."""
    images = events.filter("type <> 'deleted'").select(*DOC).distinct().filter(file_type("path") == "image")
    found = changes.backlinks(images, notes.select(*DOC, "content").filter(file_type("path") == "md"))
    linked = images.join(found.withColumnRenamed("image", "path"), DOC, "left")
    links = F.to_json(F.coalesce("linked_notes", F.array().cast("array<string>")))
    return index.set_state(state, linked.select(*DOC, links.alias("linked_notes")), ["linked_notes"])


@dataclass
class ReindexJob:
    scope: str
    target: str | None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str = "running"
    files_processed: int = 0
    total_files: int = 0
    errors: list[str] = field(default_factory=list)
    started_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    completed_at: str | None = None


def scope_of(state: DataFrame, user_id: str, scope: str, target: str | None = None) -> DataFrame:
    """State rows a reindex covers: all of a tenant, one path, or a folder (literal, case-sensitive prefix)."""
    rows = index.tenant(state, user_id)
    if scope == "full":
        return rows
    if scope not in ("path", "folder") or not target:
        raise ValueError("scope is 'full', or 'path' or 'folder' with a target")
    return rows.filter(F.col("path") == target) if scope == "path" else rows.filter(F.col("path").startswith(target.rstrip("/") + "/"))


def reindex(state: DataFrame, user_id: str, scope: str, target: str | None, process: Callable[[DataFrame], int]) -> ReindexJob:
    """Run ``process`` over the rows of the scope, hashes cleared so that they count as changed. A failure is recorded in the
    job, not raised."""
    job = ReindexJob(scope, target)
    rows = scope_of(state, user_id, scope, target).withColumn("content_hash", F.lit(None).cast("string"))
    job.total_files = rows.count()
    if scope == "path" and not job.total_files:
        raise KeyError(target)
    try:
        job.files_processed = process(rows)
        job.status = "completed"
    except Exception as e:
        job.status = "failed"
        job.errors.append(str(e).split("\n")[0])
    job.completed_at = datetime.now(timezone.utc).isoformat()
    return job
