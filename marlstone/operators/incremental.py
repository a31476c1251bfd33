"""Versioned tables of immutable files, record deltas between versions, and runs that process only those.

A version of a table adds and removes data files and adds deletion vectors (row positions that no longer count). The log
holds one small entry a version and a whole manifest every few versions, so neither committing nor reading a version
writes or reads the history again. Files, vectors and entries never change once written. The delta of two versions needs
only the files that one of them lacks and the vectors that differ. A consumer writes the version it has processed into
the very commit that publishes its output, so after any failure the next run starts where the last published one ended:
what was not committed is invisible, and what was committed is not processed again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import _path, delete_path

#: Versions between two whole manifests in the log.
CHECKPOINT = 10


class CommitConflict(RuntimeError):
    """Another writer has published the version first; read again and retry."""


@dataclass
class Manifest:
    version: int = 0
    files: list[str] = field(default_factory=list)
    #: data file -> folders of deletion vectors that have positions of it
    deleted: dict[str, list[str]] = field(default_factory=dict)
    #: versions of the sources that this version's content covers
    processed: dict[str, int] = field(default_factory=dict)


def _short(file: str) -> str:
    """Name of a data file's partition in a deletion vector."""
    return hashlib.md5(file.encode()).hexdigest()[:16]


class VersionedTable:
    """A table under ``root``, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # --- log --------------------------------------------------------------------------------------------------------
    def _entry(self, version: int, whole: bool = False) -> str:
        return f"{self.root}/_log/{version:012d}{'.whole' if whole else ''}.json"

    def _versions(self, whole: bool = False) -> list[int]:
        path, fs = _path(self.spark, f"{self.root}/_log")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:12]) for n in names if n[:1] != "." and n[12:] == (".whole.json" if whole else ".json"))

    def latest(self) -> int:
        return max(self._versions(), default=0)

    def _load(self, location: str) -> dict:
        path, fs = _path(self.spark, location)
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version (default: the latest); version 0 is the empty table."""
        version = self.latest() if version is None else version
        at = max((v for v in self._versions(whole=True) if v <= version), default=0)
        out = Manifest(**self._load(self._entry(at, whole=True))) if at else Manifest()
        files = dict.fromkeys(out.files)
        for v in range(at + 1, version + 1):
            entry = self._load(self._entry(v))
            for f in entry["removed"]:
                files.pop(f, None)
                out.deleted.pop(f, None)
            files.update(dict.fromkeys(entry["added"]))
            for f in entry["marked"]:
                out.deleted.setdefault(f, []).append(entry["vector"])
            out.processed.update(entry["processed"])
        out.version, out.files = version, list(files)
        return out

    def _put(self, location: str, content: dict) -> None:
        """Write beside and rename without overwriting, so that a file appears whole, once."""
        jvm = self.spark.sparkContext._jvm
        target, fs = _path(self.spark, location)
        fs.mkdirs(target.getParent())
        draft, _ = _path(self.spark, f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise CommitConflict(f"{location} exists") from e
            raise

    def commit(
        self, base: Manifest, added: list[str], removed: list[str] | None = None, vector: str | None = None, marked: list[str] | None = None, processed: dict[str, int] | None = None
    ) -> int:
        """Publish the version after ``base``: files added and removed, and the files of which ``vector`` holds positions."""
        version = base.version + 1
        self._put(self._entry(version), {"added": added, "removed": removed or [], "vector": vector, "marked": marked or [], "processed": processed or {}})
        if version % CHECKPOINT == 0:
            try:
                self._put(self._entry(version, whole=True), self.manifest(version).__dict__)
            except CommitConflict:
                pass  # the same manifest, left by a writer that died
        return version

    # --- writing ----------------------------------------------------------------------------------------------------
    def stage(self, rows: DataFrame) -> list[str]:
        """Write data files that no version refers to yet."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]).write.option("compression", "zstd").parquet(folder)
        path, fs = _path(self.spark, folder)
        return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))

    def append(self, rows: DataFrame, processed: dict[str, int] | None = None) -> int:
        base = self.manifest()
        return self.commit(base, self.stage(rows), processed=processed)

    def adopt(self, location: str, processed: dict[str, int] | None = None) -> int:
        """Add the Parquet files of a location that were written elsewhere and will not change. They are not copied, and not
        deleted by ``vacuum``."""
        base = self.manifest()
        return self.commit(base, sorted(self.spark.read.parquet(location).inputFiles()), processed=processed)

    def overwrite(self, rows: DataFrame, processed: dict[str, int] | None = None) -> int:
        base = self.manifest()
        return self.commit(base, self.stage(rows), base.files, processed=processed)

    def mark(self, gone: DataFrame) -> tuple[str, list[str]]:
        """A new deletion vector of rows (__file, __row), and its partitions. Older vectors are not written again, and which
        files have a share in it is read from the names of its folders."""
        folder = f"{self.root}/deleted/{uuid.uuid4().hex}"
        named = gone.select(F.substring(F.md5("__file"), 1, 16).alias("__part"), "__row")
        named.repartition("__part").write.partitionBy("__part").option("compression", "zstd").parquet(folder)
        path, fs = _path(self.spark, folder)
        return folder, [s.getPath().getName().partition("=")[2] for s in fs.listStatus(path) if s.isDirectory()]

    def replace(self, base: Manifest, gone: DataFrame | None, added: list[str], processed: dict[str, int] | None = None) -> int:
        """Commit added files together with the deletion of rows (__file, __row) of ``base``."""
        folder, parts = self.mark(gone) if gone is not None else (None, [])
        names = {_short(f): f for f in base.files} if parts else {}
        return self.commit(base, added, vector=folder, marked=[names[p] for p in parts], processed=processed)

    def delete(self, condition: Column, processed: dict[str, int] | None = None) -> int:
        """Mark the rows that meet the condition as deleted; no data file is rewritten."""
        base = self.manifest()
        gone = self.located(base).filter(condition).select("__file", "__row") if base.files else None
        return self.replace(base, gone, [], processed)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files and deletion vectors under the root that the last ``keep`` versions do not refer to, and with them what
        runs that died have left. No run may be under way. Returns the number of folders deleted."""
        latest = self.latest()
        used: set[str] = set()
        for v in range(max(1, latest - keep + 1), latest + 1):
            m = self.manifest(v)
            used |= {f.rpartition("/")[0].rpartition("/")[2] for f in m.files if f"{self.root.partition(':')[2] or self.root}/data/" in f}
            used |= {d.rpartition("/")[2] for ds in m.deleted.values() for d in ds}
        count = 0
        for kind in ("data", "deleted"):
            path, fs = _path(self.spark, f"{self.root}/{kind}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in used:
                    delete_path(self.spark, s.getPath().toString())
                    count += 1
        return count

    # --- reading ----------------------------------------------------------------------------------------------------
    def _empty(self, *more: T.StructField) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*self.schema.fields, *more]))

    def _vectors(self, deleted: dict[str, list[str]]) -> DataFrame:
        """(__part, __row) of the given vectors of the given files; only their own partitions are read."""
        by_folder: dict[str, list[str]] = {}
        for f, folders in deleted.items():
            for d in folders:
                by_folder.setdefault(d, []).append(_short(f))
        kind = "__row long, __part string"
        out = None
        for folder, parts in by_folder.items():
            rows = self.spark.read.schema(kind).option("basePath", folder).parquet(*[f"{folder}/__part={p}" for p in parts]).select("__part", "__row")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "__part string, __row long")

    def _scan(self, files: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*files)
        return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def located(self, manifest: Manifest) -> DataFrame:
        """Live rows of a manifest with their file and position. Only files that have deleted rows take part in a join."""
        held = [f for f in manifest.files if f in manifest.deleted]
        plain = [f for f in manifest.files if f not in manifest.deleted]
        out = self._scan(plain) if plain else None
        if held:
            part = F.substring(F.md5("__file"), 1, 16)
            left = self._scan(held).withColumn("__part", part).join(self._vectors({f: manifest.deleted[f] for f in held}), ["__part", "__row"], "left_anti").drop("__part")
            out = left.select(*[f.name for f in self.schema], "__file", "__row") if out is None else out.unionByName(left)
        return out if out is not None else self._empty(T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType()))

    def _rows(self, manifest: Manifest) -> DataFrame:
        """Live rows; without deletion vectors a plain scan, whose columns the planner can prune."""
        if not manifest.files:
            return self._empty()
        if not any(f in manifest.deleted for f in manifest.files):
            return self.spark.read.schema(self.schema).parquet(*manifest.files)
        return self.located(manifest).drop("__file", "__row")

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def withdrawn(self, old: int, new: int | None = None) -> bool:
        """Whether records of the old version may be missing in the new one: files removed, or rows marked."""
        a, b = self.manifest(old), self.manifest(new)
        return bool(set(a.files) - set(b.files)) or any(a.deleted.get(f) != b.deleted.get(f) for f in a.files if f in b.deleted)

    def changes(self, old: int, new: int | None = None, net: bool = True) -> DataFrame:
        """Record delta from one version to another: the columns and ``change`` (+n or -n for n equal records).

        Files of both versions are not read but for their rows whose deletion differs. With ``net`` records that leave
        with one file and come with another, as when files are rewritten, cancel out; equal records are counted.
        """
        a, b = self.manifest(old), self.manifest(new)
        was, now = set(a.files), set(b.files)
        sided = []
        for here, other, sign in ((b, was, 1), (a, now, -1)):
            own = [f for f in here.files if f not in other]
            if own:
                sided.append(self._rows(Manifest(files=own, deleted={f: here.deleted[f] for f in own if f in here.deleted})).withColumn("change", F.lit(sign)))
        moved = [f for f in b.files if f in was and a.deleted.get(f, []) != b.deleted.get(f, [])]
        if moved:
            before = self._vectors({f: [d for d in a.deleted.get(f, []) if d not in b.deleted.get(f, [])] for f in moved}).withColumn("change", F.lit(1))
            after = self._vectors({f: [d for d in b.deleted.get(f, []) if d not in a.deleted.get(f, [])] for f in moved}).withColumn("change", F.lit(-1))
            located = self._scan(moved).withColumn("__part", F.substring(F.md5("__file"), 1, 16))
            sided.append(located.join(before.unionByName(after), ["__part", "__row"]).drop("__part", "__file", "__row"))
        out = sided[0] if sided else self._empty(T.StructField("change", T.IntegerType()))
        for part in sided[1:]:
            out = out.unionByName(part)
        if net:
            out = out.groupBy(*[f"`{f.name}`" for f in self.schema]).agg(F.sum("change").alias("change")).filter("change <> 0")
        return out.withColumn("change", F.col("change").cast("long"))


def run_once(source: VersionedTable, sink: VersionedTable, transform: Callable[[DataFrame], DataFrame], name: str = "source", net: bool = False) -> int:
    """One run: process what is new in ``source`` since the version that ``sink`` has committed, and commit the output
    together with the version reached. Without news nothing is written. Returns the sink's version.

    A run that dies before its commit leaves only unreferenced files; the next one processes the same delta again.
    """
    base = sink.manifest()
    done, reached = base.processed.get(name, 0), source.latest()
    if done == reached:
        return base.version
    files = sink.stage(transform(source.changes(done, reached, net)))
    return sink.commit(base, files, processed={name: reached})


# --- the index's pending work ---------------------------------------------------------------------------------------
FEED = "event_id long, user_id string, path string, type string, content_hash string, old_path string, detected_at timestamp_ntz"
STATE = "user_id string, path string, content_hash string, indexed_at string, embedding_model_version string, linked_notes string"
_EVENT, _ROW = "struct<at:timestamp_ntz,id:bigint,here:boolean,hash:string>", "struct<at:timestamp,complete:boolean,hash:string>"
LEDGER = f"user_id string, path string, event {_EVENT}, row {_ROW}, action string"
# Fixed value: files that are linked to notes instead of being embedded.
IMAGES = r"(?i)\.(png|jpg|svg|webp)$"


def event_sides(events: DataFrame) -> DataFrame:
    """(user_id, path, event, row): what every event says of a path. A move ends its old path and makes its new one. Events without
    a tenant, path or time are left out."""
    here = F.struct(F.col("path").alias("path"), F.coalesce(F.col("type") != "deleted", F.lit(True)).alias("here"), F.lower("content_hash").alias("hash"))
    gone = F.struct(F.col("old_path").alias("path"), F.lit(False).alias("here"), F.lit(None).cast("string").alias("hash"))
    moved = (F.col("type") == "moved") & F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path"))
    sides = events.select("user_id", "detected_at", "event_id", F.explode(F.when(moved, F.array(here, gone)).otherwise(F.array(here))).alias("x"))
    event = F.struct(F.col("detected_at").alias("at"), F.col("event_id").alias("id"), F.col("x.here").alias("here"), F.col("x.hash").alias("hash"))
    rows = sides.select("user_id", F.col("x.path").alias("path"), event.cast(_EVENT).alias("event"), F.lit(None).cast(_ROW).alias("row"))
    return rows.filter("user_id IS NOT NULL AND path IS NOT NULL AND event.at IS NOT NULL")


def state_sides(state: DataFrame) -> DataFrame:
    """(user_id, path, event, row): what every state row says of its path. An image is complete by its links, any other file by the
    model it was embedded with; images are never embedded."""
    complete = F.when(F.col("path").rlike(IMAGES), F.col("linked_notes").isNotNull()).otherwise(F.col("embedding_model_version").isNotNull())
    row = F.struct(F.col("indexed_at").cast("timestamp").alias("at"), complete.alias("complete"), F.lower("content_hash").alias("hash"))
    rows = state.select("user_id", "path", F.lit(None).cast(_EVENT).alias("event"), row.cast(_ROW).alias("row"))
    return rows.filter("user_id IS NOT NULL AND path IS NOT NULL")


def _judged(sides: DataFrame) -> DataFrame:
    """One ledger row per path: its last event, its newest state row and the action they ask for."""
    last = sides.groupBy("user_id", "path").agg(F.max("event").alias("event"), F.max("row").alias("row"))
    here = F.coalesce("event.here", F.lit(True))
    known, same = F.col("row").isNotNull(), F.coalesce(F.col("row.hash") == F.col("event.hash"), F.lit(False))
    due = ~known | ~F.coalesce("row.complete", F.lit(False)) | (F.col("event").isNotNull() & ~same)
    return last.withColumn("action", F.when(here & due, "index").when(~here & known, "remove"))


def _withdrawn_paths(table: VersionedTable, done: int, delta: DataFrame, sides: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Paths of which records have left since a version; what is known of them must be read again."""
    return sides(delta.filter("change < 0")).select("user_id", "path").distinct() if done and table.withdrawn(done) else None


def update_ledger(feed: VersionedTable, states: VersionedTable, ledger: VersionedTable) -> int:
    """One run: bring the ledger (last event, newest state row and pending action of every path) up to the latest versions of feed
    and state, and commit the versions reached together with it. Returns the ledger's version.

    Only what is new in the two tables is read, and of the ledger the rows of the paths it speaks of; those are marked as
    deleted and written again. Paths of which records have been withdrawn are judged anew from the records that are left.
    Without news nothing is written; a run that dies before its commit is repeated by the next.
    """
    base = ledger.manifest()
    done = {"feed": base.processed.get("feed", 0), "state": base.processed.get("state", 0)}
    reached = {"feed": feed.latest(), "state": states.latest()}
    if base.version and done == reached:
        return base.version
    news, redo = None, None
    for table, name, sides in ((feed, "feed", event_sides), (states, "state", state_sides)):
        if done[name] == reached[name]:
            continue
        delta = table.changes(done[name], reached[name], net=False)
        fresh = sides(delta.filter("change > 0") if done[name] else delta)
        news = fresh if news is None else news.unionByName(fresh)
        again = _withdrawn_paths(table, done[name], delta, sides)
        if again is not None:
            redo = again if redo is None else redo.unionByName(again)
    if news is None:
        return ledger.commit(base, [], processed=reached)
    if not base.files:
        return ledger.commit(base, ledger.stage(_judged(news)), processed=reached)
    key = ["user_id", "path"]
    held = ledger.located(base)
    touched = news.select(*key) if redo is None else news.select(*key).unionByName(redo)
    mine = held.join(touched.distinct(), key, "left_semi")
    kept = mine.select(*key, "event", "row")
    if redo is not None:
        redo = redo.distinct()
        kept = kept.join(redo, key, "left_anti")
        for table, sides in ((feed, event_sides), (states, state_sides)):
            kept = kept.unionByName(sides(table.read()).join(redo, key, "left_semi"))
    files = ledger.stage(_judged(news.unionByName(kept)))
    return ledger.replace(base, mine.select("__file", "__row"), files, reached)


def pending(feed: VersionedTable, states: VersionedTable, ledger: VersionedTable) -> DataFrame:
    """(user_id, path, action) of the files the next run must 'index' or 'remove', each once, after a run of ``update_ledger``.

    A state row that a run left incomplete is due until a run has finished it; so is a file whose last event has no hash.
    Hashes are compared without case. Rows delivered again and late rows make no difference. Empty tables are empty
    versions.
    """
    update_ledger(feed, states, ledger)
    return ledger.read().filter("action IS NOT NULL").select("user_id", "path", "action")
