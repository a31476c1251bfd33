"""A tenant's tree of files: listing, reading, and file operations with safe paths."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import INDEXED_EXTENSIONS, TEXT_EXTENSIONS, file_type, trim_all

LISTING = "user_id string, path string, name string, type string, mtime long, size long"


class VaultError(Exception):
    """A file operation that cannot be done; subclasses say why."""


class UnsafePath(VaultError):
    pass


class NotFound(VaultError):
    pass


class AlreadyExists(VaultError):
    pass


class NotText(VaultError):
    pass


# Codes of errors by kind; the first that fits counts.
ERROR_CODES = [(UnsafePath, 400), (NotText, 400), (NotFound, 404), (AlreadyExists, 409), (VaultError, 400), (PermissionError, 403), (KeyError, 404), (ValueError, 400)]


def error_of(e: BaseException) -> tuple[int, str]:
    """(code, message) of an error for the caller; what is no fault of theirs is not told."""
    code = next((c for kind, c in ERROR_CODES if isinstance(e, kind)), 500)
    return code, str(e) if code < 500 else "internal error"


def safe_path(root: str, relative: str, writing: bool = False) -> Path:
    """The file of a relative path. Empty, dot and parent segments, hidden names, symbolic links and anything outside of the
    root are refused."""
    parts = [p for p in relative.replace("\\", "/").split("/") if p]
    if not parts or relative.startswith("/") or "\0" in relative:
        raise UnsafePath(relative)
    if any(p.startswith(".") for p in parts):
        raise UnsafePath(relative)
    base = Path(root).resolve()
    at = base
    for p in parts:
        at = at / p
        if at.is_symlink():
            raise UnsafePath(relative)
    if not at.resolve().is_relative_to(base):
        raise UnsafePath(relative)
    if not writing and not at.exists():
        raise NotFound(relative)
    return at


def walk(root: str, path: str = "", recursive: bool = True, ext: str | None = None) -> Iterator[tuple[str, str, str, int, int]]:
    """(path, name, type, mtime in ms, size) under the root in order of path; links and hidden names are left out. With an
    extension only files that end in exactly it."""
    base = Path(root)
    start = safe_path(root, path) if path.strip("/") else base
    found = []
    for folder, dirs, files in os.walk(start):
        dirs[:] = [d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(folder, d))]
        for name, kind in [*((d, "directory") for d in dirs), *((f, "file") for f in files)]:
            full = os.path.join(folder, name)
            if name.startswith(".") or os.path.islink(full):
                continue
            if ext and (kind != "file" or not name.endswith("." + ext.lstrip("."))):
                continue
            stat = os.stat(full)
            found.append((os.path.relpath(full, base).replace(os.sep, "/"), name, kind, int(stat.st_mtime * 1000), stat.st_size))
        if not recursive:
            break
    yield from sorted(found, key=lambda x: x[0].encode("utf-16-be", "surrogatepass"))


def listing(spark: SparkSession, vaults: dict[str, str], **options) -> DataFrame:
    """Entries of the tenants' trees; one task walks each tree, so the driver holds only the list of roots."""
    roots = spark.createDataFrame(list(vaults.items()), "user_id string, root string").repartition(max(1, len(vaults)), "user_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("user_id", pa.string()), ("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for user, root in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(user, *x) for x in walk(root, **options)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), kind.types)], schema=kind)

    return roots.mapInArrow(scan, LISTING)


def snapshot(spark: SparkSession, vaults: dict[str, str]) -> DataFrame:
    """(user_id, path, content_hash, mtime, size, file_type) of the files of indexed formats; hashing runs on the executors."""
    files = listing(spark, vaults).filter("type = 'file'").filter(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(INDEXED_EXTENSIONS))

    @F.arrow_udf("string")
    def digest(users: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for user, path in zip(users.to_pylist(), paths.to_pylist()):
            try:
                with open(os.path.join(vaults[user], path), "rb") as f:
                    out.append(hashlib.file_digest(f, "sha256").hexdigest())
            except OSError:
                out.append(None)  # gone since it was listed
        return pa.array(out, pa.string())

    hashed = files.select("user_id", "path", digest("user_id", "path").alias("content_hash"), "mtime", "size", file_type("path").alias("file_type"))
    return hashed.filter("content_hash IS NOT NULL")


def read_binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, content_hash, mtime, size) by Spark's own file source, for trees on shared storage. That source passes
    over names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = "file:" + str(Path(root).resolve()) if root.startswith("/") else root
    name = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit("^" + base.rstrip("/") + "/"), F.lit(""))
    return files.select(name.alias("path"), "content", F.sha2("content", 256).alias("content_hash"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


# --- frontmatter ----------------------------------------------------------------------------------------------------
_BLOCK = r"^---[ \t]*\r?\n(?:([\s\S]*?)\r?\n)?---[ \t]*(?:\r?\n|$)"


def body_of(raw: str | Column) -> Column:
    """The text without its frontmatter block, trimmed."""
    return trim_all(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, _BLOCK, ""))


def frontmatter_block(raw: str | Column) -> Column:
    return F.regexp_extract(F.col(raw) if isinstance(raw, str) else raw, _BLOCK, 1)


def parse_block(block: str) -> tuple[dict, str | None]:
    """The block's mapping and a warning; bad YAML gives an empty mapping."""
    import yaml

    try:
        data = yaml.safe_load(block) if block and block.strip() else {}
    except yaml.YAMLError as e:
        return {}, str(e).split("\n")[0]
    if data is None:
        return {}, None
    if not isinstance(data, dict):
        return {}, "frontmatter is not a mapping"
    if isinstance(data.get("tags"), str):
        data["tags"] = [data["tags"]]
    return data, None


def metadata_of(raw: Column) -> Column:
    """struct<metadata: map<string,string> of JSON values, warning>."""

    @F.arrow_udf("struct<metadata:map<string,string>,warning:string>")
    def parse(blocks: pa.Array) -> pa.Array:
        out = []
        for block in blocks.to_pylist():
            data, warning = parse_block(block or "")
            out.append({"metadata": [(str(k), json.dumps(v, ensure_ascii=False, default=str)) for k, v in data.items()], "warning": warning})
        return pa.array(out, pa.struct([("metadata", pa.map_(pa.string(), pa.string())), ("warning", pa.string())]))

    return parse(frontmatter_block(raw))


def _split(raw: str) -> tuple[str, str]:
    """(frontmatter with its fences, rest)."""
    import re

    m = re.match(_BLOCK, raw)
    return (m.group(), raw[m.end() :]) if m else ("", raw)


# --- file operations ------------------------------------------------------------------------------------------------
def write_atomic(path: Path, content: str, exclusive: bool = False) -> None:
    """Write beside and rename; with ``exclusive`` an existing file is an error, also one that appears meanwhile."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=path.parent, prefix=".draft-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(content)
        if exclusive:
            try:
                os.link(draft, path)
            except FileExistsError as e:
                raise AlreadyExists(str(path)) from e
            os.unlink(draft)
        else:
            os.replace(draft, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(draft)
        raise


def _text_file(root: str, relative: str) -> Path:
    path = safe_path(root, relative)
    if path.is_dir():
        raise NotText(relative)
    if path.suffix.lower().lstrip(".") not in TEXT_EXTENSIONS:
        raise NotText(relative)
    return path


def read_content(root: str, relative: str) -> str:
    """Trimmed text of a file; notes without their frontmatter."""
    path = _text_file(root, relative)
    raw = path.read_text("utf-8", errors="replace")
    return (_split(raw)[1] if path.suffix.lower() in (".md", ".markdown") else raw).strip()


def read_metadata(root: str, relative: str) -> tuple[dict, str | None]:
    block, _ = _split(_text_file(root, relative).read_text("utf-8", errors="replace"))
    return parse_block("\n".join(block.strip().splitlines()[1:-1]))


def _with_block(data: dict, body: str) -> str:
    import yaml

    return f"---\n{yaml.safe_dump(data, allow_unicode=True, sort_keys=False)}---\n{body}" if data else body


def create_note(root: str, relative: str, content: str, metadata: dict | None = None) -> None:
    write_atomic(safe_path(root, relative, writing=True), _with_block(metadata or {}, content + "\n"), exclusive=True)


def replace_content(root: str, relative: str, content: str) -> None:
    """The whole file, frontmatter included, becomes the content."""
    write_atomic(safe_path(root, relative), content + "\n")


def add_content(root: str, relative: str, text: str, mode: str = "append") -> None:
    """Text after or before the body, a blank line between; the frontmatter stays."""
    if mode not in ("append", "prepend"):
        raise ValueError("mode is 'append' or 'prepend'")
    path = _text_file(root, relative)
    block, body = _split(path.read_text("utf-8"))
    parts = [body.strip(), text.strip()] if mode == "append" else [text.strip(), body.strip()]
    write_atomic(path, block + "\n\n".join(p for p in parts if p) + "\n")


def update_metadata(root: str, relative: str, updates: dict) -> dict:
    """Shallow merge; None removes a key. The body stays."""
    path = _text_file(root, relative)
    block, body = _split(path.read_text("utf-8"))
    data, warning = parse_block("\n".join(block.strip().splitlines()[1:-1]))
    if warning:
        raise VaultError(warning)
    data = {k: v for k, v in {**data, **updates}.items() if v is not None}
    write_atomic(path, _with_block(data, body))
    return data


def delete_note(root: str, relative: str) -> None:
    path = safe_path(root, relative)
    if path.is_dir():
        raise VaultError(f"{relative} is a directory")
    path.unlink()


def move_note(root: str, old: str, new: str) -> None:
    source, target = safe_path(root, old), safe_path(root, new, writing=True)
    if target.exists():
        raise AlreadyExists(new)
    target.parent.mkdir(parents=True, exist_ok=True)
    os.rename(source, target)
