"""Chunks of the document formats: (document keys, chunk_index, section_path, text), one shape for all."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import MAX_TOKENS, MIN_PAGE_TOKENS, MIN_TOKENS, SHORT_TEXT_TOKENS, WIKI_LINKS, stem, token_count, trim_all
from marlstone.operators.packing import merge_runs, pack_paragraphs
from marlstone.sources.pdf import extract_pages

#: Fixed value: data rows of a CSV chunk.
CSV_ROWS = 30
CHUNK = "array<struct<section_path:string,text:string>>"
_KIND = pa.list_(pa.struct([("section_path", pa.string()), ("text", pa.string())]))


def default_count(text: str) -> int:
    """The default counter outside of the JVM; equal to ``functions.text.token_count``."""
    return len(_TOKENS.findall(text))


_TOKENS = re.compile(r"[^\W_]+|[^\s\w]|_|\s(?<![ \t\n\r\f\x0b])")


# --- Markdown -------------------------------------------------------------------------------------------------------
_HEAD = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"^\s*(?:[-+*]|\d{1,9}[.)])(?:\s|$)")
_DASHES = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_MARKS = re.compile(r"(\*{1,3}|_{2,3}|~~|(?<!\w)_)(?=\S)(.+?)(?<=\S)\1(?!\w)")
_CODE = re.compile(r"`+([^`]+)`+")
_WIKI = [(re.compile(pattern), new.replace("$", "\\")) for pattern, new in WIKI_LINKS]


def plain_wiki_text(text: str) -> str:
    for pattern, new in _WIKI:
        text = pattern.sub(new, text)
    return text


def _inline(text: str) -> str:
    """Text of a paragraph without inline markup; code spans keep their content."""
    text = _CODE.sub(r"\1", text)
    text = _LINK.sub(r"\1", text)
    for _ in range(2):
        text = _MARKS.sub(r"\2", text)
    return text


def blocks(body: str) -> list[tuple[str, int, str]]:
    """(kind, depth, text) of the top-level blocks: heading, code, table, list, quote, paragraph, rule.

    Headings inside fences are code. Table cells are joined by `` | `` and rows by a line break, so that a large table can
    be cut between rows.
    """
    out: list[tuple[str, int, str]] = []
    lines = body.replace("\r\n", "\n").split("\n")
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            mark = m[1]
            j = i + 1
            while j < n and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[j]):
                j += 1
            out.append(("code", 0, "\n".join(lines[i + 1 : j])))
            i = j + 1
            continue
        if m := _HEAD.match(line):
            out.append(("heading", len(m[1]), _inline(m[2] or "")))
            i += 1
            continue
        if _RULE.match(line):
            out.append(("rule", 0, ""))
            i += 1
            continue
        if "|" in line and i + 1 < n and "-" in lines[i + 1] and _DASHES.match(lines[i + 1]):
            j = i + 2
            while j < n and lines[j].strip() and "|" in lines[j]:
                j += 1
            rows = [lines[i], *lines[i + 2 : j]]
            out.append(("table", 0, "\n".join(" | ".join(_inline(c.strip()) for c in r.strip().strip("|").split("|")) for r in rows)))
            i = j
            continue
        if line.lstrip().startswith(">"):
            j = i
            while j < n and lines[j].strip():
                j += 1
            out.append(("quote", 0, _inline("\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]))))
            i = j
            continue
        if _ITEM.match(line):
            j = i
            while j < n and (lines[j].strip() or (j + 1 < n and (_ITEM.match(lines[j + 1]) or lines[j + 1].startswith("  ")))):
                if j > i and _HEAD.match(lines[j]):
                    break
                j += 1
            items = [re.sub(r"^\s*(?:[-+*]|\d{1,9}[.)])\s*(?:\[[ xX]\]\s+)?", "", x) for x in lines[i:j] if x.strip()]
            out.append(("list", 0, _inline("\n".join(items))))
            i = j
            continue
        j = i
        while j < n and lines[j].strip() and not _FENCE.match(lines[j]) and not (j > i and (_HEAD.match(lines[j]) or lines[j].lstrip().startswith(">"))):
            if j > i and (u := _UNDERLINE.match(lines[j])):
                out.append(("heading", 1 if u[1][0] == "=" else 2, _inline(" ".join(x.strip() for x in lines[i:j]))))
                break
            if j > i and re.match(r"^\s*(?:[-+*]|1[.)])\s+\S", lines[j]):
                out.append(("paragraph", 0, _inline("\n".join(lines[i:j]))))
                j -= 1
                break
            j += 1
        else:
            out.append(("paragraph", 0, _inline("\n".join(lines[i:j]))))
            i = j
            continue
        i = j + 1
    return out


def _packed(nodes: list[tuple[str, str]], header: str, count: Callable[[str], int], most: int) -> list[str]:
    """Nodes of an oversize group in pieces under the cap; large code and tables are cut between lines."""
    units: list[tuple[str, str, int]] = []  # glue before, text, tokens
    for kind, text in nodes:
        size = count(text)
        if kind in ("code", "table") and size > most:
            units += [("\n" if k else "\f", line, count(line)) for k, line in enumerate(text.split("\n"))] + [("\f", "", 0)]
        else:
            units.append(("\n\n", text, size))
    out: list[str] = []
    base = count(header)
    current, used = "", base
    open_ = False
    for glue, text, size in units:
        if glue == "\f" or (open_ and used + size > most):
            if open_:
                out.append(current)
            current, used, open_ = "", base, False
            if glue == "\f" and not size and not text:
                continue
        current = current + (glue if open_ else "") + text
        used += size
        open_ = True
    if open_:
        out.append(current)
    return [f"{header}\n\n{plain_wiki_text(x)}" for x in out]


def markdown_chunks(body: str | None, title: str, count: Callable[[str], int] = default_count, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[tuple[str, str]]:
    """(section_path, text) of a note. Level-1 headings start a section at the root and are not part of paths; sections of
    fewer than ``least`` tokens join the one before; groups of more than ``most`` tokens are cut at blocks."""
    if not body or not body.strip():
        return []
    groups: list[tuple[str, list[tuple[str, str]]]] = []
    stack: dict[int, str] = {}
    nodes: list[tuple[str, str]] = []

    def close() -> None:
        if not nodes:
            return
        path = " > ".join([title, *(stack[d] for d in sorted(stack))])
        size = count(plain_wiki_text("\n\n".join(t for _, t in nodes)))
        if size < least and groups:
            groups[-1][1].extend(nodes)
        else:
            groups.append((path, list(nodes)))
        nodes.clear()

    for kind, depth, text in blocks(body):
        if kind != "heading":
            nodes.append((kind, text))
            continue
        close()
        if depth == 1:
            stack.clear()
        else:
            for d in [d for d in stack if d >= depth]:
                del stack[d]
            stack[depth] = text
    close()
    out: list[tuple[str, str]] = []
    for path, members in groups:
        text = plain_wiki_text("\n\n".join(t for _, t in members))
        if count(text) > most:
            out += [(path, x) for x in _packed(members, path, count, most)]
        else:
            out.append((path, f"{path}\n\n{text}"))
    return out


def _numbered(df: DataFrame, keep: list[str], chunks: Column) -> DataFrame:
    exploded = df.select(*keep, F.posexplode(chunks).alias("chunk_index", "__c"))
    return exploded.select(*keep, "chunk_index", F.col("__c.section_path").alias("section_path"), F.col("__c.text").alias("text"))


def markdown(docs: DataFrame, keep: list[str], body: str = "text", title: str = "title", count: Callable[[str], int] = default_count) -> DataFrame:
    """Chunks of Markdown notes."""

    @F.arrow_udf(CHUNK)
    def cut(bodies: pa.Array, titles: pa.Array) -> pa.Array:
        found = [markdown_chunks(b, t or "", count) for b, t in zip(bodies.to_pylist(), titles.to_pylist())]
        return pa.array([[{"section_path": p, "text": t} for p, t in x] for x in found], _KIND)

    return _numbered(docs, keep, cut(F.col(body), F.col(title)))


# --- CSV ------------------------------------------------------------------------------------------------------------
def csv_text(docs: DataFrame, keep: list[str], content: str, name: str, rows: int = CSV_ROWS) -> DataFrame:
    """Chunks of CSV documents held as text: ``Header: value`` pairs of the filled cells, ``rows`` data rows a chunk. Empty lines
    are skipped; rows with missing or spare cells are kept with what they have."""

    @F.arrow_udf(CHUNK)
    def cut(contents: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for text, label in zip(contents.to_pylist(), names.to_pylist()):
            read = [r for r in csv.reader(io.StringIO((text or "").lstrip("﻿"), newline="")) if any(c != "" for c in r)] if text and text.strip() else []
            head, data = (read[0], read[1:]) if read else ([], [])
            chunks = []
            for i in range(0, len(data), rows):
                batch = data[i : i + rows]
                lines = [", ".join(f"{h}: {v}" for h, v in zip(head, r) if v.strip()) for r in batch]
                chunks.append({"section_path": f"{label} > Rows {i + 1}-{i + len(batch)}", "text": "\n".join(lines)})
            out.append(chunks)
        return pa.array(out, _KIND)

    return _numbered(docs, keep, cut(F.col(content), F.col(name)))


def csv_rows(rows: DataFrame, document: list[str], number: str, columns: list[str], name: Column, batch: int = CSV_ROWS) -> DataFrame:
    """The same chunks from rows of a table, for CSV files Spark has read itself: ``number`` counts from 1 in a document."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    lines = rows.select(*document, number, F.floor((F.col(number) - 1) / batch).cast("int").alias("chunk_index"), F.concat_ws(", ", *cells).alias("line"), name.alias("__name"))
    packed = lines.groupBy(*document, "chunk_index").agg(
        F.first("__name").alias("__name"), F.min(number).alias("a"), F.max(number).alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    path = F.concat("__name", F.lit(" > Rows "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))
    return packed.select(*document, "chunk_index", path.alias("section_path"), "text")


# --- canvas and drawings --------------------------------------------------------------------------------------------
def canvas(docs: DataFrame, keep: list[str], content: str, name: str) -> DataFrame:
    """One chunk per text node of a canvas. Content that is no JSON or has no node list gives no row."""
    parsed = F.from_json(F.col(content), "struct<nodes:array<struct<type:string,text:string>>>")["nodes"]
    texts = F.transform(F.filter(parsed, lambda n: (n["type"] == "text") & (trim_all(n["text"]) != "")), lambda n: trim_all(n["text"]))
    rows = docs.select(*keep, F.col(name).alias("__name"), F.posexplode(texts).alias("chunk_index", "text"))
    return rows.select(*keep, "chunk_index", F.concat("__name", F.lit(" > Node "), (F.col("chunk_index") + 1).cast("string")).alias("section_path"), "text")


def excalidraw(docs: DataFrame, keep: list[str], content: str, name: str, least: int = SHORT_TEXT_TOKENS) -> DataFrame:
    """Chunks of a drawing's texts: deleted and blank ones dropped, neighbouring short ones joined. ``keep`` must name a
    document."""
    parsed = F.from_json(F.col(content), "struct<elements:array<struct<type:string,text:string,isDeleted:boolean>>>")["elements"]
    live = F.filter(parsed, lambda e: (e["type"] == "text") & ~F.coalesce(e["isDeleted"], F.lit(False)) & (trim_all(e["text"]) != ""))
    rows = docs.select(*keep, F.col(name).alias("__name"), F.posexplode(F.transform(live, lambda e: trim_all(e["text"]))).alias("at", "text"))
    joined = merge_runs(rows, [*keep, "__name"], "at", "text", least)
    return joined.select(*keep, "chunk_index", F.concat("__name", F.lit(" > Text "), (F.col("chunk_index") + 1).cast("string")).alias("section_path"), "text")


# --- PDF pages ------------------------------------------------------------------------------------------------------
def pdf_pages(pages: DataFrame, document: list[str], page: str, text: str, name: Column, least: int = MIN_PAGE_TOKENS, most: int = MAX_TOKENS, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Chunks of extracted pages: pages of fewer than ``least`` tokens dropped, pages over ``most`` packed by paragraphs.
    ``chunk_index`` runs through the document."""
    rows = pages.select(*document, F.col(page).alias("__page"), trim_all(text).alias("__text"), name.alias("__name")).withColumn("__n", count(F.col("__text"))).filter(F.col("__n") >= least)
    parts = F.when(F.col("__n") > most, pack_paragraphs("__text", most, count)).otherwise(F.array("__text"))
    cut = rows.select(*document, "__page", "__name", F.posexplode(parts).alias("__part", "text"))
    listed = F.row_number().over(Window.partitionBy(*document).orderBy("__page", "__part")) - 1
    return cut.select(*document, listed.alias("chunk_index"), F.concat("__name", F.lit(" > Page "), F.col("__page").cast("string")).alias("section_path"), "text")


def pdf_extractor(extract: Callable[[bytes], list[str]] | None = None):
    """A column function binary -> array<string> of page texts. ``extract`` parses one file, by default an installed parser or else
    ``sources.pdf``; a file it fails on has no pages."""

    @F.pandas_udf("array<string>")
    def pages(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parse = extract or _installed_parser()
        for files in parts:
            out = []
            for raw in files:
                try:
                    out.append([" ".join(p.split()) for p in parse(raw)] if raw else [])
                except Exception:
                    out.append([])
            yield pd.Series(out)

    return pages


def _installed_parser() -> Callable[[bytes], list[str]]:
    try:
        from pypdf import PdfReader
    except ImportError:
        return extract_pages
    return lambda raw: [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def title_of(path: str) -> Column:
    return stem(path)
