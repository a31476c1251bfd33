"""Text, path and naming functions as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of chunking, in tokens.
MIN_TOKENS, MAX_TOKENS, MIN_PAGE_TOKENS, SHORT_TEXT_TOKENS = 100, 500, 10, 5
#: Fixed value: namespace of the name-based ids (DNS).
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
# Types and folders that name a section of a context pack, in order of precedence.
TYPE_SECTIONS = {
    "summary": "summary",
    "overview": "summary",
    "architecture": "architecture",
    "arch": "architecture",
    "adr": "adrs",
    "decision": "adrs",
    "glossary": "glossary",
    "definition": "glossary",
}
FOLDER_SECTIONS = [
    ("/adr/", "adrs"),
    ("/decisions/", "adrs"),
    ("/architecture/", "architecture"),
    ("/arch/", "architecture"),
    ("/glossary/", "glossary"),
    ("/definitions/", "glossary"),
    ("/summary/", "summary"),
    ("/overview/", "summary"),
]
DEFAULT_SECTION = "implementation"
# Extensions.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"]
INDEXED_EXTENSIONS = ["md", "pdf", "canvas", "excalidraw", "csv", *IMAGE_EXTENSIONS]
TEXT_EXTENSIONS = ["md", "markdown", "txt", "json", "yaml", "yml", "css", "js", "ts", "html", "xml", "csv", "svg", "canvas", "excalidraw"]

_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def terms(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_count(text: str | Column) -> Column:
    """Default token counter: runs of letters and digits, and every other visible character. Null counts 0."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B]")), F.lit(0))


def trim_all(text: str | Column) -> Column:
    """Trim of all Unicode white space, as ``trim`` takes off blanks only."""
    return F.regexp_replace(_c(text), f"^{_SPACE}+|{_SPACE}+$", "")


# Wiki links and what takes their place, in order: embeds go, aliased links give the alias, links their target.
WIKI_LINKS = [(r"!\[\[[^\]]*\]\]", ""), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1")]


def plain_wiki(text: str | Column) -> Column:
    """The text with its wiki links replaced."""
    text = _c(text)
    for pattern, new in WIKI_LINKS:
        text = F.regexp_replace(text, pattern, new)
    return text


def truncate_tokens(text: str | Column, most: int) -> Column:
    """The text up to the end of its first ``most`` tokens. Tokens are taken one by one with the blanks before them, so texts of any
    length are cut without recursion in the pattern."""
    each = F.regexp_extract_all(_c(text), F.lit(r"[ \t\n\r\f\x0B]*(?:[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B])"), 0)
    return F.array_join(F.slice(each, 1, most), "")


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: str | Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def stem(path: str | Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def clean_path(path: str | Column) -> Column:
    """Slashes collapsed, none at either end."""
    return F.regexp_replace(F.regexp_replace(_c(path), "/+", "/"), "^/|/$", "")


def file_type(path: str | Column) -> Column:
    """image, or the extension of a known document format, else md."""
    ext = extension(path)
    return F.when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext.isin("md", "pdf", "csv", "canvas", "excalidraw"), ext).otherwise("md")


def section_of(kind: str | Column, path: str | Column) -> Column:
    """Section of a context pack: by type, then by folder, else implementation."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_SECTIONS.items() for x in pair]), F.lower(_c(kind)))
    wrapped = F.concat(F.lit("/"), F.regexp_replace(F.lower(_c(path)), "^/", ""), F.lit("/"))
    folders = F.coalesce(*[F.when(F.contains(wrapped, F.lit(f)), F.lit(s)) for f, s in FOLDER_SECTIONS])
    return F.coalesce(named, folders, F.lit(DEFAULT_SECTION))


def name_uuid(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based uuid (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def chunk_uuid(user: str | Column, path: str | Column, index: str | Column) -> Column:
    return name_uuid(F.concat_ws(":", _c(user), _c(path), _c(index).cast("string")))


def clamp(x: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def relative(x: str | Column, most: str | Column) -> Column:
    """Share of the largest score; 0 if that is 0."""
    return F.when(_c(most) > 0, _c(x) / _c(most)).otherwise(0.0)


def content_hash(data: str | Column) -> Column:
    return F.sha2(_c(data).cast("binary"), 256)
