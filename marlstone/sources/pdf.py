"""Text of PDF files without a parser library: objects, compressed streams, the page tree and the text operators.

Meant for files whose fonts carry a map to Unicode or use a Latin encoding. Encrypted files, images of pages and fonts with an
encoding of their own give no or little text. A file that is damaged gives the pages that can be read, or none.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_REF = re.compile(rb"(\d{1,10})\s+\d{1,5}\s+R\b")
_STREAM = re.compile(rb"\bstream\r?\n?")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document:
    """The objects of a file by number: the dictionary's text, and the stream's bytes where there is one."""

    def __init__(self, raw: bytes):
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        starts = list(_OBJECT.finditer(raw))
        for m, after in zip(starts, [*starts[1:], None]):
            body = raw[m.end() : after.start() if after else len(raw)]
            s = _STREAM.search(body)
            if s is None:
                self.objects[int(m[1])] = (body.partition(b"endobj")[0], None)
            else:
                head = body[: s.start()]
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                data = body[s.end() : s.end() + int(size[1])] if size else body[s.end() :].rpartition(b"endstream")[0]
                self.objects[int(m[1])] = (head, _plain(head, data))
        for head, data in list(self.objects.values()):
            if data and b"/ObjStm" in head:
                self._packed(head, data)

    def _packed(self, head: bytes, data: bytes) -> None:
        first, count = re.search(rb"/First\s+(\d+)", head), re.search(rb"/N\s+(\d+)", head)
        if first and count:
            numbers = [int(x) for x in data[: int(first[1])].split()[: 2 * int(count[1])]]
            ends = [*numbers[3::2], len(data)]
            for number, at, end in zip(numbers[::2], numbers[1::2], ends):
                self.objects.setdefault(number, (data[int(first[1]) + at : int(first[1]) + end], None))

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """Numbers of the objects that an entry refers to, alone or in an array."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d{1,10}\s+\d{1,5}\s+R)", head)
        return [int(r[1]) for r in _REF.finditer(m[1])] if m else []

    def inner(self, head: bytes, key: bytes) -> bytes:
        """The dictionary of an entry, written out or referred to."""
        m = re.search(rb"/" + key + rb"\s*<<", head)
        if m:
            depth, at = 1, m.end()
            for x in re.finditer(rb"<<|>>", head[m.end() :]):
                depth += 1 if x.group() == b"<<" else -1
                if not depth:
                    return head[at : at + x.start()]
        found = self.refs(head, key)
        return self.objects.get(found[0], (b"", None))[0] if found else b""

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page dictionary, resources) in order; resources may come from a node above."""
        roots = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and not self.refs(h, b"Parent")]
        out: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()
        stack = [(n, b"") for n in reversed(roots)]
        while stack:
            number, above = stack.pop()
            if number in seen or number not in self.objects:
                continue
            seen.add(number)
            head = self.objects[number][0]
            own = self.inner(head, b"Resources") or above
            if re.search(rb"/Type\s*/Page\b", head):
                out.append((head, own))
            else:
                stack += [(kid, own) for kid in reversed(self.refs(head, b"Kids"))]
        return out

    def fonts(self, resources: bytes) -> dict[bytes, tuple[dict[int, str], int]]:
        """Per font name its map to Unicode and the bytes of a code."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d{1,10})\s+\d{1,5}\s+R", self.inner(resources, b"Font")):
            head = self.objects.get(int(number), (b"", None))[0]
            given = self.refs(head, b"ToUnicode")
            table = _unicode_map(self.objects.get(given[0], (b"", None))[1] or b"") if given else {}
            out[name] = (table, 2 if b"/Type0" in head else 1)
        return out


def _plain(head: bytes, data: bytes) -> bytes | None:
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return None
    return None if b"/Filter" in head else data


def _unicode_map(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(c)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                if first:
                    out[int(a, 16) + k] = first[:-1] + chr(ord(first[-1]) + k)
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: _ESCAPED.get(m[1], b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else m[1]), token[1:-1])


def _shown(raw: bytes, font: tuple[dict[int, str], int]) -> str:
    table, width = font
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "ignore")
    if not table:
        return raw.decode("cp1252", "ignore")
    return "".join(table.get(int.from_bytes(raw[i : i + width]), "") for i in range(0, len(raw), width))


def page_text(content: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    """Text items of a content stream, a blank between those of different operators; a wide gap inside of one is a blank too."""
    out: list[str] = []
    operands: list[bytes] = []
    font: tuple[dict[int, str], int] = ({}, 1)
    for m in _TOKEN.finditer(content):
        t = m.group()
        if not (t[:1].isalpha() or t in (b"'", b'"', b"T*")):
            operands.append(t)
            continue
        if t == b"Tf" and len(operands) > 1:
            font = fonts.get(operands[-2][1:], ({}, 1))
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            item = ""
            for x in operands:
                if x[:1] in (b"(", b"<"):
                    item += _shown(_string(x), font)
                elif t == b"TJ" and x[:1] == b"-" and float(x) < -200:
                    item += " "
            out.append(item)
        operands = []
    return " ".join(" ".join(x for x in out if x.strip()).split())


def extract_pages(raw: bytes) -> list[str]:
    """The text of every page."""
    document = Document(raw)
    out = []
    for head, resources in document.pages():
        contents = [document.objects.get(n, (b"", None)) for n in document.refs(head, b"Contents")]
        streams = [data for h, data in contents if data] + [document.objects.get(n, (b"", None))[1] or b"" for h, data in contents if data is None for n in [int(r[1]) for r in _REF.finditer(h)]]
        out.append(page_text(b"\n".join(streams), document.fonts(resources)))
    return out


def info(raw: bytes) -> dict[str, str]:
    """Title, author and subject, as far as the file has them."""
    document = Document(raw)
    trailer = re.search(rb"/Info\s+(\d{1,10})\s+\d{1,5}\s+R", raw)
    head = document.objects.get(int(trailer[1]), (b"", None))[0] if trailer else b""
    found = {}
    for key in ("Title", "Author", "Subject"):
        m = re.search(rb"/" + key.encode() + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", head, re.S)
        if m:
            found[key.lower()] = _shown(_string(m[1]), ({}, 1))
    return found
