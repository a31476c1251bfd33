"""Clean text from HTML, Markdown, wiki and LaTeX markup.

A scanner strips the syntax of the four families and notes which of them it met; what stands in code spans and fences
is set aside first and comes back unchanged. Headings stay as lines of their own, list items get a bullet or keep
their number, table cells are joined by tabs, formulas lose their delimiters and commands become plain words. Then the
line-block distribution decides what is text: stripped line lengths are summed over a sliding window of lines, a
block starts where the sum surges over a threshold and ends where it dives to nothing, and lines between are kept. Headings,
list items, table rows, code and formulas are kept wherever they stand. Only pages, that is texts with block elements of HTML,
have a threshold over 1: elsewhere short lines are titles and one-line texts, not menus and footers.

Every pattern runs in time linear in the text, or nearly: no lazy scan is started again from every opening sign.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Lines of a window, and the least sum of lengths at which the text of a page surges. 1 keeps every line that holds text.
WINDOW, SURGE = 5, 40

# Element names of HTML.
_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption "
    "center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark "
    "menu meta meter nav nobr noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script "
    "section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time "
    "title tr track tt u ul var video wbr"
)
# LaTeX commands that may stand without braces.
_BARE = (
    "LaTeX TeX alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi "
    "chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega cdot cdots times div pm mp le leq ge geq neq approx equiv sim "
    "infty partial nabla sum prod int lim log ln exp sin cos tan max min sqrt frac in notin subset cup cap forall exists to rightarrow "
    "leftarrow Rightarrow ldots dots quad qquad item newline noindent maketitle tableofcontents centering hline bigskip medskip "
    "smallskip clearpage newpage par left right"
)

_FENCE = re.compile(r"^ {0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^`\n]*)$", re.M)
_SPAN = re.compile(r"(?<!`)(?P<tick>`+)(?!`)(?P<code>(?:(?!\n[ \t]*\n).)+?)(?<!`)(?P=tick)(?!`)", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>", re.S | re.I)
_TAG = re.compile(rf"<(?P<close>/?)(?P<name>{_TAGS.replace(' ', '|')})(?P<attrs>\s[^<>]*)?/?>", re.I)
_ATTRS = re.compile(r"(?:\s++(?:[A-Za-z_:@][\w:.-]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+|/))*+\s*+/?")
_DROPPED = re.compile(r"<(script|style)\b[^<>]*>", re.I)
_DROPPED_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ENV = re.compile(r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?")
_BREAK = re.compile(r"\n[ \t]*\n")
_MATH = re.compile(r"\$\$(?P<a>(?:(?!\n[ \t]*\n)[^$])+)\$\$|\\(?P<open>[\[(])|(?<![\\$\w])\$(?![\s$])(?P<d>[^$\n]+?)(?<![\s\\])\$(?![$\w])")
_PRICE = re.compile(r"[\d.,]+(?:[^\S\n]|\s*[-–/]|[kKmM]?\b\W)")
_COMMAND = re.compile(r"(?<![\w\\:/.])\\(?P<name>[A-Za-z]+)\*?(?P<opt>\[[^\[\]\n]*\])?")
_BRACES = re.compile(r"[{}]|(?<![\w\\:/.])\\[A-Za-z]")
_BARE_NAMES = frozenset(_BARE.split())
_HEADS = frozenset(["section", "subsection", "subsubsection", "chapter", "part", "paragraph", "title"])
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(?P<body>.*?)(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_TEMPLATE = re.compile(r"\{\{(?P<body>[^{}\n]+(?:\n[^{}]*)?)\}\}")
_WIKI_LINK = re.compile(r"!?\[\[(?P<body>[^\[\]\n\s][^\[\]\n]*)\]\]")
_WIKI_HEAD = re.compile(r"^(?P<eq>={1,6})[ \t]*(?P<head>[^=\s](?:[^\n]*?[^=\s])?)[ \t]*(?P=eq)[ \t]*$", re.M)
_QUOTES = re.compile(r"(?<!')(?P<q>'{2,5})(?=[^\s'])(?P<body>[^\n]*?[^\s'])(?P=q)(?!')")
_IMAGE = re.compile(r"!\[(?P<alt>[^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|!\[(?P<alt2>[^\[\]\n]*)\]\[[^\[\]\n]*\]")
_LINK = re.compile(r"(?<![\w\]])\[(?P<text>(?!\d+\])(?![ xX]\])[^\[\]\n]+(?:\n[^\[\]\n]+)?)\](?:\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])|(?<![\w\]])\[(?P<num>\d+)\](?:\([^()\s]+\)|\[(?!\d+\])[^\[\]\n]+\])")
_LINKDEF = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+(?:[ \t]+[\"'(][^\n]*)?[ \t]*$", re.M)
_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
_ATX = re.compile(r"^ {0,3}#{1,6}[ \t]+(?P<head>\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$", re.M)
_SETEXT = re.compile(r"^ {0,3}(?![-+*>#|=]|\d+[.)]\s)(?P<head>\S[^\n]*)\n {0,3}(?:={2,}|-{3,})[ \t]*$", re.M)
_QUOTE = re.compile(r"^ {0,3}(?:>[ \t]?)+(?:\[![A-Za-z]+\][+-]?[ \t]*)?", re.M)
_LIST = re.compile(r"^(?P<in>[ \t]*)(?:[-+*]|(?P<num>\d{1,9})[.)])[ \t]+(?:\[(?P<task>[ xX])\][ \t]+)?(?=\S)", re.M)
_DASHROW = re.compile(r"^(?P<head>[^\n]*\|[^\n]*)\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$(?P<rows>(?:\n[^\n]*\|[^\n]*)*)", re.M)
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])(?P<body>(?:(?!\n[ \t]*\n)[^~])*?[^\s~])~~(?!~)", re.S)
_STAR = re.compile(r"(?<![\w*\\])(?P<m>\*{1,3})(?=[^\s*])(?P<body>(?:(?!\n[ \t]*\n)[^*])*?[^\s*])(?P=m)(?![\w*])", re.S)
_UNDER = re.compile(r"(?<![\w\\])(?P<m>_{1,3})(?=[^\s_])(?P<body>(?:(?!\n[ \t]*\n)[^_])*?[^\s_])(?P=m)(?!\w)", re.S)
# Marks inside of a text that is being cleaned: content set aside, and lines to be kept. Their characters do not occur in Unicode
# text proper; where a source has them none the less, they are set aside as content themselves.
_OPEN, _CLOSE, _KEEP = "\ue000", "\ue001", "\ue002"
_HOLD = re.compile(f"{_OPEN}(\\d+){_CLOSE}")
_OWN = re.compile(f"[{_OPEN}{_CLOSE}{_KEEP}]")
_BLOCK_TAGS = frozenset("p div li tr table ul ol h1 h2 h3 h4 h5 h6 br hr section article header footer blockquote details summary pre dd dt dl nav main aside".split())
_HEAD_TAGS = frozenset("h1 h2 h3 h4 h5 h6 title caption".split())


def _math_words(body: str) -> str:
    body = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", body)
    body = re.sub(r"\\[,;:! ]", " ", body)
    body = re.sub(r"\\([A-Za-z]+)", r"\1", body)
    return re.sub(r"\s+", " ", body.replace("{", "").replace("}", "")).strip()


class _Scan:
    def __init__(self, text: str):
        self.met, self.held, self.page = set(), [], False
        self.text = _OWN.sub(lambda m: self.hold(m.group(), False), text)

    def hold(self, content: str, keep: bool = True) -> str:
        """A sign that stands for the content; its lines are kept if it is code or a formula."""
        self.held.append(_HOLD.sub(lambda m: self.held[int(m[1])], content) if _OPEN in content else content)
        return f"{_KEEP if keep else ''}{_OPEN}{len(self.held) - 1}{_CLOSE}"

    def sub(self, pattern: re.Pattern, family: str, make) -> None:
        def one(m: re.Match) -> str:
            new = make(m)
            if new is None:
                return m.group()
            self.met.add(family)
            return new

        self.text = pattern.sub(one, self.text)

    def code(self) -> None:
        if "```" in self.text or "~~~" in self.text:
            self.fences()
        if "`" in self.text:
            self.sub(_SPAN, "markdown", lambda m: self.hold(m["code"].strip() or m["code"]))

    def fences(self) -> None:
        """Fenced code, line by line: a fence ends at a line of its own sign, as long or longer, or with the text."""
        out, code, mark = [], None, ""
        for line in self.text.split("\n"):
            if code is None:
                m = _FENCE.fullmatch(line)
                if m:
                    code, mark = [], m["mark"]
                    self.met.add("markdown")
                else:
                    out.append(line)
                continue
            rest = line.lstrip(" ")
            if len(line) - len(rest) <= 3 and rest.startswith(mark) and not rest.rstrip(" \t").strip("`~"):
                out.append(self.hold("\n".join(code).rstrip("\n")))
                code = None
            else:
                code.append(line)
        if code is not None:
            out.append(self.hold("\n".join(code).rstrip("\n")))
        self.text = "\n".join(out)

    def html(self) -> None:
        if "<" in self.text:
            self.sub(_COMMENT, "html", lambda m: "")
            self.dropped()
            self.sub(_TAG, "html", self._tag)
        if "&" in self.text:
            self.sub(_ENTITY, "html", self._entity)

    def dropped(self) -> None:
        """Scripts and styles with what they hold. Once an element has no end, none after it has one."""
        out, at, endless = [], 0, set()
        for m in _DROPPED.finditer(self.text):
            name = m[1].lower()
            if m.start() < at or name in endless:
                continue
            end = _DROPPED_END[name].search(self.text, m.end())
            if end is None:
                endless.add(name)
                continue
            out.append(self.text[at : m.start()])
            at = end.end()
            self.met.add("html")
        self.text = "".join([*out, self.text[at:]])

    def _tag(self, m: re.Match) -> str | None:
        name = m["name"].lower()
        if m["attrs"] and not _ATTRS.fullmatch(m["attrs"]):
            return None
        self.page |= name in _BLOCK_TAGS
        if name in _HEAD_TAGS and not m["close"]:
            return f"\n{_KEEP}"
        if name == "li" and not m["close"]:
            return f"\n{_KEEP}• "
        if name == "tr" and not m["close"]:
            return f"\n{_KEEP}"
        if name in ("td", "th"):
            return "\t" if m["close"] else ""
        if name == "img":
            alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", m["attrs"] or "", re.I)
            return next((x for x in alt.groups() if x), "") if alt else ""
        return "\n" if name in _BLOCK_TAGS else ""

    def _entity(self, m: re.Match) -> str | None:
        if m.group()[1] != "#" and m.group()[1:] not in html5:
            return None
        plain = html.unescape(m.group())
        return self.hold(plain) if plain in "<>&*_`$\\[]{}|#=~'" else plain

    def latex(self) -> None:
        if "$" in self.text or "\\" in self.text:
            self.formulas()
        if "\\" in self.text:
            self.sub(_ENV, "latex", lambda m: "")
            self.commands()

    def formulas(self) -> None:
        """Formulas between their delimiters, none across a blank line. Ends are looked for once each, going forward."""
        text = self.text
        out, at, pos = [], 0, 0
        ends, gap = {}, -1
        while m := _MATH.search(text, pos):
            pos = m.end()
            if m["open"]:
                end = "\\]" if m["open"] == "[" else "\\)"
                if ends.get(end, 0) is not None and ends.get(end, -1) < pos + 1:
                    found = text.find(end, pos + 1)
                    ends[end] = found if found >= 0 else None
                if gap is not None and gap < pos - 1:
                    b = _BREAK.search(text, pos - 1)
                    gap = b.start() if b else None
                if ends[end] is None or gap is not None and gap < ends[end]:
                    continue
                body, pos = text[pos : ends[end]], ends[end] + 2
            else:
                if m["d"] is not None and _PRICE.match(m["d"]):
                    continue
                body = m["a"] if m["a"] is not None else m["d"]
            out += [text[at : m.start()], self.hold(_math_words(body))]
            at = pos
            self.met.add("latex")
        self.text = "".join([*out, text[at:]])

    def commands(self) -> None:
        """Commands with their arguments, from the inside out, in one pass over braces and backslashes."""
        text = self.text
        # an open brace has what came before it, its command or None, and whether braces that belong to no command stand in it
        stack: list[tuple[list[str], re.Match | None, bool]] = []
        out: list[str] = []
        loose, at = False, 0
        while m := _BRACES.search(text, at):
            out.append(text[at : m.start()])
            at = m.end()
            if m.group() == "{":
                stack.append((out, None, loose))
                out, loose = [], False
            elif m.group() == "}":
                if not stack:
                    out.append("}")
                    continue
                body, inner = "".join(out), loose
                out, command, loose = stack.pop()
                if command is None or inner:
                    out.append((command.group() if command else "") + "{" + body + "}")
                    loose = True
                else:
                    self.met.add("latex")
                    out.append(self._command(command, body))
            else:
                m = _COMMAND.match(text, m.start())
                at = m.end()
                if text[at : at + 1] == "{":
                    stack.append((out, m, loose))
                    out, loose, at = [], False, at + 1
                    continue
                new = self._command(m, None)
                if new is not None:
                    self.met.add("latex")
                out.append(m.group() if new is None else new)
        out.append(text[at:])
        while stack:  # braces that never close
            body = "".join(out)
            out, command, _ = stack.pop()
            out.append((command.group() if command else "") + "{" + body)
        self.text = "".join(out)

    @staticmethod
    def _command(m: re.Match, body: str | None) -> str | None:
        name = m["name"]
        if name == "item":
            return f"{_KEEP}• {m['opt'][1:-1]}" if m["opt"] else f"{_KEEP}• {body}" if body else f"{_KEEP}•"
        if body is None:
            if name not in _BARE_NAMES and not m["opt"]:
                return None
            return name
        if name in _HEADS:
            return f"\n{_KEEP}{body}\n"
        if name in ("label", "vspace", "hspace", "usepackage", "documentclass", "bibliographystyle"):
            return ""
        return body

    def wiki(self) -> None:
        text = self.text
        if "{|" in text:
            self.sub(_WIKI_TABLE, "wiki", self._wiki_table)
        if "{{" in text:
            self.sub(_TEMPLATE, "wiki", lambda m: re.sub(r"\s*\|\s*", " ", m["body"]))
        if "[[" in text:
            self.sub(_WIKI_LINK, "wiki", lambda m: m["body"].rpartition("|")[2])
        if "=" in text:
            self.sub(_WIKI_HEAD, "wiki", lambda m: f"\n{_KEEP}{m['head']}\n")
        if "''" in text:
            self.sub(_QUOTES, "wiki", lambda m: m["body"])

    @staticmethod
    def _wiki_table(m: re.Match) -> str:
        rows = []
        for line in m["body"].split("\n"):
            line = line.strip()
            if line.startswith("|-") or not line:
                continue
            line = re.sub(r"^(?:\|\+|[|!])\s*", "", line)
            rows.append(_KEEP + "\t".join(c.strip() for c in re.split(r"\|\||!!", line)))
        return "\n".join(rows) + "\n"

    def markdown(self) -> None:
        text = self.text
        if "|" in text and "-" in text:
            self.sub(_DASHROW, "markdown", self._table)
        if "[" in text:
            self.sub(_IMAGE, "markdown", lambda m: m["alt"] or m["alt2"] or "")
            self.sub(_LINK, "markdown", lambda m: m["text"] or m["num"])
            self.sub(_LINKDEF, "markdown", lambda m: "")
        if "<" in text:
            self.sub(_AUTO, "markdown", lambda m: m[1])
        if "#" in text:
            self.sub(_ATX, "markdown", lambda m: f"\n{_KEEP}{m['head']}\n")
        if "==" in text or "---" in text:
            self.sub(_SETEXT, "markdown", lambda m: f"\n{_KEEP}{m['head']}\n")
            self.text = _RULE.sub("", self.text)
        if ">" in text:
            self.sub(_QUOTE, "markdown", lambda m: "")
        self.sub(_LIST, "markdown", self._item)
        if "~~" in text:
            self.sub(_STRIKE, "markdown", lambda m: m["body"])
        while True:  # outer signs first; every pass that changes something takes signs out
            before = self.text
            for pattern, sign in ((_STAR, "*"), (_UNDER, "_")):
                if sign in self.text:
                    self.sub(pattern, "markdown", lambda m: m["body"])
            if self.text == before:
                break

    @staticmethod
    def _item(m: re.Match) -> str:
        if m["num"]:
            return f"{_KEEP}{m['in']}{m['num']}) "
        return _KEEP + m["in"] + "• " + {None: "", " ": "☐ "}.get(m["task"], "☑ ")

    @staticmethod
    def _table(m: re.Match) -> str:
        rows = [m["head"], *m["rows"].split("\n")]
        return "\n".join(_KEEP + "\t".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows if r.strip())

    def lines(self, window: int, surge: int) -> list[str]:
        """Clean lines: the blocks of text and what is kept anyway, contents put back where they stood."""
        lines = self.text.split("\n")
        kept = [_KEEP in x for x in lines]
        shown = [_HOLD.sub(lambda m: self.held[int(m[1])], x.replace(_KEEP, "")) for x in lines]
        return text_blocks(shown, window, surge if self.page else 1, kept)


def text_blocks(lines: list[str], window: int = WINDOW, surge: int = SURGE, keep: list[bool] | None = None) -> list[str]:
    """Lines between the surge and dive points of the line-block distribution, and those to ``keep``; one empty line between blocks.
    A text in which nothing surges has no distribution to go by and is kept whole."""
    if not lines:
        return []
    size = np.fromiter((len(x.strip()) for x in lines), np.int64, len(lines))
    total = np.concatenate([[0], np.cumsum(size)])
    block = total[np.minimum(np.arange(len(lines)) + window, len(lines))] - total[:-1]
    if not (block >= surge).any():
        surge = 1
    kept, inside, gap = [], False, False
    for i, (line, length, ahead) in enumerate(zip(lines, size, block)):
        if not inside and length and ahead >= surge:
            inside = True
        elif inside and not ahead:
            inside = False
        if length and (inside or keep and keep[i]):
            if gap and kept:
                kept.append("")
            kept.append(line.rstrip())
            gap = False
        else:
            gap = True
    return kept


def strip_markup(text: str, window: int = WINDOW, surge: int = SURGE) -> tuple[str, list[str]]:
    """The clean text, and the families whose syntax was taken out of it."""
    scan = _Scan(text)
    scan.code()
    scan.html()
    scan.latex()
    scan.wiki()
    scan.markdown()
    return "\n".join(scan.lines(window, surge)), [f for f in FAMILIES if f in scan.met]


def cleaner(text: Column, window: int = WINDOW, surge: int = SURGE) -> Column:
    """struct<clean, families> of a text; null for null."""

    @F.arrow_udf("struct<clean:string,families:array<string>>")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("clean", pa.string()), ("families", pa.list_(pa.string()))])
        for texts in batches:
            found = [None if t is None else strip_markup(t, window, surge) for t in texts.to_pylist()]
            yield pa.array([x and {"clean": x[0], "families": x[1]} for x in found], kind)

    return clean(text)


def clean_markup(df: DataFrame, text: str = "text", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``df`` with clean_text and markup_families.

    Null texts give null in both; empty texts an empty text and no family. Rows are independent: no shuffle, repeated
    rows come out repeated. Columns of ``df`` named like an output column are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("clean_text", "markup_families")]
    found = df.select(*kept, cleaner(F.col(f"`{text}`"), window, surge).alias("__markup"))
    return found.select(*kept, F.col("__markup.clean").alias("clean_text"), F.col("__markup.families").alias("markup_families"))
