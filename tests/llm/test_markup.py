import time

import pytest
from pyspark.sql import functions as F

from marlstone.llm import markup
from marlstone.llm.markup import strip_markup, text_blocks

CASES = [
    ("a <b>bold</b> &amp; more<br/>x", "a bold & more\nx", ["html"]),
    ("x <span\n style='color:red'>y</span> <!-- no -->z", "x y z", ["html"]),
    ("<ul>\n<li>one</li>\n<li>two</li>\n</ul>", "• one\n\n• two", ["html"]),
    ("## Head\n\ntext **bold** and _it_ ~~gone~~", "Head\n\ntext bold and it gone", ["markdown"]),
    ("Head\n====\ntext", "Head\n\ntext", ["markdown"]),
    ("- a\n- [x] b\n1. c", "• a\n• ☑ b\n1) c", ["markdown"]),
    ("see [text](a.md) and [this][ref] ![alt](i.png)\n\n[ref]: x.md", "see text and this alt", ["markdown"]),
    ("| a | b |\n|---|--:|\n| 1 | 2 |", "a\tb\n1\t2", ["markdown"]),
    ("> [!note] Title\n> body", "Title\nbody", ["markdown"]),
    ("run `x <b> [[y]] $z$` now", "run x <b> [[y]] $z$ now", ["markdown"]),
    ("```py\n# no head\na_b = '<b>' # \\alpha\n```\nend", "# no head\na_b = '<b>' # \\alpha\nend", ["markdown"]),
    ("~~~\n[[x]]\n", "[[x]]", ["markdown"]),
    ("a [[Page|alias]] b [[Other#part]] ![[p.png]]", "a alias b Other#part p.png", ["wiki"]),
    ("== Head ==\n'''bold''' ''it'' {{todo|x}}", "Head\n\nbold it todo x", ["wiki"]),
    ('{| class="s"\n! a !! b\n|-\n| 1 || 2\n|}', "a\tb\n1\t2", ["wiki"]),
    ("\\section{One} text \\emph{soft} and $x_i^2$ or \\( y \\le 8 \\).", "One\n text soft and x_i^2 or y le 8.", ["latex"]),
    ("$$ v = \\frac{a}{5} $$", "v = (a)/(5)", ["latex"]),
    ("\\begin{itemize}\n\\item one\n\\end{itemize}", "• one", ["latex"]),
]


@pytest.mark.parametrize(("raw", "clean", "families"), CASES)
def test_families(raw, clean, families):
    got, met = strip_markup(raw)
    assert (got.strip(), met) == (clean, families)


@pytest.mark.parametrize(
    "text",
    [
        "Copy C:\\vaults\\alpha to drive D", "Files matching *.md and 2 * 3 * 4", "costs $40 to $639, or $5/$6", "p < 0.05 and n > 66 -> ok; Q&A follows; R&D", "set max_chunk_tokens and a_b_c",
        "use {name} as [66] in #12 with C# and F#", "status == 93 and x != y", "~55 minutes, ~8 hours", "5'' pipe, 6' tall", "a | b | c", "Map<String> x, List<Integer>", "snake_case_ and __", "10-24 and 2024-01-01", "it's 'quoted'",
    ],
)
def test_what_only_looks_like_markup(text):
    assert strip_markup(text) == (text, [])


def test_mixed_families_once_each():
    assert strip_markup("# A <b>x</b> [[l]] $y$ <i>z</i>")[1] == ["html", "markdown", "wiki", "latex"]


def test_line_blocks():
    lines = ["nav", "", "", "", "a long line of text", "another", "", "", "", "x"]
    assert text_blocks(lines) == ["nav", "", "a long line of text", "another", "", "x"]
    assert text_blocks(lines, 2, 10) == ["a long line of text", "another"]
    assert text_blocks([]) == []


def test_stripping_twice_changes_nothing_more():
    for raw, _, _ in CASES[:9]:
        once = strip_markup(raw)[0]
        assert strip_markup(once)[0].split() == once.split() or "```" in raw


def test_rows(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", 1), (2, "", 2), (3, None, 3), (1, "<b>x</b>", 1), (4, "*" * 100_000, 4)], "id long, text string, clean_text int")
    out = {(r.id, r.clean_text, tuple(r.markup_families or ()) if r.markup_families is not None else None) for r in markup.clean_markup(df).filter("id < 4").collect()}
    assert out == {(1, "x", ("html",)), (2, "", ()), (3, None, None)}
    assert markup.clean_markup(df).count() == 5 and markup.clean_markup(df.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("unit", ["[", "<", "*a ", "`", "$", "{{", "'' ", "\\(", "|-", "a_", "[[", "&", "```\n", "> ", "- ", "= ", "![", "\\x{"])
def test_long_texts_of_signs_end_soon(unit):
    strip_markup(unit * 5000)


def test_long_formulas_and_deep_nesting():
    body = " + ".join(f"x_{i}" for i in range(120))
    assert strip_markup(f"let ${body}$ hold") == (f"let {body} hold", ["latex"])
    assert strip_markup("".join(f"\\{c}{{" for c in ("emph", "textbf") * 4) + "deep" + "}" * 8) == ("deep", ["latex"])
    mixed = alike = "deep"
    for star, under in [("*", "_"), ("**", "__")] * 4:
        mixed = f"{star}x {under}x {mixed} x{under} x{star}"
        alike = f"{star}x {alike} x{star}"
    assert strip_markup(mixed) == ("x " * 16 + "deep" + " x" * 16, ["markdown"])
    assert strip_markup("_*deep*_") == ("deep", ["markdown"])
    assert strip_markup(alike) == ("x " * 8 + "deep" + " x" * 8, ["markdown"])


PAGE = """<ul><a href="/">Home</a><br/><a href="/about">About</a><br/><span>Login</span></ul>
<div></div><div></div><div></div>
<h2>Report</h2>
<p>The budget of this year covers the repair of both bridges and of the road between them.</p>
<p>Work on the first bridge starts in the spring and will be over by the end of the summer.</p>
<div></div><div></div><div></div><div></div><div></div><div></div>
<pre>x</pre>
<div>© us</div>
"""


def test_what_surrounds_the_text_of_a_page_is_cut():
    clean, families = markup.strip_markup(PAGE)
    assert clean.split("\n") == [
        "Report",
        "",
        "The budget of this year covers the repair of both bridges and of the road between them.",
        "",
        "Work on the first bridge starts in the spring and will be over by the end of the summer.",
    ]
    assert families == ["html"]
    assert "Home" in markup.strip_markup(PAGE, surge=1)[0] and "© us" in markup.strip_markup(PAGE, surge=1)[0]


@pytest.mark.parametrize("kept", ["# Head", "- item", "1. first", "`x = 1`", "$a+b$", "| a | b |\n|---|---|\n| 1 | 2 |", "\\section{Head}", "= Head =", "<h3>Head</h3>", "<li>item</li>", "```\ncode\n```"])
def test_headings_lists_tables_code_and_formulas_stay_wherever_they_stand(kept):
    alone = markup.strip_markup(kept)[0].strip()
    blank = "<div></div>\n" * 8
    page = f"{blank}Menu\n{blank}\n{kept}\n{blank}<p>{'The text of the page goes on for a while. ' * 4}</p>\n"
    clean = markup.strip_markup(page)[0]
    assert all(line in clean for line in alone.split("\n")) and "Menu" not in clean


def test_short_texts_are_kept_whole():
    assert markup.strip_markup("<p>Hi</p>")[0] == "Hi"
    assert markup.strip_markup("Title\n\n\n\n\n\n" + "A line of text that goes on and on and on. " * 3)[0].startswith("Title")


@pytest.mark.parametrize(
    "text",
    ["<a" + " " * 20_000, "<a x" * 20_000, "<script>" * 20_000, "\\(" * 20_000, "\\[ " * 20_000, "$x" * 20_000, "```a\n" * 20_000, "\\a{" * 20_000, "\\b{" * 20_000 + "x" + "}" * 20_000, "\\a[" * 20_000, "<!DOCTYPE" * 20_000, "&" * 20_000, "{" * 20_000, "<b " + "a=" * 20_000 + ">", "{{a" * 20_000, "*a" * 20_000],
)
def test_hostile_texts_take_no_longer_than_others(text):
    began = time.process_time()
    markup.strip_markup(text)
    assert time.process_time() - began < 1.0


def test_no_length_or_depth_is_too_large():
    formula = "+".join(f"x_{i}" for i in range(400))
    assert markup.strip_markup(f"so ${formula}$ holds") == (f"so {formula} holds", ["latex"])
    deep = "\\textbf{" * 500 + "word" + "}" * 500
    assert markup.strip_markup(f"a {deep} b") == ("a word b", ["latex"])
    assert markup.strip_markup("a \ue000b\ue001 \ue0023 `c`") == ("a \ue000b\ue001 \ue0023 c", ["markdown"])
    assert markup.strip_markup("`" + "\\(`x`\\)")[0]
