from pyspark.sql import functions as F

from marlstone.operators import chunking, corpus, packing
from marlstone.operators.chunking import blocks, markdown_chunks


def words(n, w="word"):
    return " ".join([w] * n)


def test_headings_make_paths():
    body = f"# Top\n\n{words(120)}\n\n## A\n\n{words(120)}\n\n### B\n\n{words(120)}\n\n## C\n\n{words(120)}"
    assert [p for p, _ in markdown_chunks(body, "note")] == ["note", "note > A", "note > A > B", "note > C"]


def test_level_one_clears_the_stack():
    body = f"## A\n\n{words(120)}\n\n# New\n\n{words(120)}"
    assert [p for p, _ in markdown_chunks(body, "n")] == ["n > A", "n"]


def test_short_sections_join_the_one_before():
    found = markdown_chunks(f"## A\n\n{words(120)}\n\n## B\n\nshort one\n\n## C\n\n{words(120)}", "n")
    assert [p for p, _ in found] == ["n > A", "n > C"]
    assert found[0][1].endswith("short one")


def test_first_short_section_keeps_its_path():
    assert [p for p, _ in markdown_chunks("## A\n\nfew\n\n## B\n\nmore", "n")] == ["n > A"]


def test_fences_hide_headings_and_tables_are_parsed():
    kinds = [k for k, _, _ in blocks("```\n# no heading\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n- y\n\n> q\n\nSet\n===\n\ntext")]
    assert kinds == ["code", "table", "list", "quote", "heading", "paragraph"]


def test_oversize_sections_are_cut_between_paragraphs():
    found = markdown_chunks("\n\n".join(words(150, w) for w in "abcd"), "n")
    assert len(found) == 2 and all(p == "n" for p, _ in found)
    assert len(markdown_chunks(words(700), "n")) == 1  # one paragraph stays whole


def test_oversize_code_is_cut_between_lines():
    found = markdown_chunks("```\n" + "\n".join(words(20, f"w{i}") for i in range(60)) + "\n```", "n")
    assert len(found) > 1
    joined = "\n".join(t.partition("\n\n")[2] for _, t in found)
    assert joined.count("w59") == 20 and joined.count("w0 ") + joined.count("w0\n") >= 20


def test_markdown_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "  \n", None), (4, "hello [[X|y]]", None)], "id long, text string, title string")
    assert [tuple(r) for r in chunking.markdown(df, ["id"]).collect()] == [(4, 0, "", "\n\nhello y")]


def test_csv(spark):
    text = "﻿name,note\r\n" + "\r\n".join(f'n{i},"a, ""b"""' for i in range(31)) + "\r\n\r\nshort\r\nx, ,spare\r\n"
    df = spark.createDataFrame([(1, text, "f.csv"), (2, "name\n", "e.csv"), (3, None, "n.csv"), (4, "", "m.csv")], "id long, text string, name string")
    found = chunking.csv_text(df, ["id"], "text", "name").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.section_path) for r in found] == [(1, "f.csv > Rows 1-30"), (1, "f.csv > Rows 31-33")]
    assert found[0].text.split("\n")[0] == 'name: n0, note: a, "b"'
    assert found[1].text.split("\n")[1:] == ["name: short", "name: x"]


def test_canvas_and_drawings_survive_bad_json(spark):
    canvas = '{"nodes":[{"type":"text","text":" a "},{"type":"file"},{"type":"text","text":"  "},{"type":"text","text":"b"}],"edges":[]}'
    df = spark.createDataFrame([(1, canvas, "c"), (2, "{oops", "c"), (3, '{"nodes": 3}', "c"), (4, None, "c")], "id long, j string, name string")
    assert [(r.id, r.chunk_index, r.section_path, r.text) for r in chunking.canvas(df, ["id"], "j", "name").collect()] == [(1, 0, "c > Node 1", "a"), (1, 1, "c > Node 2", "b")]
    long = words(9)
    drawing = '{"elements":[' + ",".join(f'{{"type":"text","text":"{t}"{d}}}' for t, d in [("a", ""), ("b", ""), ("gone", ',"isDeleted":true'), (long, ""), ("c", "")]) + "]}"
    df = spark.createDataFrame([(1, drawing, "d"), (2, "[]", "d")], "id long, j string, name string")
    assert [(r.chunk_index, r.section_path, r.text) for r in chunking.excalidraw(df, ["id"], "j", "name").orderBy("chunk_index").collect()] == [(0, "d > Text 1", "a\nb"), (1, "d > Text 2", long), (2, "d > Text 3", "c")]


def test_pages(spark):
    df = spark.createDataFrame([("f", 1, words(20)), ("f", 2, words(5)), ("f", 3, words(300) + "\n\n" + words(350)), ("f", 4, None)], "path string, n int, text string")
    found = chunking.pdf_pages(df, ["path"], "n", "text", F.col("path")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section_path) for r in found] == [(0, "f > Page 1"), (1, "f > Page 3"), (2, "f > Page 3")]


def test_files_no_parser_can_read_have_no_pages(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-broken"),), (None,)], "raw binary")
    assert [r[0] for r in df.select(chunking.pdf_extractor(lambda raw: 1 / 0)("raw")).collect()] == [[], []]
    assert df.select(chunking.pdf_extractor(lambda raw: [" a  b "])("raw")).first()[0] == ["a b"]


def test_packing_keeps_all_lines_and_the_cap(spark):
    texts = ["a b c\nd\n\ne f g h i j k", "", "x", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", packing.pack_lines("t", 4).alias("p")).collect():
        assert "\n".join(r.p) == r.t
        assert all(len(x.split()) <= 4 or "\n" not in x for x in r.p)
    assert df.select(packing.pack_paragraphs("t", 4)).collect()[1][0] == []


def test_dispatch_by_format(spark):
    docs = spark.createDataFrame([("u", "a.md", "hello"), ("u", "b.csv", "h\nv"), ("u", "c.png", "x"), ("u", "d.canvas", '{"nodes":[{"type":"text","text":"n"}]}')], "user_id string, path string, content string")
    pages = spark.createDataFrame([("u", "e.pdf", 1, words(12))], "user_id string, path string, page_num int, text string")
    found = {(r.path, r.section_path) for r in corpus.chunk_documents(docs, pages).collect()}
    assert found == {("a.md", "a"), ("b.csv", "b > Rows 1-1"), ("d.canvas", "d > Node 1"), ("e.pdf", "e > Page 1")}
