import hashlib
import uuid

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators.chunking import default_count


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_name_ids_equal_the_standard(spark):
    names = ["a:b:0", "u-1:Заметки/é.md:12", "", "x" * 1000]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.name_uuid(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n)) for r in rows)


def test_paths(spark):
    assert one(spark, T.base_name("p"), p="a/b/c.tar.gz") == "c.tar.gz"
    assert one(spark, T.stem("p"), p="a/b/c.tar.gz") == "c.tar"
    assert one(spark, T.stem("p"), p="a/.hidden") == ".hidden"
    assert one(spark, T.extension("p"), p="a.b/c") == ""
    assert one(spark, T.file_type("p"), p="x/Y.PNG") == "image"
    assert one(spark, T.file_type("p"), p="x/y.txt") == "md"
    assert one(spark, T.clean_path("p"), p="//a///b/") == "a/b"


def test_trim_takes_all_white_space(spark):
    assert one(spark, T.trim_all("s"), s=" \n\t x y ﻿\r\n") == "x y"


def test_token_counter_is_the_same_inside_and_outside(spark):
    texts = ["", "a b", "x_y z-1", "Ünï 中文", "a b", "tab\there", "é", "\x0b", "🙂!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_count("t").alias("n")).collect()
    assert [r.n for r in rows] == [default_count(r.t) for r in rows]


def test_sections(spark):
    def section(kind, path):
        return one(spark, T.section_of("k", "p"), k=kind, p=path)

    assert section("ADR", "x.md") == "adrs"
    assert section(None, "docs/Architecture/x.md") == "architecture"
    assert section("note", "adr/x.md") == "adrs"
    assert section("note", "myadr/x.md") == "implementation"
    assert section("glossary", "adr/x.md") == "glossary"


def test_wiki_links(spark):
    assert one(spark, T.plain_wiki("t"), t="![[a.png]]x [[P|alias]] [[Page]]") == "x alias Page"


def test_truncation(spark):
    assert one(spark, T.truncate_tokens("t", 3), t="one two, three") == "one two,"
    assert one(spark, T.truncate_tokens("t", 20_000), t="a b\n" * 10_500) == ("a b\n" * 10_000).rstrip("\n")
    assert one(spark, T.truncate_tokens("t", 5), t="w" * 100_000) == "w" * 100_000


def test_hash(spark):
    assert one(spark, T.content_hash("t"), t="é") == hashlib.sha256("é".encode()).hexdigest()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, None, None]
    bad = spark.createDataFrame([([float("nan"), 1.0],), (None,), ([0.0, 0.0],), ([1.0, None],), ([1.0, 2.0],), ([1.0],)], "a array<double>")
    assert [r[0] for r in bad.select(F.coalesce(V.usable(F.col("a"), 2), F.lit(False))).collect()] == [False, False, False, False, True, False]
    texts = spark.createDataFrame([("a b",), ("b a",), ("",), (None,)], "t string")
    out = [r[0] for r in texts.select(V.hashing_embedder(16)(F.col("t"))).collect()]
    assert out[0] == out[1] and out[2] is None and out[3] is None


def test_embedders_are_kept_until_the_key_changes():
    made = []
    e = V.Embedders(lambda model, key, dim: made.append((model, key, dim)) or len(made))
    assert e.of("u", "text-embedding-3-small", "k") == e.of("u", "text-embedding-3-small", "k") == 1
    assert e.of("u", "text-embedding-3-small", "other") == 2 and made[0][2] == 1536
    e.drop("u")
    assert e.of("u", "text-embedding-3-small", "other") == 3
    try:
        e.of("u", "nope", "k")
    except ValueError:
        return
    raise AssertionError
