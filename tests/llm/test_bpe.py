import random

import pytest
from tokenizers import Tokenizer

from marlstone.llm import bpe

SIGNS = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "'s", "'", "1", "²", "é", "é", "ж", "日本", "🙂", "!", "...", "====", "ing", "<|endoftext|>", "\x00", "\ufeff", "한", "ा", "x" * 40]


@pytest.fixture(scope="module")
def machine():
    with open(bpe.TOKENIZER_PATH, "rb") as f:
        return bpe.MergeAutomaton.from_bytes(f.read())


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.TOKENIZER_PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_equals_the_library_and_decodes(machine, reference):
    rnd = random.Random(7)
    for _ in range(4000):
        text = "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 12)))
        ids = machine.encode(text)
        assert ids == reference(text)
        assert machine.decode(ids) == text
    for _ in range(4000):
        text = "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 40)))
        assert machine.encode(text) == reference(text)


def test_every_adjacent_pair_has_an_arc(machine, reference):
    for text in ["hello world", "aaaaaaa", "internationalisation"]:
        ids = reference(text)
        assert all(machine.has_arc(a, b) for a, b in zip(ids, ids[1:]) if not machine.label[b].startswith(b" "))
    a, aa = machine.encode("a")[0], machine.encode("aa")
    assert len(aa) == 1 and not machine.has_arc(a, a)


def test_small_automaton_by_hand():
    names = {n: i for i, n in enumerate(["a", "b", "ab", "aba", "bb"])}
    m = bpe.MergeAutomaton(names, [("a", "b"), ("ab", "a"), ("b", "b")])
    assert [m.label[i] for i in m.run(b"abab")] == [b"ab", b"ab"]
    assert [m.label[i] for i in m.run(b"abaa")] == [b"aba", b"a"]
    assert [m.label[i] for i in m.run(b"abbb")] == [b"ab", b"bb"]
    assert m.run(b"") == ()


def test_long_runs(machine, reference):
    for text in ["a" * 50_000, " " * 50_000, "=" * 3001 + "\n" * 3001]:
        assert machine.encode(text) == reference(text)


def test_rows(spark, reference):
    df = spark.createDataFrame([(1, "Hello  wörld", 5), (2, "", 5), (3, None, 5), (1, "Hello  wörld", 5), (4, "<|endoftext|>", 5)], "doc_id long, text string, ids int")
    rows = bpe.encode_corpus(df).collect()
    assert len(rows) == 5
    assert {r.doc_id: r.ids for r in rows} == {1: reference("Hello  wörld"), 2: [], 3: [], 4: reference("<|endoftext|>")}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    counted = df.select("doc_id", bpe.counter(spark)("text").alias("n")).distinct().collect()
    assert {r.doc_id: r.n for r in counted} == {1: len(reference("Hello  wörld")), 2: 0, 3: 0, 4: len(reference("<|endoftext|>"))}
    back = bpe.encode_corpus(df).select("doc_id", bpe.decoder(spark)("ids").alias("t")).distinct().collect()
    assert {r.doc_id: r.t for r in back} == {1: "Hello  wörld", 2: "", 3: "", 4: "<|endoftext|>"}
