import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import toxicity

ORDINARY = ["The meeting on {n} moved to room {m}.", "Please review ticket {n} before the release of {m}.", "We counted {n} files in the folder {m} today.", "The report about {m} has {n} pages and two tables.", "Latency of service {m} rose to {n} ms."]
BAD = {
    "abusive": ["You are a worthless fool, {m}, and everybody laughs at you.", "Shut your mouth {m}, you useless piece of dirt.", "I will find you and break your arm, {m}."],
    "hateful": ["People from {m} are vermin and must be driven out.", "Never let one of them near {m}, that kind steals from birth."],
    "sexual": ["She slowly took off her clothes on the desk of {m}.", "Hot naked pictures for free, click on {m} tonight."],
}


def document(rnd, category=None):
    fill = lambda t: t.format(n=rnd.randint(1, 999), m="".join(rnd.choice(["ba", "ko", "ri", "tu", "zen", "mol"]) for _ in range(3)))
    out = [fill(rnd.choice(ORDINARY)) for _ in range(rnd.randint(1, 5))]
    if category:
        out.insert(rnd.randint(0, len(out)), fill(rnd.choice(BAD[category])))
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    kinds = [None] * 6 + list(BAD)
    docs = [(i, k := rnd.choice(kinds)) for i in range(1500)]
    rows = [(i, document(rnd, k), frozenset([k] if k and rnd.random() > 0.07 else ["abusive"] if not k and rnd.random() < 0.02 else [])) for i, k in docs]
    return toxicity.train(rows)


def test_held_out_accuracy(model):
    rnd = random.Random(2)
    gauges = model.gauges()
    hits = misses = false = 0
    for i in range(600):
        kind = rnd.choice([None, *BAD])
        scores = toxicity.document_scores(document(rnd, kind), gauges, model.names)
        found = {c for c, s in scores.items() if s >= model.thresholds[c]}
        hits += kind in found
        misses += kind is not None and kind not in found
        false += len(found - {kind})
    assert hits / (hits + misses) > 0.95 and hits / (hits + false) > 0.95


@pytest.mark.parametrize(("raw", "plain"), [("V​e​l a s s h o l e", "vel asshole"), ("idiiiiot", "idiot"), ("1d10t b4d", "idiot bad"), ("Іdіоt", "idiot"), ("é  É", "e e"), ("S_E_X", "sex"), ("12:30 und 77", "0:0 und 0"), ("f-o-o bar", "foo bar")])
def test_disguises(raw, plain):
    assert toxicity.normalise(raw) == plain


def test_disguised_text_is_found(model):
    gauges = model.gauges()
    plain = toxicity.document_scores("Shut your mouth bakori, you useless piece of dirt.", gauges, model.names)
    hidden = toxicity.document_scores("Ѕhut yоur m0uth bakori, you u s e l e s s piece of diiiirt.", gauges, model.names)
    assert plain["abusive"] >= model.thresholds["abusive"] and hidden["abusive"] >= model.thresholds["abusive"]


def test_windows_cover_the_whole_text():
    text = "word " * 5000 + "end."
    assert sum(w.count(b"word") for w in toxicity.windows(text)) >= 4900
    assert toxicity.windows("") == [] and toxicity.windows(" \n\n ") == []
    assert toxicity.windows("No.") == [b"no."]


def test_rows(spark, model):
    rnd = random.Random(3)
    df = spark.createDataFrame([(1, document(rnd, "hateful"), "s"), (2, "", "s"), (3, None, None), (4, "   ", "s"), (1, "x", "t")], "doc_id long, text string, offends string")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "abusive_score", "hateful_score", "sexual_score", "offends"] and out.count() == 5
    assert {(r.doc_id, tuple(r.offends)) for r in out.collect()} == {(1, ("hateful",)), (2, ()), (3, ()), (4, ()), (1, ())}


def test_fit_takes_the_newest_label_and_bears_little_data(spark):
    docs = spark.createDataFrame([(1, "You fool."), (2, "The room is free."), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "r", "none", 0, 1), (1, "r", "abusive", 2, 2), (2, "r", "none", None, 1), (2, "r", "none", None, 1), (3, "r", "sexual", 1, 1), (4, "r", "abusive", 1, 1), (1, "q", "odd", 1, 9)], "doc_id long, reviewer string, category string, severity int, reviewed_at int")
    assert sorted((r.doc_id, r.text, frozenset(r.found)) for r in toxicity.labelled(docs, labels).collect()) == [(1, "You fool.", frozenset({"abusive"})), (2, "The room is free.", frozenset())]
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter(F.size("offends") > 0).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.filter("doc_id > 100"))).filter(F.size("offends") > 0).count() == 0


def test_the_quick_level_decides_nothing(model, monkeypatch):
    rnd = random.Random(9)
    texts = [document(rnd, rnd.choice([None, None, *BAD])) for _ in range(300)]
    over = lambda g: [{c for c, s in toxicity.document_scores(t, g, model.names).items() if s >= model.thresholds[c]} for t in texts]
    screened = over(model.gauges())
    monkeypatch.setattr(toxicity, "SCREEN", -9.0)  # every window at the thorough level
    thorough = over(model.gauges())
    assert sum(a != b for a, b in zip(screened, thorough)) <= 3


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("see [agent named](notes/a.md) here", "see agent named here"),
        ("![a rude label](x.png) end", "a rude label end"),
        ('<img src="x.png" alt="a rude label"/> end', "a rude label end"),
        ("if a < b rude words c > d", "if a < b rude words c > d"),
        ("the &lt;rude words&gt; stay", "the <rude words> stay"),
        ("the <rude words> and <b rude words> stay", "the <rude words> and <b rude words> stay"),
        ('a <b>bold</b> <a href="http://x.y/z">link</a><br/>', "a bold link"),
        ("at https://x.y/z or [http://x.y](http://x.y)", "at or"),
    ],
)
def test_labels_and_bracketed_words_are_scored(raw, plain):
    assert toxicity.normalise(raw) == plain


def test_long_sentences_are_cut_at_spaces_and_overlap():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghik") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    plain = toxicity.normalise(" ".join(words))
    cut = [w.decode() for w in toxicity.windows(plain)]
    assert all(len(w) <= toxicity.LONG for w in cut)
    assert {x for w in cut for x in w.split()} == set(plain.split())
    for at in range(len(plain) - toxicity.SHARED):
        assert any(plain[at : at + toxicity.SHARED] in w for w in cut)


def test_long_sentences_without_spaces_lose_nothing():
    plain = toxicity.normalise("".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(650)))
    cut = [w.decode() for w in toxicity.windows(plain)]
    assert all(len(w) <= toxicity.LONG for w in cut)
    assert all(any(plain[at : at + toxicity.SHARED] in w for w in cut) for at in range(len(plain) - toxicity.SHARED))
