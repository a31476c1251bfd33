import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import split


def stepwise(text, limit, overlap):
    """The same cuts, one after the other."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    natural, words = split.boundaries(text)
    out, end = [], None
    while end != len(text):
        low, high = (overlap, limit) if end is None else (end, end + limit - overlap)
        high = min(high, len(text))
        fit = [x for x in natural if low < x <= high] or [x for x in words if low < x <= high] or [high]
        out.append((0 if end is None else end - overlap, int(max(fit))))
        end = out[-1][1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_doubling_equals_stepwise_cutting(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        texts = ["".join(rnd.choice(["a", "bc ", "x. ", "\n", "\n\n", "d" * 20, "```\n", "! ", "é" * 9, "🙂", "。"]) for _ in range(rnd.randint(0, 50))) for _ in range(3)]
        limit = rnd.randint(2, 40)
        overlap = rnd.randint(0, limit - 1)
        for text, cuts in zip(texts, split.cut_batch(texts, limit, overlap)):
            assert cuts == stepwise(text, limit, overlap)
            assert all(0 < b - a <= limit for a, b in cuts)
            assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(cuts)) == text
            assert all(n[0] == c[1] - overlap for c, n in zip(cuts, cuts[1:]))


def test_cuts_at_natural_boundaries():
    text = "One sentence here. " * 200
    assert all(text[b - 2 : b] == ". " or b == len(text) for _, b in split.cut_batch([text])[0])
    fenced = "intro\n```\n" + "x = 1. y\n" * 400 + "```\n"
    assert all(fenced[b - 1] == "\n" for _, b in split.cut_batch([fenced])[0])


def test_very_long_texts():
    assert len(split.cut_batch(["z" * 2_000_000])[0]) == 1111
    with pytest.raises(ValueError):
        split.cut_batch(["x"], 10, 10)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a" * 5000, 7), (2, "short", 8), (3, "", 9), (4, None, 1), (1, "a" * 5000, 7), (None, "b" * 2001, None)], "id long, text string, piece int")
    out = split.split_items(df, "text")
    assert out.columns == ["id", "piece_index", "piece_start", "piece_end", "piece"]
    counts = {r.id: r["count"] for r in out.groupBy("id").count().collect()}
    assert counts == {1: 6, 2: 1, None: 2}
    assert out.filter(F.length("piece") > 2000).count() == 0
    assert split.split_items(df.limit(0), "text").count() == 0
    sizes = {(r.id, r.n) for r in df.select("id", F.coalesce(F.size(split.cuts_of(F.col("text"))), F.lit(0)).alias("n")).collect()}
    assert sizes == {(1, 3), (2, 1), (3, 0), (4, 0), (None, 2)}
