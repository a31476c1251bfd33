"""One ranking from several differently scaled scores, by robust rank aggregation.

In each channel of a request points are ranked (ties share the middle rank) and ranks are divided by the number of the
request's points; a point without a score has rank 1. The sorted ranks of a point are held against the order statistics
of uniform numbers: the k-th smallest of m is at most r with the binomial tail P(Bin(m, r) >= k). The smallest of the m
probabilities, times m, is the point's significance, and points are ranked by it. Only ranks enter, so no channel
decides by the size of its numbers.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ranking import running_position
from marlstone.operators.sized import sized
from marlstone.session import materialize

#: Most points folded in one task when a large request's winner is looked for, and most rows of a request that one task holds.
FOLD, WHOLE = 2000, 200_000
#: Numbers of channels for which the probabilities are written out as polynomials.
PLAIN = 4


def _tail(k: Column, m: Column, r: Column) -> Column:
    """P(Bin(m, r) >= k)."""

    def term(j: Column) -> Column:
        choose = F.aggregate(F.when(j > 0, F.sequence(F.lit(1), j)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda acc, i: acc * (m - j + i) / i)
        return choose * F.pow(r, j) * F.pow(1 - r, m - j)

    return F.aggregate(F.sequence(k, m), F.lit(0.0), lambda acc, j: acc + term(j))


def _plain_tail(k: int, m: int, r: Column) -> Column:
    """The same for numbers that are known beforehand, without a loop in the row."""
    return reduce(lambda a, b: a + b, [float(math.comb(m, j)) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(k, m + 1)])


def significance(ranks: Column) -> Column:
    """Corrected minimum of the order-statistic probabilities of an array of ranks in (0, 1]."""
    ordered = F.array_sort(ranks)
    m = F.size(ranks)
    each = F.array_min(F.transform(ordered, lambda r, i: _tail(i + 1, m, r)))
    for n in range(1, PLAIN + 1):
        tails = [_plain_tail(k, n, ordered[k - 1]) for k in range(1, n + 1)]
        each = F.when(m == n, F.least(*tails) if n > 1 else tails[0]).otherwise(each)
    return F.least(F.lit(1.0), each * m)


def _keyed(scores: DataFrame, request: str, item: str, channel: str, score: str, version: str | None) -> DataFrame:
    order = F.col(f"`{version}`") if version else F.lit(0)
    rows = scores.select(F.col(f"`{request}`").alias("request"), F.col(f"`{item}`").alias("item"), F.col(f"`{channel}`").alias("channel"), order.alias("v"), F.col(f"`{score}`").cast("double").alias("s"))
    return rows.filter("request IS NOT NULL AND item IS NOT NULL AND channel IS NOT NULL")


def _newest(rows: DataFrame) -> DataFrame:
    """(request, item, channel, score) of scored points; null and NaN newest scores are left out."""
    last = rows.groupBy("request", "item", "channel").agg(F.max(F.struct("v", "s")).alias("last"))
    return last.select("request", "item", "channel", (F.col("last.s") + 0.0).alias("score")).filter("score IS NOT NULL AND NOT isnan(score)")


def _judged(items: DataFrame) -> DataFrame:
    """Items (request, item, at, n, channels) with ranks, significance and mean; rounding keeps the order of equal values free of the
    last bits of floating-point sums."""
    ranks = F.transform("channels", lambda c: F.coalesce(F.try_element_at(F.col("at"), c) / F.col("n"), F.lit(1.0)))
    scored = F.transform("channels", lambda c: F.map_contains_key("at", c))
    full = items.select("request", "item", "n", ranks.alias("ranks"), scored.alias("scored"))
    mean = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + r) / F.size("ranks")
    return full.withColumn("significance", F.round(significance(F.col("ranks")), 12)).withColumn("mean", F.round(mean, 12))


def _ranked_whole(rows: DataFrame) -> DataFrame:
    """Requests that fit a task: rows are parted by request once, and everything after happens inside of the parts."""
    valid = _newest(rows.repartition("request"))
    same = Window.partitionBy("request", "channel", "score")
    middle = F.rank().over(Window.partitionBy("request", "channel").orderBy(F.desc("score"))) + (F.count("*").over(same) - 1) / 2.0
    items = valid.withColumn("middle", middle).groupBy("request", "item").agg(F.map_from_entries(F.collect_list(F.struct("channel", "middle"))).alias("at"))
    mine = Window.partitionBy("request")
    items = items.withColumn("own", F.sort_array(F.map_keys("at"))).withColumn("n", F.count("*").over(mine)).withColumn("channels", F.array_sort(F.array_distinct(F.flatten(F.collect_set("own").over(mine)))))
    return _judged(items).withColumn("position", F.row_number().over(mine.orderBy("significance", "mean", "item")))


def _ranked_parts(rows: DataFrame) -> DataFrame:
    """Requests of any size: no task holds a whole one."""
    valid = materialize(_newest(rows), "scores")
    levels = valid.groupBy("request", "channel", "score").agg(F.count("*").alias("same")).withColumn("down", -F.col("score"))
    placed = running_position(levels, ["request", "channel"], "down", weight="same", out="upto")
    placed = placed.select("request", "channel", "score", (F.col("upto") - (F.col("same") - 1) / 2.0).alias("middle"))
    ranked = valid.join(placed, ["request", "channel", "score"])
    items = ranked.groupBy("request", "item").agg(F.map_from_entries(F.collect_list(F.struct("channel", "middle"))).alias("at"))
    lists = valid.groupBy("request").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    full = materialize(_judged(items.join(lists.join(items.groupBy("request").agg(F.count("*").alias("n")), "request"), "request")), "fused")
    # significance is cut off at 1, which many points of a large request share, so ranges are cut by the mean as well
    full = full.withColumn("__order", F.when(F.col("significance") >= 1, 1 + F.col("mean")).otherwise(F.col("significance")))
    return running_position(full, ["request"], "__order", ["mean", "item"]).drop("__order")


def _sides(scores: DataFrame, *names: str | None) -> list[tuple[DataFrame, bool]]:
    """Rows of the requests that fit a task (True), and of those that do not, if there are any."""
    rows = _keyed(scores, *names)
    large = sized(rows.groupBy("request").agg(F.count("*").alias("rows")).filter(F.col("rows") > WHOLE).select("request"), "large")
    if large.isEmpty():
        return [(rows, True)]
    return [(rows.join(large, "request", "left_anti"), True), (rows.join(large, "request", "left_semi"), False)]


def aggregate_ranks(scores: DataFrame, request: str, item: str, channel: str = "channel", score: str = "score", version: str | None = None) -> DataFrame:
    """(request, item, ranks, scored, significance, mean, position, n), the ranks in the order of the request's channels by name.

    Higher scores are better. The newest version of a (request, item, channel) counts and repeated rows once; null and
    NaN are no scores; items and channels without any score in a request do not count; rows with a null key are left
    out. Equal significance is ordered by mean rank, then item. Infinite scores are ordinary extremes. An empty table
    gives an empty table. Other columns do not matter.
    """
    out = None
    for rows, whole in _sides(scores, request, item, channel, score, version):
        ranked = (_ranked_whole(rows) if whole else _ranked_parts(rows)).select("request", "item", "ranks", "scored", "significance", "mean", F.col("position").cast("long").alias("position"), "n")
        out = ranked if out is None else out.unionByName(ranked)
    return out.withColumnsRenamed({"request": request, "item": item})


def _beats(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x < y), lambda won: won)) * 2 > F.size(a)


def _by_scored_ranks(ranking: DataFrame) -> DataFrame:
    """Ranks in which a channel that has no score of a point loses to all others."""
    return ranking.select("request", "position", "item", F.transform(F.arrays_zip("ranks", "scored"), lambda x: F.when(x["scored"], x["ranks"]).otherwise(F.lit(2.0))).alias("ranks"), "n")


def _folded(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Of each group the point that is left when, in the order of the ranking, the better of two is kept."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "item", "ranks", "n"))).alias("all"))
    best = F.aggregate("all", F.col("all")[0], lambda best, x: F.when(_beats(x["ranks"], best["ranks"]), x).otherwise(best))
    return listed.select(*keys, best.alias("best"), "all")


def majority_winners(ranking: DataFrame, request: str, item: str) -> DataFrame:
    """(request, item) of the points that beat every other point in more than half of the request's channels.

    Takes the rows of ``aggregate_ranks``. A winner survives any fold that keeps the better of two points, so blocks of
    a request are folded in the order of the ranking, then their survivors; the one that is left is held against
    every point of its request.
    """
    keyed = materialize(_by_scored_ranks(ranking.withColumnsRenamed({request: "request", item: "item"})), "ranking")
    rows = keyed
    for share in (FOLD, FOLD * FOLD):  # blocks of about FOLD points, then of about FOLD survivors
        rows = _folded(rows.withColumn("block", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / share))), ["request", "block"]).select("request", "best.*")
    best = _folded(rows, ["request"]).select("request", F.col("best.item").alias("best"), F.col("best.ranks").alias("br"))
    lost = F.when((F.col("item") != F.col("best")) & ~_beats(F.col("br"), F.col("ranks")), 1).otherwise(0)
    held = keyed.join(best, "request").groupBy("request", "best").agg(F.max(lost).alias("lost")).filter("lost = 0")
    return held.select(F.col("request").alias(request), F.col("best").alias(item))


def winners(scores: DataFrame, request: str, item: str, channel: str = "channel", score: str = "score", version: str | None = None) -> DataFrame:
    """``majority_winners`` of ``aggregate_ranks``, for requests that fit a task in the very stage that ranks them."""
    out = None
    for rows, whole in _sides(scores, request, item, channel, score, version):
        if whole:
            folded = _folded(_by_scored_ranks(_ranked_whole(rows)), ["request"])
            won = F.forall("all", lambda x: (x["item"] == F.col("best.item")) | _beats(F.col("best.ranks"), x["ranks"]))
            found = folded.filter(won).select(F.col("request").alias(request), F.col("best.item").alias(item))
        else:
            found = majority_winners(_ranked_parts(rows), "request", "item").withColumnsRenamed({"request": request, "item": item})
        out = found if out is None else out.unionByName(found)
    return out
