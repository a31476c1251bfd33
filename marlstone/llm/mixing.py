"""Mixing sources to target shares of the total size, by subset-sum budget fitting.

Sizes are tokens. The total is the largest one at which every available source can meet its share within its repeats,
unless the caller names one. A source gets as many whole copies as fit its budget; the rest is filled from one more
copy: every exact token length gives its proportional number of documents, and what is then left is fitted by a
bounded-knapsack table over the lengths still available. If the table does not meet the budget to the token, more documents go
back and the table grows, until it does or no other choice is left that could come nearer. Which documents of a length are taken is decided by a seeded hash.
Only counts by (source, length) reach the fitting, never documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import bpe
from marlstone.operators.ranking import running_position
from marlstone.operators.sized import sized
from marlstone.session import materialize

#: First span of the knapsack table in tokens, and documents of each length put back for it; both grow until the fit is the best.
TABLE, GIVE_BACK = 1 << 16, 4
SEED = 20250301


def _knapsack(size: np.ndarray, free: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Of ``free`` documents of each size as many as come nearest to ``left`` tokens from below, and the tokens that stay."""
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    through = np.full(left + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for i in range(len(size)):
        more, power = min(int(free[i]), left // int(size[i])), 1
        while more > 0 and not reached[left]:
            n = min(power, more)
            more -= n
            power *= 2
            weight = n * int(size[i])
            fresh = np.zeros_like(reached)
            fresh[weight:] = reached[: left + 1 - weight]
            fresh &= ~reached
            through[fresh] = len(parts)
            parts.append((i, n))
            reached |= fresh
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    short, taken = left - at, np.zeros(len(size), np.int64)
    while at > 0:
        i, n = parts[through[at]]
        taken[i] += n
        at -= n * int(size[i])
    return taken, short


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE, back: int = GIVE_BACK) -> np.ndarray:
    """How many documents of each length to take so that the sum comes as near to the budget as possible from below.

    The fit is exact: a sum equal to the budget cannot be bettered, and short of that the table is widened until it holds every
    choice that could matter. A best choice differs from any other full one in fewer documents than twice the longest length, as
    of more of them some would cancel out, so no more need to go back.
    """
    order = np.argsort(lengths)
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    if budget >= int((size * have).sum()):
        return counts.astype(np.int64)
    unit = int(np.gcd.reduce(size))  # sums are multiples of it
    size, budget = size // unit, budget // unit
    share = (have * budget) // int((size * have).sum())
    left = budget - int((size * share).sum())
    for i in range(len(size) - 1, -1, -1):  # a full choice: what is left is less than any document that could be added
        more = min(int(have[i] - share[i]), left // int(size[i]))
        share[i] += more
        left -= more * int(size[i])
    enough = 2 * int(size[-1])
    while True:
        given, rest = np.zeros(len(size), np.int64), left
        for i in range(len(size)):  # short documents first, so that the table has much to choose from
            given[i] = min(int(share[i]), back, max(0, table - rest) // int(size[i]))
            rest += int(given[i]) * int(size[i])
        more, short = _knapsack(size, have - share + given, rest)
        if not short or (given >= np.minimum(share, enough)).all():
            break
        table, back = table * 4, back * 4
    taken = share - given + more
    out = np.zeros(len(lengths), np.int64)
    out[order] = taken
    return out


def token_sizes(docs: DataFrame, record: str = "doc_id", source: str = "source", text: str = "text", path: str = bpe.TOKENIZER_PATH) -> DataFrame:
    """(doc, source, n_tokens), one row per document, written once."""
    count = bpe.counter(docs.sparkSession, path)
    rows = docs.select(F.col(f"`{record}`").alias("doc"), F.col(f"`{source}`").alias("source"), count(F.col(f"`{text}`")).alias("n_tokens"))
    return materialize(rows.filter("doc IS NOT NULL AND source IS NOT NULL").dropDuplicates(["doc"]), "token-sizes")


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, max_repeats, tokens, budget, copies, rest) of every listed source that has tokens.

    ``share`` is the target among those sources, ``copies`` the whole copies that fit the budget and ``rest`` what is left for
    one more copy, 0 where the repeats are used up.
    """
    listed = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sizes.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    both = held.join(listed, "source")
    all_sources = Window.partitionBy(F.lit(0))  # one row per source
    both = both.withColumn("share", F.col("target_share") / F.sum("target_share").over(all_sources))
    most = F.lit(total) if total is not None else F.floor(F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(all_sources))
    both = both.withColumn("budget", F.least(F.round(F.col("share") * most).cast("long"), F.col("max_repeats") * F.col("tokens")))
    both = both.withColumn("copies", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    return both.withColumn("rest", F.when(F.col("copies") < F.col("max_repeats"), F.col("budget") - F.col("copies") * F.col("tokens")).otherwise(F.lit(0)))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc, source, n_tokens, copies) of the documents in the mix, ``copies`` from 1 to the source's max_repeats.

    ``sizes`` comes from ``token_sizes``. Sources that are not listed, listed ones without tokens and documents without tokens
    take no part; the shares of absent sources go to the others in proportion. A source listed twice counts with its
    larger share. With a ``total`` beyond what a source can give within its repeats, that source gives all it can. An empty
    table on either side gives an empty mix.
    """
    plan = materialize(budgets(sizes, targets, total), "budgets")
    lengths = sizes.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    wanted = lengths.join(sized(plan.select("source", "rest"), "rests"), "source")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        taken = fit_lengths(group["n_tokens"].to_numpy(), group["n"].to_numpy(), int(group["rest"].iloc[0]))
        return pd.DataFrame({"source": group["source"], "n_tokens": group["n_tokens"], "take": taken})

    # a group is the distinct lengths of a source, at most the tokens of its longest document
    fitted = wanted.groupBy("source").applyInPandas(fit, "source string, n_tokens int, take long")
    fitted = materialize(fitted, "fitted")
    seeded = sizes.filter("n_tokens > 0").withColumn("luck", F.xxhash64("doc", F.lit(seed)))
    placed = running_position(seeded, ["source", "n_tokens"], "luck", ["doc"])
    chosen = placed.join(fitted, ["source", "n_tokens"]).join(sized(plan.select("source", F.col("copies").alias("whole")), "wholes"), "source")
    copies = F.col("whole") + F.when(F.col("position") <= F.col("take"), 1).otherwise(0)
    return chosen.select("doc", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per source, listed or held: its target, what it gave, and its actual share of the mix."""
    given = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").cast("long").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).cast("long").alias("tokens"))
    listed = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"))
    rows = listed.join(held, "source", "full").join(given, "source", "left").fillna(0, ["documents", "copies", "tokens", "held_tokens"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
