"""Context packs: relevance floor, merge by note, section, greedy fill of a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import relative, section_of, token_count

# Defaults and limits of a request.
DEFAULT_BUDGET, BUDGET_RANGE, DEFAULT_FLOOR = 32_000, (1_000, 128_000), 0.3


def check(budget: int, floor: float) -> None:
    if not BUDGET_RANGE[0] <= budget <= BUDGET_RANGE[1]:
        raise ValueError(f"token budget must be from {BUDGET_RANGE[0]} to {BUDGET_RANGE[1]}")
    if not 0 <= floor <= 1:
        raise ValueError("floor must be from 0 to 1")


def over_floor(results: DataFrame, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """Results with their score relative to the query's best, at or over the floor."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return results.withColumn("relative", F.round(relative(F.col("score"), best), 9)).filter(F.col("relative") >= floor)


def merged(results: DataFrame, floor: float = DEFAULT_FLOOR, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """One candidate per note: its rows' texts in the order of section path, joined by a blank line."""
    rows = over_floor(results, floor)
    piece = F.struct(F.coalesce("section_path", F.lit("")).alias("s"), "chunk_index", "row_id", "text")
    notes = rows.groupBy("query_id", "path").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.max("relative").alias("score"),
        F.min("rank").alias("first"),
        F.min_by("title", "rank").alias("title"),
        F.min_by("type", "rank").alias("type"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n\n")
    notes = notes.withColumn("text", text).withColumn("sections", F.array_distinct(F.transform("pieces", lambda p: p["s"])))
    return notes.withColumn("tokens", count(F.col("text")).cast("long")).withColumn("section", section_of("type", "path")).drop("pieces")


def assemble(results: DataFrame, budget: int = DEFAULT_BUDGET, floor: float = DEFAULT_FLOOR, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """(query_id, section, position, path, title, sections, score, tokens, text, ordinal) of the notes in each query's pack.

    Notes are taken by score while they fit: one that does not is passed over and the next is tried. ``position`` counts
    inside a section, ``ordinal`` in the order taken. A query has at most the pool of a hybrid search as candidates, so one
    array holds them.
    """
    check(budget, floor)
    notes = merged(results, floor, count)
    entry = F.struct((-F.col("score")).alias("o"), "first", "path", "tokens")
    listed = notes.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("paths"))
    fold = F.aggregate(
        "all",
        start,
        lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["paths"], F.array(x["path"])).alias("paths"))).otherwise(s),
    )
    chosen = listed.select("query_id", F.posexplode(fold["paths"]).alias("ordinal", "path"))
    packed = chosen.join(notes, ["query_id", "path"])
    place = F.row_number().over(Window.partitionBy("query_id", "section").orderBy("ordinal"))
    return packed.select("query_id", "section", place.alias("position"), "path", "title", "sections", "score", "tokens", "text", "ordinal")


def meta(results: DataFrame, pack: DataFrame, floor: float = DEFAULT_FLOOR, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Per query: tokens used, notes included, results under the floor, and notes that did not fit the budget."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    under = results.withColumn("r", F.round(relative(F.col("score"), best), 9)).groupBy("query_id").agg(
        F.count_if(F.col("r") < floor).alias("chunks_excluded"), F.count_distinct(F.when(F.col("r") >= floor, F.col("path"))).alias("notes")
    )
    used = pack.groupBy("query_id").agg(F.sum("tokens").alias("tokens_used"), F.count("*").alias("chunks_included"))
    both = under.join(used, "query_id", "left").fillna(0, ["tokens_used", "chunks_included"])
    return both.select("query_id", F.lit(budget).cast("long").alias("token_budget"), "tokens_used", "chunks_included", "chunks_excluded", (F.col("notes") - F.col("chunks_included")).alias("budget_rejected"))


def nested(pack: DataFrame) -> DataFrame:
    """(query_id, sections): a map from each non-empty section to its entries in order."""
    entry = F.struct("position", "path", "title", "score", "tokens", "text")
    sections = pack.groupBy("query_id", "section").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return sections.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "entries"))).alias("sections"))
