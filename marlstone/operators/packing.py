"""Order-dependent folds over the parts of one document, as higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import MAX_TOKENS, MIN_TOKENS, token_count


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: higher-order functions are interpreted, so an expression used twice in
    them would be computed twice, and one used inside of a lambda for every element."""
    return F.transform(F.array(value), body)[0]


def pack(parts: Column, count: Callable[[Column], Column] = token_count, most: Column | int = MAX_TOKENS, head: Column | int = 0, glue: str = "\n") -> Column:
    """array<string>: parts packed in order into texts of at most ``most`` tokens, ``head`` of them taken by a header.

    A text is closed before the part that would overflow it; a part that is too large by itself is kept whole. An
    empty array gives an empty array.
    """
    most = F.lit(most) if isinstance(most, int) else most
    head = (F.lit(head) if isinstance(head, int) else head).cast("long")
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, size: Column) -> Column:
        opens = (s["at"] < 0) | (s["used"] + size > most)
        # only the places of the cuts are carried, so the state stays small however long the texts are
        cuts = F.when(opens, F.concat(s["cuts"], F.array(s["at"] + 1))).otherwise(s["cuts"])
        return F.struct(cuts.alias("cuts"), (s["at"] + 1).alias("at"), F.when(opens, head + size).otherwise(s["used"] + size).alias("used"))

    def joined(ps: Column, cuts: Column) -> Column:
        ends = F.concat(F.slice(cuts, 2, F.greatest(F.size(cuts) - 1, F.lit(0))), F.array(F.size(ps)))
        spans = F.when(F.size(cuts) > 0, F.zip_with(cuts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.transform(spans, lambda s: F.array_join(F.slice(ps, s["a"] + 1, s["b"] - s["a"]), glue))

    if hasattr(count, "each"):  # a counter in Python takes the array at once, as it cannot stand in a function of its elements
        cuts = F.aggregate(F.transform(count.each(parts), lambda n: n.cast("long")), start, step, lambda s: s["cuts"])
        return F.when(parts.isNotNull(), let(cuts, lambda c: joined(parts, c)))

    def packed(ps: Column) -> Column:
        cuts = F.aggregate(F.transform(ps, lambda p: count(p).cast("long")), start, step, lambda s: s["cuts"])
        return let(cuts, lambda c: joined(ps, c))

    return let(parts, packed)


def pack_lines(text: str | Column, most: int = MAX_TOKENS, head: Column | int = 0, count: Callable[[Column], Column] = token_count) -> Column:
    """Lines packed into texts of at most ``most`` tokens."""
    return pack(F.split(F.col(text) if isinstance(text, str) else text, "\n"), count, most, head, "\n")


def pack_paragraphs(text: str | Column, most: int = MAX_TOKENS, count: Callable[[Column], Column] = token_count) -> Column:
    """Paragraphs (parted by blank lines; blank ones dropped) packed into texts of at most ``most`` tokens."""
    parts = F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"\n[ \t\r]*\n[\s]*"), lambda p: F.length(F.trim(p)) > 0)
    return pack(parts, count, most, 0, "\n\n")


def merge_short(sections: DataFrame, document: list[str], order: str, tokens: str, path: str, text: str, least: int = MIN_TOKENS) -> DataFrame:
    """Sections of a document with short ones joined to the open group: a section of ``least`` tokens or more opens a new
    group, a shorter one joins the one before. A group keeps its first section's path; texts are joined by blank lines."""
    doc = Window.partitionBy(*document).orderBy(order)
    grouped = sections.withColumn("__group", F.sum((F.col(tokens) >= least).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = grouped.groupBy(*document, "__group").agg(
        F.min(order).alias("__first"),
        F.min_by(path, order).alias(path),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias(text),
        F.sum(tokens).alias(tokens),
    )
    index = F.row_number().over(Window.partitionBy(*document).orderBy("__first")) - 1
    return grouped.select(*document, index.alias("chunk_index"), path, text, tokens)


def merge_runs(parts: DataFrame, document: list[str], order: str, text: str, least: int, tokens: Column | None = None) -> DataFrame:
    """(document, chunk_index, text): runs of neighbouring parts of fewer than ``least`` tokens joined by a line break; a
    longer part stands alone."""
    doc = Window.partitionBy(*document).orderBy(order)
    long = (tokens if tokens is not None else token_count(text)) >= least
    marked = parts.withColumn("__long", long)
    opens = F.col("__long") | F.coalesce(F.lag("__long").over(doc), F.lit(True))
    marked = marked.withColumn("__opens", opens.cast("int")).withColumn("__group", F.sum("__opens").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    joined = marked.groupBy(*document, "__group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias(text))
    return joined.select(*document, (F.col("__group") - 1).cast("int").alias("chunk_index"), text)
