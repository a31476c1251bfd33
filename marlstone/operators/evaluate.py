"""Retrieval quality: recall at k per query, by category and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Depth and gate.
DEPTH, GATE = 10, 0.7


def recall_at_k(retrieved: Column, relevant: Column, k: int = DEPTH, distinct: bool = True) -> Column:
    """Share of the relevant items among the first k retrieved; 0 if none is relevant. Without ``distinct`` every repeated
    hit counts, so the figure may pass 1."""
    top = F.slice(retrieved, 1, k)
    hits = F.size(F.array_intersect(top, relevant)) if distinct else F.size(F.filter(top, lambda x: F.array_contains(relevant, x)))
    return F.when(F.size(relevant) > 0, hits / F.size(relevant)).otherwise(0.0)


def ranked_lists(results: DataFrame, key: str = "path") -> DataFrame:
    """(query_id, retrieved) in order of rank."""
    return results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("retrieved"))


def report(recalls: DataFrame, modes: list[str]) -> DataFrame:
    """(category, queries, one mean per mode, passed) by category, and overall where category is null. A row passes if
    every mode reaches the gate."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in modes]
    rows = recalls.rollup("category").agg(F.count("*").alias("queries"), *means)
    passed = F.lit(True)
    for m in modes:
        passed = passed & (F.col(m) >= GATE)
    return rows.withColumn("passed", passed)
