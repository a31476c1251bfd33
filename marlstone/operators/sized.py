"""Small sides of joins, whose broadcast the planner decides by their stored size, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import materialize

#: Most bytes of the files of a table of which a copy may be sent to every executor.
BROADCAST_BYTES = 8 << 20


def sized(df: DataFrame, name: str = "sized") -> DataFrame:
    """``df``, written once, for use as a side of joins.

    The planner knows the bytes of the written files. It broadcasts the table if they are within
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond, where adaptive execution splits skewed keys; nothing
    is hinted, and no job is run to count rows.
    """
    return materialize(df, name)


def fits(stored: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast, by the bytes of its files."""
    return int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges; a component is named by its smallest node.

    Alternates large-star and small-star steps, so the rounds grow with the logarithm of the longest path and
    high-degree nodes become the centres of stars. Null ends and loops are left out; repeated edges count once; no
    edge gives no row. Every round is written to the shared folder, so nothing of the graph reaches the driver but
    two sums that tell whether it changed.
    """
    current = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna().filter("u <> v")
    current = materialize(current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v"), F.col("u")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = materialize(small.filter("u <> v").distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components have not settled")
    root = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    centres = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return root.union(centres)
