"""Positions inside groups, also where one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.sized import sized
from marlstone.session import materialize

#: Rows of a group above which it is cut into ranges that are numbered separately, and rows of a range, about.
GROUP_ROWS, RANGE_ROWS = 200_000, 100_000


def running_position(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None, weight: str | None = None, out: str = "position") -> DataFrame:
    """``df`` with the number of rows (or the sum of ``weight``) of the group up to and including this row.

    Order is by ``order`` ascending, nulls first, then ``ties``. Groups are counted first, so ``df`` should be cheap to read
    twice. A group of up to ``GROUP_ROWS`` rows is one window. Larger ones are written once, parted into ranges of keys, order
    and ties; a window numbers each range, and the ranges' sums are added in front, so no task sorts a whole hot group, nor all
    rows of a hot value that ties tell apart. An empty table gives an empty table.
    """
    ties = ties or []
    add = F.sum(weight) if weight else F.count("*")
    large = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > GROUP_ROWS)
    names = [f"__k{i}" for i in range(len(keys))]
    large = sized(large.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "__n"), "large")
    frame = lambda *more: Window.partitionBy(*keys, *more).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = large.agg(F.sum("__n")).first()[0]
    columns = [c for c in df.columns if c != out]
    if not rows:
        return df.withColumn(out, add.over(frame())).select(*columns, out)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    plain = df.join(large, same, "left_anti").withColumn(out, add.over(frame())).select(*columns, out)
    ranges = 2 + rows // RANGE_ROWS
    hot = df.join(large, same, "left_semi").repartitionByRange(ranges, *keys, order, *ties)
    hot = materialize(hot.withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = hot.groupBy(*keys, "__range").agg(add.alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__range").alias("__r"), "__before")
    numbered = hot.withColumn(out, add.over(frame("__range"))).join(sums, [*same, F.col("__range") == F.col("__r")])
    return plain.unionByName(numbered.select(*columns, (F.col(out) + F.col("__before")).alias(out)))
